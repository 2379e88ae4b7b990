"""Text helpers: cleaning, matching, formatting."""

from pyspark.sql import functions as F

# Case- and accent-insensitive comparison, used for searches and unique names.
LOOSE = "UNICODE_CI_AI"

# A tag runs from `<` to the next `>` or the end; `<` before white space is text.
_TAG = r"<(?:>|$|[^\s>][^>]*(?:>|$))"
_PRINTABLE = "^[ -~]*$"
_EMAIL = r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"

# Characters trimmed from text, and the entities for markup characters.
_TRIMMED = " \t\n\r\0\x0b"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def trimmed(text):
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIMMED))


def sanitized(text):
    """Trim, drop tags, escape markup. Tables keep raw text; use this on the way out to HTML.

    Tags are found by pattern: a `>` inside a quoted attribute ends the tag.
    """
    clean = F.regexp_replace(trimmed(text), _TAG, "")
    for char, entity in _ENTITIES:
        clean = F.replace(clean, F.lit(char), F.lit(entity))
    return clean


def loose(text):
    """The text compared and sorted without regard to case or accents."""
    return F.collate(text, LOOSE)


def has_term(text, term):
    """Substring search without regard to case or accents; wildcards are plain characters.

    Between printable ASCII texts that is a search in lower case, which is many
    times cheaper; only other texts take the collated search.
    """
    collated = F.contains(loose(text), loose(F.lit(term)))
    if not (term.isascii() and term.isprintable()):
        return collated
    return F.when(text.rlike(_PRINTABLE), F.contains(F.lower(text), F.lit(term.lower()))).otherwise(collated)


def is_email(text):
    return F.coalesce(text.rlike(_EMAIL) & ~text.contains("..") & ~text.startswith("."), F.lit(False))


def bill_number(prefix, day, number):
    """PREFIX-YYYYMMDD-NNNN; longer numbers are kept whole."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.format_string("%04d", number))


def money_text(symbol, amount):
    """Currency symbol and amount with two decimals."""
    symbol = F.lit(symbol) if isinstance(symbol, str) else symbol
    return F.concat_ws(" ", symbol, amount.cast("decimal(20,2)").cast("string"))


def first_word(name, fallback="User"):
    return F.coalesce(F.split(F.nullif(name, F.lit("")), " ")[0], F.lit(fallback))


def or_dash(text):
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


def fixed_width(text, keep, width):
    """The first `keep` characters padded with blanks to `width`, which is at least `keep`."""
    return F.rpad(F.substring(text, 1, keep), width, " ")
