"""Substring search for many terms at once, by an inverted index of letter groups.

The index holds every group of one, two and three consecutive characters of a
text, without case and accents. A term meets the index by its rarest group and is
then compared with the texts found, under the same rule as `functions.text.has_term`.
"""

import unicodedata

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import loose
from ..sources.staging import staged

GRAM = 3
# Terms that texts beyond the index are scanned for in one batch.
SCANNED_TERMS = 10_000
# The entries of a group are dealt to so many parts where terms meet them: a group may be in all texts.
PARTS = 64
_PLAIN = "^[ -~]*$"


def _accents():
    """(accented small letters, their base letters, combining marks): what decomposes into an ASCII letter and marks."""
    accented, base = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first, *marks = unicodedata.normalize("NFD", chr(code).lower())
        if marks and "a" <= first <= "z" and all(unicodedata.category(m) == "Mn" for m in marks) and chr(code) == chr(code).lower():
            accented.append(chr(code))
            base.append(first)
    return "".join(accented), "".join(base), "".join(map(chr, range(0x300, 0x370)))


_ACCENTED, _BASE, _MARKS = _accents()


def folded(text):
    """The text in lower case without accents, as far as it is Latin; other characters stay."""
    return F.translate(F.lower(text), _ACCENTED + _MARKS, _BASE)


def is_indexed(text):
    """Whether the text folds to printable ASCII; only such texts and terms meet by groups."""
    return folded(text).rlike(_PLAIN)


def holds(text, term):
    """Whether the text has the term, both columns: without regard to case or accents, wildcards plain characters."""
    plain = text.rlike(_PLAIN) & term.rlike(_PLAIN)
    return F.when(plain, F.contains(F.lower(text), F.lower(term))).otherwise(F.contains(loose(text), loose(term)))


def _groups(text, size):
    """Distinct groups of `size` consecutive characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    whole = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def gram_index(table, columns, key="id"):
    """The index rows (gram, field, key) of the given text columns; store it sorted by gram.

    Rows added or changed later join it as `gram_index` of those rows: an entry
    that is out of date costs a comparison and finds nothing.
    """
    # Few files with many texts would else be taken apart by as few tasks.
    table = table.select(key, *columns).repartition(key, *columns)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns]))
    texts = table.select(key, fields.alias("entry")).select(key, "entry.*").filter(F.col("text").isNotNull())
    texts = texts.filter(is_indexed(F.col("text"))).withColumn("text", folded(F.col("text")))
    grams = F.flatten(F.array(*[_groups(F.col("text"), size) for size in range(1, GRAM + 1)]))
    return texts.select(F.explode(grams).alias("gram"), "field", key)


def _rarest(terms, index):
    """Per term the group that fewest texts have; a term with a group that no text has is left out.

    Entries are counted before they meet the terms, so the index is not shuffled.
    """
    folds = terms.select("term", folded(F.col("term")).alias("_fold")).distinct()
    size = F.least(F.length("_fold"), F.lit(GRAM))
    groups = F.transform(F.sequence(F.lit(1), F.length("_fold") - size + 1), lambda i: F.substring(F.col("_fold"), i, size))
    asked = folds.select("term", F.explode(F.array_distinct(groups)).alias("gram"))
    known = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = asked.join(known, "gram", "left")
    first = Window.partitionBy("term").orderBy(F.col("_n").asc_nulls_first(), "gram")
    return counted.withColumn("_r", F.row_number().over(first)).filter((F.col("_r") == 1) & F.col("_n").isNotNull()).select("term", "gram")


def matches(terms, index, table, columns, key="id"):
    """Rows (term, key) of all texts of `columns` that hold a term of the frame `terms` (column `term`).

    Equal to a scan with `has_term` per term. Latin terms meet Latin texts through the index, whatever
    their length. Texts in other letters are scanned for all
    terms of a block, and terms in other letters are looked for in all texts;
    a batch of more than `SCANNED_TERMS` different terms has to be cut where there are such. A null
    term finds nothing, an empty one every text that is not null.
    """
    terms = terms.select("term").filter(F.col("term").isNotNull()).distinct()
    latin = terms.filter(is_indexed(F.col("term")) & (F.length(folded(F.col("term"))) > 0))
    # Stored, so that Spark knows how few they are and leaves the index where it lies; dealt, so that no group meets many terms in one task.
    rarest = staged(_rarest(latin, index)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = index.withColumn("_part", F.pmod(F.xxhash64(key, "field"), F.lit(PARTS)).cast("int"))
    found = rarest.join(dealt, ["gram", "_part"]).select("term", "field", key)
    texts = table.select(key, *columns)
    value = F.coalesce(*[F.when(F.col("field") == c, F.col(c)) for c in columns])
    by_index = found.join(texts, key).filter(holds(value, F.col("term"))).select("term", key)

    def scanned(rows, asked):
        block = asked.agg(F.when(F.count(F.lit(1)) <= SCANNED_TERMS, F.collect_list("term")).otherwise(
            F.raise_error(F.lit(f"more than {SCANNED_TERMS} terms to scan for")).cast("array<string>")
        )).scalar()
        each = rows.select(key, F.explode(F.array(*columns)).alias("_text")).filter(F.col("_text").isNotNull())
        hit = F.filter("_terms", lambda term: holds(F.col("_text"), term))
        return each.withColumn("_terms", block).select(F.explode(hit).alias("term"), key)

    odd = terms.join(latin, "term", "left_anti")
    beyond = [F.coalesce(~is_indexed(F.col(c)), F.lit(False)) for c in columns]
    some = beyond[0]
    for more in beyond[1:]:
        some = some | more
    return by_index.unionByName(scanned(texts.filter(some), latin)).unionByName(scanned(texts, odd)).distinct()


def best_matches(found, table, order, limit, key="id"):
    """Per term its matches with the columns of `table`, `rank` 1 to `limit` in `order`; cut before the shuffle."""
    ranked = found.join(table, key).withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)
