"""Lenient conversions of request values, as native column expressions."""

from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
_WHOLE = r"^\s*([+-]?\d+)(?![\d.eE])"
_LONG_MAX = 9223372036854775807


def _prefix(value, pattern):
    return F.nullif(F.regexp_extract(F.col(value) if isinstance(value, str) else value, pattern, 1), F.lit(""))


def leading_number(value):
    """The leading number of a text, else null."""
    return _prefix(value, _NUMBER).try_cast("double")


def float_value(value):
    """The leading number of a text, else 0."""
    return F.coalesce(leading_number(value), F.lit(0.0))


def int_value(value):
    """The leading number of a text cut to a whole number, else 0; beyond long it saturates."""
    number = float_value(value)
    cut = (
        F.when(number >= F.lit(float(_LONG_MAX)), F.lit(_LONG_MAX))
        .when(number <= F.lit(-float(_LONG_MAX)), F.lit(-_LONG_MAX - 1))
        .otherwise(number.try_cast("long"))
    )
    return F.coalesce(_prefix(value, _WHOLE).try_cast("long"), cut, F.lit(0).cast("long"))


def zero_to_null(value):
    """0 stands for "no reference"."""
    return F.nullif(value, F.lit(0).cast("long"))


def given(text):
    """A text counts as given unless it is missing, empty or "0"."""
    return F.coalesce(~text.isin("", "0"), F.lit(False))


def or_default(text, default):
    """`default` where the text is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def in_range(value, low, high):
    return F.coalesce(value.between(F.lit(low), F.lit(high)), F.lit(False))


def one_of(value, allowed):
    return F.coalesce(value.isin(*allowed), F.lit(False))


def to_money(value, precision=10, scale=2):
    """Floating-point amount to decimal, rounded half up; null when it does not fit."""
    return value.try_cast(f"decimal({precision},{scale})")


def float_text(value):
    """A double as text without a trailing `.0`."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
