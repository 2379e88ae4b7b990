import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brisktill.functions import coerce, dates, text


def value(spark, column, *inputs):
    """Results of a column expression over `x`, one per input."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [row[0] for row in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_int_value(spark):
    inputs = ["12abc", " 7", "-5.9", "+3", "1e3", ".5", "abc", "", None, "9" * 30, "-" + "9" * 30]
    assert value(spark, coerce.int_value, *inputs) == [
        12, 7, -5, 3, 1000, 0, 0, 0, 0, 9223372036854775807, -9223372036854775808,
    ]


def test_int_value_keeps_long_digits(spark):
    assert value(spark, coerce.int_value, "9007199254740993x") == [9007199254740993]


def test_float_value(spark):
    assert value(spark, coerce.float_value, "1.5kg", "-.5", "2e1", "x1", None) == [1.5, -0.5, 20.0, 0.0, 0.0]


def test_given(spark):
    assert value(spark, coerce.given, "a", "0", "", None, "00") == [True, False, False, False, True]


def test_float_text(spark):
    assert value(spark, lambda x: coerce.float_text(coerce.float_value(x)), "10.00", "12.50", "0") == ["10", "12.5", "0"]


def test_sanitized(spark):
    inputs = ["  <b>Tom</b> & \"Jerry's\" ", "a < b", "a <b", "<>x", None, "\x00\ttab\x0b"]
    assert value(spark, text.sanitized, *inputs) == [
        "Tom &amp; &quot;Jerry&#039;s&quot;", "a &lt; b", "a ", "x", "", "tab",
    ]


def test_has_term_ignores_case_and_accents_and_takes_wildcards_literally(spark):
    rows = ["Café Noir", "CAFE", "100% wool", "woolen"]
    assert value(spark, lambda x: text.has_term(x, "cafe"), *rows) == [True, True, False, False]
    assert value(spark, lambda x: text.has_term(x, "%"), *rows) == [False, False, True, False]


def test_cheap_search_equals_the_collated_one(spark):
    random.seed(3)
    chars = [chr(c) for c in range(32, 127)] + list("éÉßñ\t")
    words = spark.createDataFrame([("".join(random.choices(chars, k=random.randint(0, 6))),) for _ in range(2000)], "x string")
    terms = [*(chr(c) for c in range(32, 127)), "aB", "%_", "e-", "' "]
    slow = [F.contains(text.loose(F.col("x")), text.loose(F.lit(term))) for term in terms]
    cheap = [text.has_term(F.col("x"), term) for term in terms]
    wrong = words.select(*[F.count_if(one != other).alias(f"c{i}") for i, (one, other) in enumerate(zip(slow, cheap))])
    assert set(wrong.first()) == {0}


def test_is_email(spark):
    inputs = ["a@b.co", "a.b+c@d-e.org", "a@b", "a b@c.de", "a@@b.co", "a..b@c.de", ".a@c.de", "", None]
    assert value(spark, text.is_email, *inputs) == [True, True] + [False] * 7


def test_bill_number_keeps_long_numbers(spark):
    day = F.lit(datetime.date(2024, 3, 9))
    assert value(spark, lambda x: text.bill_number("BILL", day, coerce.int_value(x)), "7", "12345") == [
        "BILL-20240309-0007", "BILL-20240309-12345",
    ]


def test_small_texts(spark):
    assert value(spark, text.first_word, "Ann Lee", "", None) == ["Ann", "User", "User"]
    assert value(spark, text.or_dash, "x", "", None) == ["x", "—", "—"]
    assert value(spark, lambda x: text.money_text("Rs.", x.cast("decimal(10,3)")), "1.005", "2") == ["Rs. 1.01", "Rs. 2.00"]
    assert value(spark, lambda x: text.fixed_width(x, 3, 5), "abcdef", "a") == ["abc  ", "a    "]
    assert value(spark, lambda x: coerce.or_default(x, "d"), "x", "", None) == ["x", "d", "d"]


def test_week_keys_across_new_year(spark):
    days = ["2024-12-29", "2024-12-30", "2021-01-03", "2021-01-04", "2019-12-31"]
    keys = value(spark, lambda x: dates.iso_yearweek(x.cast("timestamp")), *days)
    assert keys == [202452, 202501, 202053, 202101, 202001]
    labels = value(spark, lambda x: dates.week_label(x.cast("timestamp")), *days)
    assert labels == ["2024 Week 52", "2024 Week 01", "2021 Week 53", "2021 Week 01", "2019 Week 01"]


def test_day_range_needs_both_ends():
    assert dates.day_range(None, "2024-01-01", "") is None
    assert dates.day_range(None, None, "2024-01-01") is None


@pytest.mark.parametrize("day, last", [("2024-02-10", 29), ("2023-12-31", 31)])
def test_month_bounds(day, last):
    first, end = dates.month_bounds(day)
    assert (first.day, end.day) == (1, last)


def test_unknown_grouping_means_by_day():
    assert dates.period("fortnight") is dates.PERIODS["day"]


def test_to_money_rounds_half_up_and_rejects_what_does_not_fit(spark):
    assert value(spark, lambda x: coerce.to_money(x.cast("double")), "1.005", "0.125", "123456789012") == [
        Decimal("1.01"), Decimal("0.13"), None,
    ]
