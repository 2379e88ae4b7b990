import random

import pytest
from pyspark.sql import functions as F

from brisktill.operators import ordered
from brisktill.operators.numbering import assign_bill_numbers, assign_ids, assign_parent_and_child_ids
from brisktill.operators.ordered import bucket, previous_row, running_sums


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(7)
    # Key 1 holds a third of all rows.
    data = [(random.choice([1, *range(2, 40)] if i % 3 else [1]), i * 5 + 2, random.randint(0, 9)) for i in range(900)]
    return spark.createDataFrame(data, "k long, seq long, v long"), data


@pytest.mark.parametrize("task_rows, bits", [(1 << 20, 16), (30, 6), (0, 0), (5, 3)])
def test_running_sums_equal_brute_force(rows, task_rows, bits):
    df, data = rows
    result = running_sums(
        df, ["k"], ["seq"], {"total": F.col("v"), "place": F.lit(1).cast("long")}, [bucket("seq", bits)], task_rows=task_rows
    )
    totals, places, expected = {}, {}, {}
    for k, seq, v in data:
        totals[k], places[k] = totals.get(k, 0) + v, places.get(k, 0) + 1
        expected[seq] = (totals[k], places[k])
    assert {r["seq"]: (r["total"], r["place"]) for r in result.collect()} == expected


@pytest.mark.parametrize("task_rows, bits", [(1 << 20, 16), (30, 6), (0, 0)])
def test_previous_row_equals_brute_force(rows, task_rows, bits):
    df, data = rows
    result = previous_row(df, ["k"], ["seq"], ["v"], "before", [bucket("seq", bits)], task_rows=task_rows)
    last, expected = {}, {}
    for k, seq, v in data:
        expected[seq] = last.get(k)
        last[k] = v
    assert {r["seq"]: r["before"]["v"] if r["before"] else None for r in result.collect()} == expected


def test_carry_reaches_hot_and_ordinary_keys(rows, spark):
    df, _ = rows
    carry = spark.createDataFrame([(k, k * 100) for k in range(1, 20)], "k long, extra long")
    result = running_sums(df, ["k"], ["seq"], {"t": F.col("v")}, [bucket("seq", 4)], carry, task_rows=50)
    assert result.count() == 900
    assert all(r["extra"] == (r["k"] * 100 if r["k"] < 20 else None) for r in result.collect())


def test_ids_follow_the_highest_and_the_order(spark):
    table = spark.createDataFrame([(7,), (41,)], "id long")
    new = spark.createDataFrame([(900000, "c"), (5, "a"), (70000, "b")], "seq long, name string")
    assert sorted((r["id"], r["name"]) for r in assign_ids(new, table).collect()) == [(42, "a"), (43, "b"), (44, "c")]
    empty = table.filter("id < 0")
    assert sorted(r["id"] for r in assign_ids(new, empty).collect()) == [1, 2, 3]


def test_child_ids_are_reserved_side_by_side(spark):
    parents = spark.createDataFrame([(10,)], "id long")
    children = spark.createDataFrame([(100,)], "id long")
    rows = spark.createDataFrame([(1, 3), (2, 1), (9, 2)], "seq long, width long")
    placed = assign_parent_and_child_ids(rows, parents, children, F.col("width"))
    assert sorted((r["seq"], r["id"], r["first_id"]) for r in placed.collect()) == [(1, 11, 101), (2, 12, 104), (9, 13, 105)]


def test_bill_numbers_go_on_within_a_day(spark):
    bills = spark.createDataFrame(
        [("BILL-20240101-0009",), ("BILL-20240101-0003",), ("RET-20240101-0050",), ("BILL-x",)], "bill_number string"
    )
    drafts = spark.createDataFrame(
        [(1, "2024-01-01 08:00:00"), (2, "2024-01-02 08:00:00"), (3, "2024-01-01 09:00:00")], "seq long, created_at string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    numbered = assign_bill_numbers(drafts, bills)
    assert [r["bill_number"] for r in numbered.orderBy("seq").collect()] == [
        "BILL-20240101-0010", "BILL-20240102-0001", "BILL-20240101-0011",
    ]


@pytest.mark.parametrize("crowds", [1, 2, 1 << 14])
def test_hot_keys_are_found_among_crowded_hashes(spark, monkeypatch, crowds):
    monkeypatch.setattr(ordered, "CROWDS", crowds)
    df = spark.createDataFrame([(k, n) for k in [None, *range(1, 9)] for n in range(30 if k == 3 or k is None else 4)], "k long, n long")
    cold, hot = ordered.split_hot(df, ["k"], 10)
    assert {r["k"] for r in hot.collect()} == {3} and hot.count() == 30 and cold.count() == 58
    assert ordered.split_hot(df, ["k"], 1000)[1] is None
