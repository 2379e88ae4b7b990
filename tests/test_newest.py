"""Kept lists of newest bills against the search in all bills."""

import datetime
import decimal
import random

import pytest

from brisktill.operators import diff, reads
from brisktill.plans import newest

BILLS = "id long, customer_id long, bill_number string, created_at timestamp_ntz, total_amount decimal(10,2), note string"


def bill(rng, key, customers=(None, 1, 2, 3, 4)):
    day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(12))
    return key, rng.choice(customers), f"B{key}", rng.choice([None, day, day, day]), decimal.Decimal(rng.randrange(10**6)) / 100, rng.choice("xy")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def searched(bills, limit=10):
    columns = ("customer_id", *reads.ORDER_COLUMNS, "rank")
    return rows(reads.recent_per_customer(bills, limit).select(*columns))


def listed(kept):
    return rows(newest.recent_orders(kept))


def counted(kept):
    return {r["customer_id"]: r["bills"] for r in kept.collect()}


def after(spark, old, new, limit):
    old, new = spark.createDataFrame(old, BILLS), spark.createDataFrame(new, BILLS)
    kept = newest.advanced(newest.state(old, limit), diff.change_set(old, new), new, limit)
    assert counted(kept) == counted(newest.state(new, limit))
    assert listed(kept) == searched(new, limit)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_posts_edits_and_deletes(spark, seed):
    """Bills move between customers and days, many with equal days or none, and lists of three run short."""
    rng = random.Random(seed)
    old = [bill(rng, i) for i in range(60)]
    new = [r if rng.random() < 0.6 else bill(rng, r[0]) for r in old if rng.random() < 0.6] + [bill(rng, i) for i in range(100, 110)]
    after(spark, old, new, 3)


def test_several_batches_in_a_row(spark):
    rng = random.Random(9)
    now = [bill(rng, i, (1, 2)) for i in range(30)]
    kept = newest.state(spark.createDataFrame(now, BILLS), 4)
    for step in range(3):
        later = [r for r in now if rng.random() < 0.7] + [bill(rng, 1000 * (step + 1) + i, (1, 2, 3)) for i in range(3)]
        one, two = spark.createDataFrame(now, BILLS), spark.createDataFrame(later, BILLS)
        kept, now = newest.advanced(kept, diff.change_set(one, two), two, 4), later
        assert listed(kept) == searched(two, 4)


def test_a_bill_left_out_comes_back(spark):
    """The newest of four bills goes: the list of three is filled from the bills."""
    day = lambda d: datetime.datetime(2024, 1, d)
    old = [(i, 1, f"B{i}", day(i), decimal.Decimal(i), "x") for i in range(1, 5)]
    kept = after(spark, old, old[:3], 3)
    assert [r[1] for r in listed(kept)] == [1, 2, 3]


def test_an_edited_bill_that_was_left_out_does_not_jump_in(spark):
    """Bill 1 is older than all listed ones; its amount changes while a listed one goes, so bill 2 is next, not bill 1."""
    day = lambda d: datetime.datetime(2024, 1, d)
    old = [(i, 1, f"B{i}", day(i), decimal.Decimal(i), "x") for i in range(1, 7)]
    new = [(1, 1, "B1", day(1), decimal.Decimal(99), "x"), *old[1:5]]
    kept = after(spark, old, new, 3)
    assert sorted(r[1] for r in listed(kept)) == [3, 4, 5]


def test_bills_are_read_only_to_refill(spark, tmp_path):
    rng = random.Random(2)
    old = [bill(rng, i) for i in range(40)]
    more = old + [bill(rng, i) for i in range(50, 55)]
    one, two = spark.createDataFrame(old, BILLS), spark.createDataFrame(more, BILLS)
    two.write.parquet(str(tmp_path / "all_bills"))
    stored = spark.read.parquet(str(tmp_path / "all_bills"))
    kept = newest.advanced(newest.state(one), diff.change_set(one, two), stored)
    assert not any("all_bills" in f for f in kept.inputFiles())
    assert listed(kept) == searched(two)


def test_states_merge(spark):
    rng = random.Random(5)
    every = [bill(rng, i) for i in range(80)]
    one, two = spark.createDataFrame(every[:30], BILLS), spark.createDataFrame(every[30:], BILLS)
    both = newest.merged(newest.state(one), newest.state(two))
    assert counted(both) == counted(newest.state(one.unionByName(two)))
    assert listed(both) == searched(one.unionByName(two))


def test_nothing_changes_and_everything_goes(spark):
    rng = random.Random(6)
    old = [bill(rng, i) for i in range(30)]
    after(spark, old, old, 10)
    one = spark.createDataFrame(old, BILLS)
    kept = newest.advanced(newest.state(one), diff.change_set(one, one.limit(0)), one.limit(0))
    assert kept.count() == 0
    begun = newest.advanced(newest.state(one.limit(0)), diff.change_set(one.limit(0), one), one)
    assert listed(begun) == searched(one)
