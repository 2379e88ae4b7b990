import compare
import pytest
from pyspark.sql import functions as F

from brisktill.operators import joins, reads
from brisktill.registry.queries import QUERIES
from brisktill.sources import bucketed, samples
from brisktill.sources.staging import scratch


@pytest.fixture(scope="module")
def tables(spark, folder):
    return samples.bills(spark, folder), samples.users(spark, folder), samples.bill_items(spark, folder)


@pytest.fixture(scope="module")
def store(spark, tables):
    bills, _, items = tables
    return bucketed.write(spark, bills, items, scratch(spark), "plain_store", 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(ours, theirs):
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert compare.difference(compare.spark_result(ours), compare.spark_result(theirs.select(*ours.columns))) is None


def flat(documents):
    return documents.select("id", "cashier_name", "part", "parts", F.to_json("items").alias("items"))


@pytest.fixture
def merging(spark):
    """No side is small enough to be broadcast, so bills and items meet as large tables do."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, -1)
    yield
    spark.conf.unset(name)


def test_bills_and_items_meet_without_an_exchange(spark, store, merging):
    meet = store.bills.join(store.items, store.bills["id"] == store.items["bill_id"])
    assert "SortMergeJoin" in plan(meet) and "Exchange" not in plan(meet)
    nested = reads.nest(store.items, "bill_id", list(samples.LINE_ORDER), "items").withColumnRenamed("bill_id", "id")
    joined = store.bills.join(nested, "id", "left")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    found = plan(bucketed.items_of_bills(store, F.col("payment_status") == "paid"))
    assert "SortMergeJoin" in found and "Exchange" not in found


def test_only_the_cashiers_are_moved(store, tables):
    for found in (bucketed.bill_lines(store, tables[1]), bucketed.bill_documents(store, tables[1], samples.LINE_ORDER)):
        text = plan(found)
        assert "Exchange hashpartitioning" not in text and "supplier.parquet" in text


@pytest.mark.parametrize("hot_rows", [1 << 20, 5])
def test_rows_are_those_of_the_plain_tables(spark, tables, hot_rows):
    bills, users, items = tables
    name = f"store_{hot_rows}"
    store = bucketed.write(spark, bills, items, scratch(spark), name, 8, hot_rows)
    assert (store.hot_items is None) == (hot_rows > 5)
    same(bucketed.bill_lines(store, users), reads.bill_lines(bills, users, items))
    for part_size in (reads.PART_SIZE, 3):
        ours = bucketed.bill_documents(store, users, samples.LINE_ORDER, part_size)
        same(flat(ours), flat(reads.bill_documents(bills, users, items, order=samples.LINE_ORDER, part_size=part_size)))
    paid = F.col("payment_status") == "paid"
    same(bucketed.items_of_bills(store, paid), joins.items_of_bills(items, bills.filter(paid)))


def test_another_session_opens_the_files_and_a_wrong_count_finds_none(spark, tables):
    bills, users, items = tables
    path = scratch(spark)
    bucketed.write(spark, bills, items, path, "first_name", 4, 5)
    other = spark.newSession()
    store = bucketed.open_store(other, path, "second_name", 4, 5)
    users = samples.users(other, "/root/testdata/sf0.001")
    assert bucketed.bill_lines(store, users).count() == reads.bill_lines(bills, tables[1], items).count()
    assert plan(store.items.groupBy("bill_id").count()).count("Exchange") == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bucketed.open_store(other, path, "third_name", 8)


def test_empty_tables(spark, tables):
    bills, users, items = tables
    store = bucketed.write(spark, bills.limit(0), items.limit(0), scratch(spark), "empty_store", 4)
    assert bucketed.bill_lines(store, users).count() == 0 == bucketed.bill_documents(store, users, samples.LINE_ORDER).count()


def test_queries_keep_their_stores_apart(spark, folder):
    one, two = (QUERIES["bill_lines_bucketed"](spark, folder) for _ in range(2))
    assert one.count() == two.count()
