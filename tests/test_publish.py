import datetime

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brisktill.schemas import BILL_DOCUMENT, BILL_ITEMS, BILLS, CUSTOMERS
from brisktill.sources.seed import empty_table, seed_tables
from brisktill.sources.tables import append_rows, compact, publish, published_version, read_jdbc, read_published, read_table, write_json
from brisktill.streaming.bills import daily_sales, post_documents


def test_versions_are_complete_and_append_only_where_asked(spark, tmp_path):
    root = str(tmp_path)
    assert published_version(spark, root) is None
    one = spark.createDataFrame([(1,)], "id long")
    two = spark.createDataFrame([(2,)], "id long")
    assert publish(spark, root, {"a": one, "b": one}) == 1
    assert publish(spark, root, {"b": two}, {"a": two}) == 2
    tables = read_published(spark, root)
    assert sorted(r["id"] for r in tables["a"].collect()) == [1, 2]
    assert [r["id"] for r in tables["b"].collect()] == [2]
    assert [r["id"] for r in read_published(spark, root, 1)["a"].collect()] == [1]
    assert compact(spark, root, ["a"]) == 3
    assert sorted(r["id"] for r in read_published(spark, root)["a"].collect()) == [1, 2]
    assert [r["id"] for r in read_published(spark, root)["b"].collect()] == [2]


def test_an_announced_version_is_left_alone_and_a_failed_one_replaced(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1,)], "id long")
    publish(spark, root, {"a": one}, version=1)
    one.write.parquet(f"{root}/2/a")  # an attempt that never got to its entry
    assert published_version(spark, root) == 1
    assert publish(spark, root, {}, {"a": one}, version=2) == 2
    assert publish(spark, root, {}, {"a": one}, version=2) == 2
    assert read_published(spark, root)["a"].count() == 2


def test_append_and_json(spark, tmp_path):
    rows = seed_tables(spark)["settings"]
    append_rows(rows, str(tmp_path / "settings"))
    append_rows(rows, str(tmp_path / "settings"))
    assert read_table(spark, str(tmp_path / "settings"), "settings").count() == 16
    write_json(rows.select(F.struct("setting_key").alias("s")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select("s.setting_key").count() == 8


def test_stream_of_documents_posts_like_one_batch(spark, tmp_path):
    root, inbox = str(tmp_path / "store"), tmp_path / "inbox"
    inbox.mkdir()
    tables = seed_tables(spark, datetime.datetime(2024, 1, 1))
    customers = empty_table(spark, CUSTOMERS)
    publish(
        spark, root,
        {"products": tables["products"], "customers": customers, "bills": empty_table(spark, BILLS), "bill_items": empty_table(spark, BILL_ITEMS)},
    )
    line = '{"seq": %d, "created_by": 1, "created_at": "2024-02-0%dT10:00:00Z", "total_amount": 9, "items": [{"product_id": 10, "quantity": 5}]}\n'
    (inbox / "1.json").write_text(line % (1, 1))
    (inbox / "2.json").write_text(line % (2, 1))
    schema = StructType(list(BILL_DOCUMENT.fields)).add("seq", "long").add("created_by", "long").add("created_at", "timestamp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(inbox))
    query = post_documents(stream, root, str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    store = read_published(spark, root)
    assert published_version(spark, root) == 3
    assert sorted((r["id"], r["bill_number"]) for r in store["bills"].collect()) == [(1, "BILL-20240201-0001"), (2, "BILL-20240201-0002")]
    # Eight tablets: the second five do not fit.
    assert store["products"].filter("id = 10").first()["stock"] == 3
    assert store["outcomes"].filter("status = 'created'").count() == 2


def test_daily_sales_stream_equals_batch(spark, folder, tmp_path):
    from brisktill.sources import samples

    bills = samples.bills(spark, folder).select(F.col("created_at").cast("timestamp").alias("created_at"), "total_amount")
    bills.repartition(2).write.parquet(str(tmp_path / "bills"))
    stream = spark.readStream.schema(bills.schema).parquet(str(tmp_path / "bills"))
    query = daily_sales(stream).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = bills.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*"), F.sum("total_amount"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_jdbc_needs_a_driver(spark):
    with pytest.raises(Exception):
        read_jdbc(spark, "jdbc:none://nowhere/db", "products", (1, 100), 4)
