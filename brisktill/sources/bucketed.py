"""Bills and items stored in buckets of the bill's id, so that they meet without a shuffle.

Both tables are cut into the same number of buckets, one file each, by Spark's
own hash of the id. A scan then counts as partitioned by the id, and joins and
groupings by bill need no exchange. A bucket is read by one task, and a bucketed
scan cannot be split when a key is hot: items of bills with more than
`hot_rows` lines are stored apart and take the ordinary, shuffled way.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reads
from ..operators.ordered import TASK_ROWS, split_hot
from .staging import staged

# Items of a bucket, which one task sorts.
BUCKET_ROWS = 1 << 22


class Store(NamedTuple):
    bills: DataFrame
    items: DataFrame  # of ordinary bills
    hot_items: DataFrame | None  # of bills with very many lines, None without such bills
    hot_rows: int


def bucket_count(items, bucket_rows=BUCKET_ROWS):
    """Buckets of about `bucket_rows` items each."""
    return max(1, -(-items.count() // bucket_rows))


def write(spark, bills, items, path, name, buckets, hot_rows=TASK_ROWS):
    """Store bills and items under `path` in `buckets` buckets and open them.

    `bucket_count` tells how many buckets suit some items. The tables are `<name>_bills` and `<name>_items` in the session's catalog; the files
    outlive the session, and another one finds them by `open_store`.
    """
    cold, hot = split_hot(items, ["bill_id"], hot_rows)
    folder = _folder(path, buckets)
    for kind, rows, key in (("bills", bills, "id"), ("items", cold, "bill_id")):
        # One task per bucket, so each bucket is one sorted file.
        placed = rows.withColumn(key, F.col(key).cast("long")).repartition(buckets, key)
        writer = placed.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", f"{folder}/{kind}")
        writer.saveAsTable(f"{name}_{kind}")
    (items.limit(0) if hot is None else hot).write.mode("overwrite").parquet(f"{folder}/hot_items")
    return _store(spark, folder, name, hot_rows)


def open_store(spark, path, name, buckets, hot_rows=TASK_ROWS):
    """The store written under `path` with so many buckets, registered anew in this session's catalog as `name`."""
    folder = _folder(path, buckets)
    for kind, key in (("bills", "id"), ("items", "bill_id")):
        # The number of buckets is part of the path: a wrong one finds no files.
        files = f"{folder}/{kind}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(files).schema)
        spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")
        spark.sql(
            f"CREATE TABLE {name}_{kind} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{files}'"
        )
    return _store(spark, folder, name, hot_rows)


def _folder(path, buckets):
    return f"{path}/buckets-{int(buckets)}"


def _store(spark, folder, name, hot_rows):
    hot = spark.read.parquet(f"{folder}/hot_items")
    return Store(spark.table(f"{name}_bills"), spark.table(f"{name}_items"), None if hot.isEmpty() else hot, hot_rows)


def _parted(store):
    """(bills without hot items, bills with them or None)."""
    if store.hot_items is None:
        return store.bills, None
    ids = staged(store.hot_items.select(F.col("bill_id").alias("id")).distinct())
    # Few bills are hot; stored apart, their number is known before they meet their items.
    return store.bills.join(ids, "id", "left_anti"), staged(store.bills.join(ids, "id", "left_semi"))


def bill_lines(store, users):
    """`reads.bill_lines` of the stored bills and items."""
    bills, hot = _parted(store)
    lines = reads.bill_lines(bills, users, store.items)
    return lines if hot is None else lines.unionByName(reads.bill_lines(hot, users, store.hot_items))


def bill_documents(store, users, order=("id",), part_size=reads.PART_SIZE):
    """`reads.bill_documents` of the stored bills and items."""
    bills, hot = _parted(store)
    documents = reads.bill_documents(bills, users, store.items, order=order, part_size=part_size)
    if hot is None:
        return documents
    return documents.unionByName(reads.bill_documents(hot, users, store.hot_items, order=order, part_size=part_size))


def items_of_bills(store, wanted):
    """Items of the stored bills that meet the condition `wanted`."""
    bills = store.bills.filter(wanted).select(F.col("id").alias("bill_id"))
    items = store.items.join(bills, "bill_id", "left_semi")
    if store.hot_items is None:
        return items
    ids = store.hot_items.select("bill_id").distinct()
    wanted_hot = staged(bills.join(staged(ids), "bill_id", "left_semi"))
    return items.unionByName(store.hot_items.join(wanted_hot, "bill_id", "left_semi"))
