"""Bills and their items stored by month of the bill, so that a change rewrites only the months it touches."""

from pyspark.sql import functions as F

from ..operators.diff import apply_changes, change_set
from .staging import staged
from .tables import _hadoop

MONTH = "bill_month"


def _month(created):
    return F.coalesce(F.date_format(created, "yyyy-MM"), F.lit("none"))


def write_bills(bills, path, files_per_month=1):
    """Store bills by the month of `created_at`; bills without one have a folder of their own."""
    _write(bills.withColumn(MONTH, _month(F.col("created_at"))), path, files_per_month, "id")


def write_items(items, bills, path, files_per_month=1):
    """Store items by the month of their bill; items without a bill are left out."""
    months = bills.select(F.col("id").alias("bill_id"), _month(F.col("created_at")).alias(MONTH))
    _write(items.join(months, "bill_id"), path, files_per_month, "bill_id")


def _write(rows, path, files_per_month, key):
    # A busy month is spread over several tasks by id.
    spread = rows.repartition(MONTH, F.pmod(F.xxhash64(key), F.lit(files_per_month)))
    spread.write.partitionBy(MONTH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read(spark, path):
    """The stored rows, without the month."""
    return _stored(spark, path).drop(MONTH)


def _stored(spark, path):
    found = spark.read.parquet(path)
    return found.withColumn(MONTH, F.col(MONTH).cast("string"))


def _rewrite(spark, path, months, rows, files_per_month, key):
    """Put `rows` in place of the given months. They are stored apart first, so a month is whole or as it was."""
    rows = staged(rows)
    left = {r[0] for r in rows.select(MONTH).distinct().collect()}
    _write(rows, path, files_per_month, key)
    for month in months - left:
        folder, files = _hadoop(spark, f"{path}/{MONTH}={month}")
        files.delete(folder, True)


def _months(rows):
    """The months of some rows: at most twelve for each year there are bills of."""
    return {r[0] for r in rows.select(MONTH).distinct().collect()}


def update_bills(spark, path, change, ids, files_per_month=1):
    """Apply `change` (a function of the bills) to the months that hold one of `ids` (a frame with `id`); returns the change set.

    The touched months are found from the ids and months alone; `change` sees
    the bills of these months and may edit or drop those named by `ids`, also move
    one to another month.
    """
    stored = _stored(spark, path)
    months = _months(stored.select("id", MONTH).join(ids.select("id").distinct(), "id", "left_semi"))
    touched = stored.filter(F.col(MONTH).isin(*months)).drop(MONTH) if months else stored.limit(0).drop(MONTH)
    changes = staged(change_set(touched, change(touched)))
    arriving = _months(changes.filter("operation <> 'delete'").select(_month(F.col("new.created_at")).alias(MONTH)))
    months |= arriving
    if months:
        before = stored.filter(F.col(MONTH).isin(*months)).drop(MONTH)
        after = apply_changes(before, changes).withColumn(MONTH, _month(F.col("created_at")))
        _rewrite(spark, path, months, after, files_per_month, "id")
    return changes


def delete_bills(spark, bills_path, items_path, ids, files_per_month=1):
    """Delete bills by id with their items, rewriting their months only; returns the deleted items.

    Items go first: a run that broke off in between can be run again.
    """
    stored, items = _stored(spark, bills_path), _stored(spark, items_path)
    doomed = staged(stored.select("id", MONTH).join(ids.select("id").distinct(), "id", "left_semi"))
    months = _months(doomed)
    if not months:
        return items.limit(0).drop(MONTH)
    own = items.filter(F.col(MONTH).isin(*months))
    keyed = doomed.select(F.col("id").alias("bill_id"))
    gone = staged(own.join(keyed, "bill_id", "left_semi").drop(MONTH))
    _rewrite(spark, items_path, months, own.join(keyed, "bill_id", "left_anti"), files_per_month, "bill_id")
    kept = stored.filter(F.col(MONTH).isin(*months)).join(doomed.select("id"), "id", "left_anti")
    _rewrite(spark, bills_path, months, kept, files_per_month, "id")
    return gone
