"""Differences between two versions of a table, as rows."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F


def change_set(old, new, key="id"):
    """One row per key that differs: key, operation, changed, old, new.

    operation is `insert`, `update` or `delete`; changed names the columns that
    differ, null equal to null; old and new are the whole rows without the key, null on the side that has none.
    The key is unique and never null in either version; columns are those of `new`.
    """
    columns = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(F.lit(True).alias("_"), *columns).alias("_old"))
    after = new.select(key, F.struct(F.lit(True).alias("_"), *columns).alias("_new"))
    added, gone = F.col("_old").isNull(), F.col("_new").isNull()
    differs = {c: ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in columns}
    joined = before.join(after, key, "full").filter(reduce(or_, differs.values(), added | gone))
    operation = F.when(added, "insert").when(gone, "delete").otherwise("update")
    changed = F.array_compact(F.array(*[F.when(added | gone | differ, F.lit(c)) for c, differ in differs.items()]))
    whole = lambda side: F.when(F.col(side).isNotNull(), F.col(side).dropFields("_") if columns else F.struct())
    return joined.select(key, operation.alias("operation"), changed.alias("changed"), whole("_old").alias("old"), whole("_new").alias("new"))


def apply_changes(table, changes, key="id"):
    """`table` after a change set: only the columns that differ are set."""
    edits = changes.filter("operation <> 'insert'").select(key, "operation", "changed", "new")
    joined = table.join(edits, key, "left").filter("operation is null or operation = 'update'")
    updated = F.coalesce(F.col("operation") == "update", F.lit(False))
    columns = [
        F.col(c) if c == key else F.when(updated & F.array_contains("changed", c), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        for c in table.columns
    ]
    inserted = changes.filter("operation = 'insert'").select(key, "new.*")
    return joined.select(*columns).unionByName(inserted)


def changed_values(changes, key="id"):
    """The values that differ as text, one row (key, operation, column, old_value, new_value) each."""
    columns = [f.name for f in changes.schema["new"].dataType]
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"old.{c}").cast("string").alias("old_value"), F.col(f"new.{c}").cast("string").alias("new_value"))
        for c in columns
    ]
    each = changes.select(key, "operation", "changed", F.explode(F.array(*pairs)).alias("pair"))
    return each.filter(F.array_contains("changed", F.col("pair.column"))).select(key, "operation", "pair.*")


def signed_rows(changes, columns):
    """The old rows with `sign` -1 and the new ones with +1, cut to `columns`; updates that touch none of them are left out."""
    touched = changes.filter((F.col("operation") != "update") | F.arrays_overlap("changed", F.array(*map(F.lit, columns))))
    side = lambda name, sign: touched.filter(F.col(name).isNotNull()).select(
        F.lit(sign).alias("sign"), *[F.col(f"{name}.{c}").alias(c) for c in columns]
    )
    return side("old", -1).unionByName(side("new", 1))
