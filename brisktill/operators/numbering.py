"""Row ids and bill numbers."""

from pyspark.sql import functions as F

from ..functions.text import bill_number
from .ordered import bucket, running_count, running_sums


def highest(table, column="id"):
    """The largest id of a table as a scalar, 0 when it is empty."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).cast("long")).scalar()


def assign_ids(rows, table, order="seq", column="id"):
    """Consecutive ids after the table's highest, in the order of a unique whole-number column."""
    placed = running_count(rows, [], [order], "_place", [bucket(order)])
    return placed.withColumn(column, highest(table, column) + F.col("_place")).drop("_place")


def assign_parent_and_child_ids(rows, parents, children, width, order="seq"):
    """Adds `id` after the highest parent and `first_id`, the first of `width` child ids reserved for the row."""
    values = {"_place": F.lit(1).cast("long"), "_upto": width}
    placed = running_sums(rows, [], [order], values, [bucket(order)])
    return (
        placed.withColumn("id", highest(parents) + F.col("_place"))
        .withColumn("first_id", highest(children) + F.col("_upto") - width + 1)
        .drop("_place", "_upto")
    )


def _used_numbers(bills, prefix):
    """Highest number per day (`_day` yyyymmdd, `_used`) among the bill numbers of a frame."""
    pattern = f"^{prefix}-([0-9]{{8}})-([0-9]+)$"
    numbered = bills.filter(F.col("bill_number").startswith(prefix + "-")).select(
        F.regexp_extract("bill_number", pattern, 1).alias("_day"),
        F.regexp_extract("bill_number", pattern, 2).try_cast("long").alias("_number"),
    )
    return numbered.filter(F.col("_number").isNotNull()).groupBy("_day").agg(F.max("_number").alias("_used"))


def _of_days(bills, dated, prefix):
    """Bills whose number can be of a day between the first and the last of `dated`: a range that a scan can use.

    "." is the character after "-", so the upper end takes in every number of the last day.
    """
    first, last = dated.agg(F.min("_day"), F.max("_day")).first()
    if first is None:
        return bills.limit(0)
    number = F.col("bill_number")
    return bills.filter((number >= f"{prefix}-{first}-") & (number < f"{prefix}-{last}."))


def _numbered(dated, used, prefix, order, created_at):
    placed = running_count(dated, ["_day"], [order], "_place", [bucket(order)], carry=used)
    number = F.coalesce(F.col("_used"), F.lit(0)) + F.col("_place")
    return placed.withColumn("bill_number", bill_number(prefix, F.col(created_at), number)).drop(
        "_day", "_place", "_used"
    )


def assign_bill_numbers(drafts, bills, prefix="BILL", order="seq", created_at="created_at"):
    """Adds `bill_number`: sequential within a day, after the numbers the day already has.

    The numbers are consecutive instead of drawn at random from 1 to 9999, so a
    busy day cannot run into a used number.
    """
    dated = drafts.withColumn("_day", F.date_format(created_at, "yyyyMMdd"))
    return _numbered(dated, _used_numbers(_of_days(bills, dated, prefix), prefix), prefix, order, created_at)


# ---- high-water marks: what numbering needs to know of the tables, in a few rows


def marks_of(tables, prefix="BILL"):
    """Rows (name, highest) of all tables: the highest id of each, and the highest bill number of each day.

    Names are those of the tables, and `PREFIX-YYYYMMDD` for a day.
    """
    rows = [table.agg(F.lit(name).alias("name"), F.max("id").cast("long").alias("highest")) for name, table in tables.items() if "id" in table.columns]
    if "bills" in tables:
        rows.append(_day_marks(tables["bills"], prefix))
    return _highest(rows)


def _day_marks(bills, prefix):
    return _used_numbers(bills, prefix).select(F.concat(F.lit(f"{prefix}-"), "_day").alias("name"), F.col("_used").alias("highest"))


def _highest(rows):
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    return both.filter(F.col("highest").isNotNull()).groupBy("name").agg(F.max("highest").alias("highest"))


def assign_ids_after(rows, marks, name, order="seq", column="id"):
    """`assign_ids` from the mark of a table in place of the table."""
    placed = running_count(rows, [], [order], "_place", [bucket(order)])
    mark = marks.filter(F.col("name") == name).agg(F.coalesce(F.max("highest"), F.lit(0)).cast("long")).scalar()
    return placed.withColumn(column, mark + F.col("_place")).drop("_place")


def assign_bill_numbers_after(drafts, marks, prefix="BILL", order="seq", created_at="created_at"):
    """`assign_bill_numbers` from the days' marks in place of the bills."""
    head = f"{prefix}-"
    used = marks.filter(F.col("name").startswith(head)).select(F.substr("name", F.lit(len(head) + 1)).alias("_day"), F.col("highest").alias("_used"))
    return _numbered(drafts.withColumn("_day", F.date_format(created_at, "yyyyMMdd")), used, prefix, order, created_at)


def advanced_marks(marks, new, prefix="BILL"):
    """The marks after new rows of some tables; only the new rows are read."""
    return _highest([marks, marks_of(new, prefix)])
