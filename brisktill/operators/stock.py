"""Selling lines against stock, in order, skipping the lines that do not fit.

A line takes its quantity from its product's stock when that much is left and
is skipped otherwise. Whether a line fits depends on every earlier line of the
product, yet most lines are settled without walking them one by one:

1. Up to the first line that does not fit, stock falls by the running sum. That
   sum is bucketed (`ordered.running_sums`), so a hot product stays distributed.
2. From there on less is left than that line asked for; call it `left`. Stock
   never rises, so once a quantity q was refused it stays refused: only the
   first left // q lines of each quantity can still fit. That keeps at most
   left * (1 + ln left) lines of a product, however many were sold.
3. Those few lines are walked in order with the remaining stock in hand.

Quantities are whole and not negative.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged
from .ordered import BUCKET_BITS, TASK_ROWS, bucket, bucket_offsets, running_sums, with_bucket


class Sold(NamedTuple):
    lines: DataFrame  # line_id, product_id, quantity, accepted
    used: DataFrame  # product_id, used: quantity taken from stock


def apply_stock(lines, products, bits=BUCKET_BITS, task_rows=TASK_ROWS):
    """Sell `lines` (line_id, product_id, quantity) in line_id order against `products` (id, stock)."""
    wanted = lines.filter(F.col("product_id").isNotNull()).select(
        "line_id", "product_id", F.col("quantity").cast("long").alias("quantity")
    )
    shelf = products.select(F.col("id").alias("product_id"), F.col("stock").cast("long").alias("stock"))
    asked = {"asked": F.col("quantity")}
    buckets = [bucket("line_id", bits)]
    walked = staged(running_sums(wanted, ["product_id"], ["line_id"], asked, buckets, shelf, task_rows))
    fits = F.coalesce(F.col("asked") <= F.col("stock"), F.lit(False))
    late = staged(_late_sales(walked, fits, bits))

    free = F.coalesce((F.col("quantity") == 0) & (F.col("stock") >= 0), F.lit(False))
    sold = walked.join(late.select("line_id", F.lit(True).alias("_late")), "line_id", "left").select(
        "line_id",
        "product_id",
        "quantity",
        (fits | free | F.coalesce(F.col("_late"), F.lit(False))).alias("accepted"),
    )

    early = walked.filter(fits).groupBy("product_id").agg(F.max("asked").alias("quantity"))
    used = (
        early.unionByName(late.select("product_id", "quantity"))
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("used"))
    )
    return Sold(sold, used)


def _late_sales(walked, fits, bits):
    """Accepted lines after a product's first refusal."""
    left = (
        walked.groupBy("product_id")
        .agg(
            F.max("asked").alias("_asked"),
            F.max("stock").alias("_stock"),
            F.max(F.when(fits, F.col("asked"))).alias("_early"),
        )
        .filter(F.col("_asked") > F.col("_stock"))
        .select("product_id", (F.col("_stock") - F.coalesce(F.col("_early"), F.lit(0))).alias("left"))
    )
    refused = with_bucket(
        walked.filter(~fits & (F.col("quantity") > 0)).select("line_id", "product_id", "quantity"),
        [bucket("line_id", bits)],
    )
    cell = ["product_id", "quantity"]
    chance = F.floor(F.col("left") / F.col("quantity"))
    cells = (
        bucket_offsets(refused, cell, {"count": F.lit(1).cast("long")})
        .join(left, "product_id")
        .filter(F.col("_before_count") < chance)
    )
    place = F.row_number().over(Window.partitionBy(*cell, "_bucket").orderBy("line_id"))
    candidates = (
        refused.join(cells, [*cell, "_bucket"])
        .withColumn("_place", F.col("_before_count") + place)
        .filter(F.col("_place") <= chance)
    )
    return (
        candidates.select("product_id", "line_id", "quantity", "left")
        .repartition("product_id")
        .sortWithinPartitions("product_id", "line_id")
        .mapInPandas(_sell_in_order, "product_id long, line_id long, quantity long")
    )


def _sell_in_order(batches):
    product, stock = None, 0
    for batch in batches:
        taken = []
        rows = zip(batch["product_id"].tolist(), batch["quantity"].tolist(), batch["left"].tolist())
        for at, (item, quantity, left) in enumerate(rows):
            if item != product:
                product, stock = item, left
            if quantity <= stock:
                stock -= quantity
                taken.append(at)
        yield batch.iloc[taken][["product_id", "line_id", "quantity"]]


def after_sales(products, used):
    """Products with the sold quantities taken off."""
    taken = F.coalesce(F.col("used"), F.lit(0))
    return products.join(used.withColumnRenamed("product_id", "id"), "id", "left").withColumn(
        "stock", (F.col("stock") - taken).cast("int")
    ).select(*products.columns)


def restocked(products, returned):
    """Products with quantities (product_id, quantity) put back."""
    total = returned.filter(F.col("product_id").isNotNull()).groupBy(F.col("product_id").alias("id"))
    total = total.agg(F.sum("quantity").alias("_back"))
    return products.join(total, "id", "left").withColumn(
        "stock", (F.col("stock") + F.coalesce(F.col("_back"), F.lit(0))).cast("int")
    ).select(*products.columns)
