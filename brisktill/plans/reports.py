"""The four reports: sales by period, inventory, customers, products."""

from pyspark.sql import functions as F

from ..functions.dates import day_range, period
from ..operators.joins import customers_with_bills, item_sums, items_of_bills
from ..operators.reads import where

PAYMENT_METHODS = ("cash", "card", "upi", "credit")


def sales_report(bills, start=None, end=None, group_by="day"):
    """Bills, sales, average and sales by payment method per day, week, month or year."""
    key, label = period(group_by)
    created = F.col("created_at")
    amount = F.col("total_amount")
    by_method = [
        F.coalesce(F.sum(F.when(F.col("payment_method") == method, amount)), F.lit(0))
        .cast("decimal(20,2)")
        .alias(f"{method}_sales")
        for method in PAYMENT_METHODS
    ]
    grouped = where(bills, day_range(created, start, end)).groupBy(key(created).alias("period"))
    summed = grouped.agg(
        F.min(created).alias("_first"),
        F.count(F.lit(1)).alias("bill_count"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(20,2)").alias("total_sales"),
        F.coalesce(F.avg(amount), F.lit(0)).cast("decimal(14,6)").alias("avg_sale"),
        *by_method,
    )
    labelled = summed.withColumn("period_label", label(F.col("_first")))
    order = ["period", "period_label", "bill_count", "total_sales", "avg_sale"]
    return labelled.select(*order, *[f"{method}_sales" for method in PAYMENT_METHODS]).orderBy("period")


def inventory_report(products, items, category=None, low_stock=0):
    """Active products with what was sold of them, lowest stock first; bills carry nothing it needs."""
    wanted = where(
        products.filter(F.col("is_active")),
        F.col("category") == category if category else None,
        F.col("stock") <= low_stock if low_stock else None,
    )
    return (
        wanted.select("id", "name", "price", "stock", "category")
        .join(item_sums(items), "id", "left")
        .select(
            "id",
            "name",
            "price",
            "stock",
            "category",
            F.coalesce("times_sold", F.lit(0)).alias("times_sold"),
            F.coalesce("total_quantity", F.lit(0)).alias("total_qty_sold"),
            F.coalesce(F.col("total_sales"), F.lit(0)).cast("decimal(22,2)").alias("total_sales_amount"),
        )
        .orderBy("stock", "name", "id")
    )


def customer_report(customers, bills, start=None, end=None, min_orders=1):
    """Active customers with at least `min_orders` bills: orders, spending, average, last order."""
    dated = where(bills, day_range(F.col("created_at"), start, end))
    people = customers.filter(F.col("is_active")).select("id", "name", "phone", "email")
    return (
        customers_with_bills(people, dated)
        .filter(F.col("order_count") >= min_orders)
        .withColumn("total_spent", F.coalesce(F.col("total_spent"), F.lit(0)).cast("decimal(20,2)"))
        .withColumn("avg_order_value", F.coalesce(F.col("avg_order_value"), F.lit(0)).cast("decimal(14,6)"))
        .orderBy(F.desc("total_spent"), "id")
    )


def product_report(products, items, bills=None, start=None, end=None, category=None, limit=10):
    """Best sellers by sales with what they would have sold for at list price.

    Bills are read only for a date range: every item has its bill.
    """
    dates = day_range(F.col("created_at"), start, end)
    if dates is not None:
        items = items_of_bills(items, bills.filter(dates))
    wanted = where(products.filter(F.col("is_active")), F.col("category") == category if category else None)
    potential = F.col("total_quantity") * F.col("price")
    # The ratio keeps enough digits for six decimals of a percentage.
    ratio = F.col("total_sales").cast("decimal(22,2)") / F.col("potential_sales")
    percent = (ratio * 100).cast("decimal(20,6)")
    return (
        wanted.select("id", "name", "category", "price")
        .join(item_sums(items), "id")
        .withColumn("potential_sales", potential.cast("decimal(22,2)"))
        .withColumn("total_sales", F.coalesce(F.col("total_sales"), F.lit(0)).cast("decimal(22,2)"))
        .withColumn(
            "effective_pct",
            F.when(F.col("potential_sales") > 0, percent).otherwise(F.lit(100).cast("decimal(20,6)")),
        )
        .orderBy(F.desc("total_sales"), "id")
        .limit(limit)
    )
