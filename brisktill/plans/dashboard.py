"""The dashboard: sales of a day and of its month, customers, low stock, newest bills."""

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from ..functions.dates import as_date, in_days, month_bounds
from ..operators.reads import low_stock, recent_bills


def _sales(prefix="", when=None):
    amount = F.col("total_amount") if when is None else F.when(when, F.col("total_amount"))
    count = F.count(F.lit(1)) if when is None else F.count_if(when)
    return [
        count.alias(f"{prefix}bill_count"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(20,2)").alias(f"{prefix}total_sales"),
    ]


def _today(spark):
    return datetime.now(ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))).date()


def sales_on(bills, as_of):
    """Bills and sales of one day."""
    return bills.filter(in_days(F.col("created_at"), as_of, as_of)).agg(*_sales())


def sales_in_month(bills, as_of):
    """Bills and sales of the calendar month of a day."""
    return bills.filter(in_days(F.col("created_at"), *month_bounds(as_of))).agg(*_sales())


def active_customers(customers):
    return customers.filter(F.col("is_active")).agg(F.count(F.lit(1)).alias("total_customers"))


def low_stock_count(products, at_most=5):
    return low_stock(products, at_most).agg(F.count(F.lit(1)).alias("low_stock_count"))


def summary(bills, customers, products, as_of=None):
    """One row of counts and sums. Day and month come from one scan of the month's bills."""
    as_of = as_date(as_of) if as_of else _today(bills.sparkSession)
    created = F.col("created_at")
    month = bills.filter(in_days(created, *month_bounds(as_of)))
    return month.agg(*_sales("today_", in_days(created, as_of, as_of)), *_sales("month_")).select(
        "*",
        active_customers(customers).scalar().alias("total_customers"),
        low_stock_count(products).scalar().alias("low_stock_count"),
    )


def dashboard(bills, customers, products, users, as_of=None):
    """The whole bundle in one row, the five newest bills nested."""
    newest = recent_bills(bills, users).select(F.struct("created_at", "id", F.struct("*").alias("bill")).alias("entry"))
    ordered = F.sort_array(F.collect_list("entry"), asc=False)
    nested = newest.agg(F.transform(ordered, lambda entry: entry["bill"]).alias("recent_bills"))
    return summary(bills, customers, products, as_of).select("*", nested.scalar().alias("recent_bills"))
