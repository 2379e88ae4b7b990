"""Sales and counters that are kept up to date instead of being summed from all bills each time.

The stored states are sums, so a change of bills is a set of signed rows: what a
bill was is taken off and what it became is put on. Posting, editing and
deleting bills are all the same to them.
"""

from pyspark.sql import functions as F

from ..functions.dates import as_date, month_bounds, period
from ..operators.diff import signed_rows
from .reports import PAYMENT_METHODS

_DAILY = ("created_at", "payment_method", "total_amount")
_OWNED = ("customer_id", "total_amount")
_MONEY = "decimal(22,2)"


def _daily_sums(signed):
    amount = F.col("total_amount")
    return signed.groupBy(F.to_date("created_at").alias("day"), "payment_method").agg(
        F.sum("sign").cast("long").alias("bills"),
        F.sum(F.when(amount.isNotNull(), F.col("sign")).otherwise(0)).cast("long").alias("amounts"),
        F.coalesce(F.sum(F.col("sign") * amount), F.lit(0)).cast(_MONEY).alias("total"),
    )


def _customer_sums(signed):
    owned = signed.filter(F.col("customer_id").isNotNull()).groupBy(F.col("customer_id").alias("id"))
    total = F.coalesce(F.sum(F.col("sign") * F.col("total_amount")), F.lit(0)).cast(_MONEY)
    return owned.agg(F.sum("sign").cast("long").alias("orders"), total.alias("spent"))


_STATES = {
    "daily_sales": (_daily_sums, _DAILY, ["day", "payment_method"], ["bills", "amounts", "total"]),
    "customer_sums": (_customer_sums, _OWNED, ["id"], ["orders", "spent"]),
}


def states(bills):
    """The states of all bills: `daily_sales` per day and payment method, `customer_sums` per customer."""
    return {name: sums(bills.select(F.lit(1).alias("sign"), *columns)) for name, (sums, columns, *_) in _STATES.items()}


def advanced(stored, changes):
    """The stored states after a change set of bills (see `operators.diff`); only the changed bills are read.

    Keys that no bill is left for go.
    """
    after = {}
    for name, (sums, columns, keys, values) in _STATES.items():
        both = stored[name].unionByName(sums(signed_rows(changes, columns)))
        summed = both.groupBy(*keys).agg(*[F.sum(v).cast(both.schema[v].dataType).alias(v) for v in values])
        after[name] = summed.filter(F.col(values[0]) != 0)
    return after


def sales_report(daily, start=None, end=None, group_by="day"):
    """`reports.sales_report` from the daily state."""
    key, label = period(group_by)
    day, total = F.col("day"), F.col("total")
    if start and end:
        daily = daily.filter((day >= F.lit(as_date(start))) & (day <= F.lit(as_date(end))))
    money = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(20,2)")
    methods = [money(F.when(F.col("payment_method") == m, total)).alias(f"{m}_sales") for m in PAYMENT_METHODS]
    summed = daily.groupBy(key(day).alias("period")).agg(
        F.min(day).alias("_first"),
        F.sum("bills").alias("bill_count"),
        money(total).alias("total_sales"),
        F.sum("amounts").alias("_amounts"),
        *methods,
    )
    # 18 digits after the point, of which six are kept.
    average = F.col("total_sales").cast(_MONEY) / F.nullif("_amounts", F.lit(0)).cast("decimal(20,0)")
    found = summed.withColumn("avg_sale", F.coalesce(average, F.lit(0)).cast("decimal(14,6)")).withColumn("period_label", label(F.col("_first")))
    order = ["period", "period_label", "bill_count", "total_sales", "avg_sale"]
    return found.select(*order, *[f"{m}_sales" for m in PAYMENT_METHODS]).orderBy("period")


def dashboard_sales(daily, as_of):
    """today_ and month_ bill_count and total_sales, as in `dashboard.summary`, from the daily state."""
    as_of = as_date(as_of)
    first, last = month_bounds(as_of)
    day = F.col("day")
    month = daily.filter((day >= F.lit(first)) & (day <= F.lit(last)))
    today = day == F.lit(as_of)
    columns = []
    for prefix, when in (("today_", today), ("month_", F.lit(True))):
        count = F.coalesce(F.sum(F.when(when, F.col("bills"))), F.lit(0)).cast("long")
        total = F.coalesce(F.sum(F.when(when, F.col("total"))), F.lit(0)).cast("decimal(20,2)")
        columns += [count.alias(f"{prefix}bill_count"), total.alias(f"{prefix}total_sales")]
    return month.agg(*columns)


def counters(customers, sums):
    """Customers with total_orders and total_spent from the customer state, as `posting.rebuild_counters` counts them."""
    joined = customers.drop("total_orders", "total_spent").join(sums, "id", "left")
    orders, spent = F.coalesce("orders", F.lit(0)), F.coalesce(F.col("spent"), F.lit(0)).cast(_MONEY)
    return joined.withColumn("total_orders", orders).withColumn("total_spent", spent).select(*customers.columns)
