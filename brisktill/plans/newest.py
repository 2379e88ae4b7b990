"""Every customer's newest bills, kept up to date by change sets instead of being searched for in all bills.

The state has one row per customer with a bill: `bills`, how many there are, and
`newest`, the newest of them, newest first. A list holds all bills there are, or
as many as the limit; what it leaves out is older than its last entry.
"""

from pyspark.sql import functions as F

from ..operators.reads import ORDER_COLUMNS, recent_per_customer
from ..sources.staging import staged

LIMIT = 10
_ENTRY = ("created_at", "id", "bill_number", "total_amount")


def _lists(ranked):
    """(customer_id, newest) of rows that hold at most the limit per customer."""
    newest = F.sort_array(F.collect_list(F.struct(*_ENTRY)), asc=False)
    return ranked.groupBy("customer_id").agg(newest.alias("newest"))


def state(bills, limit=LIMIT):
    """The state of all bills. Bills are counted, and cut to the newest, on the map side, so no customer is too large."""
    owned = bills.filter(F.col("customer_id").isNotNull())
    counted = owned.groupBy("customer_id").agg(F.count(F.lit(1)).alias("bills"))
    return counted.join(_lists(recent_per_customer(owned, limit)), "customer_id")


def merged(one, two, limit=LIMIT):
    """The state of two sets of bills with no bill in common, from the states of both."""
    both = F.concat(F.coalesce("o.newest", F.array()), F.coalesce("t.newest", F.array()))
    joined = one.alias("o").join(two.alias("t"), "customer_id", "full")
    bills = F.coalesce("o.bills", F.lit(0)) + F.coalesce("t.bills", F.lit(0))
    return joined.select("customer_id", bills.alias("bills"), F.slice(F.sort_array(both, asc=False), 1, limit).alias("newest"))


def _moved(changes):
    """Rows (sign, customer_id, the entry's columns): -1 for what a changed bill was, +1 for what it became."""
    listed = ("customer_id", *[c for c in _ENTRY if c != "id"])
    touched = changes.filter((F.col("operation") != "update") | F.arrays_overlap("changed", F.array(*map(F.lit, listed))))
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("b")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("b")))
    rows = touched.select("id", F.inline(sides)).filter("b.customer_id is not null")
    return rows.select("sign", "id", *[f"b.{c}" for c in listed])


def advanced(stored, changes, bills, limit=LIMIT):
    """The stored state after a change set of bills (see `operators.diff`); `bills` are the bills after it.

    Entries of changed bills are taken out, and what they became is merged in.
    If the old list left bills out, only entries not older than its last one
    are sure to be among the newest. Where too few are, the list is searched
    for again in all bills of that customer; without such customers the bills
    are not read. Customers that no bill is left for go.
    """
    moved = staged(_moved(changes))
    touched = moved.groupBy("customer_id").agg(F.sum("sign").alias("more"))
    gone = moved.filter("sign < 0").select("customer_id", "id")
    come = recent_per_customer(moved.filter("sign > 0"), limit).drop("rank")

    last = F.element_at("newest", -1)
    complete = F.col("bills") <= F.size("newest")
    kept = stored.select("customer_id", "bills", F.when(~complete, F.struct(last["created_at"].alias("created_at"), last["id"].alias("id"))).alias("last"))
    entries = stored.join(touched, "customer_id", "left_semi").select("customer_id", F.inline("newest")).join(gone, ["customer_id", "id"], "left_anti")
    lists = _lists(recent_per_customer(entries.unionByName(come), limit))

    counts = touched.join(kept, "customer_id", "left").join(lists, "customer_id", "left")
    counts = counts.withColumn("bills", F.coalesce("bills", F.lit(0)) + F.col("more")).filter("bills > 0")
    sure = F.size(F.filter("newest", lambda e: F.col("last").isNull() | (F.struct(e["created_at"], e["id"]) >= F.col("last"))))
    short = F.coalesce(sure, F.lit(0)) < F.least(F.lit(limit), "bills")
    after = staged(counts.select("customer_id", "bills", "newest", short.alias("short")))
    found = stored.join(touched, "customer_id", "left_anti").unionByName(after.filter("not short").drop("short"))

    refill = after.filter("short").select("customer_id", "bills")
    if refill.isEmpty():
        return found
    own = bills.join(refill, "customer_id", "left_semi")
    return found.unionByName(refill.join(_lists(recent_per_customer(own, limit)), "customer_id"))


def recent_orders(kept):
    """`reads.recent_per_customer` from the state."""
    ranked = kept.select("customer_id", F.posexplode("newest").alias("place", "e"))
    return ranked.select("customer_id", *[F.col(f"e.{c}").alias(c) for c in ORDER_COLUMNS], (F.col("place") + 1).alias("rank"))
