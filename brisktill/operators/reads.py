"""Lists, lookups, searches and nested documents."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_term, loose
from .joins import bills_with_cashier
from .ordered import split_hot

PRODUCT_COLUMNS = ("id", "name", "price", "stock", "category", "barcode")
USER_COLUMNS = ("id", "username", "role", "full_name", "email", "phone", "is_active", "last_login")
ORDER_COLUMNS = ("id", "bill_number", "created_at", "total_amount")
PART_SIZE = 10_000


def where(df, *conditions):
    """Filter by the conditions that are set; None means no filter."""
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def by_id(df, wanted):
    """Rows with one id, or with the ids of a frame that has an `id` column."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select("id").distinct(), "id", "left_semi")
    return df.filter(F.col("id") == F.lit(wanted))


def _active(df):
    return df.filter(F.col("is_active"))


def _any_has(columns, term):
    return reduce(or_, [has_term(F.col(column), term) for column in columns])


def _by_name(column):
    return [loose(F.col(column)), F.col("id")]


def products(table):
    return _active(table).select(*PRODUCT_COLUMNS).orderBy(*_by_name("name"))


def product(table, wanted):
    return by_id(_active(table), wanted)


def search_products(table, term, limit=50):
    found = _active(table).filter(_any_has(("name", "barcode"), term))
    return found.select(*PRODUCT_COLUMNS).orderBy(*_by_name("name")).limit(limit)


def low_stock(table, at_most=5):
    """Active products with at most this much stock."""
    return _active(table).filter(F.col("stock") <= at_most)


def customers(table):
    return _active(table).orderBy(*_by_name("name"))


def search_customers(table, term, limit=20):
    found = _active(table).filter(_any_has(("name", "phone", "email"), term))
    return found.orderBy(*_by_name("name")).limit(limit)


def users(table):
    return table.select(*USER_COLUMNS).orderBy(*_by_name("username"))


def user(table, wanted):
    return by_id(table, wanted).select(*USER_COLUMNS)


def _newest():
    return [F.col("created_at").desc(), F.col("id").desc()]


def bill_list(bills, users, term=None, limit=100):
    """The newest bills, or the newest whose number or customer name holds `term`, with the cashier."""
    wanted = where(bills, _any_has(("bill_number", "customer_name"), term) if term else None)
    # At most `limit` bills are left when they meet the users.
    return bills_with_cashier(wanted.orderBy(*_newest()).limit(limit), users).orderBy(*_newest())


def recent_bills(bills, users, limit=5):
    columns = ("id", "bill_number", "customer_name", "total_amount", "payment_method", "created_at")
    newest = bills.select(*columns, "created_by").orderBy(*_newest()).limit(limit)
    return bills_with_cashier(newest, users, "cashier").drop("created_by").orderBy(*_newest())


def recent_per_customer(bills, limit=10):
    """Every customer's newest bills with their `rank`.

    Each input partition keeps at most `limit` bills per customer before the
    shuffle, so a customer with very many bills is no heavier than others.
    """
    newest = Window.partitionBy("customer_id").orderBy(*_newest())
    return (
        bills.filter(F.col("customer_id").isNotNull())
        .select("customer_id", *ORDER_COLUMNS)
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
    )


def customer_documents(customers, bills, wanted=None, limit=10):
    """Active customers with their newest bills nested, newest first, as `orders`."""
    people = _active(customers)
    if wanted is not None:
        people = by_id(people, wanted)
        bills = (
            bills.filter(F.col("customer_id") == F.lit(wanted))
            if not isinstance(wanted, DataFrame)
            else bills.join(wanted.select(F.col("id").alias("customer_id")).distinct(), "customer_id", "left_semi")
        )
    entry = F.struct(*ORDER_COLUMNS)
    orders = recent_per_customer(bills, limit).groupBy(F.col("customer_id").alias("id"))
    orders = orders.agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("bill")))).alias("_ranked"))
    orders = orders.select("id", F.transform("_ranked", lambda ranked: ranked["bill"]).alias("orders"))
    none = F.array().cast(orders.schema["orders"].dataType)
    return people.join(orders, "id", "left").withColumn("orders", F.coalesce("orders", none))


def bill_lines(bills, users, items):
    """Bills, cashier and items flat: one row per line, and one for a bill without lines.

    An outer join could only split a hot key on the side of the bills; the
    inner join splits it on the side of the items, where it is.
    """
    header = bills_with_cashier(bills, users).withColumnRenamed("id", "bill_id")
    lines = items.select(*[F.col(c).alias(c if c == "bill_id" else f"item_{c}") for c in items.columns])
    without = header.join(items.select("bill_id").distinct(), "bill_id", "left_anti")
    return header.join(lines, "bill_id").unionByName(without, allowMissingColumns=True)


def nest(children, key, order, name, part_size=PART_SIZE):
    """Children of a key as one array in `order`, split into parts when there are very many.

    Returns (key, part, parts, array). A key with at most `part_size` children
    has one part; a larger one is scattered over parts of about that size, each
    built by its own task, so no key grows past what one row can hold.
    """
    fields = [*order, *[c for c in children.columns if c not in order and c != key]]
    items = F.sort_array(F.collect_list(F.struct(*fields))).alias(name)
    cold, hot = split_hot(children, [key], part_size)
    whole = cold.groupBy(key).agg(items).select(key, F.lit(0).alias("part"), F.lit(1).alias("parts"), name)
    if hot is None:
        return whole

    counts = hot.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / part_size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*fields), F.col("parts")).cast("int")
    # Without the repartition the grouping would stay on the key alone.
    spread = hot.join(counts, key).withColumn("part", part).repartition(key, "part")
    return whole.unionByName(spread.groupBy(key, "part", "parts").agg(items))


def bill_documents(bills, users, items, wanted=None, order=("id",), part_size=PART_SIZE):
    """Bills with cashier name and all items nested as `items`; very large bills come in several parts."""
    if wanted is not None:
        bills = by_id(bills, wanted)
        items = (
            items.filter(F.col("bill_id") == F.lit(wanted))
            if not isinstance(wanted, DataFrame)
            else items.join(wanted.select(F.col("id").alias("bill_id")).distinct(), "bill_id", "left_semi")
        )
    nested = nest(items, "bill_id", list(order), "items", part_size).withColumnRenamed("bill_id", "id")
    none = F.array().cast(nested.schema["items"].dataType)
    return (
        bills_with_cashier(bills, users)
        .join(nested, "id", "left")
        .withColumn("items", F.coalesce("items", none))
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
    )
