"""The joins of the data model. All are equi-joins on ids or phone numbers.

No side carries a broadcast hint: Spark broadcasts what its statistics or the
finished shuffle show to be small and splits skewed partitions otherwise.
"""

from pyspark.sql import functions as F

from ..functions.coerce import given
from ..functions.text import trimmed
from ..sources.staging import staged
from .numbering import assign_ids

WALK_IN = "Walk-in Customer"


def spread_key(reference, row_key):
    """A join key that equals `reference` where it is set and is scattered below zero where it is null.

    Ids are positive, so scattered rows match nothing and do not pile up in the
    partition of null.
    """
    scattered = -F.pmod(F.xxhash64(row_key), F.lit(1 << 20)) - 1
    return F.coalesce(reference.cast("long"), scattered)


def bills_with_cashier(bills, users, name="cashier_name"):
    """Bills with the user name of whoever made them, null when unknown."""
    cashiers = users.select(F.col("id").alias("_cashier"), F.col("username").alias(name))
    keyed = bills.withColumn("_cashier", spread_key(F.col("created_by"), F.col("id")))
    return keyed.join(cashiers, "_cashier", "left").drop("_cashier")


def item_sums(items):
    """Lines, quantity and amount per product: one row per product before any join."""
    return (
        items.filter(F.col("product_id").isNotNull())
        .groupBy(F.col("product_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("times_sold"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("subtotal").alias("total_sales"),
        )
    )


def products_with_items(products, items):
    """Every product with its item sums, null when never sold."""
    return products.join(item_sums(items), "id", "left")


def products_sold(products, items):
    """Products sold at least once, with their item sums."""
    return products.join(item_sums(items), "id")


def items_of_bills(items, bills):
    """Items whose bill is among `bills`."""
    return items.join(bills.select(F.col("id").alias("bill_id")), "bill_id", "left_semi")


def bill_sums(bills):
    """Orders, spending and last order date per customer; walk-in bills have no customer."""
    return (
        bills.filter(F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("total_amount").alias("total_spent"),
            F.avg("total_amount").alias("avg_order_value"),
            F.max("created_at").alias("last_order_date"),
        )
    )


def customers_with_bills(customers, bills):
    """Customers with at least one bill, with their bill sums in place of any kept counters."""
    sums = bill_sums(bills)
    kept = [c for c in customers.columns if c == "id" or c not in sums.columns]
    return customers.select(*kept).join(sums, "id")


def resolve_lines(lines, products):
    """Cart lines with the name and price of their product; manual lines keep their own."""
    known = products.select(
        F.col("id").alias("_product"), F.col("name").alias("_name"), F.col("price").alias("_price")
    )
    keyed = lines.withColumn(
        "_product", spread_key(F.col("product_id"), F.struct(*[c for c in lines.columns if c != "product_id"]))
    )
    return (
        keyed.join(known, "_product", "left")
        .withColumn("product_name", F.coalesce("_name", "product_name"))
        .withColumn("unit_price", F.coalesce("_price", "unit_price"))
        .select(*lines.columns)
    )


def find_or_create_customers(drafts, customers):
    """Resolve the customer of every draft by exact phone among active customers.

    Returns (drafts with `customer_id` set, new customer rows). A draft looks
    for a customer when it has a phone and a name other than the walk-in one.
    An unknown phone becomes one new customer, described by its first draft.
    When several customers share a phone, the first by name, then id, is taken.
    """
    name, phone = trimmed(F.col("customer_name")), trimmed(F.col("customer_phone"))
    named = drafts.withColumn("_phone", F.when(given(name) & (name != WALK_IN) & given(phone), phone))
    known = (
        customers.filter(F.col("is_active") & F.col("phone").isNotNull())
        .groupBy(F.col("phone").alias("_phone"))
        .agg(F.min_by("id", F.struct("name", "id")).alias("_known"))
    )
    # One row per phone before the join, so a phone shared by many drafts counts once.
    firsts = staged(
        named.filter(F.col("_phone").isNotNull())
        .groupBy("_phone")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by(
                F.struct(
                    trimmed(F.col("customer_name")).alias("name"),
                    trimmed(F.col("customer_email")).alias("email"),
                    trimmed(F.col("customer_address")).alias("address"),
                ),
                "seq",
            ).alias("_who"),
        )
        .join(known, "_phone", "left")
    )
    created = assign_ids(firsts.filter(F.col("_known").isNull()), customers).select(
        "id", "_who.name", F.col("_phone").alias("phone"), "_who.email", "_who.address"
    )
    found = firsts.filter(F.col("_known").isNotNull()).select("_phone", F.col("_known").alias("_customer"))
    owners = found.unionByName(created.select(F.col("phone").alias("_phone"), F.col("id").alias("_customer")))
    # Drafts without a phone are scattered by their own number instead of meeting on null.
    keyed = named.withColumn("_phone", F.coalesce("_phone", F.concat(F.lit("\0"), F.col("seq").cast("string"))))
    resolved = keyed.join(owners, "_phone", "left").withColumn("customer_id", F.col("_customer"))
    return resolved.drop("_phone", "_customer"), created
