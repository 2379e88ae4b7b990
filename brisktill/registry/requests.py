"""Change requests and drafts made out of the sample tables, so that batches grow with them."""

from pyspark.sql import functions as F

from ..operators.joins import resolve_lines
from ..operators.pricing import price_lines
from ..sources import samples


def _orders(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet")


def _customer(spark, folder):
    return spark.read.parquet(f"{folder}/customer.parquet")


def new_products(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_brand") != "Brand#7", F.concat(F.lit("new "), "p_name")).alias("name"),
        (F.col("p_retailprice").cast("decimal(10,2)") - 905).cast("decimal(10,2)").alias("price"),
        F.col("p_size").alias("stock"),
        F.when(F.col("p_size") > 10, F.col("p_type")).alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.col("p_brand").alias("barcode"),
    )


def product_changes(spark, folder):
    priority = F.col("o_orderpriority")
    return _orders(spark, folder).select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") * 2).alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("item "), priority)).alias("name"),
        (F.floor(F.col("o_totalprice") / 100000) * 10 - 10).cast("decimal(10,2)").alias("price"),
        F.lit(7).alias("stock"),
        F.when(priority != "5-LOW", F.lit("CHANGED")).alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.lit("b").alias("barcode"),
    )


def product_removals(spark, folder):
    return (
        _orders(spark, folder)
        .filter(F.col("o_orderstatus") == "F")
        .select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 3).alias("id"))
    )


def new_customers(spark, folder):
    return _customer(spark, folder).select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit("New "), "c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).alias("phone"),
        F.col("c_mktsegment").alias("email"),
        F.lit(None).cast("string").alias("address"),
    )


def customer_changes(spark, folder):
    return _orders(spark, folder).select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("Buyer "), "o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string")).alias("phone"),
        F.lit("mail").alias("email"),
        F.lit("road").alias("address"),
    )


def customer_removals(spark, folder):
    return (
        _orders(spark, folder)
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"))
    )


def bill_patches(spark, folder):
    kind = F.col("event_type")
    method = (
        F.when(kind == "click", "card").when(kind == "view", "upi").when(kind == "error", "cheque").otherwise("cash")
    )
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 3).alias("id"),
        F.concat(F.lit("Patched "), kind).alias("customer_name"),
        method.alias("payment_method"),
        F.when(F.col("value") > 30, "paid").otherwise("refunded").alias("payment_status"),
    )


def method_changes(spark, folder):
    """Every seventh bill is paid by another method than it says."""
    method = F.col("payment_method")
    after = F.when(method == "cash", "card").when(method == "card", "upi").when(method == "upi", "credit").otherwise("cash")
    bills = samples.bills(spark, folder).filter(F.col("id") % 7 == 3)
    return bills.select(F.col("id").alias("seq"), "id", "customer_name", after.alias("payment_method"), "payment_status")


def accented_products(spark, folder):
    """Products, every third one with accents in its name."""
    name = F.when(F.col("id") % 3 == 0, F.translate("name", "eo", "éô")).otherwise(F.col("name"))
    return samples.products(spark, folder).withColumn("name", name)


def product_terms(spark, folder):
    """What people type while they look for every twentieth product: one, two or four characters."""
    own = samples.products(spark, folder).filter(F.col("id") % 20 == 0)
    parts = [F.upper(F.substring("name", 3, 4)), F.substring("barcode", 6, 2), F.substring("name", 1, 1)]
    return own.select(F.explode(F.array(*parts)).alias("term"))


def bill_terms(spark, folder):
    """The last four digits of every fiftieth customer's name, as typed to find their bills."""
    return samples.customers(spark, folder).filter(F.col("id") % 50 == 0).select(F.substring("name", 15, 4).alias("term"))


def request_bodies(spark, folder):
    """Orders as request bodies (seq, body): whole ones, and such as clients get wrong in seven ways."""
    key, total = F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice")
    customer = F.col("o_custkey").cast("string")
    line = F.concat(F.lit('{"product_id": '), (key % 50 + 1).cast("string"), F.lit(', "quantity": "'), (key % 7).cast("string"), F.lit(' pcs", "unit_price": 1.5}'))
    whole = F.concat(
        F.lit('{"customer_id": '), customer, F.lit(', "customer_name": "Customer '), customer,
        F.lit('", "total_amount": '), total, F.lit(', "items": ['), line, F.lit(", "), line, F.lit("]}"),
    )
    texts = F.concat(F.lit('{"customer_id": "'), customer, F.lit('x", "customer_name": 7, "total_amount": "'), total, F.lit(' EUR", "items": []}'))
    kind = F.col("o_orderkey") % 9
    body = (
        F.when(kind == 1, texts)
        .when(kind == 2, F.substr(whole, F.lit(1), F.length(whole) - 3))
        .when(kind == 3, F.concat(F.lit("["), whole, F.lit("]")))
        .when(kind == 4, F.lit('{"customer_name": {"first": "A"}, "items": null}'))
        .when(kind == 5, F.lit('{"items": {"product_id": 1}}'))
        .when(kind == 6, F.lit('{"items": [4]}'))
        .when(kind == 7, F.lit(""))
        .otherwise(whole)
    )
    return _orders(spark, folder).select(key.alias("seq"), body.alias("body"))


def new_users(spark, folder):
    taken = F.concat(F.lit("SUPPLIER#"), F.format_string("%09d", "c_custkey"))
    fresh = F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"))
    return _customer(spark, folder).select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_acctbal") < 3000, taken).otherwise(fresh).alias("username"),
        F.when(F.col("c_nationkey") == 3, "boss").when(F.col("c_nationkey") > 9, "manager").alias("role"),
        F.col("c_name").alias("full_name"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("phone"),
    )


def user_patches(spark, folder):
    segment = F.col("c_mktsegment")
    name = F.concat(segment, F.lit("-"), F.floor(F.col("c_nationkey") / 2).cast("string"))
    return _customer(spark, folder).select(
        F.col("c_custkey").alias("seq"),
        (F.col("c_nationkey").cast("long") * 4).alias("id"),
        F.when(segment != "BUILDING", name).alias("username"),
        F.when(segment == "MACHINERY", "boss").otherwise("manager").alias("role"),
        F.col("c_name").alias("full_name"),
        F.lit("e").alias("email"),
        F.lit("p").alias("phone"),
        F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal") > 6000).alias("is_active"),
    )


def user_removals(spark, folder):
    supplier = spark.read.parquet(f"{folder}/supplier.parquet")
    return supplier.filter(F.col("s_acctbal") < 2000).select(
        F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("id")
    )


def setting_requests(spark, folder):
    """Every supplier asks for all eight settings and one unknown key."""
    key = F.col("s_suppkey").cast("string")
    values = {
        "store_name": F.col("s_name"),
        "store_address": F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")),
        "store_phone": key,
        "store_email": F.when(F.col("s_acctbal") < 1000, "nobody").otherwise(
            F.concat(F.lit("s"), key, F.lit("@example.com"))
        ),
        "tax_rate": (F.col("s_nationkey") * 5).cast("string"),
        "tax_name": F.lit(""),
        "currency_symbol": F.lit("Rs."),
        "theme": F.when(F.col("s_nationkey") > 12, "dark").otherwise("light"),
        "font": F.lit("mono"),
    }
    pairs = F.array(*[F.struct(F.lit(name).alias("setting_key"), value.alias("setting_value")) for name, value in values.items()])
    return (
        spark.read.parquet(f"{folder}/supplier.parquet")
        .select(F.col("s_suppkey").alias("batch"), F.posexplode(pairs).alias("seq", "pair"))
        .select("batch", "seq", "pair.*")
    )


def base_settings(spark, folder):
    """One setting per nation: two allowed keys among unknown ones."""
    name = F.col("n_name")
    key = F.when(F.col("n_nationkey") == 0, "theme").when(F.col("n_nationkey") == 1, "tax_name").otherwise(name)
    return spark.read.parquet(f"{folder}/nation.parquet").select(key.alias("setting_key"), name.alias("setting_value"))


def phone_drafts(spark, folder):
    """Drafts of walk-ins, of known phones and of phones nobody has yet."""
    status = F.col("o_orderstatus")
    return _orders(spark, folder).select(
        F.col("o_orderkey").alias("seq"),
        F.when(status == "P", "Walk-in Customer")
        .otherwise(F.concat(F.lit("Caller "), "o_orderpriority"))
        .alias("customer_name"),
        F.when(status == "F", F.col("o_custkey").cast("string"))
        .otherwise(F.concat(F.lit("+"), F.floor(F.col("o_custkey") / 2).cast("string")))
        .alias("customer_phone"),
        F.lit("").alias("customer_email"),
        F.lit("").alias("customer_address"),
    )


def open_bills(spark, folder):
    return samples.bills(spark, folder).filter(F.col("payment_status") != "paid")


def paid_bills(spark, folder):
    return samples.bills(spark, folder).filter(F.col("payment_status") == "paid")


def bill_drafts(spark, folder):
    """Unpaid bills to be posted; those on credit come with a method nobody accepts."""
    bills = open_bills(spark, folder)
    return bills.select(
        F.col("id").alias("seq"),
        "customer_id",
        "customer_name",
        F.lit("").alias("customer_phone"),
        F.lit("").alias("customer_email"),
        F.lit("").alias("customer_address"),
        "subtotal",
        F.lit(0).cast("decimal(10,2)").alias("discount_amount"),
        F.lit(0).cast("decimal(10,2)").alias("tax_amount"),
        F.lit(0).cast("decimal(10,2)").alias("shipping_cost"),
        "total_amount",
        F.when(F.col("payment_method") == "credit", "cheque").otherwise(F.col("payment_method")).alias("payment_method"),
        "payment_status",
        "created_by",
        "created_at",
    )


def cart_lines(spark, folder, numbered=True):
    """Items with the name and list price of their product, and with their position in the bill."""
    items = samples.numbered_items(spark, folder) if numbered else samples.bill_items(spark, folder)
    items = items.select(
        "bill_id",
        *(["position"] if numbered else []),
        "product_id",
        F.lit("").alias("product_name"),
        "quantity",
        F.lit(0).cast("decimal(10,2)").alias("unit_price"),
        "discount_percentage",
    )
    return resolve_lines(items, samples.products(spark, folder))


def draft_lines(spark, folder):
    priced = price_lines(cart_lines(spark, folder))
    return priced.select(
        F.col("bill_id").alias("seq"),
        (F.col("position") - 1).alias("pos"),
        "product_id",
        "product_name",
        "quantity",
        "unit_price",
        "discount_percentage",
        "discount_amount",
        "subtotal",
    )
