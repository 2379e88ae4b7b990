"""Retail tables as views over the sample star schema in a folder of Parquet files."""

from pyspark.sql import functions as F

from ..operators.ordered import running_count


def _load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def products(spark, folder):
    return _load(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.col("p_size").alias("stock"),
        F.col("p_type").alias("category"),
        F.lit("").alias("description"),
        F.col("p_brand").alias("barcode"),
        (F.col("p_brand") != "Brand#9").alias("is_active"),
    )


def customers(spark, folder):
    return _load(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").cast("string").alias("phone"),
        F.col("c_mktsegment").alias("email"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
        F.lit(0).alias("total_orders"),
        F.lit(0).cast("decimal(12,2)").alias("total_spent"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def users(spark, folder):
    return _load(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("username"),
        F.when(F.col("s_nationkey") < 5, "admin")
        .when(F.col("s_nationkey") < 12, "manager")
        .otherwise("cashier")
        .alias("role"),
        F.concat(F.lit("Clerk "), F.col("s_suppkey").cast("string")).alias("full_name"),
        F.concat(F.lit("clerk"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("s_nationkey").cast("string").alias("phone"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"),
    )


def bills(spark, folder):
    priority = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    total = F.col("o_totalprice").cast("decimal(10,2)")
    return _load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("BILL-"), F.col("o_orderkey").cast("string")).alias("bill_number"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("Customer#"), F.format_string("%09d", "o_custkey")).alias("customer_name"),
        total.alias("subtotal"),
        total.alias("total_amount"),
        F.when(priority.isin("1-URGENT", "5-LOW"), "cash")
        .when(priority == "2-HIGH", "card")
        .when(priority == "3-MEDIUM", "upi")
        .when(priority == "4-NOT SPECIFIED", "credit")
        .alias("payment_method"),
        F.when(status == "F", "paid").when(status == "O", "pending").when(status == "P", "partial").alias("payment_status"),
        F.col("o_custkey").alias("created_by"),
        F.col("o_orderdate").alias("created_at"),
    )


def bill_items(spark, folder):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return _load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("bill_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (price * (1 - F.col("l_discount").cast("decimal(5,2)"))).cast("decimal(12,2)").alias("subtotal"),
        (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount_percentage"),
        (F.col("l_returnflag") == "R").alias("is_return"),
    )


# Line numbers repeat within a bill; these columns in turn settle the order of lines.
LINE_ORDER = ("line_no", "quantity", "subtotal", "product_id")


def line_buckets():
    """Buckets that follow LINE_ORDER and cut even a bill of very many lines."""
    return [F.col("line_no"), F.col("quantity"), F.floor(F.col("subtotal") / 256)]


def numbered_items(spark, folder):
    """Items with their 1-based position in the bill."""
    return running_count(bill_items(spark, folder), ["bill_id"], list(LINE_ORDER), "position", line_buckets())
