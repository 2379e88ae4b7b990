"""Every registered query: name -> (spark, folder) -> DataFrame over the sample tables."""

from pyspark.sql import functions as F

from ..functions import coerce, dates, text
from ..functions.text import loose
from ..operators import changes, diff, joins, numbering, posting, pricing, reads, search, settings, validate
from ..plans import dashboard, newest, reports, standing
from ..schemas import BILL_ITEMS, BILLS
from ..sources import bucketed, monthly, samples
from ..sources.documents import parse_bill_documents, parse_bodies, split_documents
from ..sources.seed import empty_table
from ..sources.staging import scratch, staged
from ..sources.tables import as_json
from ..streaming.stock import sell_available
from . import requests

AS_OF = "2001-07-31"

QUERIES = {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


def _stamp(column="created_at"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _stamped(df, column="created_at"):
    return df.withColumn(column, _stamp(column))


# ---- reports


def _sales(name, **options):
    def query(spark, folder):
        report = reports.sales_report(samples.bills(spark, folder), **options)
        return report.withColumn("period", F.col("period").cast("string"))

    QUERIES[name] = query


_sales("sales_report_day", group_by="day")
_sales("sales_report_week", group_by="week")
_sales("sales_report_month", group_by="month")
_sales("sales_report_year", group_by="year")
_sales("sales_report_range", group_by="week", start="1997-12-20", end="1999-01-10")


@registered
def inventory_report(spark, folder):
    return reports.inventory_report(samples.products(spark, folder), samples.bill_items(spark, folder))


@registered
def inventory_low_stock(spark, folder):
    return reports.inventory_report(samples.products(spark, folder), samples.bill_items(spark, folder), low_stock=5)


@registered
def inventory_category(spark, folder):
    products, items = samples.products(spark, folder), samples.bill_items(spark, folder)
    return reports.inventory_report(products, items, category="ECONOMY")


def _customer_report(spark, folder, **options):
    report = reports.customer_report(samples.customers(spark, folder), samples.bills(spark, folder), **options)
    return _stamped(report, "last_order_date")


@registered
def customer_report(spark, folder):
    return _customer_report(spark, folder)


@registered
def customer_report_min_orders(spark, folder):
    return _customer_report(spark, folder, min_orders=12)


@registered
def customer_report_range(spark, folder):
    return _customer_report(spark, folder, start="1998-01-01", end="1998-12-31", min_orders=2)


@registered
def product_report(spark, folder):
    return reports.product_report(samples.products(spark, folder), samples.bill_items(spark, folder))


@registered
def product_report_filtered(spark, folder):
    return reports.product_report(
        samples.products(spark, folder),
        samples.bill_items(spark, folder),
        samples.bills(spark, folder),
        start="1997-01-01",
        end="1999-06-30",
        category="PROMO",
        limit=25,
    )


# ---- dashboard


@registered
def sales_on_day(spark, folder):
    return dashboard.sales_on(samples.bills(spark, folder), AS_OF)


@registered
def sales_in_month(spark, folder):
    return dashboard.sales_in_month(samples.bills(spark, folder), AS_OF)


@registered
def active_customers(spark, folder):
    return dashboard.active_customers(samples.customers(spark, folder))


@registered
def low_stock_count(spark, folder):
    return dashboard.low_stock_count(samples.products(spark, folder))


@registered
def dashboard_summary(spark, folder):
    return dashboard.summary(
        samples.bills(spark, folder), samples.customers(spark, folder), samples.products(spark, folder), AS_OF
    )


@registered
def dashboard_recent_bills(spark, folder):
    return _stamped(reads.recent_bills(samples.bills(spark, folder), samples.users(spark, folder)))


@registered
def dashboard_bundle(spark, folder):
    bundle = dashboard.dashboard(
        samples.bills(spark, folder),
        samples.customers(spark, folder),
        samples.products(spark, folder),
        samples.users(spark, folder),
        AS_OF,
    )
    numbers = F.transform("recent_bills", lambda bill: bill["bill_number"])
    return bundle.withColumn("recent_bills", F.array_join(numbers, ","))


# ---- lists, lookups, searches


@registered
def product_list(spark, folder):
    return reads.products(samples.products(spark, folder))


@registered
def product_lookup(spark, folder):
    returned = samples.bill_items(spark, folder).filter("is_return").select(F.col("product_id").alias("id"))
    return reads.product(samples.products(spark, folder), returned)


@registered
def product_search(spark, folder):
    return reads.search_products(samples.products(spark, folder), "GE")


@registered
def low_stock_list(spark, folder):
    return reads.low_stock(samples.products(spark, folder))


@registered
def customer_list(spark, folder):
    return reads.customers(samples.customers(spark, folder))


@registered
def customer_search(spark, folder):
    return reads.search_customers(samples.customers(spark, folder), "hOuse")


@registered
def customer_recent_orders(spark, folder):
    return _stamped(reads.recent_per_customer(samples.bills(spark, folder)))


@registered
def customer_documents(spark, folder):
    documents = reads.customer_documents(samples.customers(spark, folder), samples.bills(spark, folder))
    orders = F.transform("orders", lambda o: F.concat_ws(" ", o["bill_number"], o["total_amount"].cast("string")))
    return documents.select("id", "name", F.size("orders").alias("order_count"), F.array_join(orders, ",").alias("orders"))


@registered
def bill_list(spark, folder):
    return _stamped(reads.bill_list(samples.bills(spark, folder), samples.users(spark, folder)))


@registered
def bill_search(spark, folder):
    return _stamped(reads.bill_list(samples.bills(spark, folder), samples.users(spark, folder), term="r#00000004"))


@registered
def bill_items_flat(spark, folder):
    bills = samples.bills(spark, folder).select("id", "bill_number", "customer_name", "total_amount", "created_by")
    return reads.bill_lines(bills, samples.users(spark, folder), samples.bill_items(spark, folder))


def _line(item):
    return F.concat_ws(":", *[item[c].cast("string") for c in samples.LINE_ORDER], F.when(item["is_return"], "R").otherwise("S"))


def _bill_documents(spark, folder, part_size):
    bills = samples.bills(spark, folder).select("id", "bill_number", "total_amount", "created_by")
    return reads.bill_documents(
        bills,
        samples.users(spark, folder),
        samples.bill_items(spark, folder),
        order=samples.LINE_ORDER,
        part_size=part_size,
    )


@registered
def bill_documents(spark, folder):
    documents = _bill_documents(spark, folder, reads.PART_SIZE)
    line = F.transform("items", _line)
    return documents.select("id", "bill_number", "cashier_name", "part", "parts", F.array_join(line, ",").alias("items"))


@registered
def bill_documents_in_parts(spark, folder):
    """Documents cut into parts of about three items: what the parts of a bill hold together."""
    parts = _bill_documents(spark, folder, 3)
    quantity = F.aggregate("items", F.lit(0).cast("long"), lambda total, item: total + item["quantity"])
    return parts.groupBy("id").agg(
        F.max("parts").alias("parts"), F.sum(F.size("items")).alias("items"), F.sum(quantity).alias("quantity")
    )


@registered
def user_list(spark, folder):
    return reads.users(samples.users(spark, folder)).drop("last_login")


@registered
def user_lookup(spark, folder):
    cashiers = samples.bills(spark, folder).filter("payment_status = 'paid'").select(F.col("created_by").alias("id"))
    return reads.user(samples.users(spark, folder), cashiers).drop("last_login")


# ---- joins


@registered
def bills_with_cashier(spark, folder):
    named = joins.bills_with_cashier(samples.bills(spark, folder), samples.users(spark, folder))
    return named.select("id", "bill_number", "created_by", "cashier_name")


@registered
def products_with_items(spark, folder):
    return joins.products_with_items(samples.products(spark, folder), samples.bill_items(spark, folder)).select(
        "id", "name", "times_sold", "total_quantity", "total_sales"
    )


@registered
def products_sold(spark, folder):
    return joins.products_sold(samples.products(spark, folder), samples.bill_items(spark, folder)).select(
        "id", "name", "times_sold", "total_quantity", "total_sales"
    )


@registered
def customers_with_bills(spark, folder):
    return joins.customers_with_bills(samples.customers(spark, folder), samples.bills(spark, folder)).select(
        "id", "name", "order_count", "total_spent"
    )


@registered
def resolve_lines(spark, folder):
    return requests.cart_lines(spark, folder)


@registered
def find_or_create_customers(spark, folder):
    resolved, _ = joins.find_or_create_customers(
        requests.phone_drafts(spark, folder), samples.customers(spark, folder)
    )
    return resolved.select("seq", "customer_id", "customer_name", "customer_phone")


@registered
def find_or_create_new_customers(spark, folder):
    _, created = joins.find_or_create_customers(requests.phone_drafts(spark, folder), samples.customers(spark, folder))
    return created


# ---- pricing


@registered
def line_numbers(spark, folder):
    return samples.numbered_items(spark, folder)


@registered
def price_lines(spark, folder):
    return pricing.price_lines(requests.cart_lines(spark, folder))


@registered
def bill_totals(spark, folder):
    shipping = samples.bills(spark, folder).select(
        F.col("id").alias("bill_id"),
        F.when(F.col("payment_method") == "upi", 7.5).otherwise(0).cast("decimal(10,2)").alias("shipping_cost"),
    )
    return pricing.bill_totals(pricing.price_lines(requests.cart_lines(spark, folder, numbered=False)), 13, shipping)


@registered
def document_totals(spark, folder):
    """Totals of bill documents that keep their priced lines nested."""
    lines = requests.cart_lines(spark, folder, numbered=False).drop("product_name")
    documents = reads.nest(lines, "bill_id", ["product_id", "quantity", "discount_percentage"], "items")
    totals = pricing.document_totals(documents.withColumn("shipping_cost", F.lit(2.5)), 13)
    return totals.select("bill_id", "part", "subtotal", "discount_amount", "tax_amount", "total_amount")


@registered
def customer_stats_rebuild(spark, folder):
    rebuilt = posting.rebuild_counters(samples.customers(spark, folder), samples.bills(spark, folder))
    return rebuilt.select("id", "name", "total_orders", "total_spent")


# ---- settings


@registered
def settings_map(spark, folder):
    stored = settings.settings_map(settings_upsert(spark, folder)).select(F.explode("settings"))
    return stored.select(F.col("key").alias("setting_key"), F.col("value").alias("setting_value"))


@registered
def settings_upsert(spark, folder):
    return settings.upsert_settings(requests.base_settings(spark, folder), requests.setting_requests(spark, folder))[0]


@registered
def settings_outcomes(spark, folder):
    return settings.upsert_settings(requests.base_settings(spark, folder), requests.setting_requests(spark, folder))[1]


@registered
def settings_counts(spark, folder):
    """Batches of settings saved and rejected, as counted while the outcomes were stored."""
    return _counts(spark, settings.store_outcomes(settings_outcomes(spark, folder))[1])


@registered
def effective_settings(spark, folder):
    return settings.effective_settings(settings_upsert(spark, folder))


# ---- scalar functions


@registered
def period_keys(spark, folder):
    created = F.col("created_at")
    return samples.bills(spark, folder).select(
        "id",
        F.to_date(created).cast("string").alias("day"),
        F.year(created).alias("year"),
        F.month(created).alias("month"),
        dates.iso_yearweek(created).alias("yearweek"),
        dates.week_label(created).alias("week_label"),
        F.date_format(created, "yyyy-MM").alias("month_label"),
        dates.in_days(created, "1997-02-10", "1998-02-10").alias("in_range"),
    )


@registered
def lenient_numbers(spark, folder):
    """Numbers read from the start of event values and properties."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    value = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.concat(F.col("value").cast("decimal(10,2)").cast("string"), "event_type")
    )
    return events.select(
        "event_id",
        coerce.int_value(value).alias("whole"),
        coerce.float_value(value).cast("decimal(12,2)").alias("number"),
        coerce.zero_to_null(F.col("user_id")).alias("reference"),
    )


@registered
def sanitized_pages(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", text.sanitized(F.col("html")).alias("body"))


@registered
def text_fields(spark, folder):
    """Money text, first word, dash for empty, fixed width, membership and range over customers."""
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    balance = F.col("c_acctbal")
    empty = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return customer.select(
        "c_custkey",
        text.money_text("Rs.", balance.cast("decimal(10,2)")).alias("balance"),
        text.first_word(F.concat("c_mktsegment", F.lit(" "), "c_name")).alias("first_word"),
        text.or_dash(empty).alias("segment"),
        text.fixed_width(F.col("c_name"), 12, 20).alias("cell"),
        coerce.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("listed"),
        coerce.in_range(balance, 0, 100).alias("small"),
        coerce.or_default(empty, "none").alias("filled"),
    )


@registered
def valid_emails(spark, folder):
    """Addresses spelled from customers and segments, some of them broken."""
    at = F.when(F.col("c_nationkey") > 20, "").when(F.col("c_nationkey") > 18, "@@").otherwise("@")
    host = F.when(F.col("c_nationkey") == 4, "shop").when(F.col("c_nationkey") == 5, "a..b").otherwise("shop.example")
    name = F.when(F.col("c_nationkey") == 6, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "."))
    email = F.concat(name, at, host)
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey", email.alias("email"), text.is_email(email).alias("valid")
    )


@registered
def json_round_trip(spark, folder):
    """Bill documents written as JSON text, read back, and split into drafts and lines."""
    bills = samples.bills(spark, folder).select(
        F.col("id").alias("seq"),
        F.col("customer_id"),
        F.col("customer_name"),
        F.col("total_amount").cast("double"),
        F.col("payment_method"),
        F.array(F.struct(F.col("id").alias("product_id"), F.lit(2.0).alias("quantity"))).alias("items"),
    )
    encoded = as_json(bills.drop("seq"), "body").withColumn("seq", F.get_json_object("body", "$.items[0].product_id"))
    drafts, lines = split_documents(parse_bill_documents(encoded))
    return drafts.join(lines.select("seq", "pos", "product_id", "quantity"), "seq").select(
        F.col("seq").cast("long").alias("seq"),
        "customer_id",
        "customer_name",
        F.col("total_amount").cast("decimal(10,2)").alias("total_amount"),
        "payment_method",
        F.col("pos").cast("long").alias("pos"),
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
    )


# ---- table maintenance


def _outcomes(outcomes):
    return outcomes.select("seq", "id", "status", F.array_join("reasons", "; ").alias("reasons"))


@registered
def create_products(spark, folder):
    new, _ = changes.create_products(samples.products(spark, folder), requests.new_products(spark, folder))
    return new


@registered
def create_products_outcomes(spark, folder):
    _, outcomes = changes.create_products(samples.products(spark, folder), requests.new_products(spark, folder))
    return _outcomes(outcomes)


@registered
def upsert_products(spark, folder):
    new, _ = changes.replace_products(samples.products(spark, folder), requests.product_changes(spark, folder))
    return new


@registered
def upsert_products_outcomes(spark, folder):
    _, outcomes = changes.replace_products(samples.products(spark, folder), requests.product_changes(spark, folder))
    return _outcomes(outcomes)


@registered
def soft_delete_products(spark, folder):
    new, _ = changes.soft_delete(samples.products(spark, folder), requests.product_removals(spark, folder))
    return new.select("id", "name", "is_active")


@registered
def soft_delete_products_outcomes(spark, folder):
    _, outcomes = changes.soft_delete(samples.products(spark, folder), requests.product_removals(spark, folder))
    return _outcomes(outcomes)


@registered
def create_customers(spark, folder):
    new, _ = changes.create_customers(samples.customers(spark, folder), requests.new_customers(spark, folder))
    return new


@registered
def replace_customers(spark, folder):
    new, _ = changes.replace_customers(samples.customers(spark, folder), requests.customer_changes(spark, folder))
    return new


@registered
def soft_delete_customers(spark, folder):
    new, _ = changes.soft_delete(samples.customers(spark, folder), requests.customer_removals(spark, folder))
    return new.select("id", "name", "is_active")


@registered
def edit_bills(spark, folder):
    new, _ = changes.edit_bills(samples.bills(spark, folder), requests.bill_patches(spark, folder))
    return new.select("id", "customer_name", "payment_method", "payment_status")


@registered
def edit_bills_outcomes(spark, folder):
    _, outcomes = changes.edit_bills(samples.bills(spark, folder), requests.bill_patches(spark, folder))
    return _outcomes(outcomes)


@registered
def create_users(spark, folder):
    new, _ = changes.create_users(samples.users(spark, folder), requests.new_users(spark, folder))
    return new.drop("last_login")


@registered
def create_users_outcomes(spark, folder):
    _, outcomes = changes.create_users(samples.users(spark, folder), requests.new_users(spark, folder))
    return _outcomes(outcomes)


@registered
def users_patch(spark, folder):
    new, _ = changes.patch_users(samples.users(spark, folder), requests.user_patches(spark, folder))
    return new.drop("last_login")


@registered
def users_patch_outcomes(spark, folder):
    _, outcomes = changes.patch_users(samples.users(spark, folder), requests.user_patches(spark, folder))
    return _outcomes(outcomes)


def _without_users(spark, folder):
    tables = {"users": samples.users(spark, folder), "bills": samples.bills(spark, folder)}
    return changes.delete_rows(tables, "users", requests.user_removals(spark, folder))


@registered
def users_hard_delete(spark, folder):
    return _without_users(spark, folder)["users"].drop("last_login")


@registered
def users_hard_delete_outcomes(spark, folder):
    _, outcomes = changes.hard_delete(samples.users(spark, folder), requests.user_removals(spark, folder))
    return _outcomes(outcomes)


@registered
def set_null_on_delete(spark, folder):
    return _without_users(spark, folder)["bills"].select("id", "bill_number", "created_by")


@registered
def cascade_delete(spark, folder):
    pending = samples.bills(spark, folder).filter("payment_status = 'pending'")
    return changes.cascade_delete(samples.bill_items(spark, folder), "bill_id", pending)


@registered
def assign_ids(spark, folder):
    """Paid bills numbered after the highest supplier key."""
    rows = requests.paid_bills(spark, folder).withColumnRenamed("id", "seq")
    return numbering.assign_ids(rows, samples.users(spark, folder)).select("seq", "id", "bill_number")


@registered
def apply_defaults(spark, folder):
    """Customers as bare product rows: everything else comes from the column defaults."""
    rows = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("price"),
        F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")).alias("stock"),
        F.when(F.col("c_nationkey") < 6, F.col("c_mktsegment")).alias("category"),
    )
    return changes.apply_defaults(rows, "products", None).drop("created_at", "updated_at")


@registered
def change_status(spark, folder):
    """Which lines a discount really changes, null comparing equal to null."""
    items = samples.bill_items(spark, folder)
    before = F.struct(F.nullif("discount_percentage", F.lit(0)).alias("discount"), F.col("quantity").alias("quantity"))
    after = F.struct(
        F.nullif(F.col("discount_percentage") - F.when(F.col("is_return"), 0).otherwise(1), F.lit(0)).alias("discount"),
        F.greatest("quantity", F.lit(10)).alias("quantity"),
    )
    status = changes.change_status(before, after, ["discount", "quantity"])
    return items.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"))


# ---- validation


@registered
def validate_bills(spark, folder):
    """Bills as drafts checked against the posting rules: the rejects with their reasons."""
    items = samples.bill_items(spark, folder).groupBy(F.col("bill_id").alias("id")).agg(F.count(F.lit(1)).alias("item_count"))
    drafts = (
        samples.bills(spark, folder)
        .join(items, "id", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .withColumn("total_amount", F.col("total_amount") - 20000)
        .withColumn("payment_method", F.when(F.col("payment_method") == "credit", "cheque").otherwise(F.col("payment_method")))
        .withColumn("customer_phone", F.repeat("payment_status", 3))
    )
    rules = validate.bill_rules() + validate.enum_rules("bills") + validate.length_rules("bills", ["customer_phone"])
    _, rejects = validate.validate(drafts, rules)
    return rejects.select("id", "item_count", F.array_join("reasons", "; ").alias("reasons"))


@registered
def validate_cart_lines(spark, folder):
    lines = requests.cart_lines(spark, folder).withColumn("product_id", coerce.zero_to_null(F.col("product_id")))
    lines = lines.withColumn("quantity", F.col("quantity") - 1).withColumn(
        "product_name", F.when(F.col("product_id").isNotNull(), F.col("product_name")).otherwise(" ")
    )
    _, rejects = validate.validate(lines, validate.cart_line_rules())
    return rejects.select("bill_id", "position", F.array_join("reasons", "; ").alias("reasons"))


@registered
def duplicate_keys(spark, folder):
    """Customer segments as names that must be unique: who comes too late."""
    rows = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("username"),
    )
    existing = spark.read.parquet(f"{folder}/nation.parquet").select(
        F.concat(F.lit("BUILDING"), F.col("n_nationkey").cast("string")).alias("username")
    ).filter("username != 'BUILDING7'")
    return validate.first_use(rows, "username", "seq", existing)


@registered
def missing_parents(spark, folder):
    """Suppliers of sold lines that are not active users."""
    active = samples.users(spark, folder).filter("is_active")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return validate.missing_parents(lines, "l_suppkey", active)


# ---- posting and deleting bills


@registered
def bill_numbers(spark, folder):
    """Unpaid bills numbered after the paid ones of the same day."""
    paid = requests.paid_bills(spark, folder).withColumnRenamed("id", "seq").drop("bill_number")
    none = empty_table(spark, "bill_number string")
    existing = staged(numbering.assign_bill_numbers(paid, none).select("bill_number"))
    drafts = requests.open_bills(spark, folder).withColumnRenamed("id", "seq").drop("bill_number")
    return numbering.assign_bill_numbers(drafts, existing).select("seq", "bill_number")


def _post(spark, folder):
    paid = requests.paid_bills(spark, folder)
    missing = [f for f in BILLS.fields if f.name not in paid.columns]
    existing = paid.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    return posting.Posting(
        requests.bill_drafts(spark, folder),
        staged(
            requests.draft_lines(spark, folder).join(
                requests.open_bills(spark, folder).select(F.col("id").alias("seq")), "seq", "left_semi"
            )
        ),
        samples.products(spark, folder),
        samples.customers(spark, folder),
        existing,
        empty_table(spark, BILL_ITEMS),
    )


@registered
def post_bills_outcomes(spark, folder):
    outcomes = _post(spark, folder).outcomes
    return outcomes.select("seq", "status", "id", "bill_number", F.array_join("reasons", "; ").alias("reasons"))


def _counts(spark, counts):
    """Counts by name as rows; there are as many as rules."""
    return spark.createDataFrame(sorted(counts.items()), "what string, n long").filter("n > 0")


@registered
def post_bills_counts(spark, folder):
    """Drafts created and rejected, by reason, and lines sold and skipped, as counted while they were stored."""
    batch = _post(spark, folder)
    return _counts(spark, {**batch.outcome_counts, **batch.store_sold()[1]})


@registered
def post_bills_headers(spark, folder):
    bills = _post(spark, folder).bills
    return bills.select("id", "bill_number", "customer_id", "customer_name", "total_amount", "payment_method", "is_return")


@registered
def post_bills_items(spark, folder):
    items = _post(spark, folder).bill_items
    return items.select("id", "bill_id", "product_id", "product_name", "quantity", "unit_price", "discount_amount", "subtotal")


@registered
def post_bills_sold(spark, folder):
    return _post(spark, folder).sold


@registered
def post_bills_stock(spark, folder):
    return _post(spark, folder).products.select("id", "stock")


@registered
def post_bills_customers(spark, folder):
    return _post(spark, folder).customers.select("id", "total_orders", "total_spent")


def _delete(spark, folder):
    tables = {
        "bills": samples.bills(spark, folder),
        "bill_items": samples.bill_items(spark, folder),
        "products": samples.products(spark, folder),
    }
    return posting.delete_bills(tables, samples.bills(spark, folder).filter("payment_status = 'partial'"))


@registered
def delete_bills_stock(spark, folder):
    return _delete(spark, folder)["products"].select("id", "stock")


@registered
def delete_bills_remaining(spark, folder):
    remaining = _delete(spark, folder)
    bills = remaining["bills"].agg(F.count(F.lit(1)).alias("row_count"), F.sum("total_amount").alias("amount"))
    items = remaining["bill_items"].agg(F.count(F.lit(1)).alias("row_count"), F.sum("subtotal").alias("amount"))
    kind = "decimal(38,2)"
    return (
        bills.select(F.lit("bills").alias("table_name"), "row_count", F.col("amount").cast(kind).alias("amount"))
        .unionByName(items.select(F.lit("bill_items").alias("table_name"), "row_count", F.col("amount").cast(kind).alias("amount")))
    )


# ---- searches by index, many terms at once


@registered
def product_search_terms(spark, folder):
    """The first fifty active products for every term, found in name or barcode."""
    products = requests.accented_products(spark, folder).filter("is_active")
    index = staged(search.gram_index(products, ["name", "barcode"]))
    found = search.matches(requests.product_terms(spark, folder), index, products, ["name", "barcode"])
    return search.best_matches(found, products, [loose(F.col("name")), F.col("id")], 50).select("term", "rank", "id", "name")


@registered
def bill_search_terms(spark, folder):
    """The newest hundred bills for every term, found in number or customer name."""
    bills = samples.bills(spark, folder)
    index = staged(search.gram_index(bills, ["bill_number", "customer_name"]))
    found = search.matches(requests.bill_terms(spark, folder), index, bills, ["bill_number", "customer_name"])
    return search.best_matches(found, bills, [F.desc("created_at"), F.desc("id")], 100).select("term", "rank", "id", "bill_number")


# ---- differences, and states kept up to date by them


def _bill_versions(spark, folder):
    """Bills before and after a batch: every thirteenth is posted by it, some are edited, some are deleted."""
    bills = samples.bills(spark, folder)
    edited, _ = changes.edit_bills(bills, requests.method_changes(spark, folder))
    doomed = bills.filter((F.col("payment_status") == "partial") & (F.col("id") % 4 == 1)).select("id")
    after = changes.delete_rows({"bills": edited}, "bills", doomed)["bills"]
    return bills.filter(F.col("id") % 13 != 5), after


def _bill_changes(spark, folder):
    before, after = _bill_versions(spark, folder)
    return before, staged(diff.change_set(before, after))


@registered
def bill_changes(spark, folder):
    """What the batch changes, value by value."""
    return diff.changed_values(_bill_changes(spark, folder)[1])


@registered
def bill_changes_applied(spark, folder):
    """The old bills with the change set applied."""
    return _stamped(diff.apply_changes(*_bill_changes(spark, folder)))


def _standing(spark, folder):
    before, changed = _bill_changes(spark, folder)
    stored = {name: staged(state) for name, state in standing.states(before).items()}
    return standing.advanced(stored, changed)


def _standing_sales(name, **options):
    def query(spark, folder):
        report = standing.sales_report(_standing(spark, folder)["daily_sales"], **options)
        return report.withColumn("period", F.col("period").cast("string"))

    QUERIES[name] = query


_standing_sales("standing_sales_day", group_by="day")
_standing_sales("standing_sales_week", group_by="week")
_standing_sales("standing_sales_range", group_by="month", start="1997-12-20", end="1999-01-10")


@registered
def standing_dashboard(spark, folder):
    return standing.dashboard_sales(_standing(spark, folder)["daily_sales"], AS_OF)


@registered
def standing_counters(spark, folder):
    sums = _standing(spark, folder)["customer_sums"]
    return standing.counters(samples.customers(spark, folder), sums).select("id", "total_orders", "total_spent")


@registered
def standing_recent_orders(spark, folder):
    """Every customer's newest bills after the batch, from the lists kept before it."""
    before, changed = _bill_changes(spark, folder)
    kept = newest.advanced(staged(newest.state(before)), changed, diff.apply_changes(before, changed))
    return _stamped(newest.recent_orders(kept))


# ---- numbering from high-water marks


@registered
def assign_ids_after(spark, folder):
    """Paid bills numbered after the highest supplier key, which a mark holds."""
    rows = requests.paid_bills(spark, folder).withColumnRenamed("id", "seq")
    marks = staged(numbering.marks_of({"users": samples.users(spark, folder)}))
    return numbering.assign_ids_after(rows, marks, "users").select("seq", "id", "bill_number")


@registered
def bill_numbers_after(spark, folder):
    """Unpaid bills numbered after the paid ones of the same day, from the marks that the paid ones left."""
    paid = requests.paid_bills(spark, folder).withColumnRenamed("id", "seq").drop("bill_number")
    none = numbering.marks_of({"bills": empty_table(spark, "id long, bill_number string")})
    existing = staged(numbering.assign_bill_numbers_after(paid, none).select(F.col("seq").alias("id"), "bill_number"))
    marks = staged(numbering.advanced_marks(none, {"bills": existing}))
    drafts = requests.open_bills(spark, folder).withColumnRenamed("id", "seq").drop("bill_number")
    return numbering.assign_bill_numbers_after(drafts, marks).select("seq", "bill_number")


# ---- months rewritten one by one


@registered
def edit_bills_monthly(spark, folder):
    """The bills of `edit_bills`, stored by month; only the months of patched bills are rewritten."""
    path, patches = scratch(spark), requests.bill_patches(spark, folder)
    monthly.write_bills(samples.bills(spark, folder), path)
    monthly.update_bills(spark, path, lambda bills: changes.edit_bills(bills, patches)[0], patches)
    return monthly.read(spark, path).select("id", "customer_name", "payment_method", "payment_status")


@registered
def delete_bills_monthly(spark, folder):
    """What `delete_bills_remaining` leaves, from bills and items stored by month."""
    bills, items = samples.bills(spark, folder), samples.bill_items(spark, folder)
    bills_path, items_path = scratch(spark), scratch(spark)
    monthly.write_bills(bills, bills_path)
    monthly.write_items(items, bills, items_path)
    monthly.delete_bills(spark, bills_path, items_path, bills.filter("payment_status = 'partial'"))
    sums = [
        monthly.read(spark, path).agg(F.count(F.lit(1)).alias("row_count"), F.sum(amount).cast("decimal(38,2)").alias("amount")).select(F.lit(name).alias("table_name"), "*")
        for name, path, amount in (("bills", bills_path, "total_amount"), ("bill_items", items_path, "subtotal"))
    ]
    return sums[0].unionByName(sums[1])


# ---- bills and items in buckets of the bill's id


def _bucketed(spark, folder, *columns):
    bills, items = samples.bills(spark, folder).select(*columns), samples.bill_items(spark, folder)
    path = scratch(spark)
    return bucketed.write(spark, bills, items, path, f"store_{path[-32:]}", bucketed.bucket_count(items))


@registered
def bill_lines_bucketed(spark, folder):
    """The rows of `bill_items_flat`, from bucketed tables."""
    store = _bucketed(spark, folder, "id", "bill_number", "customer_name", "total_amount", "created_by")
    return bucketed.bill_lines(store, samples.users(spark, folder))


@registered
def bill_documents_bucketed(spark, folder):
    """The rows of `bill_documents`, from bucketed tables."""
    store = _bucketed(spark, folder, "id", "bill_number", "total_amount", "created_by")
    documents = bucketed.bill_documents(store, samples.users(spark, folder), samples.LINE_ORDER)
    line = F.transform("items", _line)
    return documents.select("id", "bill_number", "cashier_name", "part", "parts", F.array_join(line, ",").alias("items"))


# ---- request bodies field by field


@registered
def bodies_read(spark, folder):
    documents, _ = parse_bodies(requests.request_bodies(spark, folder))
    quantity = F.aggregate("items", F.lit(0.0), lambda total, item: total + item["quantity"])
    return documents.select(
        "seq",
        "customer_id",
        "customer_name",
        F.col("total_amount").cast("decimal(12,2)").alias("total_amount"),
        F.size("items").alias("item_count"),
        quantity.cast("int").alias("quantity"),
    )


@registered
def bodies_rejected(spark, folder):
    return parse_bodies(requests.request_bodies(spark, folder))[1].select("seq", "reason")


# ---- stock as the state of a stream


@registered
def stream_sold(spark, folder):
    """The lines of `post_bills_sold`, which arrive in three parts and are sold part by part."""
    items = _post(spark, folder).bill_items
    lines = staged(items.filter("product_id is not null").select(F.col("id").alias("line_id"), "product_id", F.col("quantity").cast("long").alias("quantity")))
    last = lines.agg(F.max("line_id")).first()[0] or 0
    inbox, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for part in range(3):
        own = lines.filter(F.least(F.floor(F.col("line_id") * 3 / (last + 1)), F.lit(2)) == part)
        own.write.mode("append").parquet(inbox)
        # All files that have arrived are one micro-batch.
        stream = spark.readStream.schema(lines.schema).parquet(inbox)
        sell_available(stream, samples.products(spark, folder), out, checkpoint, partitions=4)
    return spark.read.parquet(out).drop("stock")
