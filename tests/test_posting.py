from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brisktill.operators import posting, pricing
from brisktill.operators.joins import find_or_create_customers
from brisktill.operators.posting import Posting, _line_problems, delete_bills
from brisktill.schemas import BILL_ITEMS, BILL_PAYMENTS, BILLS
from brisktill.sources.documents import parse_bill_documents, read_bill_documents, split_documents
from brisktill.sources.seed import empty_table, seed_tables


@pytest.fixture(scope="module")
def store(spark):
    tables = seed_tables(spark)
    tables["customers"] = spark.createDataFrame(
        [(1, "Ann", "111", 3, Decimal("10.00"), True), (2, "Bob", "222", 0, Decimal("0.00"), True)],
        "id long, name string, phone string, total_orders int, total_spent decimal(12,2), is_active boolean",
    )
    tables["bills"] = empty_table(spark, BILLS)
    tables["bill_items"] = empty_table(spark, BILL_ITEMS)
    tables["bill_payments"] = empty_table(spark, BILL_PAYMENTS)
    return tables


BODIES = [
    # two lines of one product, a manual line and a customer
    """{"customer_id": 1, "customer_name": " Ann ", "items": [
        {"product_id": 10, "product_name": "Android Tablet", "quantity": 6, "unit_price": 25000, "subtotal": 150000},
        {"product_id": 10, "product_name": "Android Tablet", "quantity": 3, "unit_price": 25000, "subtotal": 75000},
        {"product_id": 0, "product_name": "Wrapping", "quantity": 1, "unit_price": 1.005, "subtotal": 1.005}],
        "subtotal": 225001.005, "total_amount": 225001.005}""",
    # no items
    '{"customer_name": "x", "items": [], "total_amount": 5}',
    # wrong method, unknown product and customer
    """{"customer_id": 77, "items": [{"product_id": 999, "quantity": 1}], "total_amount": 5, "payment_method": "cheque"}""",
    # fits what is left of product 10
    """{"items": [{"product_id": 10, "quantity": 2, "subtotal": 50000}], "total_amount": 50000,
        "payment_method": "card", "payment_status": "pending"}""",
    # fractional quantity, amount too large
    """{"items": [{"product_id": 1, "quantity": 1.5}, {"product_id": 1, "quantity": 1, "subtotal": 1e12}], "total_amount": 5}""",
    "not json",
    None,
]


@pytest.fixture(scope="module")
def posted(spark, store):
    bodies = spark.createDataFrame([(n * 100, body) for n, body in enumerate(BODIES)], "seq long, body string")
    documents = parse_bill_documents(bodies).withColumn("created_by", F.lit(2).cast("long"))
    documents = documents.withColumn("created_at", F.lit("2024-03-09 10:00:00").cast("timestamp"))
    drafts, lines = split_documents(documents)
    return Posting(drafts, lines, store["products"], store["customers"], store["bills"], store["bill_items"])


def test_outcomes(posted):
    rows = {r["seq"]: r for r in posted.outcomes.collect()}
    assert (rows[0]["status"], rows[0]["id"], rows[0]["bill_number"]) == ("created", 1, "BILL-20240309-0001")
    assert (rows[300]["status"], rows[300]["id"], rows[300]["bill_number"]) == ("created", 2, "BILL-20240309-0002")
    assert rows[100]["reasons"] == ["no items"]
    assert sorted(rows[200]["reasons"]) == ["payment_method not allowed", "unknown customer", "unknown product"]
    assert sorted(rows[400]["reasons"]) == ["line amount out of range", "quantity must be whole"]
    assert rows[500]["reasons"] == rows[600]["reasons"] == ["no items", "total must be positive"]


def test_bills_take_totals_as_sent_and_round_once(posted):
    bills = {r["id"]: r for r in posted.bills.collect()}
    assert bills[1]["total_amount"] == Decimal("225001.01") and bills[1]["customer_name"] == "Ann"
    assert (bills[1]["payment_method"], bills[1]["payment_status"]) == ("cash", "paid")
    assert bills[2]["customer_name"] == "Walk-in Customer" and bills[2]["customer_id"] is None
    assert bills[2]["created_by"] == 2 and bills[2]["is_return"] is False


def test_items_and_sold_lines(posted):
    items = posted.bill_items.orderBy("id").collect()
    assert [(r["id"], r["bill_id"], r["product_id"], r["quantity"]) for r in items] == [
        (1, 1, 10, 6), (2, 1, 10, 3), (3, 1, None, 1), (4, 2, 10, 2),
    ]
    assert items[2]["unit_price"] == Decimal("1.01")
    assert {r["line_id"]: r["accepted"] for r in posted.sold.collect()} == {1: True, 2: False, 4: True}


def test_stock_and_counters(posted):
    assert {r["id"]: r["stock"] for r in posted.products.collect()}[10] == 0
    counters = {r["id"]: (r["total_orders"], r["total_spent"]) for r in posted.customers.collect()}
    assert counters == {1: (4, Decimal("225011.01")), 2: (0, Decimal("0.00"))}


def test_delete_restores_stock_even_for_skipped_lines(posted, store, spark):
    tables = {**store, "bills": posted.bills, "bill_items": posted.bill_items, "products": posted.products}
    tables["bill_payments"] = spark.createDataFrame([(1, 1, Decimal("5.00"), "cash", None, None), (2, 2, Decimal("5.00"), "cash", None, None)], BILL_PAYMENTS)
    left = delete_bills(tables, spark.createDataFrame([(1,), (1,), (55,)], "id long"))
    assert {r["id"]: r["stock"] for r in left["products"].collect()}[10] == 9
    assert [r["id"] for r in left["bills"].collect()] == [2]
    assert [r["id"] for r in left["bill_items"].collect()] == [4]
    assert [r["id"] for r in left["bill_payments"].collect()] == [2]


def test_delete_of_post_restores_stock_when_nothing_was_skipped(spark, store):
    drafts = spark.createDataFrame([(n, 10.0, "2024-01-01") for n in range(5)], "seq long, total_amount double, day string")
    for column in ("customer_id",):
        drafts = drafts.withColumn(column, F.lit(None).cast("long"))
    for column in ("customer_name", "customer_phone", "customer_email", "customer_address", "payment_method", "payment_status"):
        drafts = drafts.withColumn(column, F.lit(None).cast("string"))
    for column in ("subtotal", "discount_amount", "tax_amount", "shipping_cost"):
        drafts = drafts.withColumn(column, F.lit(0.0))
    drafts = drafts.withColumn("created_by", F.lit(1).cast("long")).withColumn("created_at", F.col("day").cast("timestamp")).drop("day")
    lines = spark.createDataFrame(
        [(n, p, p + 1, "x", 1, 1.0, 0.0, 0.0, 1.0) for n in range(5) for p in range(4)],
        "seq long, pos int, product_id long, product_name string, quantity int, unit_price double, discount_percentage double, discount_amount double, subtotal double",
    )
    done = Posting(drafts, lines, store["products"], store["customers"], store["bills"], store["bill_items"])
    assert done.sold.filter("not accepted").count() == 0
    tables = {"bills": done.bills, "bill_items": done.bill_items, "products": done.products}
    back = delete_bills(tables, done.bills.select("id"))
    before = {r["id"]: r["stock"] for r in store["products"].collect()}
    assert {r["id"]: r["stock"] for r in back["products"].collect()} == before
    assert back["bills"].count() == back["bill_items"].count() == 0


def test_deleted_bills_are_no_longer_referred_to(spark):
    bills = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, original_bill_id long")
    items = spark.createDataFrame(
        [(10, 1, 5, 2, None, False), (11, 2, 5, 1, 10, True), (12, 3, None, 4, 11, False)],
        "id long, bill_id long, product_id long, quantity int, original_item_id long, is_return boolean",
    )
    products = spark.createDataFrame([(5, 0)], "id long, stock int")
    left = delete_bills({"bills": bills, "bill_items": items, "products": products}, spark.createDataFrame([(1,)], "id long"))
    assert {r["id"]: r["original_bill_id"] for r in left["bills"].collect()} == {2: None, 3: 2}
    assert {r["id"]: r["original_item_id"] for r in left["bill_items"].collect()} == {11: None, 12: 11}
    assert left["products"].first()["stock"] == 2


def test_rebuilt_counters_equal_the_customer_report(spark, folder):
    from brisktill.plans.reports import customer_report
    from brisktill.sources import samples

    customers, bills = samples.customers(spark, folder), samples.bills(spark, folder)
    report = customer_report(customers, bills).select("id", "order_count", "total_spent")
    rebuilt = posting.rebuild_counters(customers, bills).filter("is_active and total_orders > 0")
    rebuilt = rebuilt.select("id", "total_orders", F.col("total_spent").cast("decimal(20,2)"))
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, rebuilt.collect()))


def test_find_or_create_customers(spark):
    customers = spark.createDataFrame(
        [(1, "Zed", "1", True), (2, "Amy", "1", True), (3, "Old", "2", False), (4, "Amy", "1", True)],
        "id long, name string, phone string, is_active boolean",
    )
    drafts = spark.createDataFrame(
        [
            (5, "Late", " 2 ", "l@x.y", ""),
            (1, "First", "2", "f@x.y", "road"),
            (2, "Someone", "1", "", ""),
            (3, "Walk-in Customer", "9", "", ""),
            (4, "", "9", "", ""),
            (6, "Nobody", "", "", ""),
            (7, "Other", "3", None, None),
        ],
        "seq long, customer_name string, customer_phone string, customer_email string, customer_address string",
    )
    resolved, created = find_or_create_customers(drafts, customers)
    assert {r["seq"]: r["customer_id"] for r in resolved.collect()} == {1: 5, 5: 5, 2: 2, 3: None, 4: None, 6: None, 7: 6}
    assert sorted(map(tuple, created.collect())) == [(5, "First", "2", "f@x.y", "road"), (6, "Other", "3", "", "")]


def test_nested_totals_equal_line_totals(spark):
    items = [[(2.0, 10.05, 5.0), (1.0, 3.33, 0.0)], [(7.0, 0.99, 33.0)]]
    documents = spark.createDataFrame(
        [(n, rows, 4.5) for n, rows in enumerate(items)],
        "bill_id long, items array<struct<quantity:double,unit_price:double,discount_percentage:double>>, shipping_cost double",
    )
    nested = pricing.document_totals(documents, 13)
    lines = documents.select("bill_id", F.explode("items").alias("i")).select("bill_id", "i.*")
    shipping = documents.select("bill_id", F.col("shipping_cost").cast("decimal(10,2)"))
    flat = pricing.bill_totals(pricing.price_lines(lines), 13, shipping)
    columns = ["bill_id", "subtotal", "discount_amount", "tax_amount", "total_amount"]
    assert sorted(map(tuple, nested.select(columns).collect())) == sorted(map(tuple, flat.select(columns).collect()))
    assert flat.orderBy("bill_id").first()["subtotal"] == Decimal("22.43")  # 19.095 + 3.33


def test_fractional_quantities_are_rejected_and_have_no_price(spark):
    from brisktill.operators.validate import cart_line_rules, validate

    lines = spark.createDataFrame(
        [(1, "x", 1.5, 2.0, 0.0), (None, " ", 0.0, 0.0, 0.0), (2, "", 2.0, 3.0, 10.0)],
        "product_id long, product_name string, quantity double, unit_price double, discount_percentage double",
    )
    valid, rejects = validate(lines, cart_line_rules())
    assert [r["product_id"] for r in valid.collect()] == [2]
    assert {r["product_id"]: r["reasons"] for r in rejects.collect()} == {
        1: ["quantity must be whole"],
        None: ["product required", "quantity required", "price required"],
    }
    priced = {r["product_id"]: r["subtotal"] for r in pricing.price_lines(lines).collect()}
    assert priced == {1: None, None: Decimal("0.00"), 2: Decimal("5.40")}


def test_documents_from_json_files(spark, tmp_path):
    (tmp_path / "bills.json").write_text('{"customer_name": "A", "items": [{"quantity": 2}]}\nbroken\n')
    documents = read_bill_documents(spark, str(tmp_path))
    assert sorted((r["customer_name"] or "", len(r["items"] or [])) for r in documents.collect()) == [("", 0), ("A", 1)]


def test_counts_equal_the_outcomes(posted):
    rows = posted.outcomes.collect()
    counts = {name: n for name, n in posted.outcome_counts.items() if n}
    expected = {"created": 0, "rejected": 0}
    for row in rows:
        expected[row["status"]] += 1
        for reason in row["reasons"]:
            expected[reason] = expected.get(reason, 0) + 1
    assert counts == expected and expected["created"] == 2
    sold, lines = posted.store_sold()
    accepted = [r["accepted"] for r in sold.collect()]
    assert lines == {"sold": sum(accepted), "skipped": len(accepted) - sum(accepted)}


def test_counts_of_nothing(spark, store):
    drafts, lines = split_documents(parse_bill_documents(spark.createDataFrame([], "seq long, body string")))
    drafts = drafts.withColumn("created_by", F.lit(2).cast("long")).withColumn("created_at", F.lit("2024-03-09 10:00:00").cast("timestamp"))
    batch = Posting(drafts, lines, store["products"], store["customers"], store["bills"], store["bill_items"])
    assert set(batch.outcome_counts.values()) == {0}
    assert batch.store_sold()[1] == {"sold": 0, "skipped": 0}


def test_lines_are_not_shuffled_to_find_unknown_products(spark, frame):
    number = F.col("id")
    money = [F.lit(None).cast("decimal(10,2)").alias(c) for c in ("unit_price", "discount_percentage", "discount_amount", "subtotal")]
    lines = spark.range(2_000_000).select(F.floor(number / 4).alias("seq"), (number % 4).alias("pos"), (number % 50).alias("product_id"), F.lit("").alias("product_name"), F.lit(1.0).alias("quantity"), *money)
    found = _line_problems(lines, frame([(i,) for i in range(1, 50)], "id long"))
    assert "Exchange hashpartitioning(_product" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter(F.size("_line_reasons") > 0).count() == 40_000
