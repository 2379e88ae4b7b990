from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brisktill.operators import reads
from brisktill.plans import dashboard, reports
from brisktill.sources import samples


@pytest.fixture(scope="module")
def bills(spark):
    rows = [
        (1, "2024-12-31 23:59:59", "10.00", "cash"),
        (2, "2025-01-01 00:00:00", "5.01", "card"),
        (3, "2025-01-05 12:00:00", "1.00", None),
        (4, "2025-01-06 00:00:00", "2.00", "upi"),
    ]
    df = spark.createDataFrame(rows, "id long, created_at string, total_amount string, payment_method string")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn(
        "total_amount", F.col("total_amount").cast("decimal(10,2)")
    )


def test_a_week_across_new_year_takes_the_earliest_bills_year(bills):
    rows = reports.sales_report(bills, group_by="week").collect()
    assert [(r["period"], r["period_label"], r["bill_count"]) for r in rows] == [
        (202501, "2024 Week 01", 3), (202502, "2025 Week 02", 1),
    ]
    assert rows[0]["avg_sale"] == Decimal("5.336667")
    assert (rows[0]["cash_sales"], rows[0]["card_sales"], rows[0]["credit_sales"]) == (Decimal("10.00"), Decimal("5.01"), Decimal("0.00"))


def test_date_range_takes_whole_days_and_needs_both_ends(bills):
    assert reports.sales_report(bills, "2024-12-31", "2025-01-01").agg(F.sum("bill_count")).first()[0] == 2
    assert reports.sales_report(bills, "2025-01-05", None, "year").agg(F.sum("bill_count")).first()[0] == 4


def test_day_totals_add_up_to_year_totals(spark, folder):
    table = samples.bills(spark, folder)
    days = reports.sales_report(table).agg(F.sum("total_sales"), F.sum("bill_count")).first()
    years = reports.sales_report(table, group_by="year").agg(F.sum("total_sales"), F.sum("bill_count")).first()
    assert tuple(days) == tuple(years)


def test_method_columns_add_up_to_total_sales(spark, folder):
    report = reports.sales_report(samples.bills(spark, folder), group_by="month")
    parts = sum((F.col(f"{m}_sales") for m in reports.PAYMENT_METHODS), F.lit(0))
    assert report.filter(parts != F.col("total_sales")).count() == 0


def test_unsold_products_stay_in_inventory_and_out_of_the_product_report(spark):
    products = spark.createDataFrame(
        [(1, "A", Decimal("2.00"), 5, "c", True), (2, "B", Decimal("0.00"), 9, "c", True), (3, "C", Decimal("1.00"), 0, "d", True), (4, "D", Decimal("1.00"), 0, "d", False)],
        "id long, name string, price decimal(10,2), stock int, category string, is_active boolean",
    )
    items = spark.createDataFrame(
        [(1, 1, 3, Decimal("5.00")), (1, 2, 1, Decimal("0.00")), (1, 4, 1, Decimal("1.00")), (1, None, 1, Decimal("9.00"))],
        "bill_id long, product_id long, quantity int, subtotal decimal(10,2)",
    )
    rows = reports.inventory_report(products, items).collect()
    assert [(r["id"], r["times_sold"], r["total_qty_sold"]) for r in rows] == [(3, 0, 0), (1, 1, 3), (2, 1, 1)]
    sold = reports.product_report(products, items).collect()
    assert [(r["id"], r["effective_pct"]) for r in sold] == [(1, Decimal("83.333333")), (2, Decimal("100.000000"))]
    assert [r["id"] for r in reports.inventory_report(products, items, low_stock=5).collect()] == [3, 1]
    assert reports.inventory_report(products, items, category="0").count() == 0


def test_dashboard_of_a_day_without_bills(spark, bills):
    customers = spark.createDataFrame([(1, True), (2, False)], "id long, is_active boolean")
    products = spark.createDataFrame([(1, 5, True), (2, 6, True), (3, 1, False)], "id long, stock int, is_active boolean")
    row = dashboard.summary(bills, customers, products, "2025-01-20").first()
    assert tuple(row) == (0, Decimal("0.00"), 3, Decimal("8.01"), 1, 1)
    assert dashboard.summary(bills, customers, products).count() == 1


def test_documents_of_very_large_bills_come_in_parts(spark):
    bills = spark.createDataFrame([(1, 7), (2, None), (3, 7)], "id long, created_by long")
    users = spark.createDataFrame([(7, "kim")], "id long, username string")
    items = spark.createDataFrame([(n, 1, n % 5) for n in range(500)] + [(1000, 2, 1)], "id long, bill_id long, quantity int")
    rows = reads.bill_documents(bills, users, items, part_size=40).collect()
    ones = [r for r in rows if r["id"] == 1]
    assert len(ones) > 8 and {r["parts"] for r in ones} == {13}
    assert sorted(i["id"] for r in ones for i in r["items"]) == list(range(500))
    rest = {r["id"]: (r["cashier_name"], len(r["items"]), r["parts"]) for r in rows if r["id"] != 1}
    assert rest == {2: (None, 1, 1), 3: ("kim", 0, 1)}
    assert reads.bill_documents(bills, users, items, wanted=2).count() == 1


def test_customer_documents_by_id(spark, folder):
    row = reads.customer_documents(samples.customers(spark, folder), samples.bills(spark, folder), wanted=5).collect()
    assert len(row) == 1 and len(row[0]["orders"]) <= 10
    stamps = [o["created_at"] for o in row[0]["orders"]]
    assert stamps == sorted(stamps, reverse=True)
