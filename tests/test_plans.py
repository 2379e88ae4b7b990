"""The plans that keep the jobs fast at scale."""

import re

from brisktill.operators import reads
from brisktill.plans import dashboard, reports
from brisktill.registry import queries
from brisktill.sources import samples


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_ranges_and_columns_reach_the_scan(spark, folder):
    text = plan(reports.sales_report(samples.bills(spark, folder), "1997-01-01", "1997-12-31", "month"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def test_dashboard_reads_one_month_of_bills_once(spark, folder):
    text = plan(dashboard.summary(samples.bills(spark, folder), samples.customers(spark, folder), samples.products(spark, folder), queries.AS_OF))
    assert text.count("orders.parquet") == 1 and "GreaterThanOrEqual(o_orderdate" in text


def test_inventory_does_not_read_bills_and_sums_items_before_the_join(spark, folder):
    text = plan(reports.inventory_report(samples.products(spark, folder), samples.bill_items(spark, folder)))
    assert "orders.parquet" not in text and text.index("Join") < text.index("partial_sum")


def test_limits_are_top_k(spark, folder):
    text = plan(reads.bill_list(samples.bills(spark, folder), samples.users(spark, folder)))
    assert text.count("TakeOrderedAndProject") >= 1
    assert text.rindex("TakeOrderedAndProject") > text.index("Join")


def test_recent_orders_are_cut_before_the_shuffle(spark, folder):
    text = plan(reads.recent_per_customer(samples.bills(spark, folder)))
    assert text.index("Exchange") < text.index("row_number(), 10, Partial")


def test_lookup_by_id_reaches_both_scans(spark, folder):
    text = plan(reads.customer_documents(samples.customers(spark, folder), samples.bills(spark, folder), wanted=5))
    assert re.search(r"c_custkey#\d+L = 5", text) and "EqualTo(o_custkey,5)" in text


def test_no_query_plans_a_cartesian_product(spark, folder):
    for name in ("dashboard_bundle", "assign_ids", "bill_numbers", "customer_documents", "users_hard_delete"):
        text = plan(queries.QUERIES[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
