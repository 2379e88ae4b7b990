"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brisktill.registry.queries import QUERIES  # noqa: E402
from brisktill.session import build_session  # noqa: E402

HEADLINE = (
    "sales_report_day",
    "sales_report_week",
    "sales_report_month",
    "sales_report_range",
    "inventory_report",
    "inventory_low_stock",
    "customer_report",
    "customer_report_min_orders",
    "product_report",
    "product_report_filtered",
    "dashboard_summary",
    "dashboard_recent_bills",
    "product_search",
    "customer_search",
    "bill_search",
    "customer_recent_orders",
    "customer_documents",
    "bill_items_flat",
    "bill_documents",
    "price_lines",
    "bill_totals",
    "customer_stats_rebuild",
    "find_or_create_customers",
    "settings_upsert",
    "upsert_products",
    "users_patch",
    "edit_bills",
    "validate_bills",
    "bill_numbers",
    "post_bills_stock",
    "delete_bills_stock",
)
RUNS = 2


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            # Everything is computed; nothing is brought to the driver.
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, best of runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": RUNS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
