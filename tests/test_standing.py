import datetime
import decimal
import random
import re

import pytest
from test_plans import plan

from brisktill.operators import diff, numbering, posting
from brisktill.plans import dashboard, reports, standing

BILLS = "id long, customer_id long, created_at timestamp_ntz, payment_method string, total_amount decimal(10,2)"


def bill(rng, key):
    day = datetime.datetime(2023, 12, 20) + datetime.timedelta(days=rng.randrange(30), seconds=rng.randrange(86400))
    amount = rng.choice([None, decimal.Decimal(rng.randrange(10**7)) / 100])
    return key, rng.choice([None, 1, 2, 3]), rng.choice([None, day, day]), rng.choice(["cash", "card", "upi", None]), amount


@pytest.fixture(scope="module")
def versions(spark):
    rng = random.Random(4)
    old = [bill(rng, i) for i in range(200)]
    new = [r if rng.random() < 0.7 else bill(rng, r[0]) for r in old if rng.random() < 0.8] + [bill(rng, i) for i in range(300, 340)]
    return spark.createDataFrame(old, BILLS), spark.createDataFrame(new, BILLS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_changes_lead_from_old_to_new_and_back(versions):
    old, new = versions
    assert rows(diff.apply_changes(old, diff.change_set(old, new))) == rows(new)
    assert rows(diff.apply_changes(new, diff.change_set(new, old))) == rows(old)
    assert diff.change_set(old, old).count() == 0


def test_change_set_names_what_differs(frame):
    schema = "id long, a string, b int"
    old, new = frame([(1, "x", 1), (2, None, 2), (3, "z", None)], schema), frame([(1, "x", 1), (2, "y", 2), (4, None, None)], schema)
    found = {r["id"]: (r["operation"], r["changed"], r["old"] and tuple(r["old"]), r["new"] and tuple(r["new"])) for r in diff.change_set(old, new).collect()}
    assert found == {
        2: ("update", ["a"], (None, 2), ("y", 2)),
        3: ("delete", ["a", "b"], ("z", None), None),
        4: ("insert", ["a", "b"], None, (None, None)),
    }
    listed = rows(diff.changed_values(diff.change_set(old, new)))
    assert listed == sorted([(2, "update", "a", None, "y"), (3, "delete", "a", "z", None), (3, "delete", "b", None, None), (4, "insert", "a", None, None), (4, "insert", "b", None, None)], key=repr)


def test_empty_versions(versions):
    old, _ = versions
    none = old.limit(0)
    assert {r["operation"] for r in diff.change_set(none, old).collect()} == {"insert"}
    assert diff.apply_changes(old, diff.change_set(old, none)).count() == 0
    assert diff.change_set(none, none).count() == 0


@pytest.mark.parametrize("options", [{"group_by": g} for g in ("day", "week", "month", "year")] + [{"start": "2023-12-28", "end": "2024-01-03", "group_by": "week"}])
def test_kept_state_gives_the_report_of_all_bills(versions, options):
    old, new = versions
    kept = standing.advanced(standing.states(old), diff.change_set(old, new))
    assert standing.sales_report(kept["daily_sales"], **options).collect() == reports.sales_report(new, **options).collect()


def test_kept_state_gives_dashboard_and_counters(versions, frame):
    old, new = versions
    kept = standing.advanced(standing.states(old), diff.change_set(old, new))
    for day in ("2023-12-31", "2024-01-02", "2030-01-01"):
        ours = standing.dashboard_sales(kept["daily_sales"], day).first()
        assert tuple(ours) == (*dashboard.sales_on(new, day).first(), *dashboard.sales_in_month(new, day).first())
    people = frame([(i, f"p{i}", 9, decimal.Decimal("1.00")) for i in range(5)], "id long, name string, total_orders int, total_spent decimal(12,2)")
    counted = rows(posting.rebuild_counters(people, new).select("id", "total_orders", "total_spent"))
    assert rows(standing.counters(people, kept["customer_sums"]).select("id", "total_orders", "total_spent")) == counted


def test_state_of_all_deleted_bills_is_empty(versions):
    old, _ = versions
    kept = standing.advanced(standing.states(old), diff.change_set(old, old.limit(0)))
    assert all(state.count() == 0 for state in kept.values())


def test_marks_follow_the_tables(frame, tmp_path):
    drafts = "seq long, created_at timestamp_ntz"
    day = datetime.datetime(2024, 5, 1, 10)
    bills = frame([(7, "BILL-20240501-0041"), (9, "BILL-20240502-0003"), (8, "odd")], "id long, bill_number string")
    new = frame([(1, day), (2, day), (3, day + datetime.timedelta(days=2))], drafts)
    marks = numbering.marks_of({"bills": bills})
    assert rows(marks) == [("BILL-20240501", 41), ("BILL-20240502", 3), ("bills", 9)]
    assert rows(numbering.assign_bill_numbers_after(new, marks)) == rows(numbering.assign_bill_numbers(new, bills))
    assert rows(numbering.assign_ids_after(new, marks, "bills")) == rows(numbering.assign_ids(new, bills))
    assert rows(numbering.assign_ids_after(new, marks, "users").select("id")) == [(1,), (2,), (3,)]
    more = numbering.advanced_marks(marks, {"bills": frame([(10, "BILL-20240502-0002"), (11, "BILL-20240503-0001")], "id long, bill_number string")})
    assert rows(more) == [("BILL-20240501", 41), ("BILL-20240502", 3), ("BILL-20240503", 1), ("bills", 11)]


def test_numbering_reads_the_marks_only(spark, frame, tmp_path):
    path = str(tmp_path / "stored_bills")
    frame([(7, "BILL-20240501-0041")], "id long, bill_number string").write.parquet(path)
    bills = spark.read.parquet(path)
    marks_path = str(tmp_path / "stored_marks")
    numbering.marks_of({"bills": bills}).write.parquet(marks_path)
    drafts = frame([(1, datetime.datetime(2024, 5, 1))], "seq long, created_at timestamp_ntz")
    files = numbering.assign_bill_numbers_after(drafts, spark.read.parquet(marks_path)).inputFiles()
    assert any("stored_marks" in name for name in files) and not any("stored_bills" in name for name in files)


def test_numbers_of_other_days_are_not_read(spark, frame, tmp_path):
    path = str(tmp_path / "bills")
    numbers = [f"BILL-{20240101 + d}-{n:04d}" for d in range(20) for n in range(1, 30)] + ["BILL-20240105-12345", "BILL-202401051-0001"]
    frame([(n,) for n in numbers], "bill_number string").write.parquet(path)
    drafts = frame([(1, datetime.datetime(2024, 1, 5)), (2, datetime.datetime(2024, 1, 6))], "seq long, created_at timestamp_ntz")
    numbered = numbering.assign_bill_numbers(drafts, spark.read.parquet(path))
    assert rows(numbered.select("bill_number")) == [("BILL-20240105-12346",), ("BILL-20240106-0030",)]
    filters = re.findall(r"PushedFilters: \[[^\]]*", plan(numbered))
    assert any("GreaterThanOrEqual(bill_number,BI" in f for f in filters), filters
