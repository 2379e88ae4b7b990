import datetime
import os

import pytest
from pyspark.sql import functions as F

from brisktill.operators.stock import apply_stock
from brisktill.sources import monthly
from brisktill.sources.documents import parse_bodies
from brisktill.sources.tables import VersionTaken, _claim, publish, published_version, read_published
from brisktill.streaming import stock
from brisktill.streaming.stock import sell_available

BILLS = "id long, created_at timestamp_ntz, customer_name string"


@pytest.fixture
def store(frame, tmp_path):
    days = [datetime.datetime(2024, m, d, 9) for m in (1, 2, 3, 4) for d in (1, 20)] + [None]
    bills = frame([(i, day, f"c{i}") for i, day in enumerate(days, 1)], BILLS)
    items = frame([(b, p) for b in range(1, 11) for p in (1, 2)], "bill_id long, product_id long")
    paths = str(tmp_path / "bills"), str(tmp_path / "items")
    monthly.write_bills(bills, paths[0], 2)
    monthly.write_items(items, bills, paths[1])
    return paths


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def months(paths):
    return {p.split(f"{monthly.MONTH}=")[1].split("/")[0] for p in paths}


def test_untouched_months_keep_their_files(spark, frame, store):
    before = files(store[0])
    rename = lambda bills: bills.withColumn("customer_name", F.when(F.col("id").isin(3, 9), "new").otherwise(F.col("customer_name")))
    changes = monthly.update_bills(spark, store[0], rename, frame([(3,), (9,), (99,)], "id long"))
    assert sorted((r["id"], r["operation"], r["changed"]) for r in changes.collect()) == [(3, "update", ["customer_name"]), (9, "update", ["customer_name"])]
    after = files(store[0])
    assert months(set(before) - set(after)) == {"2024-02", "none"}
    assert all(after[p] == before[p] for p in before if p in after) and months(set(before) & set(after)) == {"2024-01", "2024-03", "2024-04"}
    assert {r["id"]: r["customer_name"] for r in monthly.read(spark, store[0]).collect()} == {i: "new" if i in (3, 9) else f"c{i}" for i in range(1, 10)}


def test_a_bill_may_move_to_another_month_and_empty_months_go(spark, frame, store):
    moved = datetime.datetime(2024, 4, 5)
    change = lambda bills: bills.withColumn("created_at", F.when(F.col("id").isin(1, 2), F.lit(moved)).otherwise(F.col("created_at")))
    monthly.update_bills(spark, store[0], change, frame([(1,), (2,)], "id long"))
    assert months(files(store[0])) == {"2024-02", "2024-03", "2024-04", "none"}
    found = monthly.read(spark, store[0])
    assert found.count() == 9 and found.filter(F.col("created_at") == F.lit(moved)).count() == 2


def test_deleting_takes_the_items_along(spark, frame, store):
    before = [files(p) for p in store]
    gone = monthly.delete_bills(spark, *store, frame([(5,), (6,), (7,), (50,)], "id long"))
    assert rows(gone) == [(b, p) for b in (5, 6, 7) for p in (1, 2)]
    assert rows(monthly.read(spark, store[0]).select("id")) == [(i,) for i in (1, 2, 3, 4, 8, 9)]
    assert rows(monthly.read(spark, store[1]).select("bill_id").distinct()) == [(i,) for i in (1, 2, 3, 4, 8, 9)]
    for path, old in zip(store, before, strict=True):
        assert months(set(old) - set(files(path))) == {"2024-03", "2024-04"}
    assert monthly.delete_bills(spark, *store, frame([(50,)], "id long")).count() == 0


def test_a_second_writer_of_a_version_is_refused(spark, frame, tmp_path):
    root = str(tmp_path)
    one = frame([(1,)], "id long")
    publish(spark, root, {"a": one})
    _claim(spark, root, 2, "somebody else", False)
    with pytest.raises(VersionTaken):
        publish(spark, root, {"a": one.limit(0)})
    with pytest.raises(VersionTaken):
        publish(spark, root, {"a": one.limit(0)}, version=2, owner="me")
    assert published_version(spark, root) == 1 and not os.path.exists(f"{root}/2")
    assert publish(spark, root, {"a": one}, version=2, owner="somebody else") == 2
    _claim(spark, root, 3, "broke off", False)
    assert publish(spark, root, {"a": one.limit(0)}, takeover=True) == 3
    assert read_published(spark, root)["a"].count() == 0


BODIES = [
    (1, '{"customer_name": "A", "customer_id": "12abc", "total_amount": "9.5 EUR", "items": [{"product_id": 3, "quantity": "2 pcs"}, {}]}'),
    (2, '{"a":'), (3, "[1]"), (4, None), (5, '{"items": 3}'), (6, '{"items":[1]}'), (7, "{}"), (9, " "), (11, "null"), (12, '"text"'),
    (8, '{"customer_name": 12, "customer_email": {"x":1}, "total_amount": true, "items": null}'), (10, '{"items": [], "customer_id": 5.9, "subtotal": [1]}'),
]


def test_bodies_are_read_field_by_field_or_rejected_with_a_reason(frame):
    documents, rejects = parse_bodies(frame(BODIES, "seq long, body string"))
    assert {r["seq"]: r["reason"] for r in rejects.collect()} == {
        2: "not JSON", 3: "not an object", 4: "no body", 5: "items is not a list", 6: "an item is not an object",
        9: "no body", 11: "not an object", 12: "not an object",
    }
    found = {r["seq"]: r for r in documents.collect()}
    assert set(found) == {1, 7, 8, 10}
    assert (found[1]["customer_id"], found[1]["customer_name"], found[1]["total_amount"]) == (12, "A", 9.5)
    assert [(i["product_id"], i["quantity"], i["product_name"]) for i in found[1]["items"]] == [(3, 2.0, None), (0, 0.0, None)]
    assert (found[8]["customer_name"], found[8]["customer_email"], found[8]["total_amount"]) == ("12", None, 1.0)
    assert (found[10]["customer_id"], found[10]["subtotal"], found[10]["items"]) == (5, 0.0, [])
    assert documents.limit(0).count() == 0


def test_stock_state_goes_on_after_a_restart(spark, frame, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    schema = "line_id long, product_id long, quantity long"
    parts = [[(1, 1, 3), (2, 1, 9), (3, 2, 1), (4, None, 1)], [(6, 1, 2), (5, 1, 6), (7, 9, 1)], [(8, 1, 0), (9, 1, 1), (10, 2, 4), (11, 2, None)]]
    products = frame([(1, 10), (2, 5), (3, 1)], "id int, stock int")
    for part in parts[:2]:
        frame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    sell_available(stream(), products, out, checkpoint, partitions=2)
    frame(parts[2], schema).coalesce(1).write.mode("append").parquet(inbox)
    # The state is the stream's by now, whatever the products say.
    sell_available(stream(), products.limit(0), out, checkpoint, partitions=2)
    found = {r["line_id"]: (r["accepted"], r["stock"]) for r in spark.read.parquet(out).collect()}
    assert found == {1: (True, 7), 2: (False, 7), 3: (True, 4), 5: (True, 1), 6: (False, 1), 7: (False, None), 8: (True, 1), 9: (True, 0), 10: (True, 0), 11: (False, 0)}


def test_state_of_a_stream_is_kept_per_shelf_of_products(spark, frame, tmp_path, monkeypatch):
    schema = "line_id long, product_id long, quantity long"
    lines = [(n, 1 + n * 7 % 40, 1 + n % 5) for n in range(400)]
    products = frame([(p, 30 + p) for p in range(1, 38)] + [(None, 5), (38, None)], "id int, stock int")
    monkeypatch.setattr(stock, "SHELVES", 3)
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    for part in (lines[:200], lines[200:]):
        frame(part, schema).repartition(4).write.mode("append").parquet(inbox)
        sell_available(spark.readStream.schema(schema).parquet(inbox), products, out, checkpoint, partitions=2)
    sold = {r["line_id"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    expected = apply_stock(frame(lines, schema), products.filter("id is not null"))
    assert sold == {r["line_id"]: r["accepted"] for r in expected.lines.collect()}
