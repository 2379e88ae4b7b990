import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brisktill.operators import changes, settings, validate
from brisktill.sources.seed import seed_tables

EARLY = datetime.datetime(2020, 1, 1)
LATE = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    return seed_tables(spark, EARLY)


def status(outcomes):
    return {r["seq"]: (r["status"], list(r["reasons"])) for r in outcomes.collect()}


def test_seed_rows_have_defaults_and_no_passwords(tables):
    assert "password" not in tables["users"].columns
    product = tables["products"].filter("id = 4").first()
    assert (product["name"], product["price"], product["is_active"]) == ("Headphones", Decimal("1500.00"), True)
    assert [tables[t].count() for t in ("users", "products", "settings")] == [3, 10, 8]


def test_replace_products_applies_requests_in_order(spark, tables):
    requests = spark.createDataFrame(
        [
            (1, 1, "A", Decimal("5.00"), 1, "c", None, None),
            (2, 1, "B", Decimal("5.00"), 1, "c", "", ""),
            (3, 1, "B", Decimal("5.00"), 1, "c", None, None),
            (4, 99, "B", Decimal("5.00"), 1, None, None, None),
            (5, 0, "", Decimal("0.00"), 1, None, None, None),
            (6, 2, "Wireless Mouse", Decimal("800.00"), 50, "Accessories", "Logitech Wireless Mouse", None),
            (7, 3, "Cable", Decimal("1.00"), None, None, None, None),
        ],
        "seq long, id long, name string, price decimal(10,2), stock int, category string, description string, barcode string",
    )
    new, outcomes = changes.replace_products(tables["products"], requests, LATE)
    assert status(outcomes) == {
        1: ("updated", []), 2: ("updated", []), 3: ("unchanged", []), 4: ("not_found", []),
        5: ("rejected", ["id required", "name required", "price must be positive"]),
        6: ("updated", []), 7: ("updated", []),
    }
    rows = {r["id"]: r for r in new.collect()}
    assert rows[1]["name"] == "B" and rows[1]["description"] == "" and rows[1]["updated_at"] == LATE
    assert (rows[3]["stock"], rows[3]["category"]) == (0, "Others")
    assert rows[4]["updated_at"] == EARLY


def test_soft_deleted_rows_are_out_of_reach(spark, tables):
    ids = spark.createDataFrame([(1, 3), (2, 3), (3, 50)], "seq long, id long")
    gone, outcomes = changes.soft_delete(tables["products"], ids, LATE)
    assert status(outcomes) == {1: ("updated", []), 2: ("unchanged", []), 3: ("not_found", [])}
    again = spark.createDataFrame(
        [(1, 3, "X", Decimal("1.00"), 1, "c", "", "")],
        "seq long, id long, name string, price decimal(10,2), stock int, category string, description string, barcode string",
    )
    _, outcomes = changes.replace_products(gone, again)
    assert status(outcomes) == {1: ("not_found", [])}


def test_price_that_does_not_fit_is_rejected(spark, tables):
    rows = spark.createDataFrame(
        [(1, "A", 1e12, 1, "c", "", ""), (2, "B", 0.005, 1, "c", "", "")],
        "seq long, name string, price double, stock int, category string, description string, barcode string",
    )
    new, outcomes = changes.create_products(tables["products"], rows)
    assert status(outcomes) == {1: ("rejected", ["price out of range"]), 2: ("created", [])}
    assert new.filter("name = 'B'").first()["price"] == Decimal("0.01")


def test_text_too_long_is_rejected(spark, tables):
    rows = spark.createDataFrame(
        [(1, "n" * 201, Decimal("1.00"), 1, "c" * 51, "", "b" * 50)],
        "seq long, name string, price decimal(10,2), stock int, category string, description string, barcode string",
    )
    _, outcomes = changes.create_products(tables["products"], rows)
    assert status(outcomes) == {1: ("rejected", ["name too long", "category too long"])}


def test_create_users_first_claim_wins_regardless_of_case(spark, tables):
    rows = spark.createDataFrame(
        [(1, "ADMIN", None, "x", None, None), (2, "Éva", None, "x", None, None), (3, "eva", None, "x", None, None), (4, "bob", "king", "x", None, None), (5, "BOB", "manager", "x", None, None)],
        "seq long, username string, role string, full_name string, email string, phone string",
    )
    new, outcomes = changes.create_users(tables["users"], rows)
    assert status(outcomes) == {
        1: ("rejected", ["username taken"]), 2: ("created", []), 3: ("rejected", ["username taken"]),
        4: ("rejected", ["role not allowed"]), 5: ("created", []),
    }
    assert {r["id"]: (r["username"], r["role"]) for r in new.filter("id > 3").collect()} == {4: ("Éva", "cashier"), 5: ("BOB", "manager")}


def test_patch_users(spark, tables):
    patches = spark.createDataFrame(
        [
            (1, 1, "root", "admin", "Root", "", "", None),
            (2, 2, "", "", "", "", "", False),
            (3, 3, "Cashier", "manager", "M", "", "", False),
            (4, 3, "boss", "king", "M", "", "", None),
            (5, 3, "", "king", "", "", "", True),
            (6, 9, "new", "admin", "N", "", "", None),
            (7, 2, "root", "cashier", "C", "", "", True),
        ],
        "seq long, id long, username string, role string, full_name string, email string, phone string, is_active boolean",
    )
    new, outcomes = changes.patch_users(tables["users"], patches)
    assert status(outcomes) == {
        1: ("updated", []), 2: ("updated", []), 3: ("rejected", ["username taken"]), 4: ("rejected", ["role not allowed"]),
        5: ("unchanged", []), 6: ("not_found", []), 7: ("rejected", ["username taken"]),
    }
    rows = {r["id"]: (r["username"], r["is_active"]) for r in new.collect()}
    assert rows == {1: ("root", True), 2: ("cashier", False), 3: ("manager", True)}


def test_edit_bills_replaces_three_columns(spark):
    bills = spark.createDataFrame([(1, "A", "cash", "paid"), (2, "B", "card", "paid")], "id long, customer_name string, payment_method string, payment_status string")
    patches = spark.createDataFrame(
        [(1, 1, None, "upi", "partial"), (2, 2, "B", "card", "paid"), (3, 2, "B", None, "paid")],
        "seq long, id long, customer_name string, payment_method string, payment_status string",
    )
    new, outcomes = changes.edit_bills(bills, patches)
    assert status(outcomes) == {1: ("updated", []), 2: ("unchanged", []), 3: ("rejected", ["payment_method not allowed"])}
    assert tuple(new.filter("id = 1").first()) == (1, "", "upi", "partial")


def test_deleting_users_clears_references(spark, tables):
    bills = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, created_by long")
    payments = spark.createDataFrame([(1, 2)], "id long, created_by long")
    left = changes.delete_rows({"users": tables["users"], "bills": bills, "bill_payments": payments}, "users", spark.createDataFrame([(2,)], "id long"))
    assert sorted(r["id"] for r in left["users"].collect()) == [1, 3]
    assert {r["id"]: r["created_by"] for r in left["bills"].collect()} == {1: None, 2: 1, 3: None}
    assert left["bill_payments"].first()["created_by"] is None


def test_hard_delete_outcomes(spark, tables):
    kept, outcomes = changes.hard_delete(tables["users"], spark.createDataFrame([(1, 2), (2, 2), (3, 8), (4, 0)], "seq long, id long"))
    assert status(outcomes) == {1: ("deleted", []), 2: ("not_found", []), 3: ("not_found", []), 4: ("rejected", ["id required"])}
    assert kept.count() == 2


def test_settings_batches_are_all_or_nothing(spark, tables):
    requests = spark.createDataFrame(
        [
            (1, 0, "tax_rate", "12.50"), (1, 1, "store_name", " Shop "),
            (2, 0, "tax_rate", "101"), (2, 1, "store_name", "Bad"),
            (3, 0, "store_email", "nobody"), (3, 1, "theme", "dark"),
            (4, 0, "store_email", ""), (4, 1, "font", "mono"),
        ],
        "batch long, seq int, setting_key string, setting_value string",
    )
    new, outcomes = settings.upsert_settings(tables["settings"], requests)
    assert {r["batch"]: r["status"] for r in outcomes.collect()} == {1: "saved", 2: "rejected", 3: "rejected", 4: "saved"}
    stored = settings.settings_map(new).first()["settings"]
    assert (stored["tax_rate"], stored["store_name"], stored["theme"], stored["store_email"]) == ("12.5", "Shop", "light", "")
    assert "font" not in stored


def test_effective_settings_accept_a_zero_tax_rate(spark):
    rows = spark.createDataFrame([("tax_rate", "0"), ("theme", "")], "setting_key string, setting_value string")
    row = settings.effective_settings(rows).first()
    assert (row["tax_rate"], row["theme"], row["tax_name"]) == (Decimal("0.00"), "light", "VAT")
    broken = spark.createDataFrame([("tax_rate", "soon")], "setting_key string, setting_value string")
    assert settings.effective_settings(broken).first()["tax_rate"] == Decimal("10.00")
    assert settings.effective_settings(rows.filter("false")).first()["tax_rate"] == Decimal("10.00")


def test_validate_splits_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "", None)], "id long, name string, price double")
    valid, rejects = validate.validate(rows, validate.product_rules())
    assert [r["id"] for r in valid.collect()] == [1]
    assert rejects.first()["reasons"] == ["name required", "price must be positive"]


def test_missing_parents_ignores_null(spark):
    children = spark.createDataFrame([(1,), (2,), (None,), (2,)], "ref long")
    assert [r["ref"] for r in validate.missing_parents(children, "ref", spark.createDataFrame([(1,)], "id long")).collect()] == [2]


def test_change_status_treats_null_as_equal(spark):
    row = spark.createDataFrame([(None, None), (None, "a")], "a string, b string")
    new = changes.change_status({"x": F.col("a")}, {"x": F.col("b")}, ["x"])
    assert [r[0] for r in row.select(new).collect()] == ["unchanged", "updated"]
