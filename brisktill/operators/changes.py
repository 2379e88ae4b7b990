"""Batch table maintenance: (table, requests) -> (new table, outcomes).

Requests carry a unique whole-number `seq`. A batch has the effect of its
requests applied one after another in `seq` order, and each request gets an
outcome row: `created`, `updated`, `unchanged`, `deleted`, `not_found` or
`rejected` with reasons. `updated_at` moves when the batch as a whole changed
a row.
"""

from pyspark.sql import functions as F

from ..functions.coerce import given
from ..functions.text import loose
from ..schemas import DEFAULTS, FOREIGN_KEYS, TABLES
from ..sources.staging import staged
from .joins import spread_key
from .numbering import assign_ids
from .ordered import bucket, previous_row
from .validate import (
    REASONS,
    check,
    customer_rules,
    enum_rules,
    first_use,
    is_valid,
    length_rules,
    no_reasons,
    product_rules,
    user_rules,
)


def _now(now):
    return F.current_timestamp() if now is None else F.lit(now)


def apply_defaults(rows, table, now=None):
    """All columns of a table's schema: given values, else the column's default, else null."""
    columns = []
    for field in TABLES[table].fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name in ("created_at", "updated_at", "payment_date"):
            default = _now(now)
        else:
            default = F.lit(DEFAULTS[table].get(field.name))
        kind = field.dataType
        columns.append(F.coalesce(value.cast(kind), default.cast(kind)).alias(field.name))
    return rows.select(*columns)


def new_rows(table, rows, name, now=None):
    """Rows in the columns and types of `table`, with the column defaults filled in."""
    return apply_defaults(rows, name, now).select(*[F.col(c).cast(kind).alias(c) for c, kind in table.dtypes])


def append(table, rows, name, now=None):
    """The table with new rows added."""
    return table.unionByName(new_rows(table, rows, name, now))


def change_status(before, after, columns):
    """`updated` when any column really differs, else `unchanged`; null equals null."""
    same = F.lit(True)
    for column in columns:
        same = same & before[column].eqNullSafe(after[column])
    return F.when(same, "unchanged").otherwise("updated")


def outcomes_of(rejected, done):
    """One outcome per request: seq, id, status, reasons."""
    turned = rejected.select("seq", F.col("id").cast("long").alias("id"), F.lit("rejected").alias("status"), REASONS)
    return done.select("seq", F.col("id").cast("long").alias("id"), "status", no_reasons().alias(REASONS)).unionByName(turned)


def replace_rows(table, requests, columns, only_active=True, now=None):
    """Set `columns` of the rows named by `id`; the last request for an id wins.

    Returns (new table, done) where `done` has seq, id and the request's status
    against the row as its predecessor left it.
    """
    kinds = dict(table.dtypes)
    wanted = requests.select(
        "seq", F.col("id").cast("long").alias("id"), *[F.col(c).cast(kinds[c]).alias(c) for c in columns]
    )
    reachable = table.filter(F.coalesce(F.col("is_active"), F.lit(False))) if only_active else table
    current = reachable.select("id", F.struct(*columns).alias("_row"))
    chained = previous_row(wanted, ["id"], ["seq"], columns, "_previous", [bucket("seq")], carry=current)
    before = F.coalesce("_previous", "_row")
    status = F.when(F.col("_row").isNull(), "not_found").otherwise(
        change_status(before, {c: F.col(c) for c in columns}, columns)
    )
    done = chained.select("seq", "id", status.alias("status"))

    last = wanted.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("_new"))
    hit = F.col("_new").isNotNull()
    if only_active:
        hit = hit & F.coalesce(F.col("is_active"), F.lit(False))
    changed = hit & (change_status(F.struct(*columns), F.col("_new"), columns) == "updated")
    replaced = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    if "updated_at" in kinds:
        replaced["updated_at"] = F.when(changed, _now(now).cast(kinds["updated_at"])).otherwise(F.col("updated_at"))
    joined = table.join(last, "id", "left")
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in table.columns]), done


def _checked_replace(table, requests, rules, columns, only_active, now):
    checked = check(requests, [("id required", F.col("id") != 0), *rules])
    new, done = replace_rows(table, checked.filter(is_valid()), columns, only_active, now)
    return new, outcomes_of(checked.filter(~is_valid()), done)


def _texts(rows, columns):
    """Missing texts become empty."""
    for column in columns:
        rows = rows.withColumn(column, F.coalesce(column, F.lit("")))
    return rows


def _product_requests(rows):
    filled = _texts(rows, ["name", "description", "barcode"])
    return filled.withColumn("category", F.coalesce("category", F.lit("Others"))).withColumn(
        "stock", F.coalesce("stock", F.lit(0))
    )


_PRODUCT_SET = ["name", "price", "stock", "category", "description", "barcode"]
_CUSTOMER_SET = ["name", "phone", "email", "address"]
_USER_SET = ["username", "role", "full_name", "email", "phone"]


def _create(table, checked, name, now):
    rejected = checked.filter(~is_valid()).withColumn("id", F.lit(None).cast("long"))
    created = assign_ids(checked.filter(is_valid()).drop(REASONS), table)
    done = created.select("seq", "id", F.lit("created").alias("status"))
    return append(table, created, name, now), outcomes_of(rejected, done)


def create_products(table, rows, now=None):
    rules = product_rules() + length_rules("products", _PRODUCT_SET)
    return _create(table, check(_product_requests(rows), rules), "products", now)


def replace_products(table, rows, now=None):
    """Replace six columns of active products; what a request leaves out becomes empty."""
    rules = product_rules() + length_rules("products", _PRODUCT_SET)
    return _checked_replace(table, _product_requests(rows), rules, _PRODUCT_SET, True, now)


def create_customers(table, rows, now=None):
    rules = customer_rules() + length_rules("customers", _CUSTOMER_SET)
    return _create(table, check(_texts(rows, _CUSTOMER_SET), rules), "customers", now)


def replace_customers(table, rows, now=None):
    rules = customer_rules() + length_rules("customers", _CUSTOMER_SET)
    return _checked_replace(table, _texts(rows, _CUSTOMER_SET), rules, _CUSTOMER_SET, True, now)


def soft_delete(table, ids, now=None):
    """Mark rows inactive; `ids` has seq and id."""
    return _checked_replace(table, ids.withColumn("is_active", F.lit(False)), [], ["is_active"], False, now)


def edit_bills(bills, patches, now=None):
    """Set customer name, payment method and payment status of bills by id."""
    columns = ["customer_name", "payment_method", "payment_status"]
    rules = enum_rules("bills", columns) + length_rules("bills", columns)
    return _checked_replace(bills, _texts(patches, columns), rules, columns, False, now)


def create_users(table, rows, now=None):
    """New users; a user name in use, or taken by an earlier request, is rejected."""
    filled = _texts(rows, ["username", "full_name", "email", "phone"]).withColumn(
        "role", F.coalesce("role", F.lit("cashier"))
    )
    rules = user_rules() + enum_rules("users") + length_rules("users", _USER_SET)
    checked = check(filled, rules)
    # Only requests that are otherwise valid claim a name.
    claims = first_use(checked.filter(is_valid()), "username", "seq", table)
    marked = claims.withColumn(
        REASONS, F.when(F.col("taken"), F.array(F.lit("username taken"))).otherwise(F.col(REASONS))
    ).drop("taken")
    return _create(table, staged(marked.unionByName(checked.filter(~is_valid()))), "users", now)


def patch_users(table, patches, now=None):
    """Patch users by id.

    The five identity columns are set when user name and full name are both
    given; `is_active` is set when present. A user name held by another user at
    the start of the batch, or claimed first by another user's request, is
    rejected together with the rest of its request.
    """
    filled = _texts(patches, _USER_SET)
    identity = given(F.col("username")) & given(F.col("full_name"))
    filled = filled.withColumn("_identity", identity)
    rules = [(reason, ~F.col("_identity") | holds) for reason, holds in enum_rules("users") + length_rules("users", _USER_SET)]
    checked = check(filled, [("id required", F.col("id") != 0), *rules])
    valid = checked.filter(is_valid())

    claims = valid.filter("_identity").withColumn("_key", loose(F.col("username")))
    holders = table.groupBy(loose(F.col("username")).alias("_key")).agg(F.min("id").alias("_holder"))
    firsts = claims.groupBy("_key").agg(F.min_by("id", "seq").alias("_first"))
    owners = firsts.join(holders, "_key", "left").select("_key", F.coalesce("_holder", "_first").alias("_owner"))
    owned = claims.join(owners, "_key", "left").withColumn(
        REASONS,
        F.when(F.col("id") != F.col("_owner"), F.array(F.lit("username taken"))).otherwise(F.col(REASONS)),
    )
    judged = staged(
        owned.drop("_key", "_owner")
        .unionByName(valid.filter(~F.col("_identity")))
        .unionByName(checked.filter(~is_valid()))
    )
    accepted = judged.filter(is_valid())

    renamed, first_done = replace_rows(table, accepted.filter("_identity"), _USER_SET, False, now)
    switched, second_done = replace_rows(
        renamed, accepted.filter(F.col("is_active").isNotNull()), ["is_active"], False, now
    )
    known = table.select("id", F.lit(True).alias("_known"))
    done = (
        accepted.select("seq", "id")
        .join(first_done.select("seq", F.col("status").alias("_a")), "seq", "left")
        .join(second_done.select("seq", F.col("status").alias("_b")), "seq", "left")
        .join(known, "id", "left")
        .select(
            "seq",
            "id",
            F.when(F.col("_known").isNull(), "not_found")
            .when((F.col("_a") == "updated") | (F.col("_b") == "updated"), "updated")
            .otherwise("unchanged")
            .alias("status"),
        )
    )
    return switched, outcomes_of(judged.filter(~is_valid()), done)


def hard_delete(table, ids):
    """(rows kept, outcomes); `ids` has seq and id. Children are handled by `delete_rows`."""
    checked = check(ids.select("seq", "id"), [("id required", F.col("id") != 0)])
    wanted = checked.filter(is_valid())
    first = wanted.groupBy("id").agg(F.min("seq").alias("_first"))
    known = table.select("id", F.lit(True).alias("_known"))
    fate = first.join(known, "id", "left")
    hit = F.coalesce(F.col("_known"), F.lit(False)) & (F.col("seq") == F.col("_first"))
    done = wanted.join(fate, "id").select("seq", "id", F.when(hit, "deleted").otherwise("not_found").alias("status"))
    return table.join(first.select("id"), "id", "left_anti"), outcomes_of(checked.filter(~is_valid()), done)


def set_null_on_delete(child, column, deleted):
    """Clear references to deleted ids."""
    gone = deleted.select(F.col("id").alias("_ref"), F.lit(True).alias("_gone")).distinct()
    keyed = child.withColumn("_ref", spread_key(F.col(column), F.col("id")))
    return (
        keyed.join(gone, "_ref", "left")
        .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
        .select(*child.columns)
    )


def cascade_delete(child, column, deleted):
    """Drop rows that refer to deleted ids."""
    gone = deleted.select(F.col("id").alias(column)).distinct()
    return child.join(gone, column, "left_anti").select(*child.columns)


def delete_rows(tables, name, deleted):
    """`tables` without the rows of table `name` whose `id` is in `deleted`, with every foreign key applied."""
    return _release({**tables, name: cascade_delete(tables[name], "id", deleted)}, name, deleted)


def _release(tables, parent, deleted):
    for child, column, action in _references(tables, parent):
        rows = tables[child]
        if action == "set null":
            tables = {**tables, child: set_null_on_delete(rows, column, deleted)}
            continue
        tables = {**tables, child: cascade_delete(rows, column, deleted)}
        if _references(tables, child):
            gone = deleted.select(F.col("id").alias(column)).distinct()
            tables = _release(tables, child, rows.join(gone, column, "left_semi").select("id"))
    return tables


def _references(tables, parent):
    return [
        (child, column, action)
        for child, column, owner, action in FOREIGN_KEYS
        if owner == parent and child in tables and column in tables[child].columns
    ]
