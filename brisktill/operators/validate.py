"""Row rules: every row is either valid or rejected with its reasons."""

from pyspark.sql import functions as F

from ..functions.coerce import float_value, given, in_range, one_of, to_money
from ..functions.text import is_email, loose
from ..schemas import ENUMS, TEXT_LENGTHS

REASONS = "reasons"


def reasons_of(rules):
    """Array of the reasons whose rule does not hold; a null rule does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)) for reason, holds in rules])
    ).cast("array<string>")


def no_reasons():
    return F.array().cast("array<string>")


def check(rows, rules):
    return rows.withColumn(REASONS, reasons_of(rules))


def is_valid():
    return F.size(REASONS) == 0


def validate(rows, rules):
    """(valid rows, rejected rows with `reasons`)."""
    checked = check(rows, rules)
    return checked.filter(is_valid()).drop(REASONS), checked.filter(~is_valid())


def enum_rules(table, columns=None):
    """Enum columns hold one of their values or null."""
    return [
        (f"{column} not allowed", F.col(column).isNull() | one_of(F.col(column), allowed))
        for (owner, column), allowed in ENUMS.items()
        if owner == table and (columns is None or column in columns)
    ]


def length_rules(table, columns):
    return [
        (f"{column} too long", F.col(column).isNull() | (F.length(column) <= limit))
        for column, limit in TEXT_LENGTHS[table].items()
        if column in columns
    ]


def required(column):
    return (f"{column} required", given(F.col(column)))


def product_rules():
    price = F.col("price")
    return [
        required("name"),
        ("price must be positive", price > 0),
        ("price out of range", price.isNull() | to_money(price).isNotNull()),
    ]


def customer_rules():
    return [required("name"), required("phone")]


def user_rules():
    return [required("username"), required("full_name")]


def bill_rules(items="item_count", total="total_amount"):
    return [("no items", F.col(items) > 0), ("total must be positive", F.col(total) > 0)]


def cart_line_rules():
    """A cart line names a product and has a whole quantity and a price."""
    return [
        ("product required", F.col("product_id").isNotNull() | given(F.trim("product_name"))),
        ("quantity required", F.col("quantity") != 0),
        ("quantity must be whole", F.col("quantity").isNull() | (F.col("quantity") == F.floor("quantity"))),
        ("price required", F.col("unit_price") != 0),
    ]


def setting_rules(key="setting_key", value="setting_value"):
    """A tax rate lies in 0..100; an e-mail address, when given, is well formed."""
    name, text = F.col(key), F.col(value)
    return [
        ("tax_rate out of range", (name != "tax_rate") | in_range(float_value(text), 0, 100)),
        ("store_email not valid", (name != "store_email") | ~given(text) | is_email(text)),
    ]


def missing_parents(children, foreign_key, parents, key="id"):
    """Distinct non-null foreign keys without a parent row."""
    wanted = children.filter(F.col(foreign_key).isNotNull()).select(foreign_key).distinct()
    return wanted.join(parents.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def first_use(rows, key, seq, existing=None, fold=True):
    """Adds `taken`: the key is already used by `existing` or by an earlier row.

    With `fold`, keys are compared without regard to case or accents, as a
    unique name is.
    """
    compared = loose(F.col(key)) if fold else F.col(key)
    marked = rows.withColumn("_key", compared)
    firsts = marked.groupBy("_key").agg(F.min(seq).alias("_first"))
    if existing is not None:
        known = existing.select((loose(F.col(key)) if fold else F.col(key)).alias("_key")).distinct()
        firsts = firsts.join(known.withColumn("_known", F.lit(True)), "_key", "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(None).cast("boolean"))
    taken = F.coalesce(F.col("_known"), F.lit(False)) | (F.col(seq) > F.col("_first"))
    return marked.join(firsts, "_key", "left").withColumn("taken", F.coalesce(taken, F.lit(False))).drop(
        "_key", "_first", "_known"
    )
