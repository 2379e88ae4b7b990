"""Bill documents: JSON in, drafts and lines out."""

from pyspark.sql import functions as F

from ..functions.coerce import float_value, int_value
from ..schemas import BILL_DOCUMENT


def read_bill_documents(spark, path):
    """One JSON bill per line; a body that cannot be read becomes an empty bill."""
    return spark.read.schema(BILL_DOCUMENT).option("mode", "PERMISSIVE").json(path)


def parse_bill_documents(df, body="body"):
    """Bill documents from a text column; other columns are kept. Bad or missing bodies become empty bills."""
    parsed = F.from_json(F.coalesce(F.col(body), F.lit("{}")), BILL_DOCUMENT, {"mode": "PERMISSIVE"})
    kept = [c for c in df.columns if c != body]
    return df.withColumn("_bill", parsed).select(*kept, "_bill.*")


def split_documents(documents):
    """(drafts, lines) of documents that carry a unique `seq`; line positions keep their order."""
    lines = documents.select("seq", F.posexplode("items").alias("pos", "item")).select("seq", "pos", "item.*")
    return documents.drop("items"), lines


# ---- request bodies field by field: what can be read is read, what cannot is listed with the reason

_TEXTS = ("customer_name", "customer_phone", "customer_email", "customer_address", "payment_method", "payment_status")
_NUMBERS = ("subtotal", "discount_amount", "tax_amount", "shipping_cost", "total_amount")
_LINE_NUMBERS = ("unit_price", "discount_percentage", "discount_amount", "subtotal")


def _field(value, name, kind="string"):
    return F.try_variant_get(value, f"$.{name}", kind)


def _kind(value):
    return F.schema_of_variant(value)


def _number_text(value, name):
    """A number, or a text that may start with one, as text; true counts as 1, anything else as missing."""
    flag = F.try_variant_get(value, f"$.{name}", "boolean")
    kind = _kind(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind == "BOOLEAN", flag.cast("int").cast("string")).when(
        ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), _field(value, name)
    )


def _text(value, name):
    kind = _kind(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), _field(value, name))


def parse_bodies(df, body="body"):
    """(documents, rejects) of request bodies in a text column; other columns are kept.

    A body that is not JSON, not an object, or whose `items` is not a list of
    objects is rejected with its reason. In all others each field is read for
    itself: numbers may be texts that start with one, else they are 0, texts may
    be numbers, and a missing, null or nested value where a text belongs is null.
    """
    found = df.withColumn("_value", F.try_parse_json(F.col(body)))
    value = F.col("_value")
    items = F.try_variant_get(value, "$.items", "variant")
    lines = F.try_variant_get(value, "$.items", "array<variant>")
    listed = items.isNull() | F.is_variant_null(items) | lines.isNotNull()
    odd = F.exists(lines, lambda line: ~F.coalesce(_kind(line).startswith("OBJECT"), F.lit(False)))
    reason = (
        F.when(F.col(body).isNull() | (F.btrim(body) == ""), "no body")
        .when(value.isNull(), "not JSON")
        .when(~_kind(value).startswith("OBJECT"), "not an object")
        .when(~listed, "items is not a list")
        .when(F.coalesce(odd, F.lit(False)), "an item is not an object")
    )
    judged = found.withColumn("reason", reason)
    kept = [c for c in df.columns if c != body]
    line = lambda x: F.struct(
        int_value(_number_text(x, "product_id")).alias("product_id"),
        _text(x, "product_name").alias("product_name"),
        float_value(_number_text(x, "quantity")).alias("quantity"),
        *[float_value(_number_text(x, c)).alias(c) for c in _LINE_NUMBERS],
    )
    documents = judged.filter("reason is null").select(
        *kept,
        int_value(_number_text(value, "customer_id")).alias("customer_id"),
        *[_text(value, c).alias(c) for c in _TEXTS],
        *[float_value(_number_text(value, c)).alias(c) for c in _NUMBERS],
        F.transform(F.coalesce(lines, F.array().cast("array<variant>")), line).alias("items"),
    )
    rejects = judged.filter("reason is not null").select(*kept, body, "reason")
    return documents, rejects
