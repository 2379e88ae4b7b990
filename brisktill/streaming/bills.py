"""Bills as they arrive: posting each micro-batch, and running sales by day."""

from pyspark.sql import functions as F

from ..operators.posting import Posting
from ..sources.documents import split_documents
from ..sources.staging import staged
from ..sources.tables import publish, read_published


def post_batch(spark, root, documents, version, prefix="BILL", owner=None):
    """Post bill documents against the published tables and publish the result as `version`.

    Bills, items and outcomes are appended, products and customers replaced.
    """
    tables = read_published(spark, root, version - 1)
    # Staged, so that the source is read and parsed once.
    drafts, lines = split_documents(staged(documents))
    posting = Posting(
        drafts, lines, tables["products"], tables["customers"], tables["bills"], tables["bill_items"], prefix
    )
    customers = posting.customers
    for field in tables["customers"].schema.fields:
        customers = customers.withColumn(field.name, F.col(field.name).cast(field.dataType))
    return publish(
        spark,
        root,
        {"products": posting.products, "customers": customers},
        {"bills": posting.bills, "bill_items": posting.bill_items, "outcomes": posting.outcomes},
        version,
        owner,
    )


def post_documents(documents, root, checkpoint, first_version=2, **options):
    """Start posting a stream of bill documents that carry a unique whole-number `seq` and `created_at`.

    Batch n becomes version first_version + n, so a batch that is run again
    after a failure cannot be posted twice.
    """

    def post(batch, number):
        post_batch(batch.sparkSession, root, batch, first_version + number, owner=f"stream {checkpoint}")

    return documents.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint).start(**options)


def daily_sales(bills, late="1 day"):
    """Bills and sales per day over a stream of bills; a day closes `late` after its end."""
    return (
        bills.withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("bill_count"), F.sum("total_amount").alias("total_sales"))
        .select(F.col("day.start").alias("day"), "bill_count", "total_sales")
    )
