"""Invoice arithmetic on lines and bills.

Line amounts are kept exact at six decimals (whole quantity, two-decimal price
and discount percentage) and rounded once, on the line and on the bill.
"""

from decimal import Decimal

from pyspark.sql import functions as F

from .ordered import running_count

EXACT = "decimal(24,6)"
TOTAL = "decimal(20,2)"


def _hundredth():
    return F.lit(Decimal("0.01"))


def _gross(quantity, unit_price):
    """Null for a quantity that is not whole: such a line is rejected, not rounded."""
    whole = F.when(quantity == F.floor(quantity), quantity.cast("decimal(10,0)"))
    return whole * unit_price.cast("decimal(10,2)")


def line_subtotal(quantity, unit_price, discount_percentage):
    """Quantity times price less the discount percentage, unrounded."""
    kept = F.lit(Decimal("100.00")) - F.coalesce(discount_percentage.cast("decimal(5,2)"), F.lit(Decimal("0.00")))
    return (_gross(quantity, unit_price) * kept * _hundredth()).cast(EXACT)


def line_discount(quantity, unit_price, discount_percentage):
    """What the discount percentage takes off, unrounded."""
    off = F.coalesce(discount_percentage.cast("decimal(5,2)"), F.lit(Decimal("0.00")))
    return (_gross(quantity, unit_price) * off * _hundredth()).cast(EXACT)


def price_lines(lines):
    """Adds `subtotal` and `discount_amount` in money and their unrounded `exact_*` forms."""
    amounts = [F.col("quantity"), F.col("unit_price"), F.col("discount_percentage")]
    return (
        lines.withColumn("exact_subtotal", line_subtotal(*amounts))
        .withColumn("exact_discount", line_discount(*amounts))
        .withColumn("subtotal", F.col("exact_subtotal").cast(TOTAL))
        .withColumn("discount_amount", F.col("exact_discount").cast(TOTAL))
    )


def number_lines(lines, order, buckets, key="bill_id", column="line_number"):
    """Serial number of a line in its bill, in `order`."""
    return running_count(lines, [key], order, column, buckets)


def bill_totals(priced, tax_rate, shipping=None, key="bill_id"):
    """Subtotal, discount, tax and total of every bill from its priced lines.

    `shipping` is (key, shipping_cost); a bill without a row ships free. The
    discount is for information: lines are already net of it.
    """
    sums = priced.groupBy(key).agg(
        F.sum("exact_subtotal").alias("_subtotal"), F.sum("exact_discount").alias("_discount")
    )
    if shipping is None:
        sums = sums.withColumn("shipping_cost", F.lit(Decimal("0.00")))
    else:
        sums = sums.join(shipping.select(key, "shipping_cost"), key, "left")
    cost = F.coalesce(F.col("shipping_cost"), F.lit(Decimal("0.00"))).cast("decimal(10,2)")
    rate = tax_rate if hasattr(tax_rate, "cast") else F.lit(Decimal(str(tax_rate)))
    subtotal = F.col("_subtotal").cast("decimal(26,6)")
    tax = subtotal * rate.cast("decimal(5,2)") * _hundredth()
    return sums.select(
        key,
        subtotal.cast(TOTAL).alias("subtotal"),
        F.col("_discount").cast(TOTAL).alias("discount_amount"),
        tax.cast(TOTAL).alias("tax_amount"),
        cost.alias("shipping_cost"),
        (subtotal + tax + cost).cast(TOTAL).alias("total_amount"),
    )


def document_totals(documents, tax_rate):
    """`bill_totals` for bill documents that keep their lines in an `items` array."""
    zero = F.lit(Decimal("0")).cast(EXACT)

    def total(amount):
        return F.aggregate(
            F.col("items"),
            zero,
            lambda so_far, item: (
                so_far + amount(item["quantity"], item["unit_price"], item["discount_percentage"])
            ).cast(EXACT),
        )

    rate = F.lit(Decimal(str(tax_rate))).cast("decimal(5,2)")
    shipping = F.coalesce(F.col("shipping_cost").cast("decimal(10,2)"), F.lit(Decimal("0.00")))
    subtotal = F.col("_subtotal")
    tax = subtotal * rate * _hundredth()
    # The sums are columns of their own, so that each is computed once.
    summed = documents.withColumns({"_subtotal": total(line_subtotal), "_discount": total(line_discount)})
    return summed.withColumns(
        {
            "subtotal": subtotal.cast(TOTAL),
            "discount_amount": F.col("_discount").cast(TOTAL),
            "tax_amount": tax.cast(TOTAL),
            "total_amount": (subtotal + tax + shipping).cast(TOTAL),
        }
    ).drop("_subtotal", "_discount")
