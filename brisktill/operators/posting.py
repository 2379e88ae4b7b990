"""Posting and deleting bills with their effect on stock and customer counters."""

from functools import cached_property, reduce
from operator import or_

from pyspark.sql import functions as F

from ..functions.coerce import given, to_money, zero_to_null
from ..functions.text import trimmed
from ..schemas import TEXT_LENGTHS
from ..sources.staging import staged, staged_counting
from .changes import delete_rows, new_rows
from .joins import WALK_IN, spread_key
from .numbering import assign_bill_numbers, assign_parent_and_child_ids
from .stock import after_sales, apply_stock, restocked
from .validate import REASONS, bill_rules, check, enum_rules, is_valid, length_rules, missing_parents, no_reasons

_AMOUNTS = ["subtotal", "discount_amount", "tax_amount", "shipping_cost", "total_amount"]
_TEXTS = ["customer_name", "customer_phone", "customer_email", "customer_address"]
_LINE_AMOUNTS = {"unit_price": 10, "discount_percentage": 5, "discount_amount": 10, "subtotal": 10}
_MAX_QUANTITY = 2147483647
_LINE_REASONS = ("unknown product", "quantity must be whole", "product_name too long", "line amount out of range")


def customer_sums(bills):
    """Bills and spending per customer."""
    owned = bills.filter(F.col("customer_id").isNotNull()).groupBy(F.col("customer_id").alias("id"))
    return owned.agg(F.count(F.lit(1)).alias("_orders"), F.sum("total_amount").alias("_spent"))


def add_to_counters(customers, bills):
    """Customers with the bills added to total_orders and total_spent.

    Counters come back wider than they are stored, so that a busy customer
    cannot overflow them half-way through a batch.
    """
    joined = customers.join(customer_sums(bills), "id", "left")
    orders = F.coalesce("total_orders", F.lit(0)).cast("long") + F.coalesce("_orders", F.lit(0))
    spent = F.coalesce(F.col("total_spent"), F.lit(0)).cast("decimal(22,2)") + F.coalesce(
        F.col("_spent"), F.lit(0)
    ).cast("decimal(22,2)")
    counted = {"total_orders": orders, "total_spent": spent.cast("decimal(22,2)")}
    return joined.select(*[counted.get(c, F.col(c)).alias(c) for c in customers.columns])


def rebuild_counters(customers, bills):
    """Customers with total_orders and total_spent counted anew from all bills."""
    zero = {"total_orders": F.lit(0), "total_spent": F.lit(0)}
    return add_to_counters(customers.select(*[zero.get(c, F.col(c)).alias(c) for c in customers.columns]), bills)


def _line_problems(lines, products):
    """Per draft: line count, ids to reserve and what is wrong with its lines."""
    # Stored, so that Spark knows how few they are and leaves the lines where they lie.
    missing = staged(missing_parents(lines, "product_id", products)).withColumnRenamed("product_id", "_product")
    keyed = lines.withColumn("_product", spread_key(F.col("product_id"), F.struct("seq", "pos")))
    marked = keyed.join(missing.withColumn("_missing", F.lit(True)), "_product", "left")
    quantity = F.col("quantity")
    limit = TEXT_LENGTHS["bill_items"]["product_name"]
    amounts = [F.col(c).isNotNull() & to_money(F.col(c), digits).isNull() for c, digits in _LINE_AMOUNTS.items()]
    wrong = (
        F.col("_missing").isNotNull(),
        (quantity < 0) | (quantity > _MAX_QUANTITY) | (quantity != F.floor(quantity)),
        F.length("product_name") > limit,
        reduce(or_, amounts),
    )
    problems = dict(zip(_LINE_REASONS, wrong, strict=True))
    flags = [F.coalesce(F.max(bad), F.lit(False)).alias(f"_{reason}") for reason, bad in problems.items()]
    summary = marked.groupBy("seq").agg(
        F.count(F.lit(1)).alias("item_count"), (F.max("pos") + 1).cast("long").alias("_width"), *flags
    )
    found = F.array_compact(F.array(*[F.when(F.col(f"_{reason}"), F.lit(reason)) for reason in problems]))
    return summary.select("seq", "item_count", "_width", found.alias("_line_reasons"))


class Posting:
    """A batch of draft bills posted against the tables.

    `drafts`: seq (unique whole number, the posting order), the customer columns,
    amounts, payment_method, payment_status, created_by and created_at.
    `lines`: seq, pos (0-based, unique in its draft), product_id, product_name,
    quantity, unit_price, discount_percentage, discount_amount, subtotal.

    A draft that breaks a rule is rejected whole: it adds no bill and no lines
    and moves neither stock nor counters. Client totals are taken as sent. A
    line that no longer fits the stock is billed without moving it; see
    `sold`.

    Checked drafts, numbered bills and posted lines are staged once and shared
    by all results that need them; results nobody asks for cost nothing.
    """

    def __init__(self, drafts, lines, products, customers, bills, bill_items, prefix="BILL", now=None):
        self._drafts = drafts
        self._lines = lines.withColumn("product_id", zero_to_null(F.col("product_id")))
        self._products, self._customers = products, customers
        self._old_bills, self._old_items = bills, bill_items
        self._prefix, self._now = prefix, now

    @cached_property
    def _checked_and_counts(self):
        header = self._drafts.withColumn("customer_id", zero_to_null(F.col("customer_id")))
        for column in _TEXTS:
            header = header.withColumn(column, trimmed(F.col(column)))
        header = header.withColumn(
            "customer_name", F.when(given(F.col("customer_name")), F.col("customer_name")).otherwise(WALK_IN)
        )
        header = header.withColumn("payment_method", F.coalesce("payment_method", F.lit("cash")))
        header = header.withColumn("payment_status", F.coalesce("payment_status", F.lit("paid")))
        for column in _AMOUNTS:
            header = header.withColumn(column, to_money(F.coalesce(F.col(column), F.lit(0))))

        stranger = staged(missing_parents(header, "customer_id", self._customers)).withColumnRenamed("customer_id", "_customer")
        header = (
            header.withColumn("_customer", spread_key(F.col("customer_id"), F.col("seq")))
            .join(stranger.withColumn("_stranger", F.lit(True)), "_customer", "left")
            .join(_line_problems(self._lines, self._products), "seq", "left")
            .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        )
        rules = bill_rules() + enum_rules("bills") + length_rules("bills", _TEXTS)
        rules += [(f"{column} out of range", F.col(column).isNotNull()) for column in _AMOUNTS]
        rules.append(("unknown customer", F.col("_stranger").isNull()))
        all_reasons = F.concat(REASONS, F.coalesce("_line_reasons", no_reasons()))
        checked = check(header, rules).withColumn(REASONS, all_reasons)
        counts = {"created": F.count_if(is_valid()), "rejected": F.count_if(~is_valid())}
        for reason in [name for name, _ in rules] + list(_LINE_REASONS):
            counts[reason] = F.count_if(F.array_contains(REASONS, reason))
        return staged_counting(checked.drop("_line_reasons", "_stranger", "_customer"), counts)

    @property
    def _checked(self):
        return self._checked_and_counts[0]

    @cached_property
    def _numbered(self):
        valid = self._checked.filter(is_valid()).drop(REASONS)
        placed = staged(assign_parent_and_child_ids(valid, self._old_bills, self._old_items, F.col("_width")))
        return staged(assign_bill_numbers(placed, self._old_bills, self._prefix))

    @cached_property
    def _items(self):
        bills = self._numbered.select("seq", F.col("id").alias("bill_id"), "first_id", "created_at")
        items = (
            self._lines.join(bills, "seq")
            .withColumn("id", F.col("first_id") + F.col("pos"))
            .withColumn("product_name", F.coalesce("product_name", F.lit("")))
            .withColumn("quantity", F.coalesce("quantity", F.lit(0)).cast("int"))
        )
        for column, digits in _LINE_AMOUNTS.items():
            items = items.withColumn(column, to_money(F.coalesce(F.col(column), F.lit(0)), digits))
        return staged(items.drop("seq", "pos", "first_id"))

    @cached_property
    def _sales(self):
        return apply_stock(self._items.withColumnRenamed("id", "line_id"), self._products)

    @property
    def bills(self):
        """Bill rows to append."""
        return new_rows(self._old_bills, self._numbered, "bills", self._now)

    @property
    def bill_items(self):
        """Item rows to append."""
        return new_rows(self._old_items, self._items, "bill_items", self._now)

    @property
    def products(self):
        """All products after the sales."""
        return after_sales(self._products, self._sales.used)

    @property
    def customers(self):
        """All customers after their counters moved."""
        return add_to_counters(self._customers, self._numbered)

    @property
    def sold(self):
        """line_id, product_id, quantity and whether stock covered the line."""
        return self._sales.lines

    @property
    def outcomes(self):
        """One row per draft: seq, status, id, bill_number, reasons."""
        created = self._numbered.select(
            "seq", F.lit("created").alias("status"), "id", "bill_number", no_reasons().alias(REASONS)
        )
        rejected = self._checked.filter(~is_valid()).select(
            "seq",
            F.lit("rejected").alias("status"),
            F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("string").alias("bill_number"),
            REASONS,
        )
        return created.unionByName(rejected)

    @property
    def outcome_counts(self):
        """Drafts created, rejected and, per reason, rejected for it; counted by the write that stores the checked drafts."""
        return self._checked_and_counts[1]

    def store_sold(self):
        """`sold`, stored, and how many of its lines were sold and skipped, counted by the same write."""
        accepted = F.col("accepted")
        return staged_counting(self.sold, {"sold": F.count_if(accepted), "skipped": F.count_if(~accepted)})


def delete_bills(tables, ids):
    """Delete bills by id with their items and payments, putting sold quantities back in stock.

    Lines of returns and lines without a product put nothing back. Lines that
    were skipped when posted are put back too, and customer counters stay as
    they are: `rebuild_counters` shows the drift.
    """
    doomed = ids.select("id").distinct()
    items = tables["bill_items"].join(doomed.withColumnRenamed("id", "bill_id"), "bill_id", "left_semi")
    back = items.filter(F.col("product_id").isNotNull() & ~F.coalesce("is_return", F.lit(False)))
    remaining = delete_rows(tables, "bills", doomed)
    remaining["products"] = restocked(tables["products"], back.select("product_id", "quantity"))
    return remaining
