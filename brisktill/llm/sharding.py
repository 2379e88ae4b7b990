"""A reproducible shuffle into shards: a Feistel permutation of global row numbers. DataFrame functions only."""

import math

from pyspark.sql import functions as F

from ..sources.staging import staged
from .rows import free_names, let

ROUNDS = 8
# Steps that are walked in one go; a row that needs more, which next to none does, walks on as far as a cycle can lead.
WALK = 64


def numbered(rows, order, number="row"):
    """`rows` with gapless numbers from 0 along `order`, null first, whatever files the rows came in.

    Rows are range-sorted over all tasks, also those of one key: a row's place
    in the table is the last sort column, so equal rows spread. Each task
    counts on from what the partitions before it hold; only one count per
    partition is added up in one place. `rows` is read twice.
    """
    tie, part, place, first, before = free_names(rows, "tie", "part", "place", "first", "before")
    columns = [*order, F.col(tie)]
    ordered = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*columns)
    ordered = ordered.sortWithinPartitions(*columns).drop(tie)
    kept = staged(ordered.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias(first))
    offsets = counts.selectExpr(
        part, first, f"coalesce(sum(n) over (order by {part} rows between unbounded preceding and 1 preceding), 0) as {before}"
    )
    return kept.join(offsets, part).withColumn(number, F.col(before) + F.col(place) - F.col(first)).drop(part, place, first, before)


def _sides(n):
    """(a, b) with a * b >= n by as little as a square-like grid allows."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mixed(seed, turn, half):
    """60 bits of a hash of a round and a half."""
    text = F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _once(x, a, b, seed, rounds):
    """One pass of the network over numbers below a * b: halves of a and b values change in turns."""

    def turn(halves, i):
        left = F.pmod(halves["l"] + F.pmod(_mixed(seed, i, halves["r"]), F.lit(a)), F.lit(a))
        right = F.pmod(halves["r"] + F.pmod(_mixed(seed, i, halves["l"]), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(
            F.when(even, left).otherwise(halves["l"]).alias("l"), F.when(even, halves["r"]).otherwise(right).alias("r")
        )

    start = F.struct(F.floor(x / b).alias("l"), F.pmod(x, F.lit(b)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def permuted(x, n, seed=0, rounds=ROUNDS):
    """A column of numbers below `n`, each sent to another below `n`: a bijection fixed by seed and n.

    The network permutes the numbers below a * b, a grid just large enough; a
    result of n or more is sent on until it falls below n. No cycle holds more
    than a * b - n such results, which bounds the walk.
    """
    a, b = _sides(n)
    a, b = int(a), int(b)
    over = a * b - n
    step = lambda y: _once(y, a, b, seed, rounds)

    def walk(y, steps):
        if not steps:
            return y
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y, lambda v, _: F.when(v < n, v).otherwise(step(v)))

    def settled(y):
        return F.when(y < n, y).otherwise(walk(y, over)) if over > WALK else y

    return let(walk(step(x.cast("long")), min(over, WALK)), settled)


def place(rows, shards, number="row", seed=0):
    """Numbered rows with shard (int) and slot (long): counts of shards differ by one at most, slots are gapless."""
    n = rows.count()
    shard, slot, at = *free_names(rows, "shard", "slot"), F.col(number)
    sent = F.struct(permuted(at, max(n, 1), seed).alias("p"))
    found = let(sent, lambda s: F.struct(F.pmod(s["p"], F.lit(shards)).cast("int").alias("s"), F.floor(s["p"] / shards).alias("t")))
    (both,) = free_names(rows, "both")
    return rows.withColumn(both, found).withColumns({shard: F.col(f"{both}.s"), slot: F.col(f"{both}.t")}).drop(both)


def shards(docs, shards=24, id_col="doc_id", text_col="text", seed=0):
    """One row per row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8, text_crc32 its unsigned CRC (null:
    as if empty). Rows are numbered by id, then by what the text holds; equal
    rows in any order. The law is `rows`: shard and slot follow from the row
    number, the row count, `shards` and `seed` alone, so equal texts lie apart
    and grown_shard is null. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = numbered(own, [F.col(c) for c in ("id", "size", "text_crc32", "h")]).drop("h")
    found = place(staged(rows), shards, "row", seed)
    return found.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
