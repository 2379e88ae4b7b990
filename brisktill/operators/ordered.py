"""Running sums and previous rows that stay distributed when one key is hot.

A window over a key puts every row of that key in one task, which is fine up to
some size. Keys with more rows than that are cut into buckets that follow the
sort order; each bucket is summarised, only the summaries are walked key by
key, and rows meet their bucket's result on (key, bucket). Results equal the
plain window's. Without hot keys there is only the plain window.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged

BUCKET_BITS = 16
# The most rows of one key that are sorted by one task.
TASK_ROWS = 1 << 20
# Keys are counted by so many hash values first.
CROWDS = 1 << 14

_BUCKET = "_bucket"
_COARSE = "_coarse"
_BEFORE = "_before_"
_EARLIER = "_earlier_"


def bucket(order, bits=BUCKET_BITS):
    """Buckets of 2**bits consecutive values of a whole-number sort column."""
    return F.shiftright(F.col(order).cast("long"), bits)


def with_bucket(df, buckets):
    """Adds the bucket; several columns form one that sorts column by column."""
    return df.withColumn(_BUCKET, buckets[0] if len(buckets) == 1 else F.struct(*buckets))


def split_hot(df, keys, task_rows=TASK_ROWS):
    """(rows of ordinary keys, rows of keys with more than `task_rows` rows or None if there are none).

    Keys are counted when this is called. No key is hot if no hash value of the
    keys has too many rows; that count has few groups and shuffles next to
    nothing, and only rows of such values are counted key by key. Without hot keys the rows stay as they
    are and are read once; else the hot keys are stored, so that Spark knows how
    many there are before it chooses how to join them.
    """
    crowd = F.pmod(F.xxhash64(*keys), F.lit(CROWDS))
    crowds = df.groupBy(crowd.alias("_crowd")).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > task_rows)
    crowded = [row["_crowd"] for row in crowds.collect()]
    if not crowded:
        return df, None
    counts = df.filter(crowd.isin(crowded)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.filter(F.col("_rows") > task_rows).select(*keys)
    if hot.isEmpty():
        return df, None
    hot = staged(hot)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def _carried(rows, carry):
    if carry is None:
        return rows
    return rows.join(carry, [c for c in carry.columns if c in rows.columns], "left")


def bucket_offsets(bucketed, keys, values):
    """Per key and bucket: `_before_<name>`, the sum of each value over the key's earlier buckets.

    Whole-number buckets are walked in two steps, coarse ones of 2**20 buckets
    each and then those within, so that a sparse sort column, with as many
    buckets as rows, is no burden for one task either.
    """
    totals = bucketed.groupBy(*keys, _BUCKET).agg(*[F.sum(value).alias(name) for name, value in values.items()])
    if dict(totals.dtypes)[_BUCKET] != "bigint":
        return _walked(totals, keys, _BUCKET, values, _BEFORE)
    totals = totals.withColumn(_COARSE, F.shiftright(_BUCKET, 20))
    coarse = totals.groupBy(*keys, _COARSE).agg(*[F.sum(name).alias(name) for name in values])
    coarse = _walked(coarse, keys, _COARSE, values, _EARLIER)
    fine = _walked(totals, [*keys, _COARSE], _BUCKET, values, _BEFORE).join(coarse, [*keys, _COARSE])
    before = [(F.col(_EARLIER + name) + F.col(_BEFORE + name)).alias(_BEFORE + name) for name in values]
    return fine.select(*keys, _BUCKET, *before)


def _walked(totals, keys, bucket, values, prefix):
    """Sums over the earlier buckets of the same keys."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(prefix + name) for name in values]
    return totals.select(*keys, bucket, *sums)


def _bucketed_sums(df, keys, order, values, buckets, carry):
    bucketed = with_bucket(df, buckets)
    offsets = _carried(bucket_offsets(bucketed, keys, values), carry)
    within = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.col(_BEFORE + name) + F.sum(value).over(within)).alias(name) for name, value in values.items()]
    joined = bucketed.join(offsets, [*keys, _BUCKET])
    kept = [c for c in joined.columns if c != _BUCKET and not c.startswith(_BEFORE)]
    return joined.select(*kept, *sums)


def running_sums(df, keys, order, values, buckets, carry=None, task_rows=TASK_ROWS):
    """Adds a column per entry of `values`: its sum up to and including each row within the key.

    `buckets` must not decrease along `order`. `carry` is keyed by columns of
    `keys`; its other columns are added to the rows. Those of hot keys get them
    through the bucket table, so they are never shuffled by the key alone.
    """
    if not keys:
        return _bucketed_sums(df, keys, order, values, buckets, carry)
    cold, hot = split_hot(df, keys, task_rows)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(value).over(within).alias(name) for name, value in values.items()]
    plain = _carried(cold, carry).select("*", *sums)
    return plain if hot is None else plain.unionByName(_bucketed_sums(hot, keys, order, values, buckets, carry))


def running_count(df, keys, order, out, buckets, carry=None, task_rows=TASK_ROWS):
    """Adds `out`, the 1-based position of each row within its key."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("long")}, buckets, carry, task_rows)


def previous_row(df, keys, order, columns, out, buckets, carry=None, task_rows=TASK_ROWS):
    """Adds `out`, the struct of `columns` of the row before in the same key, null on the first."""
    held = F.struct(*columns)
    cold, hot = split_hot(df, keys, task_rows)
    plain = _carried(cold, carry).withColumn(out, F.lag(held).over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is None:
        return plain

    bucketed = with_bucket(hot, buckets)
    last = bucketed.groupBy(*keys, _BUCKET).agg(F.max_by(held, F.struct(*order)).alias("_last"))
    last = last.withColumn(_BEFORE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_BUCKET))).drop("_last")
    within = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    chained = (
        bucketed.join(_carried(last, carry), [*keys, _BUCKET])
        .withColumn(out, F.coalesce(F.lag(held).over(within), F.col(_BEFORE)))
        .drop(_BUCKET, _BEFORE)
    )
    return plain.unionByName(chained)
