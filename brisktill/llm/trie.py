"""Prefix trie of conversations, as a node table with minimal perfect hash slots.

A prefix has a digest that is a function of sums over its turns, so prefixes of
one very long conversation come from running sums and not from one task. Nodes
whose subtree is small are dealt to shards by the root of that subtree; a shard
gives its distinct digests gapless slots, scatters counts into flat arrays and
adds them up through the parents' slots, deepest nodes first. The few nodes
above, whose subtrees hold too many rows for one shard, are added up by joins
that double their reach.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import bucket, running_sums
from ..sources.staging import staged
from .rows import WORD
from .sharding import numbered

# Turns that one shard holds, and the fewest of a subtree that is not kept whole.
SHARD_ROWS = 1 << 18
LEAST_SPLIT = 256
# Conversations end in blocks of so many consecutive ids.
_BLOCK_BITS = 10
ROOT = hashlib.md5(b"0:0:0").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Slots:
    """A minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1 without gaps.

    Digests that are alone at their place of a level get it; the others go on to
    the next, smaller level. A slot is the rank of the place among those taken. The
    digests are kept by slot, so that a lookup of any other is found out.
    """

    def __init__(self, high, low):
        self.levels, rest, base = [], np.arange(len(high)), 0
        while len(rest):
            if len(self.levels) > 200:
                raise ValueError("repeated digests")
            place = self._place(high[rest], low[rest], len(self.levels), 2 * len(rest))
            alone = np.bincount(place, minlength=2 * len(rest)) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            rest = rest[~alone[place]]
        self.high, self.low = np.zeros_like(high), np.zeros_like(low)
        slot = self._slot(high, low)
        self.high[slot], self.low[slot] = high, low

    @staticmethod
    def _place(high, low, level, size):
        x = (high ^ (low << np.uint64(32) | low >> np.uint64(32))) + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return (x % np.uint64(size)).astype(np.int64)

    def _slot(self, high, low):
        out, rest = np.full(len(high), -1), np.arange(len(high))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(high[rest], low[rest], level, len(alone))
            hit = alone[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        return out

    def find(self, high, low):
        """The slot of each digest, -1 for those that are not in the table."""
        if not len(self.high):
            return np.full(len(high), -1)
        slot = self._slot(high, low)
        return np.where((slot >= 0) & (self.high[slot] == high) & (self.low[slot] == low), slot, -1)


def _distinct(high, low):
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
    return high[new], low[new]


def _halves(column):
    both = np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


_NODE = [
    T.StructField("dig", T.BinaryType()),
    T.StructField("par", T.BinaryType()),
    *[T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved")],
]


def shard_nodes(table):
    """The nodes of one shard from its rows (c, d, words, dig, par, mark): see `_NODE`; parent is null at a subtree's root.

    Rows of one digest have to agree on parent, depth and last turn, else the digests have collided.
    """
    high, low = _halves(table["dig"])
    par_high, par_low = _halves(table["par"])
    c, d, words, mark = (table[n].to_numpy() for n in ("c", "d", "words", "mark"))
    slots = Slots(*_distinct(high, low))
    slot, n = slots.find(high, low), len(slots.high)
    fixed = []
    for values in (d, words, mark, par_high, par_low):
        flat = np.zeros(n, values.dtype)
        flat[slot] = values
        if (flat[slot] != values).any():
            raise ValueError("two different prefixes have one digest")
        fixed.append(flat)
    depth, words, _, par_high, par_low = fixed
    n_convs = np.bincount(slot, minlength=n)
    conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(conv, slot, c)
    parent = slots.find(par_high, par_low)
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    saved = (n_convs - 1) * words
    order = np.argsort(-depth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        part = part[parent[part] >= 0]
        np.add.at(leaves, parent[part], leaves[part])
        np.add.at(saved, parent[part], saved[part])
    byte = lambda a, b: pa.array([x.tobytes() for x in np.stack([a, b], 1).astype(">u8")], pa.binary())
    above = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
    columns = [byte(slots.high, slots.low), byte(par_high, par_low), conv, depth, above, n_convs, children, leaves, saved]
    return pa.table(dict(zip([f.name for f in _NODE], columns, strict=True)))


def rebuilt(turns, head):
    """(rows, convs): the turns of every rebuilt conversation, and every conversation.

    rows (c, d, turn digest t, words), d from 1; convs (c, n) with n rebuilt turns.
    `head` gives, from the column c, the conversation whose first turns come first and how many of
    a conversation's own first turns they replace.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        role.alias("role"),
        F.sha2(text, 256).alias("body"),
        F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256)).alias("t"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = numbered(own, [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")], "row").drop("turn", "role", "body")
    rows = staged(rows)
    base, replaced = head(F.col("c"))
    convs = rows.groupBy("c").agg(F.min("row").alias("row0"), F.count(F.lit(1)).alias("own"))
    convs = staged(convs.withColumn("base", base).withColumn("h", replaced.cast("long")))
    there = convs.select(F.col("c").alias("base"), F.col("row0").alias("base0"), F.col("own").alias("base_own"))
    convs = convs.join(there, "base", "left").withColumn("given", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = staged(convs.withColumn("n", F.col("given") + F.greatest(F.lit(0), F.col("own") - F.col("h"))))
    tail = rows.join(convs.select("c", "row0", "h", "given", "n"), "c").filter("row - row0 >= h")
    tail = tail.select("c", (F.col("row") - F.col("row0") + 1 - F.col("h") + F.col("given")).alias("d"), "t", "words", "n")
    # Global row numbers name the base's first turns.
    asked = convs.filter("given > 0").select("c", "n", "base0", F.explode(F.sequence(F.lit(1), F.col("given"))).alias("d"))
    asked = asked.withColumn("row", F.col("base0") + F.col("d") - 1).join(rows.drop("c"), "row").select("c", "d", "t", "words", "n")
    return tail.unionByName(asked), convs.select("c", "n")


def _paths(rows):
    """Rows with the digests of the prefix and of the one before; each is a hash of two 64-bit sums over the prefix's turns."""
    wide = lambda x: x.cast("decimal(38,0)")
    rows = rows.withColumn("x1", wide(F.xxhash64("d", "t"))).withColumn("x2", wide(F.xxhash64("t", "d", F.lit("second"))))
    rows = running_sums(staged(rows), ["c"], ["d"], {"s1": F.col("x1"), "s2": F.col("x2")}, [bucket("d")])
    digest = lambda d, a, b: F.unhex(F.md5(F.concat_ws(":", d.cast("string"), a.cast("string"), b.cast("string"))))
    d, s1, s2 = F.col("d"), F.col("s1"), F.col("s2")
    before = digest(d - 1, wide(s1 - F.col("x1")), wide(s2 - F.col("x2")))
    mark = F.xxhash64("t")
    return staged(rows.select("c", "d", "n", "words", mark.alias("mark"), digest(d, s1, s2).alias("dig"), before.alias("par")))


def _split(paths):
    """(rows below with their shard, rows above): above are prefixes whose subtree has too many rows to be kept whole."""
    spark = paths.sparkSession
    total = paths.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))
    limit = max(LEAST_SPLIT, min(SHARD_ROWS, total // shards))
    sizes = paths.groupBy("dig").agg(F.sum(F.col("n") - F.col("d") + 1).alias("size"))
    large = staged(sizes.filter(F.col("size") > limit).select("dig"))
    above = staged(paths.join(large, "dig", "left_semi"))
    below = paths.join(large, "dig", "left_anti")
    # Below a large prefix all of a conversation's longer ones are small; the first of them names the subtree.
    unit = below.groupBy("c").agg(F.min_by("dig", "d").alias("unit"))
    below = below.join(staged(unit), "c").withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)))
    return below.drop("unit", "n"), above


def _above(above, convs, tops):
    """The nodes above the shards, root included, with the sums of all that is below them.

    Each round adds to a node what its descendants at a distance below twice the
    last one hold, so the rounds grow with the logarithm of the depth.
    """
    checks = [F.min(x).eqNullSafe(F.max(x)) for x in ("par", "d", "mark")]
    nodes = above.groupBy("dig").agg(
        F.first("par").alias("par"), F.min("c").alias("conv_id"), F.first("d").cast("long").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), (checks[0] & checks[1] & checks[2]).alias("sound"),
    )
    nodes = nodes.withColumn("words", F.when(F.col("sound"), F.col("words")).otherwise(F.raise_error(F.lit("two different prefixes have one digest")).cast("long")))
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("dig"), F.lit(None).cast("binary").alias("par"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = staged(nodes.drop("sound").unionByName(root))
    inner = nodes.filter("par is not null").select("par", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
    given = tops.select("par", "n_leaves", "saved").unionByName(inner).groupBy(F.col("par").alias("dig"))
    given = given.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("given"))
    nodes = nodes.join(staged(given), "dig", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    nodes = nodes.withColumn("n_children", zero("n_children"))
    leaves = zero("leaves") + (F.col("n_children") == 0).cast("long")
    nodes = nodes.withColumn("n_leaves", leaves).withColumn("saved", zero("given") + (F.col("n_convs") - 1) * F.col("words"))
    nodes = staged(nodes.drop("leaves", "given", "words"))
    sums = nodes.select("dig", F.col("par").alias("up"), "n_leaves", "saved")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        more = sums.filter("up is not null").groupBy(F.col("up").alias("dig")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        further = sums.select(F.col("dig").alias("up"), F.col("up").alias("next"))
        sums = sums.join(more, "dig", "left").join(further, "up", "left")
        sums = staged(sums.select("dig", F.col("next").alias("up"), (F.col("n_leaves") + zero("l")).alias("n_leaves"), (F.col("saved") + zero("s")).alias("saved")))
    return staged(nodes.drop("n_leaves", "saved").join(sums.drop("up"), "dig"))


def _ends(paths, convs):
    """(dig, ends_sha256) of the nodes at which a conversation ends: the digest of their ids in order, comma-joined.

    Ids are joined in blocks of neighbours; only a node with several blocks passes them, in order, through one task.
    """
    ends = paths.filter("d = n").select("dig", "c").unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("dig"), "c"))
    blocks = ends.groupBy("dig", F.shiftright("c", _BLOCK_BITS).alias("block"))
    blocks = staged(blocks.agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids")))
    per = staged(blocks.groupBy("dig").agg(F.count(F.lit(1)).alias("blocks"), F.min("ids").alias("ids")))
    single = per.filter("blocks = 1").select("dig", F.sha2("ids", 256).alias("ends_sha256"))
    schema = T.StructType([T.StructField("dig", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def run(batches):
        held, digest = None, None
        for batch in batches:
            done = []
            for dig, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if dig != held:
                    if held is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = dig, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield _batch(done, schema.names)
        if held is not None:
            yield _batch([(held, digest.hexdigest())], schema.names)

    many = blocks.join(per.filter("blocks > 1").select("dig"), "dig", "left_semi").repartition("dig").sortWithinPartitions("dig", "block")
    return single.unionByName(many.select("dig", "ids").mapInArrow(run, schema))


def _batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], names=names)


def same(c):
    """Conversations as they are."""
    return c, F.lit(0)


def nodes(turns, head=same):
    """One row per distinct prefix of the conversations in `turns` (conv_id, turn, role, text), the empty one included.

    Turns go by turn (null first), then role and digest of the text; a null
    role or text is empty, and rows without conv_id belong to no conversation. Equal
    rows are several turns. `head` may put another conversation's first turns
    first (see `rebuilt`). No conversation, no rows; otherwise the root has all of them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (sum over the subtree of words in the last text
    times members but one), ends_sha256 (of the ids that end here).
    """
    rows, convs = rebuilt(turns, head)
    paths = _paths(rows)
    below, above = _split(paths)
    schema = T.StructType(_NODE)
    small = staged(below.groupBy("shard").applyInArrow(shard_nodes, schema))
    tops = small.filter("parent is null")
    spine = _above(above, convs, tops)
    names = spine.select(F.col("dig").alias("par"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["dig", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    inner = small.filter("parent is not null").withColumn("parent_conv_id", F.col("parent")).select(*columns)
    found = inner.unionByName(tops.join(names, "par").select(*columns)).unionByName(spine.join(names, "par", "left").select(*columns))
    found = found.join(_ends(paths, convs), "dig", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return found.withColumnRenamed("saved", "saved_tokens").drop("dig")
