"""SimHash near-duplicates by pigeonhole blocks."""

import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from .components import components
from .rows import free_names, map_batches, slices

BITS = 64
# Shingles whose bits are counted at once.
_AT_ONCE = 1 << 16
# The most fingerprints of a block that are paired off; larger blocks are split again.
BLOCK_ROWS = 64


def fingerprint(text, shingle=3, seed=42):
    """The fingerprint of UTF-8 bytes (None: no words), as a signed 64-bit number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    width = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width)), strict=False))
    total = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for part in slices(shingles, _AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in part], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(docs, id_col="doc_id", text_col="text", shingle=3, seed=42):
    """One row (id, fingerprint long) per row of `docs`.

    ASCII letters are lower-cased, words are split at ASCII white space, and a
    bit is set if it is set in over half of the shingles' hashes, repeats
    included. A text with fewer words than a shingle is one shingle; a null,
    empty or blank text has fingerprint 0.
    """
    schema = T.StructType([docs.select(id_col).schema[0], T.StructField("fingerprint", T.LongType())])

    def start():
        return lambda batch: [
            batch.column(0),
            [fingerprint(text, shingle, seed) for text in batch.column(1).to_pylist()],
        ]

    return map_batches(docs.select(id_col, F.col(text_col).cast("binary")), start, schema)


def _splits(free, max_distance, blocks):
    """Masks over the bits of `free`: any two numbers that differ in at most `max_distance` of them agree on one."""
    bounds = [len(free) * i // blocks for i in range(blocks + 1)]
    cut = [sum(1 << b for b in free[bounds[i] : bounds[i + 1]]) for i in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(cut, blocks - max_distance)]


def _signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints, max_distance=2, blocks=None, block_rows=BLOCK_ROWS):
    """Pairs (a, b) of different fingerprints of `prints` (distinct, one column) that differ in at most `max_distance` bits.

    Bits are split into `blocks` blocks; a close pair agrees on all but
    `max_distance` of them, so it meets under one of the choices of blocks.
    Fingerprints that agree on one choice form a bucket. A bucket of more than
    `block_rows` is split again in the same way over its remaining bits, until
    so few bits are left that a bucket is small by itself; so no bucket is
    paired off whole unless it is small, and no pair is lost. A pair can come
    more than once.
    """
    blocks = blocks or max_distance + 2
    if not 0 <= max_distance < blocks <= BITS:
        raise ValueError(f"{blocks} blocks cannot serve {max_distance} differing bits")
    rows = prints.select(F.col(prints.columns[0]).alias("a"), F.lit(0).alias("path"))
    fixed, found = [0], None
    while True:
        # The masks below each path; a bucket is a path and the bits under its mask.
        below, last = [], False
        for mask in fixed:
            free = [b for b in range(BITS) if not mask >> b & 1]
            below.append([mask | more for more in _splits(free, max_distance, blocks)])
            last |= BITS - below[-1][0].bit_count() <= 8
        width = len(below[0])
        table = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in masks]) for masks in below])
        step = rows.select("a", "path", F.posexplode(table[F.col("path")]).alias("i", "mask"))
        step = step.select("a", (F.col("path") * width + F.col("i")).alias("path"), F.col("a").bitwiseAND(F.col("mask")).alias("key"))
        sizes = step.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        small = sizes if last else sizes.filter(F.col("n") <= block_rows)
        members = step.join(small.select("path", "key"), ["path", "key"])
        other = members.withColumnRenamed("a", "b")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
        pairs = members.join(other, (members.path == other.path) & (members.key == other.key) & (F.col("a") < F.col("b")) & near)
        pairs = pairs.select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        large = staged(step.join(sizes.filter(F.col("n") > block_rows).select("path", "key"), ["path", "key"]).select("a", "path"))
        if large.isEmpty():
            return found
        rows, fixed = large, [mask for masks in below for mask in masks]


def near_duplicates(docs, id_col="doc_id", text_col="text", shingle=3, max_distance=2, seed=42):
    """One row (id, fingerprint long, component_id) per row of `docs`.

    Fingerprints that differ in at most `max_distance` bits link, and so do
    equal ones; `component_id` is the smallest id reachable. Rows with a null
    id take part and are named by the others (null if all ids of a component
    are null); repeated rows stay repeated; an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle, seed))
    classes = staged(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")))
    roots = components(links(classes.select("fingerprint"), max_distance))
    tied = classes.join(roots, classes.fingerprint == roots.vertex, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    tied = staged(tied)
    named = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = staged(tied.join(named, "root").select("fingerprint", "component_id"))
    return prints.join(by_print, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def keep_one(docs, id_col="doc_id", text_col="text", shingle=3, max_distance=2, seed=42):
    """The rows of `docs`, columns unchanged, with one document left of each group of near-duplicates.

    The document with the smallest id stays, of several with that id the first
    in the table, and of a group without any id the first one. The rows are
    stored once with their keys, which both passes read.
    """
    (key,) = free_names(docs, "row_key")
    keyed = staged(docs.withColumn(key, F.monotonically_increasing_id()))
    name = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(key).alias("key"))
    texts = keyed.select(name.alias("id"), F.col(text_col).alias("text"))
    found = near_duplicates(texts, "id", "text", shingle, max_distance, seed)
    # The few that go are joined, not the many that stay: a short list spares the texts a shuffle.
    goes = staged(found.filter("id.key <> component_id.key").select(F.col("id.key").alias("key")))
    return keyed.join(goes, keyed[key] == goes["key"], "left_anti").drop(key)
