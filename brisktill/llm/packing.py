"""Packing of documents into training sequences along a space-filling curve."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import free_names
from .tokens import encoder, tokenizer_path

TOKENIZER = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
LENGTH = 1024
END = 0
# Hashed vectors have so many buckets; they are projected to so many coordinates of so many bits.
BUCKETS = 4096
DIMENSIONS = 4
BITS = 12
# Coordinates of projected unit vectors lie within this range but for a few, which take its ends.
REACH = 3.0
# Bytes of a text that are hashed at once.
_AT_ONCE = 1 << 20


def projection(seed=11):
    """The random signs that project hashed vectors, the same for the same seed."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (BUCKETS, DIMENSIONS))


def hashed_vector(text):
    """Counts of a text's hashed runs of four bytes (UTF-8 bytes, or None for none)."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer((text or b"").ljust(4), np.uint8)
    for at in range(0, len(raw) - 3, _AT_ONCE):
        part = raw[at : at + _AT_ONCE + 3].astype(np.uint32)
        grams = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        counts += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
    return counts


def cells(vectors, signs):
    """Grid cells of hashed vectors: square roots of counts, scaled to length one and projected."""
    rows = np.sqrt(np.asarray(vectors, float))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    place = (np.clip(rows @ signs / REACH, -1, 1) + 1) / 2
    return np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(points, bits=BITS):
    """Positions along the Hilbert curve of grid cells, one row per point (Skilling, 2004).

    Cells that follow each other along the curve are neighbours in the grid.
    """
    x = np.array(points, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_key(text, seed=11):
    """The position of a text column along the curve."""
    signs = projection(seed)

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        keys = []
        for part in range(0, len(texts), 256):
            vectors = [hashed_vector(t) for t in texts.slice(part, 256).to_pylist()]
            keys.append(hilbert_key(cells(vectors, signs)))
        return pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))

    return key(text.cast("binary"))


def pack(docs, id_col="doc_id", text_col="text", paths=None, length=LENGTH, end=END, seed=11):
    """Pieces of documents in sequences of at most `length` tokens.

    Documents are range-sorted by their place along the curve, so that
    neighbours hold similar text; each partition then writes its documents one
    after another and cuts the stream every `length` tokens. Only the last
    sequence of a partition is shorter. A document's tokens are its ids and
    `end`; a null or empty text is `end` alone. Documents at one place are
    sorted by id and row, so copies of one text spread over partitions, and a
    lost task is rerun with the same result.

    One row per piece: the id, start (the document's ids before it), ids
    (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset
    (tokens of the sequence before it). Sequence ids are unique, not gapless.
    """
    if length < 1:
        raise ValueError("a sequence needs room for a token")
    paths = paths or [tokenizer_path(name) for name in TOKENIZER]
    place, row = free_names(docs.select(id_col, text_col), "place", "row")
    placed = docs.select(
        id_col, F.col(text_col), curve_key(F.col(text_col), seed).alias(place), F.monotonically_increasing_id().alias(row)
    )
    order = [place, id_col, row]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, text_col)
    schema = T.StructType(
        [
            ordered.schema[0],
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            *[T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")],
        ]
    )
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(*paths).encode
        first, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                names, texts = batch.slice(part, 64).columns
                sources, pieces = [], []
                for i, text in enumerate(texts.to_pylist()):
                    ids = encode(text).tobytes() + last
                    total = len(ids) // 4
                    start = 0
                    while start < total:
                        offset = at % length
                        step = min(length - offset, total - start)
                        sources.append(i)
                        pieces.append((start, ids[4 * start : 4 * (start + step)], total, first + at // length, offset))
                        start += step
                        at += step
                columns = [pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(sources)), *columns], names=titles)

    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    titles = [f.name for f in schema]
    return ordered.mapInArrow(run, schema)


def sequences(pieces, length=LENGTH, pad=END):
    """One row per sequence of `pieces`: sequence_id, tokens (without padding), ids (padded unless a power of two).

    Padding fills a sequence to `length`; one whose length is a power of two stays as it is.
    """
    zeros = np.array([pad], "<u4").tobytes()
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    found = pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("tokens", F.length("ids") / 4)
    found = found.withColumn("tokens", F.col("tokens").cast("long"))
    whole = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    padding = F.expr(f"repeat(X'{zeros.hex()}', cast({length} - tokens as int))")
    return found.withColumn("ids", F.when(whole, F.col("ids")).otherwise(F.concat("ids", padding)))


def digest(pieces, id_col="doc_id"):
    """Pieces with length and ids_crc32 instead of the ids."""
    return pieces.select(
        id_col, "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
