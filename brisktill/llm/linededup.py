"""Line dedup across documents by a fixed-depth template tree."""

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from .rows import free_names, map_batches

# A path of the tree: the number of tokens, then so many leading tokens.
DEPTH = 8
# Shorter lines coincide without being copied: they recur only once so many documents have them.
LEAST_TOKENS = 5
COMMON_DOCUMENTS = 10
# Tails of a leaf's lines are compared by segments; half of those with a token have to agree, and so many at least.
SEGMENTS = 8
LEAST_ALIKE = 2
# Leaves with at most so many different tails are compared in one row, others by keys.
TAILS_AT_ONCE = 64

_DIGIT = re.compile(r"\d")
WILD = "<*>"
_SIGN = 1 << 63
# Scripts that put no spaces between words; each of their characters is a token.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
)
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


def _hash(text):
    value = xxhash.xxh64_intdigest(text.encode())
    return value - (value >> 63 << 64)


def tokens_of(line):
    """The words of a line, in scripts without spaces the characters.

    Tokens with a digit are variable fields and become a wildcard, unless they
    make up over half of the line.
    """
    tokens = line.split() if line.isascii() else _TOKEN.findall(line)
    if _DIGIT.search(line):
        masked = [WILD if _DIGIT.search(t) else t for t in tokens]
        if 2 * masked.count(WILD) <= len(masked):
            return masked
    return tokens


def whole(tokens):
    """The hash of a line that its tokens make up."""
    return _hash(" ".join(tokens))


def template(line, depth=DEPTH):
    """(line hash, leaf hash, two halves of the tail's signature, segments with a token) of a line, or None if it is too short.

    The leaf is the path of the token count and the leading tokens. The
    signature has 16 bits for each segment of the tail; a tail of fewer
    tokens than segments has one token in each of the first ones.
    """
    tokens = tokens_of(line)
    if len(tokens) < LEAST_TOKENS:
        return None
    tail = tokens[depth:]
    filled = min(len(tail), SEGMENTS)
    cuts = [len(tail) * i // max(filled, 1) for i in range(filled + 1)]
    parts = [xxhash.xxh32_intdigest(" ".join(tail[a:b])) & 0xFFFF for a, b in itertools.pairwise(cuts)]
    parts += [0] * (SEGMENTS - filled)
    halves = [int.from_bytes(np.array(parts[i : i + 4], ">u2").tobytes(), "big", signed=True) for i in (0, 4)]
    leaf = _hash(f"{len(tokens)} " + " ".join(tokens[:depth]))
    return whole(tokens), leaf, *halves, filled


def alike(a, b, filled):
    """Whether half of the `filled` segments, and `LEAST_ALIKE` at least, agree between two signatures (pairs of halves)."""
    same = filled - SEGMENTS
    for x, y in zip(a, b, strict=True):
        for i in range(4):
            part = F.shiftrightunsigned(x.bitwiseXOR(y), 16 * i).bitwiseAND(F.lit(0xFFFF))
            same += (part == 0).cast("int")
    return (2 * same >= filled) & (same >= LEAST_ALIKE)


def lines(docs, key, id_col, text_col, depth=DEPTH):
    """One row (key, doc, line number from 0, line hash, leaf, tail signature) per line with a token; short ones have no leaf and tail."""
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("doc", docs.schema[id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in ("line", "exact", "leaf", "tail", "rest", "filled")],
        ]
    )

    def start():
        def work(batch):
            rows, source = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for number, line in enumerate((text or "").split("\n")):
                    if found := template(line, depth) or ((short := tokens_of(line)) and (whole(short), *[None] * 4)):
                        rows.append((number, *found))
                        source.append(i)
            source = pa.array(source, pa.int64())
            keys, names = batch.column(0).take(source), batch.column(1).take(source)
            return [keys, names, *(zip(*rows, strict=True) if rows else [[]] * 6)]

        return work

    return map_batches(docs.select(key, id_col, text_col), start, schema)


def _shared(rows, by):
    """Values of a column that come in two documents or more, with the first one."""
    found = rows.groupBy(by).agg(F.min("doc").alias("first"), F.max("doc").alias("final"), F.count("doc").alias("named"), F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("first") < F.col("final")) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))).select(by, "first")


def _common(short):
    """Short lines that `COMMON_DOCUMENTS` documents have, with the first one; rows without an id are one document."""
    found = short.select("exact", "doc").distinct().groupBy("exact").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= COMMON_DOCUMENTS).select("exact", "first")


def _choices():
    """Per number of filled segments from `LEAST_ALIKE`: pairs of segments, and per pair the smallest sets that are enough and have it as their first pair.

    Two alike tails agree on all of such a set, and so on its pair. Pairs and sets are masks over (tail, rest).
    """

    def mask(chosen):
        halves = [sum(0xFFFF << 16 * (3 - c % 4) for c in chosen if c // 4 == half) for half in (0, 1)]
        return [h - (h >> 63 << 64) for h in halves]

    out = []
    for filled in range(LEAST_ALIKE, SEGMENTS + 1):
        enough = max(LEAST_ALIKE, -(-filled // 2))
        # Of so many segments two lie in the same one of `enough - 1` groups.
        below = {p: [] for p in itertools.combinations(range(filled), 2) if (p[1] - p[0]) % (enough - 1) == 0}
        for chosen in itertools.combinations(range(filled), enough):
            below[next(p for p in below if set(p) <= set(chosen))].append(mask(chosen))
        out.append([(mask(p), sets) for p, sets in below.items()])
    return out


def _masks(masks):
    return F.array(*[F.struct(*[F.lit(m).cast("long").alias(n) for m, n in zip(mask, ("m0", "m1"), strict=True)]) for mask in masks])


def _masked(rows, masks, number, a, b):
    """`rows` once per mask of a list, with the mask's number and the parts of the tail under it."""
    rows = rows.select(*rows.columns, F.posexplode(masks).alias(number, "m"))
    return rows.withColumns({a: F.col("tail").bitwiseAND(F.col("m.m0")), b: F.col("rest").bitwiseAND(F.col("m.m1"))}).drop("m")


def _later(doc, first):
    return (doc > first) | (doc.isNull() & first.isNotNull())


def _earlier_in_crowd(tails):
    """(leaf, tail, rest, first): per tail an earlier document than its own first one that has an alike tail, or its own if there is none.

    Alike tails have a pair of segments in common. Each tail first meets the
    earliest one of those with the same pair; most near copies are settled by
    that. If none is earlier, no alike one under this pair is. What stays open
    is looked up by the pair's sufficient sets among the tails that have the
    pair, so few tails are taken by all their sets and no pairs of tails are made.
    """
    choices = _choices()
    filled = (F.col("filled") - LEAST_ALIKE + 1).cast("int")
    pairs = F.element_at(F.array(*[_masks([pair for pair, _ in group]) for group in choices]), filled)
    sets = F.element_at(F.element_at(F.array(*[F.array(*[_masks(below) for _, below in group]) for group in choices]), filled), F.col("pair") + 1)
    tail, bucket = ["leaf", "tail", "rest"], ["leaf", "pair", "a", "b"]

    paired = _masked(tails, pairs, "pair", "a", "b")
    # Stored, so that a short list is known as such and near copies, who share their pairs, are not dealt by them.
    leads = staged(paired.groupBy(bucket).agg(F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "tail", "rest")).alias("lead")))
    earlier = _later(F.col("first"), F.col("lead.first"))
    close = alike((F.col("tail"), F.col("rest")), (F.col("lead.tail"), F.col("lead.rest")), F.col("filled"))
    met = paired.join(leads, bucket).withColumns({"earlier": earlier, "close": close})
    settled = met.groupBy(tail).agg(
        F.first("first").alias("first"),
        F.first("filled").alias("filled"),
        F.min(F.when(F.col("earlier") & F.col("close"), F.col("lead.first"))).alias("found"),
        F.collect_list(F.when(F.col("earlier") & ~F.col("close"), F.struct("pair", "a", "b"))).alias("open"),
    )
    settled = staged(settled)

    asked = settled.filter("found is null").select(*tail, "filled", F.inline("open"))
    members = paired.join(staged(asked.select(bucket).distinct()), bucket, "left_semi")
    one_set = ["leaf", "pair", "set", "part", "other"]
    by_set = _masked(members, sets, "set", "part", "other").groupBy(one_set).agg(F.min("first").alias("earliest"))
    answers = _masked(asked, sets, "set", "part", "other").join(by_set, one_set).groupBy(tail).agg(F.min("earliest").alias("earliest"))
    return settled.join(answers, tail, "left").select(*tail, F.least("first", "found", "earliest").alias("first"))


def _first_alike(tails):
    """(leaf, tail, rest, first): per tail of a leaf a document that has an alike one, earlier than the tail's own first one if any is.

    `tails` are the different ones, with their first document. In a leaf of
    few tails each meets all others; larger ones are compared by keys.
    """
    crowded = tails.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TAILS_AT_ONCE).select("leaf")
    crowded = staged(crowded)
    few = tails.join(crowded, "leaf", "left_anti").groupBy("leaf").agg(F.collect_list(F.struct("tail", "rest", "first", "filled")).alias("all"))

    def earliest(one, every):
        close = F.filter(every, lambda o: alike((one["tail"], one["rest"]), (o["tail"], o["rest"]), one["filled"]))
        return F.array_min(F.transform(close, lambda o: o["first"]))

    met = F.transform("all", lambda one: F.struct(one["tail"].alias("tail"), one["rest"].alias("rest"), earliest(one, F.col("all")).alias("first")))
    near = few.select("leaf", F.inline(met))
    return near.unionByName(_earlier_in_crowd(staged(tails.join(crowded, "leaf", "left_semi"))))


def recurring(rows):
    """(key, line) of the lines whose template an earlier document has.

    Earlier is a smaller id; a null id comes last. A line recurs if an earlier
    document has the same line but for variable fields, or a line of the same
    leaf that agrees on half of the segments of the tail that hold a token,
    and on `LEAST_ALIKE` at least. A line of fewer than `LEAST_TOKENS` tokens has to be the same in
    `COMMON_DOCUMENTS` documents.
    """
    later = _later(F.col("doc"), F.col("first"))
    short, rows = rows.filter("leaf is null"), rows.filter("leaf is not null")
    shared = staged(_shared(rows, "exact").unionByName(_common(short)))
    same = rows.unionByName(short).join(shared, "exact").filter(later).select("key", "line")
    signed = rows.filter(F.col("filled") >= LEAST_ALIKE)
    in_leaf = staged(signed.join(staged(_shared(signed, "leaf").select("leaf")), "leaf").select("key", "doc", "line", "leaf", "tail", "rest", "filled"))
    tails = staged(in_leaf.groupBy("leaf", "tail", "rest").agg(F.min("doc").alias("first"), F.first("filled").alias("filled")))
    close = in_leaf.join(staged(_first_alike(tails)), ["leaf", "tail", "rest"]).filter(later)
    return same.unionByName(close.select("key", "line"))


def dedup(docs, id_col="doc_id", text_col="text", count_col="n_dropped", depth=DEPTH):
    """The rows of `docs` without lines whose template an earlier document has; `count_col` counts the lines dropped.

    Rows with the same id are one document, as are rows without one, and a
    document's own repeated lines stay. A null or empty text stays as it is; so does every text that
    loses nothing. The rows are stored once with their keys: both passes read
    the stored ones, however `docs` would be split on a second read.
    """
    key, dropped = free_names(docs, "row_key", "row_lines")
    keyed = staged(docs.withColumn(key, F.monotonically_increasing_id()))
    found = recurring(staged(lines(keyed, key, id_col, text_col, depth)))
    by_row = staged(found.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.col("line").cast("int")).alias(dropped)))
    # A share of all rows is listed, so the list grows with the table: the same merge join at every size.
    joined = keyed.join(by_row.hint("merge"), key, "left")
    split = F.split(F.col(text_col), "\n")
    # Kept line numbers come from a set difference, which stays linear for texts of very many lines.
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
    rest = F.transform(F.array(split), lambda all_lines: F.array_join(F.transform(kept, lambda i: all_lines[i]), "\n"))[0]
    text = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(rest)
    out = joined.withColumn(text_col, text).withColumn(count_col, F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
    return out.select(*docs.columns, count_col)


def drop_lines(docs, id_col="doc_id", text_col="text", length_col="n_chars", depth=DEPTH):
    """The rows of `docs`, columns unchanged, without recurring lines; rows whose last word went with them go too.

    A text that changes gets its length in `length_col`, if there is such a column.
    """
    (count,) = free_names(docs, "n_dropped")
    out = dedup(docs, id_col, text_col, count, depth).filter((F.col(count) == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if length_col in docs.columns:
        length = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(count) > 0, length).otherwise(F.col(length_col)))
    return out.drop(count)
