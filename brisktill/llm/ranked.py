"""Ranked lexical search of all documents for a stated set of items, by a dual-tree search.

Items and documents are each held in a hierarchy whose nodes keep, per term,
the maximum over what lies below them. The product of two nodes' maxima is at
least the score of every pair below; where it is less than the weakest kth
score of the node's items, the whole batch of pairs is left out. Scores are
whole numbers, so nothing is lost to rounding.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.staging import staged
from .rows import free_names
from .terms import chunks, terms

# Items come to the driver in blocks of so many characters of text (or one longer item); the documents are read for each.
BLOCK_CHARS = 4 << 20
# Hierarchy of documents: so many under a node of each level, and at most so many under a root.
DOC_LEVELS = (512, 64, 16)
TREE_DOCS = 4096
# Hierarchy of items below a root of at most so many items and words.
ITEM_LEVELS = (64, 8, 1)
ROOT_ITEMS, ROOT_WORDS = 256, 8192
# Cells of a matrix of node maxima.
CELLS = 1 << 22
# One document in so many gives the kth scores that the search starts from.
START = 16
# Contributions of a term to a score are below its weight times this.
MOST = 1_000_000


class Root:
    """A root of the items' hierarchy: its items, their terms, and the terms' weights per level."""

    def __init__(self, items, codes, weights):
        self.items = np.asarray(items)
        self.codes = np.unique(np.concatenate([codes[i] for i in items]))
        exact = max(int(weights[codes[i]].sum()) for i in items) * MOST < 1 << 53
        self.kind = np.float64 if exact else np.int64
        table = np.zeros((len(self.codes), len(items)), self.kind)
        for column, i in enumerate(items):
            table[np.searchsorted(self.codes, codes[i]), column] = weights[codes[i]]
        self.table = table
        self.levels = [np.maximum.reduceat(table, np.arange(0, len(items), size), axis=1) for size in ITEM_LEVELS]


def roots(codes, weights):
    """Roots over the items with a term, those with the same weightiest term side by side."""
    order = sorted((i for i, c in enumerate(codes) if len(c)), key=lambda i: (int(codes[i][np.argmax(weights[codes[i]])]), i))
    held, words = [], 0
    for i in order:
        if held and (len(held) == ROOT_ITEMS or words + len(codes[i]) > ROOT_WORDS):
            yield Root(held, codes, weights)
            held, words = [], 0
        held.append(i)
        words += len(codes[i])
    if held:
        yield Root(held, codes, weights)


def _rise(matrix, counts):
    """Maxima of consecutive rows, `counts` of them each."""
    return np.maximum.reduceat(matrix, np.arange(0, len(matrix), counts), axis=0)


def _finer(alive, axis, times, size):
    return np.repeat(alive, times, axis=axis).take(range(size), axis=axis)


def _dense(rows, columns, values, shape, kind):
    out = np.zeros(shape, kind)
    np.maximum.at(out, (rows, columns), values)
    return out


def pairs(root, doc, code, impact, n_docs, weakest):
    """(item positions in the root, documents, scores) of all pairs that score at least the item's weakest kth and above 0.

    Documents are numbered along the tree; (doc, code, impact) lists their terms in order of documents.
    """
    at = np.minimum(np.searchsorted(root.codes, code), len(root.codes) - 1)
    own = root.codes[at] == code
    doc, column, impact = doc[own], at[own], impact[own]
    leaf = DOC_LEVELS[-1]
    leaves = -(-n_docs // leaf)
    levels = [_dense(doc // leaf, column, impact, (leaves, len(root.codes)), root.kind)]
    for small, large in zip(DOC_LEVELS[::-1], DOC_LEVELS[-2::-1], strict=False):
        levels.insert(0, _rise(levels[0], large // small))
    limits = [np.minimum.reduceat(weakest, np.arange(0, len(weakest), size)) for size in ITEM_LEVELS]
    alive = np.ones((len(levels[0]), root.levels[0].shape[1]), bool)
    for depth, (docs, items) in enumerate(zip(levels, root.levels, strict=True)):
        if depth:
            alive = _finer(alive, 0, DOC_LEVELS[depth - 1] // DOC_LEVELS[depth], len(docs))
            alive = _finer(alive, 1, ITEM_LEVELS[depth - 1] // ITEM_LEVELS[depth], items.shape[1])
        some, others = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        bound = docs[some] @ items[:, others]
        # An equal score can still win by its document's id.
        alive[np.ix_(some, others)] &= (bound >= limits[depth][others]) & (bound > 0)
    out = []
    kept = np.flatnonzero(alive.any(1))
    step = max(1, CELLS // (leaf * len(root.codes)))
    starts = np.searchsorted(doc, np.arange(leaves + 1) * leaf)
    for some in (kept[i : i + step] for i in range(0, len(kept), step)):
        others = np.flatnonzero(alive[some].any(0))
        own = np.concatenate([np.arange(starts[a], starts[a + 1]) for a in some])
        row = np.searchsorted(some, doc[own] // leaf) * leaf + doc[own] % leaf
        score = _dense(row, column[own], impact[own], (len(some) * leaf, len(root.codes)), root.kind) @ root.table[:, others]
        good = (score >= weakest[others]) & (score > 0) & np.repeat(alive[np.ix_(some, others)], leaf, axis=0)
        row, item = np.nonzero(good)
        out.append((others[item], some[row // leaf] * leaf + row % leaf, score[row, item].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


class Pool:
    """The best `k` documents of each item so far: (item, score, doc, key), highest first, ties by ascending id, null last."""

    def __init__(self, n_items, k, start, kind):
        self.k, self.weakest = k, start.copy()
        self.rows = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "doc": pa.array([], kind), "key": pa.array([], pa.int64())})
        self.waiting = []
        self.n_items = n_items

    def add(self, item, score, doc, key):
        if len(item):
            self.waiting.append(pa.table({"item": item, "score": score, "doc": doc, "key": key}))

    def settle(self):
        if not self.waiting:
            return
        rows = pa.concat_tables([self.rows, *self.waiting])
        by = [("item", "ascending"), ("score", "descending"), ("doc", "ascending"), ("key", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_end"))
        item = rows["item"].to_numpy()
        first = np.searchsorted(item, np.arange(self.n_items))
        self.rows = rows.filter(pa.array(np.arange(len(item)) - first[item] < self.k)).combine_chunks()
        self.waiting = []
        item, score = self.rows["item"].to_numpy(), self.rows["score"].to_numpy()
        last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == self.k - 1)
        self.weakest[item[last]] = np.maximum(self.weakest[item[last]], score[last])


def vectors(docs, vocabulary, id_col, text_col):
    """Stored rows (key, doc, n, docs, codes, counts): per document with a term of the vocabulary what it has of it.

    Rows without a key sum up a task's chunk: its terms, its documents with a term, and the documents per term.
    """
    (key,) = free_names(docs, "row_key")
    fields = [T.StructField("key", T.LongType()), T.StructField("doc", docs.schema[id_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("n", "docs")] + [T.StructField(n, T.BinaryType()) for n in ("codes", "counts")]
    names = [f.name for f in fields]
    size = len(vocabulary)

    def counted(part):
        found, rows = terms(part.column(2))
        n = np.bincount(rows, minlength=part.num_rows)
        coded = found.dictionary_encode()
        code = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.string()), value_set=vocabulary), -1).to_numpy()
        code = code[coded.indices.to_numpy(zero_copy_only=False)] if len(code) else np.empty(0, np.int64)
        pair, count = np.unique(rows[code >= 0] * size + code[code >= 0], return_counts=True)
        doc, code = pair // size, pair % size
        own, at = np.unique(doc, return_index=True)
        bounds = np.append(at, len(doc)).astype(np.int32) * 4
        lists = [
            pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds), pa.py_buffer(x.astype("<u4"))]) for x in (code, count)
        ]
        own = pa.array(own)
        head = [c.take(own) for c in part.columns[:2]]
        yield pa.RecordBatch.from_arrays([*head, pa.array(n.astype(np.int64)).take(own), pa.nulls(len(own), pa.int64()), *lists], names=names)
        seen, df = np.unique(code, return_counts=True)
        total = [pa.nulls(1, pa.int64()), pa.nulls(1, part.column(1).type), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])]
        yield pa.RecordBatch.from_arrays([*total, *[pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (seen, df)]], names=names)

    def run(batches):
        for batch in batches:
            for begin, end in chunks(batch.column(2)):
                yield from counted(batch.slice(begin, end - begin))

    keyed = docs.select(F.monotonically_increasing_id().alias(key), id_col, text_col)
    return staged(keyed.mapInArrow(run, T.StructType(fields)))


def _frequencies(stored, size):
    """(documents with a term, terms, documents per code): the sums of the tasks' sums; `size` bounds what comes back."""
    sums = stored.filter("key is null")
    n_docs, n_terms = sums.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches):
        for batch in batches:
            code, df = (np.frombuffer(b"".join(c.to_pylist()), "<u4").astype(np.int64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(df)], names=["code", "df"])

    per_code = sums.select("codes", "counts").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for code, df in per_code.collect():
        out[code] = df
    return n_docs, n_terms, out


def _searched(rows, kind, forest, weights, n_docs, n_terms, n_items, k, start):
    """Each task's best `k` documents per item, as far as they reach the start scores."""
    most = max(len(root.codes) for root in forest)
    tree_docs = DOC_LEVELS[-1] * max(1, min(TREE_DOCS // DOC_LEVELS[-1], CELLS // most))

    def search(batch, pool):
        counts = pc.binary_length(batch.column(3)).to_numpy() // 4
        n = batch.column(2).to_numpy()
        code, tf = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").astype(np.int64) for i in (3, 4))
        doc = np.repeat(np.arange(len(n)), counts)
        m = 50 + 50 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        # Neighbours in the tree share their weightiest term.
        gain = np.lexsort((-weights[code] * impact, doc))
        lead = code[gain[np.cumsum(counts) - counts]]
        order = np.argsort(lead, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        turned = np.argsort(place[doc], kind="stable")
        doc, code, impact = place[doc][turned], code[turned], impact[turned]
        for root in forest:
            item, found, score = pairs(root, doc, code, impact, len(n), pool.weakest[root.items])
            row = pa.array(order[found])
            pool.add(root.items[item], score, batch.column(1).take(row), batch.column(0).take(row))
        pool.settle()

    def run(batches):
        pool = None
        for batch in batches:
            pool = pool or Pool(n_items, k, start, batch.column(1).type)
            for at in range(0, batch.num_rows, tree_docs):
                search(batch.slice(at, tree_docs), pool)
        if pool:
            yield from pool.rows.to_batches(max_chunksize=10_000)

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), kind, T.StructField("key", T.LongType())])
    return rows.select("key", "doc", "n", "codes", "counts").mapInArrow(run, schema)


def _best(found, k):
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs, ids, texts, k, id_col, text_col):
    """(item position, rank, doc, score) of one block of items."""
    found, rows = terms(pa.array(texts, pa.string()))
    coded = found.dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.string())
    if not len(vocabulary):
        return None
    bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
    coded = coded.indices.to_numpy(zero_copy_only=False)
    codes = [np.unique(coded[a:b]).astype(np.int64) for a, b in itertools.pairwise(bounds)]
    stored = vectors(docs, vocabulary, id_col, text_col)
    n_docs, n_terms, df = _frequencies(stored, len(vocabulary))
    if not n_docs:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    forest = list(roots(codes, weights))
    own = stored.filter("key is not null")
    kind = stored.schema["doc"]
    none = np.zeros(len(ids), np.int64)
    sample = own.filter(F.pmod(F.xxhash64("key"), F.lit(START)) == 0)
    begun = _best(_searched(sample, kind, forest, weights, n_docs, n_terms, len(ids), k, none), k).filter(F.col("rank") == k)
    start = none.copy()
    for item, score in begun.select("item", "score").collect():
        start[item] = score
    return _best(_searched(own, kind, forest, weights, n_docs, n_terms, len(ids), k, start), k).select("item", "rank", "doc", "score")


def _cut(rows):
    """(ids, texts) of consecutive items, at most `BLOCK_CHARS` of text or one item."""
    ids, texts, size = [], [], 0
    for name, text in rows:
        if ids and size + len(text) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, texts


def search(docs, items, k=50, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """Rows (item, rank, doc, score): the `k` documents of highest score above 0 for each row of `items`.

    Equal scores go by ascending document id, null last; rows with the same id
    and score keep any order. Each row of `items` is an item of its own, also
    if ids are equal or null; items and documents without a term (null or
    empty texts) get no rows. Every document is searched: a sample of them only
    sets the kth scores to start from. Items are read block by block.
    """
    kind = T.StructField("item", items.schema[item_id].dataType)
    out = [kind, T.StructField("rank", T.IntegerType()), T.StructField("doc", docs.schema[id_col].dataType), T.StructField("score", T.LongType())]
    spark = docs.sparkSession
    result = spark.createDataFrame([], T.StructType(out))
    asked = items.filter(F.col(item_text).isNotNull()).select(item_id, item_text)
    for ids, texts in _cut(asked.toLocalIterator()):
        found = _block(docs, ids, texts, k, id_col, text_col)
        if found is not None:
            names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("at", T.LongType()), kind]))
            found = found.withColumnRenamed("item", "at").join(names, "at").select("item", "rank", "doc", "score")
            result = result.unionByName(staged(found))
    return result
