"""Benchmark decontamination by a distributed positional inverted index.

The texts' term postings are stored once: for every segment (documents of one
task, some megabytes of text) and term the places where the term stands. Test
items are cut into windows of `WIDTH` words. A window is looked for from its
rarest term: that term's list, shifted by the term's offset, gives the places
where the window could begin, the second-rarest term's list cuts these down,
and what is left meets the lists of all the window's terms.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.staging import staged
from .rows import free_names
from .terms import chunks, terms

WIDTH = 10
# Places left free between the documents of a segment, so that nothing matches across two of them.
GAP = 1024


class PositionalIndex:
    """`lists` (term, segment, places: unsigned 32-bit numbers, ascending) and `docs` (key, doc, segment, first, n_words)."""

    def __init__(self, stored):
        self.lists = stored.filter("term is not null").select("term", "segment", "places")
        self.docs = stored.filter("key is not null").select("key", "doc", "segment", "first", "n_words")


def build_index(docs, id_col="doc_id", text_col="text"):
    """The stored positional index of all terms of whole texts.

    One pass writes postings and document rows together, so both agree on keys
    and segments however often they are read. A null text has no terms.
    """
    (key,) = free_names(docs, "row_key")
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("segment", T.LongType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("key", T.LongType()),
            T.StructField("doc", kind),
            T.StructField("first", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for begin, end in chunks(batch.column(2)):
                part = batch.slice(begin, end - begin)
                found, rows = terms(part.column(2))
                yield from _segment(part, found, rows)

    keyed = docs.select(F.monotonically_increasing_id().alias(key), id_col, text_col)
    return PositionalIndex(staged(keyed.mapInArrow(run, schema)))


_ROWS = 10_000


def _segment(part, found, rows):
    """Posting rows and document rows of one segment, named by its first document's key."""
    names = ["term", "segment", "places", "key", "doc", "first", "n_words"]
    segment = part.column(0)[0].as_py()
    counts = np.bincount(rows, minlength=part.num_rows)
    taken = counts + GAP * (counts > 0)
    first = np.cumsum(taken) - taken
    coded = found.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    place = first[rows] + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    order = np.argsort(codes, kind="stable")
    bounds = np.zeros(len(coded.dictionary) + 1, np.int64)
    np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)) * 4, out=bounds[1:])
    lists = pa.py_buffer(place[order].astype("<u4"))
    lists = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), lists])
    for at in range(0, len(lists), _ROWS):
        some = lists.slice(at, _ROWS).cast(pa.binary())
        n = len(some)
        word = coded.dictionary.slice(at, _ROWS).cast(pa.string())
        void = [pa.nulls(n, t) for t in (pa.int64(), part.column(1).type, pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([word, pa.array(np.full(n, segment)), some, *void], names=names)
    n = part.num_rows
    columns = [pa.nulls(n, pa.string()), pa.array(np.full(n, segment)), pa.nulls(n, pa.binary()), *part.columns[:2]]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(first), pa.array(counts.astype(np.int64))], names=names)


def item_words(items, id_col="item_id", text_col="text"):
    """One row (item, name, n, words) per row of `items` with a word.

    Items are named by their id as text, the empty string for none. Equal word
    sequences are one `item`, a 60-bit digest, whatever they are called.
    """
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            found, rows = terms(batch.column(1))
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(bounds), found.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["name", "words"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_col)
    found = named.mapInArrow(run, schema).filter("size(words) > 0")
    item = F.conv(F.substring(F.sha2(F.concat_ws(" ", "words"), 256), 1, 15), 16, 10).cast("long")
    return staged(found.select(item.alias("item"), "name", F.size("words").alias("n"), "words").distinct())


def _plan(index, items, width):
    """(probes, words): the two rarest terms of every window and where such windows begin; per item its words.

    Windows of an item that share both are one probe. Frequencies come from the index; a window with a term that no
    text has is no probe. c is -1 where a window has one word.
    """
    words = staged(items.select("item", "n", "words").distinct().select("item", "n", F.posexplode("words").alias("o", "term")))
    asked = staged(words.select("term").distinct())
    frequency = index.lists.join(asked, "term").groupBy("term").agg(F.sum(F.octet_length("places")).alias("f"))
    found = words.join(staged(frequency), "term", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    found = found.withColumn("k", F.least(F.col("n"), F.lit(width)))
    begins = F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("k") + 1), F.least(F.col("o"), F.col("n") - F.col("k")))
    windows = found.withColumn("s", F.explode(begins)).groupBy("item", "s", "k")
    windows = windows.agg(F.sort_array(F.collect_list(F.struct("f", "o", "term"))).alias("by")).filter(F.col("by")[0]["f"] > 0)
    first, second = F.col("by")[0], F.get("by", F.lit(1))
    picked = windows.select(
        "item", "s", "k", first["o"].alias("a"), first["term"].alias("first_term"),
        F.coalesce(second["o"], F.lit(-1)).alias("c"), second["term"].alias("second_term"),
    )
    return staged(picked.groupBy("item", "k", "a", "first_term", "c", "second_term").agg(F.collect_list("s").alias("begins"))), words


def _spread(lists, kept):
    """A row per place of a list, which replaces the list."""
    fields = [*lists.select(*kept).schema, T.StructField("place", T.LongType())]

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
            source = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            place = pa.array(np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[c.take(source) for c in batch.columns[:-1]], place], names=[f.name for f in fields])

    return lists.select(*kept, "places").mapInArrow(run, T.StructType(fields))


def confirmed(lists, asked, payload, reach=0):
    """The rows of `asked` (segment, term, place, payload columns) whose term stands within `reach` of the place.

    Places asked of one list are gathered, met with the list in one step and
    dealt out again. A group holds what is asked of one term in one segment.
    Lists of terms that nothing asks for stay where they are.
    """
    asked = staged(asked)
    lists = lists.join(staged(asked.select("term").distinct()), "term", "left_semi")
    held = F.collect_list(F.struct("place", *payload)).alias("asked")
    joined = lists.join(asked.groupBy("segment", "term").agg(held), ["segment", "term"])
    fields = [T.StructField("segment", T.LongType()), T.StructField("term", T.StringType())]
    schema = T.StructType([*fields, *asked.select("place", *payload).schema])

    def run(batches):
        for batch in batches:
            nested, lists_of = batch.column(2), batch.column(3).to_pylist()
            bounds = nested.offsets.to_numpy()
            flat = nested.values
            places = flat.field("place").to_numpy(zero_copy_only=False)
            hit = np.zeros(len(places), bool)
            for row, stored in enumerate(lists_of):
                there = np.frombuffer(stored, "<u4").astype(np.int64)
                part = slice(bounds[row], bounds[row + 1])
                after = np.searchsorted(there, places[part] - reach)
                hit[part] = there[np.minimum(after, len(there) - 1)] <= places[part] + reach
                hit[part] &= after < len(there)
            chosen = pa.array(np.flatnonzero(hit))
            row = pa.array(np.searchsorted(bounds, np.flatnonzero(hit), side="right") - 1)
            values = flat.take(chosen)
            columns = [batch.column(0).take(row), batch.column(1).take(row), *values.flatten()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select("segment", "term", "asked", "places").mapInArrow(run, schema)


def _candidates(index, probes, reach):
    """(segment, item, a, c, origin): where a probe's two rarest terms stand as in the window.

    origin is the place of the item's word 0, so the window's other words have known places. With a reach, the second
    term stands anywhere within it of the first.
    """
    rarest = index.lists.join(probes.withColumnRenamed("first_term", "term"), "term")
    found = _spread(rarest, ["segment", "item", "a", "c", "second_term"])
    found = staged(found.withColumn("origin", F.col("place") - F.col("a")).drop("place"))
    payload = ["item", "a", "c", "origin"]
    alone = found.filter("c < 0").select("segment", *payload)
    place = (F.col("origin") + F.col("a" if reach else "c")).alias("place")
    pairs = found.filter("c >= 0").select("segment", F.col("second_term").alias("term"), place, *payload)
    pairs = confirmed(index.lists, pairs, payload, reach).select("segment", *payload)
    return staged(pairs.unionByName(alone))


def phrases(index, items, width=WIDTH):
    """Rows (segment, item, begin, end) of `item_words`: the longest stretches of places that hold whole windows of an item.

    A window is `width` consecutive words of an item, or all of them if it has
    fewer. What two rarest terms leave over meets the lists of all terms of the
    window; runs of confirmed places as long as a window are occurrences.
    """
    probes, words = _plan(index, items, width)
    found = _candidates(index, probes, 0).join(probes.select("item", "a", "c", "k", "begins"), ["item", "a", "c"])
    found = found.select("segment", "item", "origin", "k", F.explode("begins").alias("s"))
    found = found.select("segment", "item", "origin", "k", F.explode(F.sequence("s", F.col("s") + F.col("k") - 1)).alias("o")).distinct()
    asked = found.join(words, ["item", "o"]).withColumn("place", F.col("origin") + F.col("o"))
    there = confirmed(index.lists, asked, ["item", "origin", "k"])
    run = F.col("place") - F.row_number().over(Window.partitionBy("segment", "item", "origin").orderBy("place"))
    runs = there.withColumn("run", run).groupBy("segment", "item", "origin", "k", "run")
    runs = runs.agg(F.min("place").alias("begin"), F.max("place").alias("end")).filter("end - begin + 1 >= k")
    return staged(runs.select("segment", "item", "begin", "end").distinct())


def near(index, items, distance, width=WIDTH):
    """Rows (segment, item, begin, end): places of a window's rarest term with all its other terms within `distance`.

    Order and repeats do not matter; begin and end are the rarest term's place.
    """
    if not 0 < distance < GAP:
        raise ValueError(f"distance is 1 to {GAP - 1}")
    probes, words = _plan(index, items, width)
    found = _candidates(index, probes, distance).join(probes.select("item", "a", "c", "k", "begins"), ["item", "a", "c"])
    found = found.select("segment", "item", "k", F.explode("begins").alias("s"), (F.col("origin") + F.col("a")).alias("place"))
    own = words.select("item", "o", "term")
    asked = found.withColumn("o", F.explode(F.sequence("s", F.col("s") + F.col("k") - 1))).join(own, ["item", "o"])
    asked = staged(asked.drop("o").distinct())
    by = ["segment", "item", "s", "place"]
    needed = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("needed"))
    there = confirmed(index.lists, asked, ["item", "s"], distance).groupBy(*by).agg(F.count(F.lit(1)).alias("there"))
    matches = needed.join(there, by).filter("needed = there")
    return staged(matches.select("segment", "item", F.col("place").alias("begin"), F.col("place").alias("end")).distinct())


def located(index, found):
    """`found` (segment, begin, ...) with the key of the document it lies in: the last one that begins at or before it."""
    starts = index.docs.filter("n_words > 0").select("segment", F.col("first").alias("at"), "key", F.lit(None).cast("struct<item bigint, begin bigint, end bigint>").alias("hit"))
    hits = found.select("segment", F.col("begin").alias("at"), F.lit(None).cast("bigint").alias("key"), F.struct("item", "begin", "end").alias("hit"))
    # A segment's documents and hits are as many as some megabytes of text can hold.
    order = Window.partitionBy("segment").orderBy("at", F.col("key").isNull())
    both = starts.unionByName(hits).withColumn("key", F.last("key", ignorenulls=True).over(order))
    return both.filter("hit is not null").select("key", "hit.*")


def contamination(docs, items, width=WIDTH, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """One row (doc, n_words, n_hit, n_items, items_sha256, contaminated) per row of `docs`.

    n_hit counts words inside any occurrence of a window; n_items the ids of
    items with one (all items without an id count as one, named by the empty string). Null and
    wordless texts have no words and no hits; wordless items have no windows;
    equal texts and repeated rows are each counted as they stand. Empty tables give no rows, or no hits.
    """
    index = build_index(docs, id_col, text_col)
    named = item_words(items, item_id, item_text)
    hits = staged(located(index, phrases(index, named, width)))
    words = hits.select("key", F.explode(F.sequence("begin", "end")).alias("place")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = hits.select("key", "item").distinct().join(named.select("item", "name").distinct(), "item")
    names = names.groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names"))
    rows = index.docs.join(staged(words.join(names, "key")), "key", "left")
    return rows.select(
        "doc",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
