"""Quality rules whose thresholds come from the corpus, per language and source. DataFrame functions only."""

from pyspark.sql import functions as F

from ..sources.staging import staged
from .rows import WORD, free_names, let

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
# Sketch values keep their leading bits: whole numbers below 256 are exact, others off by one part in 128 at most.
SKETCH_BITS = 8
# Sketches of fewer documents give way to those of the language, then to those of all.
LEAST_DOCUMENTS = 100

# Ratios that are judged: name, the counts n and of with n * scale div of, and whether there is a lower fence too.
RULES = (
    ("symbol_rate", "n_symbols", 1000, "n_words", False),
    ("dup_line_rate", "n_dup_lines", 1000, "n_lines", False),
    ("stutter_rate", "n_stutters", 1000, "n_words", False),
    ("word_length", "word_chars", 100, "n_words", True),
)
# Fences lie so many quartile distances from the median.
SPREAD = 8
# A text may go beyond a fence by so many occurrences: one repeated line among three says little, forty among a hundred much.
OCCURRENCES = 3


def _repeats(words, window):
    """Of an array of words: `windows`, the words that lie in a window of `window` words found twice or more,
    and `stutters`, the words equal to the word before.

    Windows are compared by 64-bit hashes of their words' hashes. Only a text
    in which one comes twice sorts them; then the words of the marked windows
    are counted once each, left to right.
    """

    def hashed(h):
        last = F.size(h) - window
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[h[i + j] for j in range(window)]))

    def marked(order):
        same = lambda i, j: order[i]["h"] == order[j]["h"]
        last = F.size(order) - 1
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < last, same(i, i + 1)).otherwise(False),
        )
        return F.array_sort(F.transform(twice, lambda i: order[i]["p"]))

    def covered(starts):
        zero = F.struct(F.lit(-window).alias("p"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(window), p - a["p"])).alias("n")),
            lambda a: a["n"],
        )

    def count(hashes):
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, let(order, lambda o: let(marked(o), covered))).otherwise(0)

    def stutters(h):
        pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: a == b)
        return F.when(F.size(h) > 1, F.size(F.filter(pairs, lambda same: same))).otherwise(0)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    both = lambda h: F.struct(let(hashed(h), count).alias("windows"), stutters(h).alias("stutters"))
    return let(hashes, both)


def base_columns(text, window=WINDOW):
    """One struct of the base counts of a text column (null: none).

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines
    (such lines equal to an earlier one), n_repeat_words (in a window found twice)
    and n_stutters (words equal to the word before).
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    by_word = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            _repeats(w, window).alias("repeats"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")
        ),
    )
    return let(
        F.struct(by_word.alias("w"), by_line.alias("l")),
        lambda s: F.struct(
            s["w"]["n"].alias("n_words"),
            s["w"]["chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            s["l"]["n"].alias("n_lines"),
            s["l"]["dups"].alias("n_dup_lines"),
            s["w"]["repeats"]["windows"].cast("long").alias("n_repeat_words"),
            s["w"]["repeats"]["stutters"].cast("long").alias("n_stutters"),
        ),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")


def measured(docs, text_col="text", least_words=20, most_repeats=30):
    """`docs` with the struct column `quality` added: the base counts, the judged ratios and base_failed.

    Ratios of a text without words or lines are null.
    """
    base = F.struct(base_columns(F.col(text_col)).alias("b"))

    def judged(s):
        b = s["b"]
        per = lambda n, scale, of: F.when(b[of] > 0, F.floor(b[n] * scale / b[of]))
        failed = (b["n_words"] < least_words) | (b["n_repeat_words"] * 100 > b["n_words"] * most_repeats)
        return F.struct(
            *[b[c].alias(c) for c in BASE],
            *[per(n, scale, of).alias(name) for name, n, scale, of, _ in RULES],
            failed.alias("base_failed"),
        )

    return docs.withColumn("quality", let(base, judged))


def sketches(rows, keys=("lang", "source")):
    """Quantile sketches of the judged ratios of rows that pass the base rules: counts per rule, keys and bucket.

    A bucket keeps the leading bits of a whole number (as HDR histograms do),
    so a sketch has a few hundred buckets at most, sketches merge by adding
    counts, and the result depends on no order. Counts are summed before the
    shuffle, so a hot source costs no more than others.
    """
    each = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.col(f"quality.{r[0]}").alias("v")) for r in RULES])
    long = rows.filter("not quality.base_failed").select(*keys, F.inline(each)).filter("v is not null")
    bucket = F.expr("shiftleft(shiftright(v, s), s)")
    return long.withColumn("s", _shift("v")).groupBy("rule", *keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _shift(value):
    """The bits of a whole number that its bucket leaves out."""
    return F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))


def thresholds(sketch, keys=("lang", "source"), least=LEAST_DOCUMENTS):
    """Per rule and keys: low and high, the fences, `SPREAD` quartile distances from the median.

    Nothing else sets them: in a group whose quartiles are equal the median is
    the fence. A bucket counts with the end that makes a distance longer, so
    the sketch's error loses no text. Sketches are merged upwards, (lang,
    source) into lang into all, and the finest level with `least` documents
    decides.
    """
    levels = []
    for depth in range(len(keys), -1, -1):
        own = list(keys[:depth])
        merged = sketch.groupBy("rule", *own, "bucket").agg(F.sum("n").alias("n"))
        cumulative = merged.selectExpr(
            *["rule"], *[f"`{k}`" for k in own], "bucket",
            f"sum(n) over (partition by {', '.join(['rule', *[f'`{k}`' for k in own]])} order by bucket) as upto",
            f"sum(n) over (partition by {', '.join(['rule', *[f'`{k}`' for k in own]])}) as total",
        )
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
        levels.append(
            cumulative.groupBy("rule", *own).agg(
                F.max("total").alias("n"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3")
            )
        )
    groups = sketch.select("rule", *keys).distinct()
    best = None
    for depth, level in zip(range(len(keys), -1, -1), levels, strict=True):
        own = list(keys[:depth])
        named = level.select(
            F.col("rule").alias("r"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(own)],
            F.struct("n", "q1", "q2", "q3").alias(f"level{depth}"),
        )
        on = F.col("rule") == F.col("r")
        for i, k in enumerate(own):
            on &= F.col(k).eqNullSafe(F.col(f"k{i}"))
        groups = groups.join(named, on, "left").drop("r", *[f"k{i}" for i in range(depth)])
        level = F.col(f"level{depth}")
        enough = F.when((level["n"] >= least) | F.lit(depth == 0), level)
        best = enough if best is None else F.coalesce(best, enough)
    low = F.array(*[F.lit(r[0]) for r in RULES if r[4]])
    end = lambda q: F.col(q) + F.expr("shiftleft(1L, s)") - 1
    ends = groups.select("rule", *keys, best.alias("q"))
    for q in ("q2", "q3"):
        ends = ends.withColumn("s", _shift(f"q.{q}")).withColumn(f"{q}_end", end(f"q.{q}"))
    return ends.select(
        "rule",
        *keys,
        F.when(F.array_contains(low, F.col("rule")), F.expr(f"q2_end - {SPREAD} * (q2_end - q.q1)")).alias("low"),
        F.expr(f"q.q2 + {SPREAD} * (q3_end - q.q2)").alias("high"),
    )


def judged(rows, keys=("lang", "source")):
    """Rows with `quality` (a table: it is read twice) and `kept` added.

    Thresholds of all rules meet a row in one join on the keys, null keys
    included. A row is kept if it passes the base rules and each of its ratios
    lies within its fences, or beyond by `OCCURRENCES` at most; a ratio that is null passes.
    """
    by_rule = thresholds(sketches(rows, keys), keys)
    wide = by_rule.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high").alias("f")))).alias("fences")
    )
    names = [f"fence_key_{i}" for i in range(len(keys))]
    wide = staged(wide.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "fences"))
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on &= F.col(k).eqNullSafe(F.col(n))
    within = ~F.col("quality.base_failed")
    for name, n, scale, of, _ in RULES:
        fence, value, size = F.col("fences")[name], F.col(f"quality.{n}") * scale, F.col(f"quality.{of}")
        below = value <= fence["high"] * size + OCCURRENCES * scale
        above = fence["low"].isNull() | (value >= fence["low"] * size - OCCURRENCES * scale)
        within &= F.coalesce((size == 0) | (below & above), F.lit(True))
    return rows.join(wide, on, "left").withColumn("kept", within).drop("fences", *names)


def quality(docs, id_col="doc_id", text_col="text", keys=("lang", "source")):
    """One row per row of `docs`: id, the base counts, the judged ratios, base_failed and kept.

    A null or empty text has no words and fails the base rules; documents with
    a null language or source form groups of their own; repeated rows are
    judged one by one; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(text_col).alias("t"))
    rows = staged(measured(own, "t").drop("t"))
    found = judged(rows, tuple(f"key{i}" for i in range(len(keys))))
    return found.select(F.col("id").alias(id_col), "quality.*", "kept")


def keep_good(docs, text_col="text", keys=("lang", "source")):
    """The rows of `docs` that are kept, columns unchanged."""
    row, text = F.struct("*").alias("row"), F.col(text_col).alias("t")
    own = docs.select(row, *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], text)
    rows = staged(measured(own, "t").drop("t"))
    return judged(rows, tuple(f"key{i}" for i in range(len(keys)))).filter("kept").select("row.*")
