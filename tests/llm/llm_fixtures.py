"""Small tables for the text operators: nulls, blanks, repeats, ties, long texts, clashing columns."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Columns that operators use inside, as a table may have them already.
CLASHING = (
    "row_key", "row_lines", "n_dropped", "quality", "kept", "fingerprint", "component_id", "key", "t", "row", "place",
    "tie", "part", "fences", "key0", "id", "ids", "doc", "start", "vector", "n", "cls",
)


def prose(seed, words, line=12):
    rng = random.Random(seed)
    parts = [rng.choice("the of and to in is that it was for on are with as at be this from or an".split()) + rng.choice("abcdefghij") * rng.randint(0, 4) for _ in range(words)]
    return "\n".join(" ".join(parts[i : i + line]) for i in range(0, words, line))


def awkward_rows():
    """Rows of every kind an operator has to bear."""
    long = prose(1, 30_000)
    texts = [
        (1, prose(2, 200), "en", "a"),
        (2, prose(2, 200), "en", "a"),
        (2, prose(2, 200), "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, "a"),
        (5, " \t\n ", "de", None),
        (6, prose(3, 200) + " end", "en", "a"),
        (7, prose(3, 200) + " eng", "en", "a"),
        (8, long, "fr", "b"),
        (9, "one word " * 40, "fr", "b"),
        (None, prose(2, 200), None, None),
        (None, prose(4, 60), "en", "b"),
        (10, "日本語 テキスト é ü 😀 \x00 x", None, "b"),
        (11, "a" * 50_000, "en", None),
        (12, "### $$$ " * 30, "en", "a"),
        (13, prose(5, 100) + "\nCopyright 2019 by the owners of this text, all rights reserved\n" + prose(6, 40), "en", "a"),
        (14, prose(7, 100) + "\nCopyright 2021 by the owners of this text, all rights reserved\n" + prose(8, 40), "en", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(df):
    """With more columns, named like those that operators add inside."""
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHING if name not in df.columns})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(pairs, members):
    """Smallest member reachable over `pairs`, per member."""
    parent = {m: m for m in members}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {m: find(m) for m in members}
