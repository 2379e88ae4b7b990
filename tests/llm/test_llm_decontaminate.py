import hashlib
import re

import llm_fixtures as fx
import pytest
from pyspark.sql import functions as F

from brisktill.llm import decontaminate
from brisktill.llm.queries import QUERIES

ITEMS = "item_id string, text string"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def windows(items, width=10):
    found = {}
    for name, text in items:
        own = words(text)
        k = min(width, len(own))
        for s in range(len(own) - k + 1 if own else 0):
            found.setdefault(tuple(own[s : s + k]), set()).add("" if name is None else str(name))
    return found


def brute(docs, items, width=10):
    asked = windows(items, width)
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for k in {len(w) for w in asked}:
            for s in range(len(own) - k + 1):
                if found := asked.get(tuple(own[s : s + k])):
                    hit.update(range(s, s + k))
                    names |= found
        out.append((doc, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(docs, items):
    return sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=repr)


def test_query_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    ours = QUERIES["op12_benchmark_decontamination"](spark, folder)
    assert ours.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in ours.collect()), key=repr) == brute(docs, items)


def awkward_items():
    texts = [r[1] for r in fx.awkward_rows()]
    return [
        ("a", " ".join(texts[0].split()[20:60])),
        ("a", " ".join(texts[0].split()[20:60])),
        ("b", texts[0].split("\n")[3].upper() + "!"),
        (None, " ".join(texts[8].split()[-25:])),
        (None, "one word one word one word one word one word one"),
        ("c", "one word"),
        ("d", "日本語"),
        ("e", "owners OF-this text"),
        ("f", "words that nobody has at all zzzz"),
        ("g", None),
        ("h", " ... "),
        ("i", " ".join(texts[0].split()[-9:] + texts[1].split()[:9])),
        ("j", texts[8]),
    ]


def test_awkward_rows(spark, frame):
    docs = [(r[0], r[1]) for r in fx.awkward_rows()]
    ours = found(fx.clashing(fx.awkward(spark)).repartition(1), fx.clashing(frame(awkward_items(), ITEMS)))
    assert ours == brute(docs, awkward_items())
    assert any(r[2] > 25_000 for r in ours)


def test_nothing_matches_across_documents(spark, frame):
    docs = frame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string").repartition(1)
    items = frame([("x", "d e f g h i"), ("y", "c d e f")], ITEMS)
    assert [(r[0], r[2], r[3]) for r in found(docs, items)] == [(1, 4, 1), (2, 0, 0)]


def test_empty_tables(spark, frame):
    none = frame([], ITEMS)
    assert found(fx.empty(spark), frame([("x", "a b")], ITEMS)) == []
    blank = hashlib.sha256(b"").hexdigest()
    assert found(frame([(1, "a b"), (2, None)], "doc_id long, text string"), none) == [(1, 2, 0, 0, blank, False), (2, 0, 0, 0, blank, False)]


def brute_near(docs, items, distance, width=10):
    frequency = {}
    for _, text in docs:
        for w in words(text):
            frequency[w] = frequency.get(w, 0) + 1
    out = set()
    for doc, text in docs:
        places = {}
        for p, w in enumerate(words(text)):
            places.setdefault(w, []).append(p)
        for name, item in items:
            own = words(item)
            k = min(width, len(own))
            for s in range(len(own) - k + 1 if own else 0):
                window = own[s : s + k]
                rarest = min(range(k), key=lambda i: (frequency.get(window[i], 0), i))
                for p in places.get(window[rarest], []):
                    if all(any(abs(p - q) <= distance for q in places.get(w, [])) for w in window):
                        out.add((doc, name, p))
    return out


@pytest.mark.parametrize("distance", [1, 4, 15])
def test_proximity_equals_brute_force(spark, frame, distance):
    docs = [(i, fx.prose(i, 400)) for i in range(12)]
    items = [("p", "the of and"), ("q", " ".join(words(docs[3][1])[50:64][::-1])), ("r", "to to is"), ("s", "nobody to")]
    index = decontaminate.build_index(frame(docs, "doc_id long, text string"))
    named = decontaminate.item_words(frame(items, ITEMS))
    hits = decontaminate.located(index, decontaminate.near(index, named, distance)).join(index.docs, "key")
    hits = hits.join(named.select("item", "name").distinct(), "item").select("doc", "name", (F.col("begin") - F.col("first")).alias("p"))
    assert {tuple(r) for r in hits.collect()} == brute_near(docs, items, distance)


def test_proximity_stays_within_documents(spark, frame):
    index = decontaminate.build_index(frame([(1, "a b"), (2, "c d")], "doc_id long, text string").repartition(1))
    named = decontaminate.item_words(frame([("x", "b c")], ITEMS))
    assert decontaminate.near(index, named, decontaminate.GAP - 1).count() == 0
    with pytest.raises(ValueError, match="distance"):
        decontaminate.near(index, named, decontaminate.GAP)
