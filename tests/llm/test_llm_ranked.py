import math
import random
from collections import Counter

import llm_fixtures as fx
import numpy as np
import pytest
from test_llm_decontaminate import words

from brisktill.llm import ranked
from brisktill.llm.queries import QUERIES

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def brute(docs, items, k=50):
    """{item position: [(score, doc), ...]}, best first."""
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = {}
    for at, (_, text) in enumerate(items):
        scores = []
        for doc, c, n in counted:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(words(text))}
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        if scores:
            out[at] = [(-s[0], s[3]) for s in sorted(scores)[:k]]
    return out


def expected(docs, items, k=50):
    return sorted(((items[at][0], i + 1, d, s) for at, best in brute(docs, items, k).items() for i, (s, d) in enumerate(best)), key=repr)


def found(docs, items, k=50):
    return sorted((tuple(r) for r in ranked.search(docs, items, k).collect()), key=repr)


def test_query_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    ours = QUERIES["op13_ranked_search"](spark, folder)
    assert ours.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in ours.collect()), key=repr) == expected(docs, items)


def test_awkward_rows(spark, frame):
    docs = [(r[0], r[1]) for r in fx.awkward_rows()]
    items = [("a", docs[0][1]), ("b", "the of AND"), ("b", "copyright"), (None, "日本語 x"), ("c", None), ("d", ""), ("e", "zzzz"), ("f", docs[8][1])]
    ours = found(fx.clashing(fx.awkward(spark)), fx.clashing(frame(items, ITEMS)), 5)
    assert ours == expected(docs, items, 5)


def test_ties_go_by_id(spark, frame):
    docs = [(i, "same words here" if i % 3 else "other") for i in range(900, 0, -1)]
    items = [("x", "same words")]
    assert found(frame(docs, DOCS).repartition(5), frame(items, ITEMS), 20) == expected(docs, items, 20)


def test_empty_tables(spark, frame):
    assert found(fx.empty(spark), frame([("x", "a b")], ITEMS)) == []
    assert found(frame([(1, "a b")], DOCS), frame([], ITEMS)) == []
    assert found(frame([(1, None), (2, "...")], DOCS), frame([("x", "a b")], ITEMS)) == []


def test_blocks_of_items(spark, frame, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_CHARS", 30)
    docs = [(i, fx.prose(i, 80)) for i in range(40)]
    items = [(str(i), " ".join(fx.prose(i, 80).split()[: 5 + i % 7])) for i in range(9)]
    assert found(frame(docs, DOCS), frame(items, ITEMS), 3) == expected(docs, items, 3)


def test_pairs_keep_all_that_reach_the_limit_and_prune(monkeypatch):
    rng = random.Random(3)
    n_docs, n_items, n_codes = 700, 90, 300
    codes = [np.unique([rng.randrange(n_codes) for _ in range(rng.randint(1, 12))]) for _ in range(n_items)]
    weights = np.array([rng.randint(1, 12_000) for _ in range(n_codes)])
    table = np.zeros((n_docs, n_codes), np.int64)
    for d in range(n_docs):
        for c in rng.sample(range(n_codes), rng.randint(0, 9)):
            table[d, c] = rng.randint(1, 999_999)
    doc, code = np.nonzero(table)
    monkeypatch.setattr(ranked, "ROOT_ITEMS", 32)
    for quantile in (0, 0.9, 1):
        seen = 0
        for root in ranked.roots(codes, weights):
            scores = np.stack([(table[:, codes[i]] * weights[codes[i]]).sum(1) for i in root.items])
            weakest = np.quantile(scores, quantile, axis=1, method="lower")
            item, found_doc, score = ranked.pairs(root, doc, code, table[doc, code], n_docs, weakest)
            wanted = {(i, d, scores[i, d]) for i, d in zip(*np.nonzero((scores >= weakest[:, None]) & (scores > 0)), strict=True)}
            assert set(zip(item, found_doc, score, strict=True)) == wanted and len(item) == len(wanted)
            seen += len(root.items)
        assert seen == n_items


@pytest.mark.parametrize("cells", [1, 1 << 12])
def test_small_matrices_give_the_same(spark, frame, monkeypatch, cells):
    monkeypatch.setattr(ranked, "CELLS", cells)
    monkeypatch.setattr(ranked, "ROOT_WORDS", 20)
    docs = [(i, fx.prose(i, 60)) for i in range(60)]
    items = [(str(i), " ".join(fx.prose(i, 60).split()[:15])) for i in range(7)]
    assert found(frame(docs, DOCS), frame(items, ITEMS), 4) == expected(docs, items, 4)
