import zlib

import llm_fixtures as fx
import numpy as np

from brisktill.llm import langid
from brisktill.llm.queries import QUERIES


def brute_vector(text):
    """Sum of the bound vectors of every trigram, one by one."""
    import unicodedata

    codes = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()]
    if not any(codes):
        return None
    codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
    codes = [0] * bool(codes[0]) + codes + [0] * bool(codes[-1])
    total = np.zeros(langid.DIMENSIONS, np.int64)
    for i in range(len(codes) - 2):
        a, b, c = (langid.letter_vector(x).astype(np.int64) for x in codes[i : i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_document_vectors_equal_brute_force():
    texts = ["Hello,  World!", "a", "é", " x ", "日本語 テキスト", "12 34", "", None, "aa  bb--cc", "İstanbul ß"]
    vectors, lettered = langid.Bundler().bundle(texts)
    for text, vector, ok in zip(texts, vectors, lettered, strict=True):
        expected = brute_vector(text or "")
        assert ok == (expected is not None)
        assert (vector == (expected if ok else 0)).all()


def test_long_texts_are_bundled_whole(monkeypatch):
    text = fx.prose(3, 3000)
    whole, _ = langid.Bundler().bundle([text, "short"])
    monkeypatch.setattr(langid, "_AT_ONCE", 1000)
    monkeypatch.setattr(langid, "_KEPT", 300)
    parts, _ = langid.Bundler().bundle([text, "short"])
    assert (whole == parts).all()


def test_query_equals_brute_force_and_is_accurate(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    sums = {}
    for i, text, lang in docs:
        vector = brute_vector(text or "")
        if not out[i] and lang is not None and vector is not None:
            sums[lang] = sums.get(lang, 0) + vector
    languages = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in languages])
    found = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, folder).collect()}
    assert len(found) == len(docs)
    right = []
    for i, text, lang in docs:
        r, vector = found[i], brute_vector(text or "")
        assert r["held_out"] == out[i] and 0 <= r["score"] <= 1
        if vector is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosine = unit @ vector / np.linalg.norm(vector)
        assert abs(r["score"] - max(cosine.max(), 0)) < 1e-6 and cosine[languages.index(r["lang_pred"])] > cosine.max() - 1e-6
        if out[i] and lang:
            right.append(r["lang_pred"] == lang)
    assert np.mean(right) > 0.95


def test_labels_of_held_out_documents_do_not_matter(spark, frame):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    kind = "doc_id long, text string, lang string"
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    one, two = (sorted(map(tuple, langid.identify(frame(r, kind)).collect())) for r in (rows, wrong))
    assert one == two and all(r[2] == rows[r[0]][2] for r in one)


def test_awkward_rows_and_tables_to_learn_nothing_from(spark, frame):
    docs = fx.clashing(fx.awkward(spark))
    found = langid.identify(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in fx.awkward_rows())
    for r in found:
        if r["doc_id"] in (3, 4, 5):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(fx.empty(spark)).count() == 0
    bare = frame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(bare).collect()} == {"und"}
