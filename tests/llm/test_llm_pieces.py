import random
import time

import llm_fixtures as fx
import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from brisktill.llm import pieces
from brisktill.llm.queries import QUERIES
from brisktill.llm.tokens import tokenizer_path

POOL = ["a", "b", " ", "  ", "▁", "\n", "é", "日本", "語", "the", "ing", "😀", "\x00", "1", "12", ".", ",", "tion", "er", "Ω", "͸", "한", "국", "    "]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path(pieces.MODEL)


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_query_equals_the_library(spark, folder, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op3_sentencepiece"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) and r["round_trip"]


def test_random_texts_equal_the_library(path, library):
    rng = random.Random(3)
    own = pieces.Pieces(path)
    texts = ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += [" ", "a" * 300, "日本語" * 400, "thetheing" * 200, None]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "")
        assert own.decode(ids) == library.decode(ids.tolist())


def test_long_texts_without_spaces(path, library):
    rng = random.Random(8)
    own = pieces.Pieces(path)
    texts = ["".join(rng.choices([x for x in POOL if " " not in x], k=k)) for k in (255, 256, 257, 600, 5000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text) and own.decode(ids) == library.decode(ids.tolist())
    long = "".join(rng.choices(["token", "iza", "tion", "日", "of", "un", "spaced", "x"], k=340_000))
    start = time.process_time()
    (ids,) = own.encode([long])
    assert len(long) > 1_000_000 and time.process_time() - start < 20 and own.decode(ids) == long


def test_kept_chunks_do_not_change_results(path, library, monkeypatch):
    monkeypatch.setattr(pieces, "_KEPT", 50)
    own, rng = pieces.Pieces(path), random.Random(4)
    for _ in range(20):
        texts = [fx.prose(rng.randint(0, 30), 40) for _ in range(5)]
        assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)


def test_unigram_scores_give_the_best_path(path, tmp_path):
    """The same pieces as a unigram model: the library's own search is the reference."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for rank, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = -float(np.float32(np.log(rank + 2.0)))
    unigram = tmp_path / "unigram.model"
    unigram.write_bytes(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(unigram)), pieces.Pieces(str(unigram))
    score = lambda ids: sum(own.score[i] for i in ids)
    rng = random.Random(6)
    texts = [fx.prose(i, 30) for i in range(40)] + ["".join(rng.choices(["the", "ing", "a", " ", "re", "x"], k=12)) for _ in range(300)]
    texts += ["".join(rng.choices(["the", "ing", "a", "re", "x", "日", "\u0378"], k=k)) for k in (200, 400)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        theirs = library.encode(text)
        assert own.decode(ids) == text
        assert abs(score(ids) - score(theirs)) < 1e-3


def test_awkward_rows(spark, library):
    docs = fx.clashing(fx.awkward(spark))
    encoded = pieces.encode(docs)
    found = sorted((repr(r["doc_id"]), list(r["ids"])) for r in encoded.collect())
    assert found == sorted((repr(i), library.encode(t or "")) for i, t, *_ in fx.awkward_rows())
    back = sorted((repr(r["doc_id"]), r["text"]) for r in pieces.decode(encoded).collect())
    assert back == sorted((repr(i), t or "") for i, t, *_ in fx.awkward_rows())


def test_bytes_that_are_no_text(spark, frame, path):
    own = pieces.Pieces(path)
    ids = [own.byte[0xFF], own.byte[0xE3]]
    found = pieces.decode(frame([(1, ids), (2, None), (3, [])], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {1: "��", 2: "", 3: ""}


def test_empty_table(spark):
    assert pieces.encode(fx.empty(spark)).count() == 0
