import itertools
import random
import zlib

import llm_fixtures as fx
import numpy as np
import pytest
from tokenizers import Tokenizer

from brisktill.llm import packing
from brisktill.llm.queries import QUERIES
from brisktill.llm.tokens import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*[tokenizer_path(n) for n in packing.TOKENIZER])


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(2)
    pool = [*map(chr, range(0x180)), *"\u0085    　﻿​日本한😀'", *[" ", "a", "'s", "1", "\n"] * 20, "<|endoftext|>"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 15))) for _ in range(5000)]
    assert all(encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


def check(pieces, docs, library, length=1024):
    """Each id of each document in exactly one piece, sequences without gaps, padding at the partitions' ends only."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    wanted = {}
    for name, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        wanted.setdefault((name, len(ids)), []).append(np.array(ids, "<u4").tobytes())
    assert by_doc.keys() == wanted.keys()
    for key, texts in wanted.items():
        # Rows with one id and size: every piece fits one of them, and all starts come as often as there are rows.
        assert sum(p["length"] for p in by_doc[key]) == key[1] * len(texts)
        for p in by_doc[key]:
            assert p["ids_crc32"] in {zlib.crc32(t[4 * p["start"] : 4 * (p["start"] + p["length"])]) for t in texts}
        covered = sorted(itertools.chain.from_iterable(range(p["start"], p["start"] + p["length"]) for p in by_doc[key]))
        assert covered == sorted(list(range(key[1])) * len(texts))
    short = 0
    for parts in by_sequence.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        total = sum(n for _, n in parts)
        assert total <= length
        short += total < length
    return short


def test_query_equals_the_library(spark, folder, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = QUERIES["op8_packing"](spark, folder)
    assert check(found.collect(), docs, library) <= 8


def test_awkward_rows(spark, library):
    found = packing.digest(packing.pack(fx.clashing(fx.awkward(spark)))).collect()
    check(found, [r[:2] for r in fx.awkward_rows()], library)


def test_short_sequences_and_empty_table(spark, library, frame):
    docs = [(i, fx.prose(i, i)) for i in range(30)]
    found = packing.digest(packing.pack(frame(docs, "doc_id long, text string"), length=7)).collect()
    check(found, docs, library, 7)
    assert packing.pack(fx.empty(spark)).count() == 0


def test_sequences_are_padded_but_for_powers_of_two(spark, frame):
    docs = frame([(1, "a b c"), (2, "d e f g h")], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, length=6)
    found = packing.sequences(pieces, 6).collect()
    assert sum(r["tokens"] for r in found) == 4 + 6
    for r in found:
        assert len(r["ids"]) == 4 * (r["tokens"] if r["tokens"] & (r["tokens"] - 1) == 0 else 6)


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_long_texts_hash_as_a_whole():
    text = fx.prose(3, 400_000).encode()
    grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 4).astype(np.uint32)
    codes = grams[:, 0] | grams[:, 1] << 8 | grams[:, 2] << 16 | grams[:, 3] << 24
    expected = np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=packing.BUCKETS)
    assert len(text) > packing._AT_ONCE and (packing.hashed_vector(text) == expected).all()
    assert packing.hashed_vector(None).sum() == 1 == packing.hashed_vector(b"a").sum()


def test_neighbours_along_the_curve_are_alike(spark, folder):
    """Documents of one language lie together far more often than by chance."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keyed = sorted((r["k"], r["lang"]) for r in docs.select(packing.curve_key(docs["text"]).alias("k"), "lang").collect())
    langs = [lang for _, lang in keyed]
    chance = sum((langs.count(x) / len(langs)) ** 2 for x in set(langs))
    assert np.mean([a == b for a, b in itertools.pairwise(langs)]) > chance + 0.15
