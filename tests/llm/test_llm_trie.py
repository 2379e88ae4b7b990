import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brisktill.llm import trie
from brisktill.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r[2], r[4]) for r in sorted(own)] for c, own in convs.items()}


def mixed(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        parents = {p[:-1] for p in members if p}
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(prefix))
        out.append(
            (
                min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own),
                sum(p[:-1] == prefix for p in members if p), sum(p not in parents for p in below),
                sum((len(members[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, folder)) == brute(mixed(ordered(rows)))


def awkward_rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "é ü z"])) for c in range(-25, 45) for t in range(rng.randint(1, 5))]
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in (200, 2000, 5000, 90_000) for t in range(6)]
    rows += [(300, t, "user", f"long {t}") for t in range(60)]
    rows += [(301, t, "user", f"long {t}") for t in range(45)]
    return rows


def head(c):
    return c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4


@pytest.mark.parametrize("least", [256, 1, 8])
def test_awkward_rows(spark, frame, monkeypatch, least):
    """With a small limit most nodes lie above the shards."""
    monkeypatch.setattr(trie, "LEAST_SPLIT", least)
    monkeypatch.setattr(trie, "SHARD_ROWS", max(least, 2))
    turns = frame(awkward_rows(), TURNS).withColumns({n: F.lit("own") for n in ("c", "d", "row", "dig", "n", "shard", "words")})
    assert found(trie.nodes(turns.repartition(3), head)) == brute(mixed(ordered(awkward_rows())))


def test_conversations_as_they_are(spark, frame):
    rows = [(1, 0, "u", "x y"), (1, 1, "a", "z"), (2, 0, "u", "x y"), (3, 0, "ux", " y"), (4, 0, "u", "x y"), (4, 1, "a", "z")]
    assert found(trie.nodes(frame(rows, TURNS))) == brute(ordered(rows))


def test_empty_tables(spark, frame):
    assert found(trie.nodes(frame([], TURNS))) == []
    assert found(trie.nodes(frame([(None, 1, "u", "x")], TURNS), head)) == []


def test_ends_in_many_blocks(spark, frame):
    rows = [(c, 0, "u", "x") for c in range(-3000, 3000, 3)]
    assert found(trie.nodes(frame(rows, TURNS))) == brute(ordered(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    slots = trie.Slots(high, low)
    assert sorted(slots.find(high, low)) == list(range(n))
    assert set(slots.find(high + np.uint64(1), low)) <= {-1}


def test_repeated_digests_are_refused():
    same = np.array([3, 3], np.uint64)
    with pytest.raises(ValueError, match="repeated"):
        trie.Slots(same, same)


def test_collisions_are_found_out():
    digest = [bytes(15) + b"\x01"] * 2
    rows = {"c": [1, 2], "d": [1, 1], "words": [2, 2], "mark": [5, 6], "dig": pa.array(digest, pa.binary()), "par": pa.array([bytes(16)] * 2, pa.binary())}
    with pytest.raises(ValueError, match="one digest"):
        trie.shard_nodes(pa.table(rows))
