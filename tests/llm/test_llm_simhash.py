import random

import llm_fixtures as fx
import numpy as np
import pytest
import xxhash

from brisktill.llm import simhash
from brisktill.llm.components import components
from brisktill.llm.queries import QUERIES


def brute_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    """{row: smallest id reachable} of a list of (id, fingerprint)."""
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= distance]
    root = fx.groups(pairs, range(len(prints)))
    names = {}
    for i, (name, _) in enumerate(prints):
        names.setdefault(root[i], []).append(name)
    return [min((n for n in names[root[i]] if n is not None), default=None) for i in range(len(prints))]


def test_query_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, brute_print(t)) for i, t in docs]
    expected = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True))
    assert sorted(tuple(r) for r in QUERIES["op4_simhash_near_dedup"](spark, folder).collect()) == expected


def test_awkward_rows(spark):
    rows = [(i, brute_print(t)) for i, t, *_ in fx.awkward_rows()]
    expected = sorted(((i, p, c) for (i, p), c in zip(rows, brute_components(rows), strict=True)), key=repr)
    found = [(r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(fx.clashing(fx.awkward(spark))).collect()]
    assert sorted(found, key=repr) == expected


def test_null_ids_alone_have_no_name(spark, frame):
    found = simhash.near_duplicates(frame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in found] == [None, None]


def test_keep_one(spark):
    docs = fx.clashing(fx.awkward(spark))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert set(rows) <= {tuple(r) for r in docs.collect()}
    prints = [(i, brute_print(t)) for i, t, *_ in fx.awkward_rows()]
    component = brute_components(prints)
    assert len(rows) == len({c if c is not None else ("own", i) for i, c in enumerate(component)})
    assert all(r[0] in component for r in rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(fx.empty(spark)).count() == 0
    assert simhash.keep_one(fx.empty(spark)).count() == 0


@pytest.mark.parametrize(("distance", "blocks", "rows"), [(2, None, 64), (2, None, 4), (3, 6, 8), (1, 3, 2), (0, 2, 64)])
def test_links_lose_no_pair_also_when_blocks_are_split(spark, frame, distance, blocks, rows):
    """Fingerprints crowd around a few centres, so blocks are large and split again and again."""
    rng = random.Random(distance * 100 + rows)
    prints = set()
    for center in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(120):
            value = center
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            prints.add(value)
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    found = simhash.links(frame([(p,) for p in signed], "p long"), distance, blocks, rows).distinct().collect()
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert {tuple(r) for r in found} == expected


def test_components_of_chains_stars_and_loops(spark, frame):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2000), (5, 3), (5, 3)]
    edges += [(rng.randint(3000, 3300), rng.randint(3000, 3300)) for _ in range(150)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    members = {v for a, b in edges if a != b for v in (a, b)}
    expected = fx.groups([e for e in edges if e[0] != e[1]], members)
    found = components(frame(edges, "a long, b long")).collect()
    assert {r["vertex"]: r["root"] for r in found} == expected and len(found) == len(members)
    assert components(frame([], "a long, b long")).count() == 0


def test_kept_rows_do_not_depend_on_a_second_split(spark, tmp_path):
    docs = [(i, fx.prose(i // 2, 60)) for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(7, "doc_id").write.parquet(f"{tmp_path}/t")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    found = simhash.keep_one(spark.read.parquet(f"{tmp_path}/t"))
    try:
        spark.conf.set(size, "1k")
        left = sorted(r["doc_id"] for r in found.collect())
    finally:
        spark.conf.set(size, before)
    assert left == list(range(0, 600, 2))
