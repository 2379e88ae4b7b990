import random

import llm_fixtures as fx
import numpy as np
import pytest

from brisktill.llm import embeddings
from brisktill.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """[(id, links, component, kept)] of (id, vector, label) by comparing all rows."""
    units = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v)
        v = np.array(v, np.float32).astype(float) if ok else None
        units.append(v / np.linalg.norm(v) if ok and v.any() else None)
    pairs = []
    for i, u in enumerate(units):
        for j in range(i):
            w = units[j]
            if u is not None and w is not None and rows[i][2] == rows[j][2] and len(u) == len(w) and u @ w >= least:
                pairs.append((i, j))
    root = fx.groups(pairs, range(len(rows)))
    links = [0] * len(rows)
    for pair in pairs:
        for i in pair:
            links[i] += 1
    names = {}
    for i, row in enumerate(rows):
        names.setdefault(root[i], []).append(row[0])
    out = []
    for i, row in enumerate(rows):
        component = min((n for n in names[root[i]] if n is not None), default=None)
        out.append((row[0], links[i], component, row[0] == component))
    return sorted(out, key=repr)


def found(df, **settings):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **settings).collect()), key=repr)


def crowd(seed, groups, size, dims, noise):
    """Vectors around random centres, at distances on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rng.standard_normal(dims)
        for _ in range(size):
            v = center / np.linalg.norm(center) + rng.standard_normal(dims) * noise * rng.random() / dims**0.5
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], g % 3))
    return rows


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    units = np.array([v for _, v, _ in rows], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    labels = np.array([x for _, _, x in rows])
    close = (units @ units.T >= 0.98) & (labels[:, None] == labels)
    root = fx.groups([(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j], range(len(rows)))
    first = {}
    for i, row in enumerate(rows):
        first[root[i]] = min(first.get(root[i], row[0]), row[0])
    expected = sorted((row[0], int(close[i].sum()) - 1, first[root[i]], first[root[i]] == row[0]) for i, row in enumerate(rows))
    assert sorted(tuple(r) for r in QUERIES["op10_embedding_near_dedup"](spark, folder).collect()) == expected


@pytest.mark.parametrize(("dims", "noise", "least"), [(64, 0.35, 0.98), (13, 0.4, 0.95), (1, 0.1, 0.98)])
def test_crowded_vectors(spark, frame, dims, noise, least):
    rows = crowd(dims, 12, 25, dims, noise)
    assert found(frame(rows, KIND), least_cosine=least) == brute(rows, least)


def test_awkward_rows(spark, frame):
    one, near = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.1]
    rows = [
        (1, one, 0), (2, one, 0), (2, one, 0), (3, near, 0), (4, [2.0, 4.0, 6.0, 8.0], 0), (5, one, 1), (6, one, None), (7, None, 0),
        (8, [0.0] * 4, 0), (9, [], 0), (10, [1.0, None, 3.0, 4.0], 0), (11, [float("nan"), 2.0, 3.0, 4.0], 0), (12, [float("inf")] * 4, 0),
        (None, one, 0), (None, [-1.0, 0.0, 0.0, 0.0], 7), (13, one[:3], 0), (14, [1e-30, 2e-30, 3e-30, 4e-30], 0), (15, [1e38, 2e38, 3e38, 3.4e38], 0),
        (16, [-0.0, 0.0, 0.0, 1.0], 2), (17, [0.0, 0.0, 0.0, 1.0], 2), (2, [4.0, 3.0, 2.0, 1.0], 0),
    ]
    assert found(fx.clashing(frame(rows, KIND))) == brute(rows)


def test_one_vector_in_most_rows(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "CASE WHEN id % 3 > 0 THEN array(1.0f, 2.0f) ELSE array(cast(id AS float), 1.0f) END AS embedding", "1 AS label")
    rows = [(r[0], list(r[1]), r[2]) for r in df.filter("vec_id < 300").collect()]
    assert found(df.filter("vec_id < 300")) == brute(rows)
    most = [r for r in found(df) if r[0] % 3]
    assert len({r[1] for r in most}) == 1 and most[0][1] >= 1999


def test_chains_reach_further_than_links(spark, frame):
    rng = random.Random(1)
    rows = [(i, [float(np.cos(i * 0.15)), float(np.sin(i * 0.15))], 1) for i in range(12)]
    rng.shuffle(rows)
    assert found(frame(rows, KIND)) == brute(rows)


def test_empty_table(spark, frame):
    assert found(frame([], KIND)) == []


@pytest.mark.parametrize("depth", [1, 3, 5, 8])
def test_every_depth_finds_every_pair(depth):
    """Any two rows of a block within the radius: the one's own cell is among those the other's ball touches."""
    rng = np.random.default_rng(depth)
    one = rng.standard_normal((300, 8)) * 0.3
    two = one + rng.standard_normal((300, 8)) * 0.1
    radius = 0.3
    _, own = embeddings._cells(one, radius, depth, False)
    rows, cells = embeddings._cells(two, radius, depth)
    touched = set(zip(rows.tolist(), cells.tolist(), strict=True))
    near = np.flatnonzero(((one - two) ** 2).sum(1) <= radius**2)
    assert len(near) > 100 and all((i, own[i]) in touched for i in near.tolist())


def test_the_grid_is_finer_for_more_rows():
    depths = [embeddings._depth(n, n, 0.2, 3) for n in (10, 8000, 32000, 400000)]
    assert depths == sorted(set(depths)) and depths[3] == embeddings.BLOCK


def test_few_candidates_among_many_vectors(spark):
    """On the grid of a label with 400,000 rows less than 1 % of all pairs of random vectors meet in a block; none that is near is lost."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((8000, 64))
    vectors[7900:] = vectors[:100] + rng.standard_normal((100, 64)) * 0.1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    radius = 0.2 * (8 / 64) ** 0.5
    turned = vectors @ embeddings._rotation(64, 3)
    depth = embeddings._depth(400000, 400000, 0.2, 3)
    own = embeddings._cells(turned[:, :8], radius, depth, False)[1]
    touched = embeddings._cells(turned[:, :8], radius, depth)[1]
    keys, counts = np.unique(own, return_counts=True)
    at = np.minimum(np.searchsorted(keys, touched), len(keys) - 1)
    assert counts[at[keys[at] == touched]].sum() < 0.01 * 8000**2

    some = np.r_[0:300, 7900:8000]
    df = spark.createDataFrame([(int(i), 1, vectors[i].tolist()) for i in some], "id long, label int, unit array<double>")
    met = {(r["a"], r["b"]) for r in embeddings.near_pairs(df, df, 0.2, smaller="a < b").collect()}
    close = {(int(some[i]), int(some[j])) for i, j in zip(*np.nonzero(vectors[some] @ vectors[some].T >= 0.98), strict=True) if i < j}
    assert close and close <= met
