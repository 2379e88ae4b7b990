import zlib
from collections import Counter

import llm_fixtures as fx
import pytest
from pyspark.sql import functions as F

from brisktill.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 24, 97, 100, 1000, 4097])
def test_permutation_is_a_bijection(spark, n):
    found = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, seed=n).alias("p")).collect()]
    assert sorted(found) == list(range(n))
    assert n < 100 or sum(a == b for a, b in enumerate(found)) < n / 5


def test_grids_are_just_large_enough():
    for n in [*range(1, 2000), 10**9, 10**12 + 7, 10**15]:
        a, b = sharding._sides(n)
        assert n <= a * b < n + a


def test_seed_decides(spark):
    one, two, again = ([r["p"] for r in spark.range(50).select(sharding.permuted(F.col("id"), 50, s).alias("p")).collect()] for s in (1, 2, 1))
    assert one == again != two


def rows(docs, shards=5):
    return [tuple(r) for r in sharding.shards(docs, shards).collect()]


def test_awkward_rows(spark):
    found = rows(fx.clashing(fx.awkward(spark)))
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in fx.awkward_rows())
    assert Counter(r[:3] for r in found) == wanted
    counts = Counter(r[4] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    assert all(sorted(r[5] for r in found if r[4] == s) == list(range(c)) for s, c in counts.items())
    assert {r[3] for r in found} == {"rows"} and {r[6] for r in found} == {None}


def test_place_does_not_depend_on_files_or_order(spark):
    docs = fx.awkward(spark)
    turned = docs.orderBy(F.rand(3)).repartition(7)
    assert sorted(rows(docs), key=repr) == sorted(rows(turned), key=repr)


def test_one_id_in_all_rows(spark):
    docs = spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    found = rows(docs, 3)
    assert sorted((r[4], r[5]) for r in found) == sorted((i % 3, i // 3) for i in range(1000))


def test_fewer_rows_than_shards_and_empty_table(spark):
    assert len({r[4] for r in rows(spark.range(3).selectExpr("id AS doc_id", "'x' AS text"), 24)}) == 3
    assert rows(fx.empty(spark)) == []


def test_numbers_follow_the_order(spark):
    values = spark.range(500).select((F.col("id") * 7 % 501).alias("v")).repartition(6)
    found = {r["v"]: r["row"] for r in sharding.numbered(values, [F.col("v")]).collect()}
    assert [found[v] for v in sorted(found)] == list(range(500))
