"""Connected components of an edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each
step ties vertices to the smallest vertex near them, the number of edges never
grows, and the rounds needed grow with the logarithm of the size, also for
long chains. Every step is a group-by and a join; nothing is collected.
"""

from pyspark.sql import functions as F

from ..sources.staging import staged


def _both_ways(edges):
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(turned)


def _linked(neighbours, smallest):
    # The minima are a table of their own, so that both sides of the join are
    # plain shuffles and a hot vertex can be split by AQE.
    return neighbours.join(staged(smallest), "a")


def _large_star(edges):
    near = _both_ways(edges)
    smallest = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _linked(near.filter("b > a"), smallest).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges):
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _linked(down, smallest).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = smallest.select("a", F.col("m").alias("b"))
    return moved.unionByName(kept)


def _clean(edges):
    return edges.filter("a <> b").distinct()


def _state(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges):
    """`edges` (a, b: long) to one row (vertex, root) per vertex that has an edge; the root is the smallest vertex reachable.

    Loops and repeated edges do not matter; an empty table gives an empty result.
    """
    edges = staged(_clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = staged(_clean(_small_star(staged(_clean(_large_star(edges))))))
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
