"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c lie `reach` = sqrt(2 - 2c) apart. Where many vectors
crowd together, their pairs are not listed: vectors on the same sides of some
random planes through the origin give a centre, their mean, and what lies within
half the reach of a centre is a cluster, all of whose members link. Then each
vector meets clusters instead of vectors. By the triangle inequality, whole shells of a cluster link
or don't; only members of shells in doubt, and vectors in no cluster, are
compared one by one, by their cosine. Clusters change how much is compared,
never what links.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from .components import components

# Dimensions of a block. Its range join lays a grid over some of them.
BLOCK = 8
# A copy of a row for one more cell is written and sorted: 4 microseconds in a check run. A pair met in the join is estimated at 0.1 or less.
COPY_COST = 40
# Slack of the squared-distance budgets: coordinates are kept in single precision.
SLACK = 1e-5
# Shells of a cluster by distance from its centre.
SHELLS = 16
# Distances this close to the reach are in doubt.
DOUBT = 1e-9

_X = [f"x{i}" for i in range(BLOCK)]


def _valid(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rotation(size, seed):
    """A random rotation, the same for the same seed: it spreads a distance evenly over blocks."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _by_size(*vectors):
    """(rows, matrix per column) for each length among Arrow lists of numbers; the columns agree in length."""
    sizes = vectors[0].value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        lists = [v.take(pa.array(own)) for v in vectors]
        yield own, [x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size) for x in lists]


def _units(classes, seed):
    """(cls, label, n, size, unit, key): vectors at length one in double precision and the sides of the planes they lie on.

    There are as many planes as tell the vectors of the largest label apart,
    were they spread evenly: with more, a crowd falls to pieces, with fewer,
    its mean drowns among the others'. Each vector is divided by its largest entry first, so that no square over- or underflows.
    """
    fields = [T.StructField("cls", T.LongType()), classes.schema["label"], T.StructField("n", T.LongType())]
    fields += [T.StructField("size", T.IntegerType()), T.StructField("unit", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*fields, T.StructField("key", T.LongType())])
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    planes = min(62, int(largest or 1).bit_length())

    def run(batches):
        for batch in batches:
            for own, (rows,) in _by_size(batch.column(3)):
                rows = rows / np.abs(rows).max(1, keepdims=True)
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                size = rows.shape[1]
                sides = (rows @ _rotation(size, seed))[:, :planes] > 0
                keys = sides @ (1 << np.arange(sides.shape[1], dtype=np.int64))
                ends = np.arange(len(own) + 1, dtype=np.int32) * size
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(pa.array(own)) for i in range(3)],
                        pa.array(np.full(len(own), size, np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel())), pa.array(keys),
                    ],
                    names=[f.name for f in schema],
                )

    return classes.select("cls", "label", "n", "vector").mapInArrow(run, schema)


def _per_pair(measure, v, w):
    """A column of what `measure` gives for the rows of two matrices, of columns of lists that agree in length."""

    @F.arrow_udf("double")
    def measured(v: pa.Array, w: pa.Array) -> pa.Array:
        out = np.zeros(len(v))
        for own, (one, two) in _by_size(v, w):
            out[own] = measure(one, two)
        return pa.array(out)

    return measured(v, w)


def _distance(v, w):
    return _per_pair(lambda one, two: np.linalg.norm(one - two, axis=1), v, w)


def _cosine(v, w):
    return _per_pair(lambda one, two: np.einsum("ij,ij->i", one, two), v, w)


def _cells(vectors, radius, depth, spread=True):
    """Of the rows of one block: (rows, cells), the grid cells over `depth` axes that a row's ball of `radius` touches, or its own only.

    Cells are twice the radius wide, so a ball reaches one neighbour at most
    along each axis, and several axes at once only if their distances fit into
    the radius together. Cells are named by a hash: two with one name cost a
    comparison and lose nothing.
    """
    grid = vectors[:, :depth]
    at = np.floor(grid / (2 * radius)).astype(np.int64)
    into = grid / (2 * radius) - at
    side = np.where(into < 0.5, -1, 1)
    gap = np.minimum(into, 1 - into) * 2 * radius
    rows, cells = [], []
    for steps in itertools.product((0, 1) if spread else (0,), repeat=grid.shape[1]):
        steps = np.array(steps)
        near = np.flatnonzero(((gap * steps) ** 2).sum(1) <= radius**2 * (1 + SLACK))
        cell = at[near] + steps * side[near]
        key = np.zeros(len(cell), np.int64)
        for axis in range(cell.shape[1]):
            key = key * 0x9E3779B1 + cell[:, axis]
        rows.append(near)
        cells.append(key)
    return np.concatenate(rows), np.concatenate(cells)


def _depth(left, right, reach, seed):
    """How many axes the grid of a block gets for so many rows of one label on either side.

    Each axis more makes more copies of the rows on the right and lets fewer
    pairs meet. Both are counted on made blocks of vectors that lie evenly,
    where only the reach matters; the depth with the least work is taken. Any
    depth finds all pairs.
    """
    rng = np.random.default_rng([seed, BLOCK])
    one, two = rng.standard_normal((2, 1000, BLOCK))
    radius = reach * BLOCK**0.5
    work = {}
    for depth in range(1, BLOCK + 1):
        own, counts = np.unique(_cells(one, radius, depth, False)[1], return_counts=True)
        touched = _cells(two, radius, depth)[1]
        at = np.minimum(np.searchsorted(own, touched), len(own) - 1)
        met = counts[at[own[at] == touched]].sum()
        work[depth] = COPY_COST * right * len(touched) / len(two) + left * right * met / (len(one) * len(two))
    return min(work, key=work.get)


def _blocks(vectors, reach, seed, depth, spread):
    """Per vector (id, label, unit) and block: (id, label, size, block, cell, x0 ...), with every cell the ball touches if `spread`."""
    fields = [T.StructField("id", T.LongType()), vectors.schema["label"]]
    fields += [T.StructField(n, T.IntegerType()) for n in ("size", "block")]
    schema = T.StructType([*fields, T.StructField("cell", T.LongType()), *[T.StructField(n, T.FloatType()) for n in _X]])

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                yield from of(batch.slice(part, 256))

    def of(batch):
        for own, (rows,) in _by_size(batch.column(2)):
            size = rows.shape[1]
            turned = rows @ _rotation(size, seed)
            for block, a in enumerate(range(0, size, BLOCK)):
                coordinates = turned[:, a : a + BLOCK].astype(np.float32)
                width = coordinates.shape[1]
                radius = reach * (width / size * (1 + SLACK)) ** 0.5 + SLACK
                padded = np.zeros((len(own), BLOCK), np.float32)
                padded[:, :width] = coordinates
                at, cells = _cells(coordinates.astype(float), radius, depth, spread)
                pick = pa.array(own[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick), batch.column(1).take(pick),
                        pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), block, np.int32)),
                        pa.array(cells), *[pa.array(padded[at, j]) for j in range(BLOCK)],
                    ],
                    names=[f.name for f in schema],
                )

    return vectors.mapInArrow(run, schema)


def near_pairs(left, right, reach, seed=3, smaller=None):
    """Pairs (a, b) of rows (id, label, unit) of two tables that may lie within `reach` of each other; none that do is left out.

    Labels and lengths have to agree. Blocks share the squared reach out in
    proportion to their dimensions, so a pair that keeps to the whole keeps to
    the share of one block at least. In a block, a vector meets those whose
    balls touch its grid cell, and the exact block distance decides. The grid
    is the finer the more rows the largest label has.
    `smaller` may name a condition on the ids a and b.
    """
    keys = ["label", "size", "block", "cell"]
    rows = [side.groupBy("label").count().agg(F.max("count")).first()[0] or 0 for side in (left, right)]
    depth = _depth(*rows, reach, seed)
    one = _blocks(left, reach, seed, depth, False).withColumnRenamed("id", "a").withColumnsRenamed({n: f"l{n}" for n in _X})
    two = _blocks(right, reach, seed, depth, True).withColumnRenamed("id", "b")
    apart = sum((F.col(f"l{n}").cast("double") - F.col(n)) ** 2 for n in _X)
    width = F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK)
    budget = reach**2 * width / F.col("size") * (1 + 2 * SLACK) + 2 * SLACK**2
    met = staged(one).join(staged(two), keys).filter(F.expr(smaller or "a <> b") & (apart <= budget))
    return met.select("a", "b").distinct()


def _clusters(units, reach, seed):
    """(members, centres): (cls, c, rho, n) of vectors within half the reach of a centre, and (id, label, unit).

    Centres are means of vectors with one key. Whatever its own key, a vector
    belongs to the centre with most vectors near it, so that a crowd which the
    planes cut up comes together again.
    """
    by = ["label", "size", "key"]
    crowded = staged(units.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(*by))
    own = staged(units.join(crowded, by).select(*by, "cls", "unit"))
    means = own.select(*by, F.posexplode("unit").alias("at", "x")).groupBy(*by, "at").agg(F.avg("x").alias("x"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])
    centres = staged(means.groupBy(*by).agg(centre.alias("centre")))
    half = reach / 2 - DOUBT
    near = own.join(centres, by).filter(_distance("unit", "centre") <= half)
    seeds = near.groupBy(*by).agg(F.min("cls").alias("id"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    centres = staged(centres.join(staged(seeds), by).select("id", "label", F.col("centre").alias("unit"), "m"))

    every = units.select(F.col("cls").alias("id"), "label", "unit")
    met = near_pairs(every, centres.drop("m"), reach / 2, seed, "true")
    rho = _with_units(met, every, centres).select("a", "b", _distance("v", "w").alias("rho")).filter(F.col("rho") <= half)
    best = F.max(F.struct("m", (-F.col("b")).alias("minus"), "rho")).alias("best")
    best = rho.join(centres.select(F.col("id").alias("b"), "m"), "b").groupBy(F.col("a").alias("cls")).agg(best)
    members = best.join(units.select("cls", "n"), "cls").select("cls", (-F.col("best.minus")).alias("c"), "best.rho", "n")
    members = staged(members)
    # Centres whose vectors all belong to others have nothing to be compared with.
    return members, staged(centres.drop("m").join(members.select(F.col("c").alias("id")).distinct(), "id", "left_semi"))


def _with_units(pairs, a, b):
    """Pairs (a, b) with the units of both ids, from tables (id, unit)."""
    one = pairs.join(a.select(F.col("id").alias("a"), F.col("unit").alias("v")), "a")
    return one.join(b.select(F.col("id").alias("b"), F.col("unit").alias("w")), "b")


def links(units, least_cosine, seed=3):
    """(counts, edges) of `units`: (cls, others), the linked rows beside a class's own, and (a, b), edges with the same components as all links."""
    reach = (2 - 2 * least_cosine) ** 0.5
    members, centres = _clusters(units, reach, seed)
    all_units = units.select(F.col("cls").alias("id"), "label", "unit")
    alone = staged(units.join(members.select("cls"), "cls", "left_anti").select(F.col("cls").alias("id"), "label", "unit", "n"))

    # Members of a cluster all link.
    whole = staged(members.groupBy("c").agg(F.sum("n").alias("w"), F.min("cls").alias("b")))
    inside = members.join(whole, "c").select("cls", (F.col("w") - F.col("n")).alias("others"))
    tied = members.join(whole, "c").filter("cls <> b").select(F.col("cls").alias("a"), "b")

    # Each vector against the shells of clusters other than its own.
    shelled = staged(members.withColumn("shell", F.floor(F.col("rho") / (reach / 2) * SHELLS)))
    shells = shelled.groupBy("c", "shell").agg(F.max("rho").alias("rho"), F.sum("n").alias("w"), F.min("cls").alias("first"))
    met = near_pairs(all_units, centres, reach * 1.5, seed, "true")
    met = met.join(members.select(F.col("cls").alias("a"), F.col("c").alias("own")), "a", "left").filter(~F.col("own").eqNullSafe(F.col("b")))
    far = _with_units(met, all_units, centres).select("a", F.col("own").isNull().alias("lone"), F.col("b").alias("c"), _distance("v", "w").alias("d"))
    seen = staged(far.filter(F.col("d") <= reach * 1.5 + DOUBT).join(shells, "c").filter(F.col("d") - F.col("rho") <= reach + DOUBT))
    sure = F.col("d") + F.col("rho") <= reach - DOUBT
    certain = seen.filter(sure)
    doubtful = seen.filter(~sure).select("a", "lone", "c", "shell").join(shelled.select("c", "shell", F.col("cls").alias("b")), ["c", "shell"])
    one_way = _linked(doubtful.select("a", "b", "lone"), all_units, all_units, least_cosine)

    # Vectors in no cluster link with each other, and clusters' members with them as they with the members.
    alone_units = alone.select("id", "label", "unit")
    lone_pairs = near_pairs(alone_units, alone_units, reach, seed, "a < b").withColumn("lone", F.lit(True))
    listed = one_way.unionByName(_linked(lone_pairs, alone_units, alone_units, least_cosine))
    turned = listed.filter("lone").select(F.col("b").alias("a"), F.col("a").alias("b"))
    listed = staged(listed.select("a", "b").unionByName(turned))
    by_shell = certain.filter("lone").join(alone.select(F.col("id").alias("a"), "n"), "a").groupBy("c", "shell").agg(F.sum("n").alias("others"))

    weight = units.select(F.col("cls").alias("b"), "n")
    counts = inside.unionByName(certain.select(F.col("a").alias("cls"), F.col("w").alias("others")))
    counts = counts.unionByName(shelled.join(by_shell, ["c", "shell"]).select("cls", "others"))
    counts = counts.unionByName(listed.join(weight, "b").select(F.col("a").alias("cls"), F.col("n").alias("others")))
    counts = counts.groupBy("cls").agg(F.sum("others").alias("others"))
    edges = tied.unionByName(certain.select("a", F.col("first").alias("b"))).unionByName(listed)
    return counts, edges


def _linked(pairs, a, b, least_cosine):
    """The pairs whose vectors' cosine, in double precision, is large enough."""
    return staged(_with_units(pairs, a, b).filter(_cosine("v", "w") >= least_cosine).select(*pairs.columns))


def near_duplicates(table, least_cosine=0.98, id_col="vec_id", vector_col="embedding", label_col="label", seed=3):
    """One row (id, n_links, component_id, kept) per row of `table`.

    Rows link if their labels are equal and not null and their vectors have a
    cosine of `least_cosine` or more; a vector that is null, empty, zero or
    holds a null or non-finite entry links with nothing, and so do vectors of
    different lengths. n_links counts linked rows, component_id is the smallest
    id reachable, kept tells whether it is the row's own. Equal vectors are one
    class, so a vector that fills a third of the table costs no more than
    another. Rows with a null id take part and are named by the others; rows
    with one id and different vectors are different vectors.
    """
    if not 0.5 <= least_cosine <= 1:
        raise ValueError("the cosine must lie between 0.5 and 1")
    rows = table.select(
        F.col(id_col).alias("id"),
        F.when(_valid(F.col(vector_col)) & F.col(label_col).isNotNull(), F.col(vector_col)).alias("vector"),
        F.col(label_col).alias("label"),
    )
    own = rows.filter("vector is not null")
    classes = own.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()))
    counts, edges = links(staged(_units(classes, seed)), least_cosine, seed)
    roots = components(edges).select(F.col("vertex").alias("cls"), "root")
    tied = classes.join(roots, "cls", "left").join(counts, "cls", "left").select(
        "label", "vector", "first", F.coalesce("root", "cls").alias("root"),
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    )
    tied = staged(tied)
    named = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    by_vector = staged(tied.join(named, "root").select("label", "vector", "n_links", "component_id"))
    found = rows.join(by_vector, ["label", "vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
