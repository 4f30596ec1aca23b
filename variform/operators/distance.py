"""Distance relations ``dist(a, b, d)`` and distances computed on demand.

A relation over all items grows with their square, so the all-pairs operators return it over
distinct vectors, together with how many items each end stands for; ``profiles.members`` gives the
way back to items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions.columns import euclidean, exact_sum
from variform.operators import pairwise
from variform.operators.profiles import collapse, members
from variform.session import stage

PIVOT_LIMIT = 10_000


def all_pairs(items: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(a, b, d, n_a, n_b)`` over unordered pairs of distinct vectors of ``items(id, x)``.

    ``metric='euclidean'`` is missing-aware and plain Euclidean on complete vectors;
    ``'geodesic'`` takes (latitude, longitude) vectors.
    """
    return pairwise.pair_relation(stage(collapse(items)), metric)


def distance_range(items: DataFrame, metric: str = "euclidean") -> tuple[float, float]:
    """Smallest and largest entry of the full matrix, its zero diagonal included."""
    row = pairwise.pair_extremes(stage(collapse(items)), metric).first()
    return row["min_d"], row["max_d"]


def normalize(dist: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Min-max scale ``d`` by the range of the whole matrix; NULL if all distances are equal.

    The range can be given; by default it is the relation's own, with 0 for the diagonal that a
    relation of distinct pairs leaves out.
    """
    if low is None or high is None:
        row = dist.agg(F.least(F.min("d"), F.lit(0.0)).alias("low"), F.max("d").alias("high")).first()
        low, high = row["low"], row["high"]
    return dist.withColumn("d", scaled(F.col("d"), low, high))


def scaled(d: Column, low: float, high: float) -> Column:
    return F.try_divide(d - F.lit(low), F.lit(high) - F.lit(low))


def symmetrize(pairs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Both directions of an unordered relation, plus the diagonal of ``items`` at distance 0."""
    swapped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    both = pairs.select("a", "b", "d").unionByName(swapped)
    if items is not None:
        both = both.unionByName(items.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d")))
    return both.withColumn("d", F.coalesce("d", F.lit(0.0)))


def item_relation(items: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(a, b, d)`` over all ordered pairs of items, diagonal included, for the wide file of a small frame.

    Grows with the square of the items, so it stops at what a wide file can hold; use
    :func:`all_pairs` with ``profiles.members`` beyond that.
    """
    n = items.count()
    if n > PIVOT_LIMIT:
        raise ValueError(f"{n} items are too many for a relation of all items, keep that of distinct vectors")
    profiles = stage(collapse(items))
    relation = symmetrize(pairwise.pair_relation(profiles, metric), profiles)
    held = stage(members(items, profiles))
    left, right = (held.select(F.col("id").alias(f"_{c}"), F.col("profile").alias(c)) for c in "ab")
    return relation.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "d")


def pair_distances(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Distance of each given pair ``(a, b)``, looked up through two equi-joins."""
    left = items.select(F.col("id").alias("a"), F.col("x").alias("_x"))
    right = items.select(F.col("id").alias("b"), F.col("x").alias("_y"))
    return pairs.join(left, "a").join(right, "b").withColumn("d", euclidean("_x", "_y")).drop("_x", "_y")


def lookup(pairs: DataFrame, dist: DataFrame) -> DataFrame:
    """Distance of each given pair from a relation that holds both directions."""
    return pairs.join(dist.select("a", "b", "d"), ["a", "b"])


def sub_distances(dist: DataFrame, frame: DataFrame, check: bool = True) -> DataFrame:
    """Rows and columns of the frame only, with the frame positions of both ends.

    An id the relation does not know is an error.
    """
    if check:
        unknown = frame.join(dist.select(F.col("a").alias("id")).distinct(), "id", "left_anti").take(5)
        if unknown:
            raise KeyError(f"not in the distance relation: {[r['id'] for r in unknown]}")
    pos_a = frame.select(F.col("id").alias("a"), F.col("pos").alias("pos_a"))
    pos_b = frame.select(F.col("id").alias("b"), F.col("pos").alias("pos_b"))
    return dist.join(pos_a, "a").join(pos_b, "b").select("a", "b", "d", "pos_a", "pos_b")


def row_sums(items: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, sum_d, n_items)``: summed distance of each distinct vector to all items."""
    profiles = stage(collapse(items))
    return pairwise.row_sums(profiles, metric).join(profiles.select("id", F.col("w").alias("n_items")), "id")


def relation_row_sums(dist: DataFrame) -> DataFrame:
    """``(id, sum_d)`` from a relation that holds both directions."""
    return dist.groupBy(F.col("a").alias("id")).agg(exact_sum("d").alias("sum_d"))


def within_sample_distance(samples: DataFrame, items: DataFrame, group: str, metric: str = "euclidean") -> DataFrame:
    """``(group, sum_d, n_pairs)``: summed distance over the unordered pairs of each sample."""
    drawn = samples.select(group, "id").join(items.select("id", "x"), "id")
    totals = pairwise.pair_statistics(stage(collapse(drawn, group)), group, ("distance",), metric)
    return totals.select(group, F.col("total").alias("sum_d"), F.col("n").cast("bigint").alias("n_pairs"))


def summed_distance_to_set(items: DataFrame, chosen: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, score)``: summed distance of every candidate to the chosen items."""
    return pairwise.score_against(items.select("id", "x"), chosen, "sum", metric).select("id", "score")


def min_distance_to_set(items: DataFrame, chosen: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, score)``: smallest distance of every candidate not yet chosen to the chosen items."""
    rest = items.select("id", "x").join(chosen.select("id"), "id", "left_anti")
    return pairwise.score_against(rest, chosen, "min", metric).select("id", "score")


def running_overlap(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``(a, b, pos, overlap)``: running share of equal values over shared positions, per given pair.

    Vectors meet whole, by two equi-joins, and are folded within the row.
    """
    left = items.select(F.col("id").alias("a"), F.col("x").alias("_x"))
    right = items.select(F.col("id").alias("b"), F.col("x").alias("_y"))
    cells = F.zip_with("_x", "_y", lambda x, y: F.struct((x == y).alias("same"), (x.isNotNull() & y.isNotNull()).alias("both")))

    def step(state: Column, cell: Column) -> Column:
        same = state["same"] + F.coalesce(cell["same"].cast("int"), F.lit(0))
        total = state["total"] + cell["both"].cast("int")
        ratio = F.try_divide(same, total)
        return F.struct(same.alias("same"), total.alias("total"), F.concat(state["ran"], F.array(ratio)).alias("ran"))

    start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("total"), F.array().cast("array<double>").alias("ran"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    ran = joined.select("a", "b", F.posexplode(F.aggregate(cells, start, step, lambda s: s["ran"])).alias("pos", "overlap"))
    return ran.where(F.col("overlap").isNotNull())


def to_wide(dist: DataFrame, ids: list, id_name: str = "Lang_ID") -> DataFrame:
    """Square table with one column per id; only for small frames (a column per item)."""
    if len(ids) > PIVOT_LIMIT:
        raise ValueError(f"{len(ids)} columns are too many for a wide table, keep the long relation")
    return dist.groupBy(F.col("a").alias(id_name)).pivot("b", ids).agg(F.first("d"))


def from_wide(wide: DataFrame, id_name: str = "Lang_ID") -> DataFrame:
    """Long relation of a square table."""
    values = [c for c in wide.columns if c != id_name]
    long = wide.unpivot([id_name], [F.col(f"`{c}`").cast("double").alias(c) for c in values], "b", "d")
    return long.select(F.col(id_name).alias("a"), "b", "d")
