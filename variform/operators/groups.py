"""How alike items are inside and across given groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variform.operators import neighbours
from variform.operators.profiles import collapse
from variform.session import small_table, stage


def group_sizes(items: DataFrame, group: str) -> DataFrame:
    return items.groupBy(group).agg(F.count(F.lit(1)).alias("n_members"))


def group_feature_overlap(items: DataFrame, features: list[str], group: str, method: str, groups: DataFrame | None = None) -> DataFrame:
    """``(method, group, avg_overlap, n_members)``: mean share of equal raw values over the pairs of a group.

    A feature value held by c members makes c*(c-1)/2 equal pairs, so counts per value give the
    exact mean without forming pairs. Missing tokens are values like any other, an empty cell equals nothing; a group
    of one scores 0 and items without a group are left out. ``groups(group)`` names groups that are
    listed even if none of their members has features: they score 0 with 0 members.
    """
    held = items.where(F.col(group).isNotNull())
    cells = held.select(
        F.col(group).alias("group"),
        F.posexplode(F.array(*[F.col(f).cast("string") for f in features])).alias("pos", "val"),
    )
    counts = cells.groupBy("group", "pos", "val").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum(F.when(F.col("pos") == 0, F.col("c")))
    equal = F.coalesce(F.sum(F.when(F.col("val").isNotNull(), F.col("c") * (F.col("c") - 1))), F.lit(0))
    found = counts.groupBy("group").agg(
        F.coalesce(F.try_divide(equal.cast("double"), n * (n - 1) * len(features)), F.lit(0.0)).alias("avg_overlap"),
        n.alias("n_members"),
    )
    if groups is not None:
        named = groups.select(F.col(group).alias("group")).where(F.col("group").isNotNull()).distinct()
        found = named.join(found, "group", "left").na.fill({"avg_overlap": 0.0, "n_members": 0})
    return found.select(F.lit(method).alias("method"), "group", "avg_overlap", "n_members")


def group_members(items: DataFrame, group: str) -> DataFrame:
    """``(group, id)`` in long form, so that a group of any size stays spread over tasks."""
    return items.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), "id")


def feature_value_domain(long: DataFrame) -> DataFrame:
    """``(feature, val)``: distinct non-missing values of each feature."""
    return long.where(F.col("val").isNotNull()).select("feature", "val").distinct()


def nearest_with_ties(items: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, profile, nearest_d, n_nearest)``: distance to the nearest different item and how many lie there.

    Items that share a vector share the answer. The tied neighbours themselves are
    ``neighbours.nearest_edges`` joined to the items behind each profile.
    """
    items = stage(items)
    profiles = stage(collapse(items))
    edges = neighbours.nearest_edges(profiles, metric)
    sizes = profiles.select(F.col("id").alias("b"), "w")
    per_profile = edges.join(sizes, "b").groupBy("a").agg(F.min("d").alias("nearest_d"), F.sum("w").alias("n_nearest"))
    keyed = profiles.join(per_profile, profiles["id"] == per_profile["a"]).select(
        "x", F.col("a").alias("profile"), "nearest_d", "n_nearest"
    )
    return items.join(keyed, "x").select("id", "profile", "nearest_d", "n_nearest")


def neighbour_group_purity(items: DataFrame, group: str, metric: str = "euclidean") -> DataFrame:
    """One row ``(in_group, out_group, total)`` over all nearest-neighbour pairs, ties included.

    Two missing groups count as the same group. Counts per profile and group stand for the items,
    so tied copies are multiplied, not listed.
    """
    counted = items.groupBy("x", F.col(group).alias("g")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    counted = stage(counted)
    profiles = stage(counted.groupBy("x").agg(F.min("id").alias("id"), F.sum("n").alias("w")))
    edges = stage(neighbours.nearest_edges(profiles, metric).select("a", "b"))
    sizes = profiles.select("id", "w")
    left, right = (sizes.select(F.col("id").alias(c), F.col("w").alias(f"w_{c}")) for c in "ab")
    total = edges.join(left, "a").join(right, "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("total"))
    held = stage(counted.drop("id").join(profiles.select("x", "id"), "x").select("id", "g", "n"))
    g_left = held.select(F.col("id").alias("a"), F.col("g").alias("g_a"), F.col("n").alias("n_a"))
    g_right = held.select(F.col("id").alias("b"), F.col("g").alias("g_b"), F.col("n").alias("n_b"))
    same = edges.join(g_left, "a").join(g_right, "b").where(F.col("g_a").eqNullSafe(F.col("g_b")))
    inside = same.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("in_group"))
    row, whole = inside.first()["in_group"], total.first()["total"] or 0
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("in_group", "out_group", "total")])
    return small_table(items.sparkSession, schema, {"in_group": [row], "out_group": [whole - row], "total": [whole]})
