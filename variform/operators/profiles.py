"""Collapse items that share one vector into a weighted profile.

Distances depend on vectors only, so every all-pairs quantity can be computed over distinct
profiles and weighted by how many items stand behind each. Copies, however many, cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variform.operators.ranks import first_per_key


def collapse(items: DataFrame, *group: str) -> DataFrame:
    """``items(id, x)`` to ``(group.., id, x, w)``: one row per distinct vector, ``id`` the smallest.

    The grouped count combines on the map side, so a hot vector does not travel.
    """
    return items.groupBy(*group, "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))


def members(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(id, profile)``: which profile each item belongs to."""
    keyed = profiles.select(F.col("id").alias("profile"), "x")
    return items.join(keyed, "x").select("id", "profile")


def earliest_copies(items: DataFrame, k: int) -> DataFrame:
    """At most ``k`` items per distinct vector, the earliest ones in frame order.

    A greedy pick of ``k`` items never needs more: copies score alike and ties go to the
    earliest, so the copy numbered ``k + 1`` is never reached.
    """
    # a leading hash lets the sort compare numbers before it compares vectors
    hashed = items.withColumn("_hash", F.xxhash64("x"))
    return first_per_key(hashed, ["_hash", "x"], [F.col("pos")], k).drop("rn", "_hash")
