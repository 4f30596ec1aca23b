"""Diverse samples: greedy selection over vectors or over a given distance relation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variform.operators import distance, pairwise
from variform.operators.greedy import MAXMIN, MAXSUM, SCORE_DIGITS, Pick, first_of_ties, first_pick, greedy
from variform.operators.profiles import earliest_copies
from variform.operators.sets import assert_known
from variform.session import small_table, stage


def _pick_table(spark: SparkSession, id_type: T.DataType, ids: list) -> DataFrame:
    schema = T.StructType([T.StructField("pick_order", T.IntegerType()), T.StructField("id", id_type)])
    return small_table(spark, schema, {"pick_order": list(range(1, len(ids) + 1)), "id": ids})


def with_frame(items: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """``(id, pos, x)``: frame items in frame order; without a frame, all items ordered by id."""
    if frame is None:
        return items.select("id", F.col("id").alias("pos"), "x")
    return items.join(frame.select("id", "pos"), "id").select("id", "pos", "x")


class Candidates:
    """Items made ready for picking up to ``k`` of them by either objective.

    ``vectors(id, pos, x, w)`` has the distinct vectors with their earliest item and stands for all items in row sums;
    ``items`` is what can be picked. With ``copies`` it shrinks to the earliest ``k`` items of each vector.
    """

    def __init__(self, items: DataFrame, k: int, frame: DataFrame | None = None, metric: str = "euclidean", copies: bool = False):
        if k < 1:
            raise ValueError(f"Invalid value {k=}, make sure k > 0")
        placed = with_frame(items, frame)
        self.k, self.metric = k, metric
        self.items = stage(earliest_copies(placed, k) if copies else placed)
        # without a frame the id is the position, and its minimum aggregates by hash
        earliest = F.min("id" if frame is None else F.struct("pos", "id")).alias("e")
        e = F.col("e")
        id_pos = (e.alias("id"), e.alias("pos")) if frame is None else ("e.id", "e.pos")
        weighed = (placed if copies else self.items).groupBy("x").agg(earliest, F.count(F.lit(1)).alias("w"))
        self.vectors = stage(weighed.select(*id_pos, "x", "w"))

    @cached_property
    def first(self) -> Pick:
        return first_pick(self.vectors, self.metric)

    def pick(self, objective: str) -> DataFrame:
        """``(pick_order, id)`` of the greedy sample of size ``k``."""
        picks = greedy(self.items, self.k, objective, self.metric, self.first)
        return _pick_table(self.items.sparkSession, self.items.schema["id"].dataType, [p.id for p in picks])


def sample_maxsum(
    items: DataFrame, k: int, frame: DataFrame | None = None, metric: str = "euclidean", copies: bool = False
) -> DataFrame:
    """``(pick_order, id)``: each pick has the largest summed distance to the picks before it.

    Set ``copies`` where many items share a vector: only distinct vectors and their earliest items
    are then scored, with the same result.
    """
    return Candidates(items, k, frame, metric, copies).pick(MAXSUM)


def sample_maxmin(
    items: DataFrame, k: int, frame: DataFrame | None = None, metric: str = "euclidean", copies: bool = False
) -> DataFrame:
    """``(pick_order, id)``: each pick has the largest distance to its nearest pick so far."""
    return Candidates(items, k, frame, metric, copies).pick(MAXMIN)


def expand_sample(items: DataFrame, chosen: DataFrame, n: int, frame: DataFrame | None = None, metric: str = "euclidean") -> DataFrame:
    """``(pick_order, id)``: the ``n`` next best items for an existing sample, never one of its own.

    The frame limits what may be added; the sample may lie outside it. A chosen id without features is an error.
    """
    assert_known(chosen, items, "the items")
    rest = with_frame(items, frame).join(chosen.select("id"), "id", "left_anti")
    sample = items.join(chosen.select("id"), "id", "left_semi")
    scored = pairwise.score_against(rest, sample, "sum", metric).withColumnRenamed("score", "base")
    picks = greedy(stage(scored), n, MAXSUM, metric)
    return _pick_table(items.sparkSession, items.schema["id"].dataType, [p.id for p in picks])


def sample_from_distances(
    dist: DataFrame, k: int, objective: str, frame: DataFrame | None = None, clustered: bool = False
) -> DataFrame:
    """As the greedy samplers, on a relation ``(a, b, d)`` that holds both directions.

    Each step reads only the rows of the picks so far, a small part of the files of a relation
    clustered by ``a``. It is staged that way first, unless ``clustered`` says it was written so.
    """
    if frame is None:
        dist = dist.select("a", "b", "d", F.col("a").alias("pos_a"), F.col("b").alias("pos_b"))
    else:
        dist = distance.sub_distances(dist, frame)
    if frame is not None or not clustered:
        dist = stage(dist.repartitionByRange("a").sortWithinPartitions("a"))
    first = first_of_ties(dist.groupBy("a", "pos_a").agg(F.sum("d").alias("score")), "score", "pos_a")
    if k < 1 or first is None:
        raise ValueError(f"Invalid value {k=}, make sure k > 0")
    picks = [first["a"]]
    gather = F.sum if objective == MAXSUM else F.min
    while len(picks) < k:
        row = (
            dist.where(F.col("a").isin(picks) & ~F.col("b").isin(picks))
            .groupBy("b", "pos_b")
            .agg(F.round(gather("d"), SCORE_DIGITS).alias("score"))
            .orderBy(F.desc("score"), "pos_b")
            .first()
        )
        if row is None:
            raise ValueError(f"Invalid value {k=}, there are only {len(picks)} items to sample from")
        picks.append(row["b"])
    return _pick_table(dist.sparkSession, dist.schema["a"].dataType, picks)


def prefixes(picks: DataFrame, method: str, ks: Iterable[int]) -> DataFrame:
    """``samples(method, run, k, id)`` for every size: the picks for ``k`` are the first ``k`` picks."""
    sizes = F.array(*[F.lit(k).cast("int") for k in sorted(set(ks))])
    return picks.withColumn("k", F.explode(sizes)).where(F.col("pick_order") <= F.col("k")).select(
        F.lit(method).alias("method"), F.lit(0).alias("run"), "k", "id"
    )
