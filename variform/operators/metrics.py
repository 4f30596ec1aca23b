"""Diversity metrics of any number of samples in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions.columns import exact_mean
from variform.operators import pairwise
from variform.operators.distance import scaled
from variform.operators.profiles import collapse
from variform.operators.sets import assert_known
from variform.session import stage

FVO_MODES = ("every_position", "shared_positions", "pair_mean")
METRICS = ("entropy_with_missing", "entropy_without_missing", "fvi", "mpd", "fvo")


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def _entropy(n: Column, n_log_n: Column) -> Column:
    """Base-2 entropy from the total count and the sum of c * log2(c)."""
    return F.coalesce(F.try_divide(n * F.log2(n) - n_log_n, n), F.lit(0.0))


def value_metrics(drawn: DataFrame, group: str, digits: int | None = 10) -> DataFrame:
    """Entropies and feature value inclusion of ``drawn(group, id, x)``, averaged over features.

    Counting combines on the map side, so a sample of any size reduces to its distinct values.
    """
    cells = drawn.select(group, F.posexplode("x").alias("pos", "val"))
    counts = cells.groupBy(group, "pos", "val").agg(F.count(F.lit(1)).cast("double").alias("c"))
    known = F.col("val").isNotNull()
    n_log_n = (F.col("c") * F.log2("c")).cast("decimal(38,15)")
    features = counts.groupBy(group, "pos").agg(
        F.sum("c").alias("n_all"),
        F.sum(n_log_n).cast("double").alias("s_all"),
        F.sum(F.when(known, F.col("c"))).alias("n_known"),
        F.sum(F.when(known, n_log_n)).cast("double").alias("s_known"),
        F.count_if(known).alias("distinct"),
    )
    return features.groupBy(group).agg(
        exact_mean(_round(_entropy(F.col("n_all"), F.col("s_all")), digits)).alias("entropy_with_missing"),
        exact_mean(_round(_entropy(F.col("n_known"), F.col("s_known")), digits)).alias("entropy_without_missing"),
        F.avg(F.col("distinct") / 2).alias("fvi"),
    )


def pair_metrics(
    drawn: DataFrame, group: str, distance_range: tuple[float, float] = (0.0, 1.0), metric: str = "euclidean"
) -> DataFrame:
    """``(group, mpd, fvo_<mode>..)`` of ``drawn(group, id, x)``; NULL where a sample has no usable pair."""
    totals = pairwise.pair_statistics(stage(collapse(drawn, group)), group, metric=metric)

    def of(stat: str) -> Column:
        return F.max(F.when(F.col("stat") == stat, F.col("mean")))

    return totals.groupBy(group).agg(
        scaled(of("distance"), *distance_range).alias("mpd"), *[of(mode).alias(f"fvo_{mode}") for mode in FVO_MODES]
    )


def mean_pairwise_distance(drawn: DataFrame, group: str, distance_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    totals = pairwise.pair_statistics(stage(collapse(drawn, group)), group, ("distance",))
    return totals.select(group, scaled(F.col("mean"), *distance_range).alias("mpd"))


def feature_value_overlap(drawn: DataFrame, group: str) -> DataFrame:
    """``(group, mode, fvo)`` for every way of averaging the running overlap."""
    totals = pairwise.pair_statistics(stage(collapse(drawn, group)), group, ("overlap",))
    return totals.select(group, F.col("stat").alias("mode"), F.col("mean").alias("fvo"))


def relation_mpd(samples: DataFrame, dist: DataFrame, group: str) -> DataFrame:
    """Mean pairwise distance from a relation that holds both directions.

    Rows of the relation are kept where both ends are in the sample, by two equi-joins. An id the relation does not
    know is an error.
    """
    ends = samples.select(group, F.col("id").alias("a")), samples.select(group, F.col("id").alias("b"))
    assert_known(samples, dist.select(F.col("a").alias("id")).distinct(), "the distance relation")
    inside = dist.where("a < b").join(ends[0], "a").join(ends[1], [group, "b"])
    return inside.groupBy(group).agg(exact_mean("d").alias("mpd"))


def evaluate(
    samples: DataFrame,
    items: DataFrame,
    distance_range: tuple[float, float] = (0.0, 1.0),
    fvo_mode: str = "every_position",
    digits: int | None = 10,
    with_members: bool = True,
) -> DataFrame:
    """All five metrics of every sample in ``samples(method, run, k, id)``.

    Items are read once, by a join on the sampled ids; a sampled id without features is an error. ``distance_range`` is the range that
    normalises distances. ``with_members`` adds the sorted, comma-joined ids of each sample.
    """
    if fvo_mode not in FVO_MODES:
        raise ValueError(f"Invalid value {fvo_mode=}, choose from {FVO_MODES}")
    keys = ("method", "run", "k")
    sample_id = F.to_json(F.struct(*keys))
    # vectors are many times their estimate, so items are merged by id and never broadcast
    featured = items.select("id", "x", F.lit(True).alias("_known")).hint("merge")
    drawn = stage(samples.withColumn("sample_id", sample_id).join(featured, "id", "left"))
    unknown = drawn.where("_known IS NULL").select("id").distinct().take(5)
    if unknown:
        raise KeyError(f"not in the items: {[r['id'] for r in unknown]}")
    group_keys = ("sample_id", *keys)
    if with_members:
        # compare ids as they are before turning them into text
        ordered = F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))
        heads = drawn.groupBy(*group_keys).agg(F.array_join(ordered, ",").alias("sample"))
    else:
        heads = drawn.select(*group_keys).distinct()
    values = value_metrics(drawn, "sample_id", digits)
    pairs = pair_metrics(drawn.select("sample_id", "id", "x"), "sample_id", distance_range)
    scored = heads.join(values, "sample_id").join(pairs, "sample_id", "left")
    out = (*keys, "entropy_with_missing", "entropy_without_missing", "fvi", "mpd")
    members = ("sample",) if with_members else ()
    return scored.select(*out, F.col(f"fvo_{fvo_mode}").alias("fvo"), *members)
