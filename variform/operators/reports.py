"""Tables behind the comparisons of sampling methods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variform.functions.columns import exact_mean
from variform.operators.metrics import METRICS
from variform.session import stage

# display names of the methods (fixed values)
METHOD_LABELS = {
    "maxmin": "MaxMin",
    "maxsum": "MaxSum",
    "random_genus": "RandomGenus*",
    "random_family": "RandomFamily*",
    "convenience": "Convenience*",
    "random": "Random*",
}
DETERMINISTIC = ("maxsum", "maxmin")
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def relabel(df: DataFrame, labels: Mapping[str, str] = METHOD_LABELS, source: str = "method", target: str = "Method") -> DataFrame:
    """Rename a column and map its values; values without a label become NULL."""
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return df.withColumnRenamed(source, target).withColumn(target, table[F.col(target)])


def slice_results(
    results: DataFrame, ks: Sequence[int] | None = None, methods: Sequence[str] | None = None, run: int | None = None
) -> DataFrame:
    """Rows of the given sizes, and of the given methods or the given run."""
    if ks is not None:
        results = results.where(F.col("k").isin(*ks))
    either: list[Column] = []
    if methods is not None:
        either.append(F.col("method").isin(*methods))
    if run is not None:
        either.append(F.col("run") == run)
    for condition in either[1:]:
        either[0] = either[0] | condition
    return results.where(either[0]) if either else results


def explode_sample(results: DataFrame) -> DataFrame:
    """One row per member of the comma-joined ``sample`` column."""
    return results.withColumn("id", F.explode(F.split("sample", ","))).drop("sample")


def summarize_runs(results: DataFrame, by: Sequence[str] = ("method", "k"), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample deviation of every metric; no deviation for deterministic methods."""
    random = ~F.col("method").isin(*DETERMINISTIC)
    out = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        out += [exact_mean(m).alias(f"{m}_mean"), F.stddev_samp(F.when(random, F.col(m))).alias(f"{m}_std")]
    return results.groupBy(*by).agg(*out)


#: Different scores that a task orders, and ranges that a larger one is cut in.
RANGE_ROWS = 65_536
RANGES = 256


def distribution_summary(scores: DataFrame, by: str, value: str = "score") -> DataFrame:
    """``(by, n, q0, q25, q50, q75, q100)``: exact interpolated quartiles per group of any size.

    Equal scores are merged first. As long as a range holds many different scores, approximate quantiles cut it in
    ranges of about equal size, counts tell in which of them the wanted ranks lie, and only those are kept. What is left
    is small and ordered; groups and ranges are never ordered whole.
    """
    score = F.col(value).cast("double")
    counts = stage(scores.groupBy(F.col(by).alias("_by"), score.alias("v")).agg(F.count(F.lit(1)).alias("c")))
    # filtered only here: before the aggregate it would compute every score twice
    counts = counts.where(F.col("v").isNotNull())
    sizes = counts.groupBy("_by").agg(F.sum("c").alias("n"))
    cells = counts.join(sizes.withColumnRenamed("_by", "_of"), F.col("_by").eqNullSafe(F.col("_of"))).drop("_of")
    cells = cells.withColumns({"part": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")})
    # the two neighbouring ranks of every quartile
    ranks = F.array(*[r for q in QUARTILES for r in (F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1)))])
    key = ["_by", "n", "part", "before"]
    while (cells.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > RANGE_ROWS:
        edges = F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)]).alias("edges")
        cut = cells.groupBy(*key).agg(edges).select(F.col("_by").alias("_of"), F.col("part").alias("_part"), "edges")
        same = F.col("_by").eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_part"))
        binned = stage(cells.join(cut, same).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("_of", "_part", "edges"))
        ranges = binned.groupBy(*key, "bin").agg(F.sum("c").alias("bin_c"))
        upto = F.sum("bin_c").over(Window.partitionBy(*key).orderBy("bin"))
        ranges = ranges.withColumn("_before", F.col("before") + upto - F.col("bin_c"))
        wanted = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("bin_c")))
        kept = ranges.where(wanted).select(F.col("_by").alias("_of"), F.col("part").alias("_part"), F.col("bin").alias("_bin"), "_before")
        found = binned.join(kept, same & (F.col("bin") == F.col("_bin")))
        cells = stage(found.select("_by", "v", "c", "n", (F.col("part") * RANGES + F.col("bin")).alias("part"), F.col("_before").alias("before")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*key).orderBy("v"))
    cells = cells.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("c") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("first")) & (rank <= F.col("last")), F.col("v")))

    aggregates = []
    for q in QUARTILES:
        place = F.lit(q) * (F.col("n") - 1)
        aggregates += [at(F.floor(place)).alias(f"_lo{q}"), at(F.ceil(place)).alias(f"_hi{q}")]
    found = cells.groupBy(F.col("_by").alias(by), "n").agg(*aggregates)

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"`_lo{q}`"), F.col(f"`_hi{q}`")
        return (low + (high - low) * (place - F.floor(place))).alias(f"q{int(q * 100)}")

    return found.select(by, "n", *[quantile(q) for q in QUARTILES])


def overlap_histogram(overlaps: DataFrame, width: float = 0.05) -> DataFrame:
    """``(method, bin, n)``: groups by their average overlap, those above 0 only."""
    shown = overlaps.where(F.col("avg_overlap") > 0)
    # guard the bin edge against the last digit of a computed mean
    bin_no = F.floor(F.round(F.col("avg_overlap"), 9) / width + 1e-9).cast("int")
    return shown.groupBy("method", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_groups(overlaps: DataFrame, method: str = "family", n: int = 25) -> DataFrame:
    """The first ``n`` groups by name among those above 0, best overlap first."""
    shown = overlaps.where((F.col("avg_overlap") > 0) & (F.col("method") == method))
    return shown.orderBy("group").limit(n).orderBy(F.desc("avg_overlap"), "group")
