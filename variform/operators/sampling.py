"""Seeded sampling of items: random, stratified and most-used-first.

Every method takes a list of draws (run, k, seed) and returns ``samples(method, run, k, id)``, so a
sweep over sizes and seeds is one job. The order of items under a seed is an MD5 of seed and id.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variform.functions.columns import shuffle_key
from variform.operators.ranks import lowest
from variform.session import small_table, stage


class Draw(NamedTuple):
    run: int
    k: int
    seed: int


def draws_for(ks: Iterable[int], runs: int) -> list[Draw]:
    """``runs`` draws per size; the seed of a run is ``run + k``."""
    return [Draw(run, k, run + k) for k in ks for run in range(runs)]


def _draw_table(df: DataFrame, draws: list[Draw]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in Draw._fields])
    return small_table(df.sparkSession, schema, {c: [getattr(d, c) for d in draws] for c in Draw._fields})


def _check(draws: list[Draw], available: int) -> None:
    for draw in draws:
        if draw.k < 1 or draw.k > available:
            raise ValueError(f"Invalid value k={draw.k}, make sure k > 0 and k <= {available}")


def _per_draw(df: DataFrame, draws: list[Draw], need: Column | None = None) -> DataFrame:
    """Every row once per draw, with ``run, k, seed`` and how many rows the draw ``need``s."""
    each = F.array(*[F.struct(*[F.lit(v).cast("int").alias(c) for c, v in zip(Draw._fields, d)]) for d in draws])
    rows = df.withColumn("_draw", F.explode(each)).select(*df.columns, "_draw.*")
    return rows.withColumn("need", F.col("k") if need is None else need)


def _label(samples: DataFrame, method: str) -> DataFrame:
    return samples.select(F.lit(method).alias("method"), "run", "k", "id")


def random_draws(frame: DataFrame, draws: list[Draw]) -> DataFrame:
    """Each draw: ``k`` items of the frame, without replacement."""
    n = frame.count()
    _check(draws, n)
    keyed = _per_draw(frame.select("id"), draws).withColumn("h", shuffle_key(F.col("seed"), "id"))
    return _label(lowest(keyed, ["run", "k"], n, len(draws)), "random")


def stratified_draws(items: DataFrame, key: str, draws: list[Draw], method: str = "stratified") -> DataFrame:
    """Each draw: ``k`` items spread over the groups of ``items(id, key)`` as evenly as possible.

    With at least ``k`` groups: one item from each of ``k`` random groups. With fewer: ``k //
    groups`` from each (a missing group counts as one here), then random items from everything not
    yet picked, items without a group included. Choosing the item within a group, the groups and the filling use
    separate keys, so none depends on another.
    """
    shape = items.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(key).alias("groups"),
        F.count_if(F.col(key).isNull()).alias("ungrouped"),
    ).first()
    n, groups = shape["n"], shape["groups"]
    _check(draws, n)
    n_groups = groups + (1 if shape["ungrouped"] else 0)
    share = {d: d.k // n_groups if d.k > groups else 1 for d in draws}
    grouped = items.where(F.col(key).isNotNull()).select("id", F.col(key).alias("_group"))
    parts = []
    singles, several = ([d for d in draws if keep(share[d])] for keep in (lambda s: s == 1, lambda s: s > 1))
    if singles:  # the lowest of a group is a minimum, which combines before the shuffle
        keyed = _per_draw(grouped, singles).withColumn("h", shuffle_key(F.col("seed"), "id"))
        first = keyed.groupBy("run", "k", "seed", "_group").agg(F.min(F.struct("h", "id")).alias("_first"))
        parts.append(first.select("run", "k", "seed", F.col("_first.id").alias("id")))
    if several:
        keyed = _per_draw(grouped, several, F.floor(F.col("k") / n_groups)).withColumn("h", shuffle_key(F.col("seed"), "id"))
        parts.append(lowest(keyed, ["run", "k", "seed", "_group"], n, len(several) * groups).drop("_group"))
    table = reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    picks = table.select("run", "k", "id", F.concat(F.lit("0"), shuffle_key(F.col("seed"), "id", "group")).alias("h"))
    filling = [d for d in draws if d.k > groups]
    if filling:
        # of the k lowest no more are picked already than the picks that need no filling
        keyed = _per_draw(items.select("id"), filling).withColumn("h", shuffle_key(F.col("seed"), "id", "fill"))
        low = lowest(keyed.drop("seed"), ["run", "k"], n, len(filling))
        seeds = _draw_table(items, filling).select("run", "k", "seed")
        fill = low.join(seeds, ["run", "k"]).select("run", "k", "id", F.concat(F.lit("1"), shuffle_key(F.col("seed"), "id", "fill")).alias("h"))
        # an item that is picked and also drawn for filling counts as picked
        picks = picks.unionByName(fill).groupBy("run", "k", "id").agg(F.min("h").alias("h"))
    most = max(max(d.k, groups) for d in draws) + max(d.k for d in draws)
    return _label(lowest(picks.withColumn("need", F.col("k")), ["run", "k"], most, len(draws)), method)


def convenience_draws(frame: DataFrame, counts: DataFrame, draws: list[Draw]) -> DataFrame:
    """Each draw: the ``k`` most-used items of the frame by ``counts(id, n)``, equal counts in random order.

    How many items have each count tells the count of the last item, which no seed changes; only the items that have
    just that count are drawn.
    """
    used = counts.select("id", "n").join(frame.select("id").hint("merge"), "id", "left_semi")
    by_count = stage(used.groupBy("n").agg(F.count(F.lit(1)).alias("_items")))
    total = by_count.agg(F.coalesce(F.sum("_items"), F.lit(0)).alias("n")).first()["n"]
    _check(draws, total)
    # a row per different count, of which there are at most about the root of twice the uses
    upto = by_count.withColumn("_upto", F.sum("_items").over(Window.orderBy(F.desc("n"))))
    ks = F.filter(F.array(*[F.lit(k) for k in sorted({d.k for d in draws})]), lambda k: k <= F.col("_upto"))
    before = F.col("_upto") - F.col("_items")
    last = upto.withColumn("k", F.explode(ks)).groupBy("k").agg(F.max(F.struct("n", before.alias("before"))).alias("_last"))
    met = {r["k"]: (r["_last"]["n"], r["k"] - r["_last"]["before"]) for r in last.collect()}  # a row per size
    bars = F.array(*[F.struct(*[F.lit(v).cast("int").alias(c) for c, v in zip(Draw._fields, d)], F.lit(met[d.k][0]).alias("_last_n"), F.lit(met[d.k][1]).alias("need")) for d in draws])
    lowest_bar = min(bar for bar, _ in met.values())
    each = used.where(F.col("n") >= lowest_bar).withColumn("_draw", F.explode(bars)).select("id", "n", "_draw.*")
    above = each.where(F.col("n") > F.col("_last_n")).select("run", "k", "id")
    ties = each.where(F.col("n") == F.col("_last_n")).withColumn("h", shuffle_key(F.col("seed"), "id"))
    return _label(above.unionByName(lowest(ties.select("run", "k", "id", "h", "need"), ["run", "k"], total, len(draws))), "convenience")


def random_split(ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` ids at random."""
    return random_draws(ids.select(F.col(ids.columns[0]).alias("id")), [Draw(0, k, seed)]).select("id")


def sorted_members(samples: DataFrame) -> DataFrame:
    """One row per sample with its ids sorted."""
    return samples.groupBy("method", "run", "k").agg(F.array_sort(F.collect_list("id")).alias("ids"))
