"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are) and normalised. The
exponent is bisected: the largest that reaches a target entropy, or the smallest that repeats no source more often than
a limit. Each source then has a token budget: so many whole epochs and a part of one more. Its documents are dealt to
blocks of about ``BLOCK`` documents by hash; every epoch permutes the blocks anew and takes them in that order, the last
one in part, until the budget is met. Budgets are overshot by less than one document per source.

Only per-source and per-block sums are gathered; a document finds its epochs by joining its block's plan, so a source
with a third of all rows is spread over as many blocks as it needs and no text is shuffled for ordering. What reaches
the driver is one row per source.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and are taken with their block;
sources without tokens have weight zero; rows that repeat an id within a source are drawn together, rows without an id
go by their text; an empty table gives no rows; the result has the columns of the input (extra ones too, whatever their
names) and ``epoch``, ``mix_at``, ``mix_tie``, which replace columns of those names. Ordering by (mix_at, mix_tie) gives the mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variform.llm.common import spare, stage
from variform.session import small_table

BLOCK = 1_000
STEPS = 60
_WORKING = ("_mix_key", "_mix_block", "_mix_blocks", "_mix_cut")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def weights(sizes: list[int], exponent: float) -> list[float]:
    """Normalised powers of the token shares; sources without tokens get nothing."""
    total = sum(sizes)
    powers = [(n / total) ** exponent if n else 0.0 for n in sizes]
    whole = sum(powers)
    return [p / whole for p in powers] if whole else powers


def entropy(shares: list[float]) -> float:
    return -sum(w * math.log(w) for w in shares if w > 0)


def find_exponent(sizes: list[int], budget: int, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The largest exponent of at least the target entropy, or the smallest that stays within the repeats.

    Both are monotone in the exponent. A target that even equal weights miss gives 0; a limit that even the natural
    shares break gives 1.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    total = sum(sizes)
    if not total:
        return 1.0

    def spread_enough(exponent: float) -> bool:
        return entropy(weights(sizes, exponent)) >= target_entropy

    def too_often(exponent: float) -> bool:
        return max(w * budget / n for w, n in zip(weights(sizes, exponent), sizes) if n) > max_repeats

    below = spread_enough if max_repeats is None else too_often
    if below(1.0):
        return 1.0
    if not below(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) else (low, middle)
    return low if max_repeats is None else high


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _order(seed: int, *what: Column) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def _name() -> tuple[Column, Column]:
    """What a document is hashed by: its id, or its text if it has none (a null changes no hash)."""
    return F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def _keyed(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents with the key of their source and their block."""
    wide = docs.withColumn("_mix_key", _key(F.col("source"))).join(blocks.withColumnRenamed("key", "_mix_key"), "_mix_key")
    return wide.withColumn("_mix_block", F.pmod(F.xxhash64(F.lit("block"), *_name()), F.col("_mix_blocks"))).drop("_mix_blocks")


_PLAN = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("budget", T.LongType()), T.StructField("weight", T.DoubleType())]
)


def mix(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    seed: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """The draws of the mixture: the rows of ``docs`` once for each epoch that takes them. ``budget`` is in tokens."""
    docs = docs.select([c for c in docs.columns if c not in ("epoch", "mix_at", "mix_tie")])
    # columns under the working names travel under others
    given = {c: spare([*docs.columns, *_WORKING], c)[0] if c.lower() in _WORKING else c for c in docs.columns}
    docs = docs.withColumnsRenamed(given)
    # two small stages: blocks per source, then tokens per block
    blocks = stage(
        docs.groupBy(_key(F.col("source")).alias("key")).count().select("key", F.ceil(F.col("count") / block).cast("long").alias("_mix_blocks"))
    )
    counted = _keyed(docs.select("doc_id", "source", "text"), blocks).groupBy("_mix_key", "_mix_block").agg(F.sum(tokens(F.col("text"))).alias("tokens"))
    per_block = stage(counted.select(F.col("_mix_key").alias("key"), F.col("_mix_block").alias("block"), "tokens"))
    sums = sorted((r["key"], r["n"]) for r in per_block.groupBy("key").agg(F.sum("tokens").alias("n")).collect())
    sizes = [n for _, n in sums]
    budget = sum(sizes) if budget is None else budget
    shares = weights(sizes, find_exponent(sizes, budget, target_entropy, max_repeats))
    columns = {"key": [k for k, _ in sums], "size": sizes, "budget": [round(w * budget) for w in shares], "weight": shares}
    sources = small_table(docs.sparkSession, _PLAN, columns)

    # epochs of each block, and how many tokens its source has taken before it
    epochs = per_block.join(sources, "key").where("size > 0")
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("budget") / F.col("size")).cast("int"))))
    turn = Window.partitionBy("key", "epoch").orderBy(_order(seed, F.col("block"), F.col("epoch")), "block")
    before = F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("epoch") * F.col("size")
    taken = epochs.withColumn("before", before).where("before < budget").withColumn("rest", F.col("budget") - F.col("before"))
    taken = stage(taken.select("key", "block", "epoch", (F.col("before") / F.col("budget")).alias("at"), "rest", (F.col("rest") < F.col("tokens")).alias("part")))

    # where a budget ends inside a block: the last document taken, by the order of the block's documents
    ends = taken.where("part").select(F.col("key").alias("_mix_key"), F.col("block").alias("_mix_block"), "epoch", "rest")
    inside = _keyed(docs.select("doc_id", "source", "text"), blocks).join(ends, ["_mix_key", "_mix_block"])
    inside = inside.select("_mix_key", "_mix_block", "epoch", "rest", _order(seed, *_name(), F.col("epoch")).alias("tie"), tokens(F.col("text")).alias("n"))
    run = Window.partitionBy("_mix_key", "_mix_block", "epoch").orderBy("tie").rangeBetween(Window.unboundedPreceding, -1)
    cuts = inside.withColumn("sofar", F.coalesce(F.sum("n").over(run), F.lit(0))).where("sofar < rest")
    cuts = cuts.groupBy(F.col("_mix_key").alias("key"), F.col("_mix_block").alias("block"), "epoch").agg(F.max("tie").alias("cut"))

    plan = taken.join(cuts, ["key", "block", "epoch"], "left").select(
        F.col("key").alias("_mix_key"), F.col("block").alias("_mix_block"), "epoch", F.col("at").alias("mix_at"), F.col("cut").alias("_mix_cut")
    )
    # staged, so that Spark knows its size: while it is small it is broadcast and no text is shuffled
    plan = stage(plan)
    drawn = _keyed(docs, blocks).join(plan, ["_mix_key", "_mix_block"]).withColumn("mix_tie", _order(seed, *_name(), F.col("epoch")))
    drawn = drawn.where(F.col("_mix_cut").isNull() | (F.col("mix_tie") <= F.col("_mix_cut")))
    return drawn.select(*(F.col(name).alias(c) for c, name in given.items()), "epoch", "mix_at", "mix_tie")


def report(docs: DataFrame, max_repeats: float) -> DataFrame:
    """Every draw with its place in the mixture."""
    return mix(docs.select("doc_id", "source", "text"), max_repeats=max_repeats).select(
        "doc_id", "source", "epoch", tokens(F.col("text")).alias("n_tokens"), F.round("mix_at", 9).alias("mix_at"), "mix_tie"
    )
