"""The first rows of each key, for keys of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 256


def first_per_key(rows: DataFrame, by: list[str], order: list[Column], k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` first rows per key, numbered ``rn``.

    Up to the optimizer's group-limit threshold a rank filter is also applied before the shuffle,
    so a hot key sends at most ``k`` rows per task. For larger ``k`` each key is first cut in salted
    parts, so that no task sorts a whole hot key.
    """
    if k > int(rows.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        part = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
        rows = salted.withColumn("_part_rn", part).where(F.col("_part_rn") <= k).drop("_salt", "_part_rn")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rn", rank).where(F.col("rn") <= k)


#: Rows of a key that the last range is expected to hold.
RANGE_ROWS = 4096
#: Digits of a hash that part a range in the next ones: 256 of them.
DIGITS = 2
#: Keys up to which every task is given the cuts of all keys.
FEW_KEYS = 10_000
#: Parts in which a key meets its cut where keys are more.
KEY_PARTS = 16


def _meet_cuts(keyed: DataFrame, cut: DataFrame, by: list[str], how: str, keys: int | None) -> DataFrame:
    """``keyed`` with the cut of its key.

    The size of ``keyed`` is estimated by the compressed column that its ids come from, so a free choice of the join may
    send all its rows through the driver. Few cuts go to every task; many meet their rows in sorted parts of a key.
    """
    if keys is not None and keys <= FEW_KEYS:
        return keyed.join(F.broadcast(cut), by, how)
    parts = cut.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1))))
    rows = keyed.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(KEY_PARTS)).cast("int"))
    return rows.join(parts.hint("merge"), [*by, "_part"], how).drop("_part")


def lowest(keyed: DataFrame, by: list[str], rows: int, keys: int | None = None) -> DataFrame:
    """``(by.., id)``: the ``need`` lowest rows by (h, id) of every key of ``keyed(by.., id, h, need)``.

    ``h`` is text of evenly spread hex digits, ``need`` the same in all rows of a key, ``rows`` what a key may hold and
    ``keys`` how many keys there are at most, if known.
    Keys are not ranked whole. Rows are counted by the first digits of ``h``, and the counts tell in which range the
    last wanted row lies; that range is counted by the next digits, until ranges are small. All rows below the last
    range are in, and only the rows inside it are ranked. So no task holds a key, whatever it has or needs.
    """
    levels = max(0, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16**DIGITS)))
    cut = None
    for level in range(levels):
        length = DIGITS * level
        inside = keyed.withColumns({"_prefix": F.lit(""), "_left": F.col("need")}) if cut is None else _meet_cuts(keyed, cut, by, "inner", keys).where(F.substring("h", 1, length) == F.col("_prefix"))
        digits = F.substring("h", length + 1, DIGITS)
        counts = inside.groupBy(*by, "_prefix", "_left", digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_digits"))
        reached = counts.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_left"))
        last = F.min(F.struct("_digits", "_prefix", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"))).alias("_last")
        cut = reached.groupBy(*by).agg(last).select(*by, F.concat("_last._prefix", "_last._digits").alias("_prefix"), F.col("_last._left").alias("_left"))
    if cut is None:
        edge, below = keyed.withColumn("_left", F.col("need")), None
    else:
        # a key that has no more than it needs was never cut
        placed = _meet_cuts(keyed, cut, by, "left", keys).withColumn("_head", F.substring("h", 1, DIGITS * levels))
        below = placed.where(F.col("_prefix").isNull() | (F.col("_head") < F.col("_prefix"))).select(*by, "id")
        edge = placed.where(F.col("_head") == F.col("_prefix"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
    found = edge.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).select(*by, "id")
    return found if below is None else below.unionByName(found)
