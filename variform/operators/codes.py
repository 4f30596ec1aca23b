"""Translation between code systems through a taxonomy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_codes(taxonomy: DataFrame, code: str, target: str, order: str, keep: str = "first") -> DataFrame:
    """``(code, target)`` with one target per code: that of the first or last row in table order."""
    pick = F.min_by if keep == "first" else F.max_by
    known = taxonomy.where(F.col(code).isNotNull())
    return known.groupBy(F.col(code).alias("code")).agg(pick(target, order).alias("target"))


def map_codes(df: DataFrame, code: str, mapping: DataFrame, how: str = "left") -> DataFrame:
    """Add ``target`` for the code of each row; NULL where the mapping has none."""
    return df.join(mapping.withColumnRenamed("code", code), code, how)


def unmapped_codes(df: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """``(code, n)`` of codes without a target and the rows they cost."""
    lost = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return lost.join(mapping.withColumnRenamed("code", code), code, "left_anti").withColumnRenamed(code, "code")


def names(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add the taxonomy's name of each id."""
    return df.join(taxonomy.select("id", "name"), "id", "left")
