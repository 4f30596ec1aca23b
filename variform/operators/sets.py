"""Frames as sets of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(frame: DataFrame) -> DataFrame:
    return frame.select(F.col(frame.columns[0]).alias("id"))


def intersect(*frames: DataFrame) -> DataFrame:
    """Ids present in every frame."""
    return reduce(lambda a, b: a.intersect(b), map(_ids, frames))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return _ids(left).subtract(_ids(right))


def union(*frames: DataFrame) -> DataFrame:
    """Ids present in any frame, once each."""
    return reduce(lambda a, b: a.union(b), map(_ids, frames)).distinct()


def union_tagged(tag: str, **frames: DataFrame) -> DataFrame:
    """All rows of all tables, with the name of the table each came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dataset_coverage(dataset: DataFrame, items: DataFrame) -> DataFrame:
    """One row ``(n_dataset, n_covered)``: distinct ids of a dataset and how many have features."""
    known = _ids(items).distinct().withColumn("_known", F.lit(True))
    return _ids(dataset).distinct().join(known, "id", "left").agg(
        F.count(F.lit(1)).alias("n_dataset"), F.count("_known").alias("n_covered")
    )


def duplicates(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, n)`` of every id that occurs more than once."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_known(df: DataFrame, known: DataFrame, what: str, id_col: str = "id") -> None:
    """An error naming some ids that the other table does not have."""
    unknown = df.select(F.col(id_col).alias("id")).join(_ids(known), "id", "left_anti").distinct().take(5)
    if unknown:
        raise KeyError(f"not in {what}: {[r['id'] for r in unknown]}")


def assert_unique(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The table itself, or an error naming some duplicated ids."""
    found = duplicates(df, id_col).take(5)
    if found:
        raise ValueError(f"duplicate ids: {[r['id'] for r in found]}")
    return df
