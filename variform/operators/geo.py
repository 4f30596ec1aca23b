"""Geographic distances between items with coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variform.functions.columns import geodesic
from variform.operators import distance


def positions(items: DataFrame) -> DataFrame:
    """``(id, x)`` with x = (latitude, longitude); both missing if either is."""
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lat, lon = (F.when(known, F.col(c).cast("double")) for c in ("latitude", "longitude"))
    return items.select("id", F.array(lat, lon).alias("x"))


def geo_distances(items: DataFrame) -> DataFrame:
    """``(a, b, d, n_a, n_b)``: kilometres between distinct places; 0 where a coordinate is missing."""
    return distance.all_pairs(positions(items), "geodesic")


def pair_kilometres(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Kilometres of each given pair ``(a, b)``; 0 where a coordinate is missing."""
    a, b = (
        items.select(F.col("id").alias(c), F.col("latitude").alias(f"lat_{c}"), F.col("longitude").alias(f"lon_{c}")) for c in "ab"
    )
    km = geodesic(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.withColumn("d", F.coalesce(km, F.lit(0.0))).drop("lat_a", "lon_a", "lat_b", "lon_b")
