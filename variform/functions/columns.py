"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from variform.functions.kernels import EARTH_FLATTENING, EARTH_RADIUS_KM

# tokens that mean "missing" in feature files (fixed values)
MISSING_TOKENS = ("no_cov", "?", "nan", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: Column | str) -> Column:
    """A raw feature value as DOUBLE; missing tokens become NULL, any other text that is no number is an error."""
    c = _col(c).cast("string")
    number = c.try_cast("double")
    checked = F.when(number.isNull(), F.raise_error(F.concat(F.lit("no number and no missing token: "), c)).cast("double")).otherwise(number)
    return F.when(c.isNull() | F.trim(c).isin(*MISSING_TOKENS) | F.isnan(number), None).otherwise(checked)


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles as decimals of 15 digits after the point, so that the order of the rows does not change it."""
    return F.sum(_col(c).cast("decimal(38,15)")).cast("double")


def exact_mean(c: Column | str) -> Column:
    """Mean of the doubles that are not null, independent of the order of the rows."""
    return F.try_divide(exact_sum(c), F.count(_col(c)))


def shuffle_key(seed: Column, item: Column | str, salt: str | None = None) -> Column:
    """A reproducible random order: equal for equal seed and id, whatever the partitioning."""
    parts = [seed.cast("string"), *([F.lit(salt)] if salt else []), _col(item).cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def euclidean(x: Column | str, y: Column | str, missing: float = 0.0) -> Column:
    """Missing-aware Euclidean distance of two array columns."""
    x, y = _col(x), _col(y)
    squares = F.filter(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), lambda s: s.isNotNull())
    total = F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s)
    return F.coalesce(F.sqrt(F.try_divide(total * F.size(x), F.size(squares))), F.lit(missing))


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on the ellipsoid by Lambert's long-line formula; NULL if a coordinate is missing."""
    f = EARTH_FLATTENING
    b1 = F.atan((1 - f) * F.tan(F.radians(lat1)))
    b2 = F.atan((1 - f) * F.tan(F.radians(lat2)))
    half = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.least(F.greatest(half, F.lit(0.0)), F.lit(1.0))
    s = 2 * F.asin(F.sqrt(h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = F.try_divide((s - F.sin(s)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2), F.pow(F.cos(s / 2), 2))
    y = F.try_divide((s + F.sin(s)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(s / 2), 2))
    known = half.isNotNull()
    near_antipodal = EARTH_RADIUS_KM * s
    return F.when(
        known,
        F.when(h == 0, 0.0).when(h > 1 - 1e-6, near_antipodal).otherwise(EARTH_RADIUS_KM * (s - f / 2 * (x + y))),
    )


def words(c: Column | str) -> Column:
    """Number of whitespace-separated tokens of a text; 0 for an empty one."""
    return F.size(F.array_remove(F.split(_col(c), r"[ \t\r\n]+"), ""))
