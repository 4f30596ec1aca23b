"""Cleaning of wide feature tables: one row per item, one column per feature, plus an id column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions.columns import clean_number

# features with values 0..3 in the default feature inventory (fixed values)
MULTI_VALUE_FEATURES = ("GB024", "GB025", "GB065", "GB130", "GB193", "GB203")


def feature_columns(df: DataFrame, id_col: str = "id", prefix: str | None = None) -> list[str]:
    """Feature names in table order, all but the id or those with a prefix."""
    return [c for c in df.columns if c != id_col and (prefix is None or c.startswith(prefix))]


def clean_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing tokens to NULL, everything else to DOUBLE."""
    return df.withColumns({f: clean_number(f) for f in features})


def select_features(df: DataFrame, features: Sequence[str], id_col: str = "id") -> DataFrame:
    """Keep the id and the listed features, in list order."""
    return df.select(id_col, *features)


def select_items(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the items listed in ``ids``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def binarize(df: DataFrame, features: Sequence[str] = MULTI_VALUE_FEATURES) -> DataFrame:
    """Split each multi-value feature that is present into two binary ones, placed at the end.

    1 sets the first, 2 the second, 3 both, anything else neither; missing stays missing.
    """
    present = sorted(set(features) & set(df.columns))
    added = []
    for f in present:
        for suffix, values in (("_1", (1.0, 3.0)), ("_2", (2.0, 3.0))):
            flag = F.when(F.col(f).isNull(), None).when(F.col(f).isin(*values), 1.0).otherwise(0.0)
            added.append(flag.alias(f + suffix))
    return df.select(*[c for c in df.columns if c not in present], *added)


def drop_macro_items(df: DataFrame, taxonomy: DataFrame, id_col: str = "id", on_unknown: str = "drop") -> DataFrame:
    """Keep items the taxonomy lists with no child; unknown items are dropped, kept or an error."""
    children = taxonomy.select(F.col("id").alias(id_col), "child_language_count")
    if on_unknown == "error" and not df.join(children, id_col, "left_anti").isEmpty():
        raise KeyError("items without a taxonomy entry")
    if on_unknown == "keep":
        return df.join(children.where("child_language_count > 0"), id_col, "left_anti")
    return df.join(children.where("child_language_count = 0"), id_col, "left_semi")


def coverage(features: Sequence[str]) -> Column:
    """Number of features with a value."""
    return sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))


def enough_coverage(features: Sequence[str], min_coverage: float, inclusive: bool = False) -> Column:
    bar = F.lit(min_coverage * len(features))
    return coverage(features) >= bar if inclusive else coverage(features) > bar


def crop_coverage(df: DataFrame, min_coverage: float | None, inclusive: bool = False, id_col: str = "id") -> DataFrame:
    """Keep items with values for more than (``inclusive``: at least) a share of the features."""
    if not min_coverage:
        return df
    return df.where(enough_coverage(feature_columns(df, id_col), min_coverage, inclusive))


def to_vector(df: DataFrame, features: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(id, x)`` with the features as one array in the given order."""
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))


def to_long(df: DataFrame, features: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(id, pos, feature, val)``, one row per item and feature, missing values included."""
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f).alias("val")) for i, f in enumerate(features)]
    return df.select(F.col(id_col).alias("id"), F.inline(F.array(*cells)))


def integral_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features whose every value is whole become BIGINT; one pass over the data decides."""
    whole = df.agg(*[F.coalesce(F.bool_and(F.col(f) == F.floor(f)), F.lit(True)).alias(f) for f in features]).first()
    return df.withColumns({f: F.col(f).cast("bigint") for f in features if whole[f]})


def prepare_features(
    df: DataFrame,
    features: Sequence[str] | None = None,
    items: DataFrame | None = None,
    multi_value: Sequence[str] | None = None,
    taxonomy: DataFrame | None = None,
    min_coverage: float | None = None,
    inclusive: bool = False,
    id_col: str = "id",
) -> DataFrame:
    """The cleaning chain in its fixed order; steps without an argument are skipped.

    Coverage is measured after binarizing, so a split feature counts twice.
    """
    features = list(features or feature_columns(df, id_col))
    out = clean_missing(select_features(df, features, id_col), features)
    if items is not None:
        out = select_items(out, items, id_col)
    if multi_value:
        out = binarize(out, multi_value)
    if taxonomy is not None:
        out = drop_macro_items(out, taxonomy, id_col)
    return crop_coverage(out, min_coverage, inclusive, id_col)


def cleaning_report(
    df: DataFrame,
    features: Sequence[str] | None = None,
    items: DataFrame | None = None,
    multi_value: Sequence[str] | None = None,
    taxonomy: DataFrame | None = None,
    min_coverage: float | None = None,
    inclusive: bool = False,
    id_col: str = "id",
) -> DataFrame:
    """``(step, rows_before, cols_before, rows_after, cols_after)`` of :func:`prepare_features`, in one pass.

    Steps without an argument are skipped there and have no row here.
    """
    chosen = list(features or feature_columns(df, id_col))
    flagged = clean_missing(select_features(df, chosen, id_col), chosen)
    if multi_value:
        flagged = binarize(flagged, multi_value)
    final = feature_columns(flagged, id_col)
    n_raw, n_in, n_out = len(feature_columns(df, id_col)), len(chosen), len(final)
    stays = F.lit(True)
    counts, steps, last, width = [F.count(F.lit(1)).alias("n0")], [], "n0", n_in

    def step(name: str, cols_after: int, keeps: Column | None = None) -> None:
        nonlocal stays, last, width
        before = last
        if keeps is not None:
            stays, last = stays & keeps, f"n{len(counts)}"
            counts.append(F.count_if(stays).alias(last))
        steps.append((name, before, n_raw if name == "1 features" else width, last, cols_after))
        width = cols_after

    if features:
        step("1 features", n_in)
    if items is not None:
        listed = items.select(F.col(items.columns[0]).alias(id_col)).distinct().withColumn("_listed", F.lit(True))
        flagged = flagged.join(listed, id_col, "left")
        step("2 items", n_in, F.col("_listed").isNotNull())
    if multi_value:
        step("3 binarize", n_out)
    if taxonomy is not None:
        leaf = taxonomy.where("child_language_count = 0").select(F.col("id").alias(id_col)).distinct().withColumn("_leaf", F.lit(True))
        flagged = flagged.join(leaf, id_col, "left")
        step("4 macro", width, F.col("_leaf").isNotNull())
    if min_coverage:
        step("5 crop", width, enough_coverage(final, min_coverage, inclusive))
    whole = flagged.agg(*counts)
    rows = [
        F.struct(
            F.lit(name).alias("step"),
            F.col(before).alias("rows_before"),
            F.lit(cols_before).cast("bigint").alias("cols_before"),
            F.col(after).alias("rows_after"),
            F.lit(cols_after).cast("bigint").alias("cols_after"),
        )
        for name, before, cols_before, after, cols_after in steps
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "step string, rows_before bigint, cols_before bigint, rows_after bigint, cols_after bigint")
    return whole.select(F.inline(F.array(*rows)))
