import pytest
from pyspark.sql import functions as F

from variform.operators import cleaning

ROWS = [
    ("a", "1", "2", "no_cov"),
    ("b", "?", "3", "1"),
    ("c", "0", "0", ""),
    ("d", "nan", None, "2"),
    ("e", "1", "7", "0"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, "id string, GB001 string, GB024 string, Q1 string")


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([("a", 0), ("b", 2), ("c", 0), ("e", 0)], "id string, child_language_count int")


def table(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_missing_tokens_become_null_and_never_nan(raw):
    clean = cleaning.clean_missing(raw, ["GB001", "GB024", "Q1"])
    assert table(clean) == {
        "a": (1.0, 2.0, None), "b": (None, 3.0, 1.0), "c": (0.0, 0.0, None), "d": (None, None, 2.0), "e": (1.0, 7.0, 0.0),
    }


def test_binarize_moves_split_features_to_the_end(raw):
    split = cleaning.binarize(cleaning.clean_missing(raw, ["GB001", "GB024", "Q1"]))
    assert split.columns == ["id", "GB001", "Q1", "GB024_1", "GB024_2"]
    flags = {k: v[2:] for k, v in table(split).items()}
    assert flags == {"a": (0.0, 1.0), "b": (1.0, 1.0), "c": (0.0, 0.0), "d": (None, None), "e": (0.0, 0.0)}


def test_selection(raw, spark):
    picked = cleaning.select_features(raw, ["Q1", "GB001"])
    assert picked.columns == ["id", "Q1", "GB001"]
    assert cleaning.feature_columns(raw, prefix="GB") == ["GB001", "GB024"]
    ids = spark.createDataFrame([("e",), ("b",), ("zz",)], "code string")
    assert set(table(cleaning.select_items(raw, ids))) == {"b", "e"}


def test_macro_items(raw, taxonomy):
    assert set(table(cleaning.drop_macro_items(raw, taxonomy))) == {"a", "c", "e"}
    assert set(table(cleaning.drop_macro_items(raw, taxonomy, on_unknown="keep"))) == {"a", "c", "d", "e"}
    with pytest.raises(KeyError):
        cleaning.drop_macro_items(raw, taxonomy, on_unknown="error")


@pytest.mark.parametrize("share,inclusive,kept", [(2 / 3, True, "abce"), (2 / 3, False, "e"), (None, False, "abcde"), (0, False, "abcde")])
def test_crop_is_strict_unless_told_otherwise(raw, share, inclusive, kept):
    clean = cleaning.clean_missing(raw, ["GB001", "GB024", "Q1"])
    assert set(table(cleaning.crop_coverage(clean, share, inclusive))) == set(kept)


def test_whole_chain_and_its_report(raw, taxonomy, spark):
    listed = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "id string")
    out = cleaning.prepare_features(raw, ["GB024", "GB001"], listed, ["GB024"], taxonomy, 0.5)
    assert table(out) == {"a": (1.0, 0.0, 1.0), "e": (1.0, 0.0, 0.0)}
    report = cleaning.cleaning_report(raw, ["GB024", "GB001"], listed, ["GB024"], taxonomy, 0.5)
    assert [tuple(r)[1:] for r in report.orderBy("step").collect()] == [
        (5, 3, 5, 2), (5, 2, 4, 2), (4, 2, 4, 3), (4, 3, 2, 3), (2, 3, 2, 3),
    ]


def test_report_names_the_steps_that_were_asked_for(raw, taxonomy):
    report = cleaning.cleaning_report(raw, multi_value=["GB024"], min_coverage=0.5)
    kept = cleaning.prepare_features(raw, multi_value=["GB024"], min_coverage=0.5).count()
    assert [tuple(r) for r in report.orderBy("step").collect()] == [("3 binarize", 5, 3, 5, 4), ("5 crop", 5, 4, kept, 4)]
    assert [tuple(r) for r in cleaning.cleaning_report(raw, taxonomy=taxonomy).collect()] == [("4 macro", 5, 3, 3, 3)]
    assert cleaning.cleaning_report(raw).collect() == []


def test_whole_number_columns_become_integers(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, None), (2, None, 1.0, None)], "id int, f double, g double, h double")
    types = dict(cleaning.integral_columns(df, ["f", "g", "h"]).dtypes)
    assert types == {"id": "int", "f": "bigint", "g": "double", "h": "bigint"}


def test_vector_and_long_forms_keep_feature_order(raw):
    clean = cleaning.clean_missing(raw, ["GB001", "GB024", "Q1"])
    features = ["Q1", "GB001"]
    assert table(cleaning.to_vector(clean, features))["b"] == ([1.0, None],)
    long = cleaning.to_long(clean, features).where(F.col("id") == "b").orderBy("pos").collect()
    assert [tuple(r) for r in long] == [("b", 0, "Q1", 1.0), ("b", 1, "GB001", None)]
