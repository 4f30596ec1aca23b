"""Ids without features, empty cells and unreadable text: nothing is lost without a message."""

import pytest

from data import items_table
from variform.functions.columns import clean_number
from variform.operators import diverse, groups, metrics, sampling
from variform.operators.greedy import first_of_ties
from variform.operators.sampling import Draw
from variform.plans.methods import Inputs
from variform.plans.sweep import sweep

VECTORS = {i: [float(i), float(i % 3), None if i % 4 else 1.0] for i in range(1, 7)}


def test_methods_draw_only_items_with_features(spark):
    items = items_table(spark, VECTORS)
    wide = spark.createDataFrame([(i, f"g{i % 9}") for i in range(1, 41)], "id int, group string")
    counts = spark.createDataFrame([(i, 100 + i) for i in range(1, 41)], "id int, n int")
    inputs = Inputs(items, families=wide, genera=wide, counts=counts)
    rows = sweep(inputs, [4], 2, ["random_family", "random_genus", "convenience", "random"]).collect()
    assert len(rows) == 8 and all(len(r["sample"].split(",")) == 4 for r in rows)


def test_unknown_ids_are_errors(spark):
    items = items_table(spark, VECTORS)
    drawn = sampling.random_draws(spark.createDataFrame([(i,) for i in (1, 2, 99)], "id int"), [Draw(0, 3, 0)])
    with pytest.raises(KeyError, match="99"):
        metrics.evaluate(drawn, items)
    with pytest.raises(KeyError, match="98"):
        diverse.expand_sample(items, spark.createDataFrame([(1,), (98,)], "id int"), 1)
    dist = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5)], "a int, b int, d double")
    with pytest.raises(KeyError, match="99"):
        metrics.relation_mpd(drawn.select("run", "id"), dist, "run")


def test_the_sample_may_lie_outside_the_frame(spark):
    items = items_table(spark, {1: [0.0], 2: [1.0], 3: [5.0], 4: [9.0]})
    frame = spark.createDataFrame([(2, 1), (3, 0)], "id int, pos int")
    chosen = spark.createDataFrame([(1,), (4,)], "id int")
    grown = diverse.expand_sample(items, chosen, 2, frame).orderBy("pick_order").collect()
    # 2 is at 1 + 8 and 3 at 5 + 4 from the sample: a tie, which the frame's order settles
    assert [r["id"] for r in grown] == [3, 2]
    far = spark.createDataFrame([(4,)], "id int")
    assert [r["id"] for r in diverse.expand_sample(items, far, 1, frame).collect()] == [2]


def test_empty_cells_match_nothing_and_empty_groups_stay(spark):
    items = spark.createDataFrame([("a", "g", None, "1"), ("b", "g", None, "2")], "id string, fam string, f string, h string")
    known = spark.createDataFrame([("x", "g"), ("y", "lonely"), ("z", None)], "id string, fam string")
    found = {r["group"]: r for r in groups.group_feature_overlap(items, ["f", "h"], "fam", "family", known).collect()}
    assert found["g"]["avg_overlap"] == 0.0 and found["g"]["n_members"] == 2
    assert found["lonely"]["avg_overlap"] == 0.0 and found["lonely"]["n_members"] == 0 and len(found) == 2


def test_unreadable_text_is_an_error(spark):
    rows = spark.createDataFrame([("1",), ("?",), (" no_cov ",), (None,), ("nan",)], "v string")
    assert [r["n"] for r in rows.select(clean_number("v").alias("n")).collect()] == [1.0, None, None, None, None]
    with pytest.raises(Exception, match="three"):
        spark.createDataFrame([("three",)], "v string").select(clean_number("v").alias("n")).collect()


def test_ties_do_not_depend_on_the_size_of_the_table(spark):
    rows = spark.createDataFrame([(1, 100_000_000_002.5), (2, 100_000_000_003.5)], "pos int, s double")
    assert first_of_ties(rows, "s", "pos")["pos"] == 2
    rows = spark.createDataFrame([(2, 0.1 + 0.2), (1, 0.3)], "pos int, s double")
    assert first_of_ties(rows, "s", "pos")["pos"] == 1
    assert first_of_ties(rows.limit(0), "s", "pos") is None
