import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import distance_matrix, greedy_picks, items_table, random_vectors
from variform.operators import diverse, greedy, pairwise


def picked(df):
    rows = sorted(df.collect(), key=lambda r: r["pick_order"])
    assert [r["pick_order"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["id"] for r in rows]


@pytest.mark.parametrize("objective", ["maxsum", "maxmin"])
@pytest.mark.parametrize("seed,values,missing", [(1, 2, 0.3), (2, 4, 0.0), (3, 3, 0.6)])
def test_matches_the_direct_loop_on_tied_categorical_data(spark, objective, seed, values, missing):
    vectors = random_vectors(70, 4, values, missing, seed)
    expected = greedy_picks(distance_matrix(vectors), 12, objective)
    pick = diverse.sample_maxsum if objective == "maxsum" else diverse.sample_maxmin
    items = items_table(spark, vectors)
    assert picked(pick(items, 12)) == expected
    assert picked(pick(items.repartition(5), 12, copies=True)) == expected


@pytest.mark.parametrize("objective", ["maxsum", "maxmin"])
def test_copies_may_be_picked_again_when_nothing_else_is_left(spark, objective):
    vectors = {i: [float(i % 3), 1.0] for i in range(12)}
    expected = greedy_picks(distance_matrix(vectors), 7, objective)
    pick = diverse.sample_maxsum if objective == "maxsum" else diverse.sample_maxmin
    assert picked(pick(items_table(spark, vectors), 7, copies=True)) == expected


def test_many_partitions_and_long_chains_settle_the_same_picks(spark):
    rng = np.random.default_rng(5)
    vectors = {int(i): [float(v) for v in row] for i, row in enumerate(rng.normal(size=(300, 6)))}
    expected = greedy_picks(distance_matrix(vectors), 40, "maxmin")
    items = items_table(spark, vectors)
    assert picked(diverse.sample_maxmin(items.repartition(7), 40)) == expected
    assert picked(diverse.sample_maxmin(items.coalesce(1), 40))[:15] == expected[:15]


@pytest.mark.parametrize("objective", ["maxsum", "maxmin"])
@pytest.mark.parametrize("missing", [0.0, 0.4])
def test_running_scores_settle_the_same_picks(spark, monkeypatch, objective, missing):
    """Scores are written every few picks, and items that cannot win are left out."""
    monkeypatch.setattr(greedy, "RESTAGE", 6)
    monkeypatch.setattr(greedy, "KEEP", 5)
    monkeypatch.setattr(greedy, "POOL", 24)
    left_out, possible = [], greedy._possible

    def watched(items, *args):
        out = possible(items, *args)
        left_out.append(items.count() - out.count())
        return out

    monkeypatch.setattr(greedy, "_possible", watched)
    vectors = random_vectors(150, 5, 4, missing, 21)
    if not missing:  # an outlier group, so that sums part early
        vectors |= {200 + i: [v + (40.0 if i % 2 else 0.0) for v in vectors[i]] for i in range(20)}
    ids = list(vectors)
    expected = [ids[i] for i in greedy_picks(distance_matrix(vectors), 30, objective)]
    pick = diverse.sample_maxsum if objective == "maxsum" else diverse.sample_maxmin
    assert picked(pick(items_table(spark, vectors).repartition(4), 30)) == expected
    assert objective == "maxsum" or max(left_out) > 0


@pytest.mark.parametrize("band", [2, 16])
@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_first_pick_by_bands_of_the_highest_bounds(spark, monkeypatch, band, missing):
    vectors = random_vectors(200, 6, 5, missing, 8)
    expected = greedy_picks(distance_matrix(vectors), 1, "maxsum")[0]
    monkeypatch.setattr(greedy, "FIRST_BAND", band)
    monkeypatch.setattr(greedy, "LARGEST_BAND", 4 * band)
    items = items_table(spark, vectors).withColumn("pos", F.col("id")).withColumn("w", F.lit(1))
    assert greedy.first_pick(items.repartition(3)).id == expected
    monkeypatch.setattr(greedy, "SECOND_ORDER", 0)
    assert greedy.first_pick(items).id == expected


@pytest.mark.parametrize("missing", [0.0, 0.4, 0.8])
def test_bound_is_above_the_mean_distance(spark, monkeypatch, missing):
    vectors = random_vectors(80, 5, 4, missing, 11)
    items = items_table(spark, vectors).withColumn("w", F.lit(1))
    x = np.array([[np.nan if v is None else v for v in row] for row in vectors.values()])
    mean = distance_matrix(vectors).mean(axis=1)
    both = greedy._mean_bound(greedy._moments(items.repartition(3)), x)
    monkeypatch.setattr(greedy, "SECOND_ORDER", 0)
    one = greedy._mean_bound(greedy._moments(items), x)
    assert (both >= mean).all() and (one >= mean).all() and both.mean() <= one.mean() + 1e-12


def test_first_pick_of_gappy_features_settles_early(spark, monkeypatch):
    """As many missing-value patterns as items: the bound needs no table of them."""
    rng = np.random.default_rng(9)
    rate = rng.uniform(0.1, 0.5, 60)
    x = (rng.random((6000, 60)) < rate).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, i, [None if np.isnan(v) else float(v) for v in row], 1) for i, row in enumerate(x)]
    items = spark.createDataFrame(rows, "id bigint, pos bigint, x array<double>, w int").repartition(4).cache()
    summed, means = [], greedy._mean_distances
    monkeypatch.setattr(greedy, "_mean_distances", lambda v, band, m: summed.append(len(band)) or means(v, band, m))
    found = greedy.first_pick(items)
    sums = pairwise.row_sums(items).orderBy(F.desc("sum_d"), "id").first()
    assert found.id == sums["id"] and sum(summed) < 3000


def weighed(spark, x, w):
    rows = [(i, i, [None if np.isnan(v) else float(v) for v in row], int(n)) for i, (row, n) in enumerate(zip(x, w))]
    return spark.createDataFrame(rows, "id bigint, pos bigint, x array<double>, w int")


def test_first_pick_of_complete_features_settles_early(spark, monkeypatch):
    """Directions without structure are almost equally far from all others: squares alone leave every item in the race."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    items = weighed(spark, x, rng.integers(1, 4, len(x))).repartition(4).cache()
    summed, means = [], greedy._mean_distances
    monkeypatch.setattr(greedy, "_mean_distances", lambda v, band, m: summed.append(len(band)) or means(v, band, m))
    found = greedy.first_pick(items)
    sums = pairwise.row_sums(items).orderBy(F.desc("sum_d"), "id").first()
    assert found.id == sums["id"] and sum(summed) < 1000


@pytest.mark.parametrize("data", ["spread", "shifted", "outliers", "values", "gaps", "copies"])
def test_cubic_bound_is_above_the_mean_distance(spark, data):
    rng = np.random.default_rng(23)
    x, w = rng.normal(size=(150, 6)), rng.integers(1, 5, 150)
    if data == "shifted":
        x += 1e4
    elif data == "outliers":
        x[:3] *= 1e4
    elif data == "values":
        x = np.round(x)
    elif data == "gaps":
        x[rng.random(x.shape) < 0.1] = np.nan
    elif data == "copies":
        x[5:] = x[0]
    items = weighed(spark, x, w).repartition(3)
    moments = greedy._moments(items)
    plain = greedy._mean_bound(moments, x)
    cubic = greedy._mean_bound(moments, x, greedy._cubic(items, moments[-1]))
    d = distance_matrix({i: [None if np.isnan(v) else v for v in row] for i, row in enumerate(x)})
    mean = d @ w / w.sum()
    assert (cubic >= mean).all() and (cubic <= plain).all()
    assert data not in ("spread", "gaps") or (cubic - mean).sum() < 0.9 * (plain - mean).sum()


def test_frame_order_decides_ties(spark):
    vectors = {"a": [0.0], "b": [1.0], "c": [0.0], "d": [1.0]}
    items = items_table(spark, vectors)
    frame = spark.createDataFrame([("d", 0), ("c", 1), ("b", 2), ("a", 3)], "id string, pos int")
    assert picked(diverse.sample_maxsum(items, 2, frame)) == ["d", "c"]
    assert picked(diverse.sample_maxsum(items, 2)) == ["a", "b"]
    assert picked(diverse.sample_maxmin(items, 2, frame.where("id <> 'c'"))) == ["a", "d"]


def test_prefix_of_a_longer_run(spark):
    items = items_table(spark, random_vectors(50, 5, 4, 0.2, 4))
    long = picked(diverse.sample_maxsum(items, 9))
    assert picked(diverse.sample_maxsum(items, 4)) == long[:4]
    table = diverse.sample_maxsum(items, 9)
    sizes = {r["k"]: r["n"] for r in diverse.prefixes(table, "maxsum", [2, 5, 9]).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert sizes == {2: 2, 5: 5, 9: 9}


def test_expand_never_repeats_a_chosen_item(spark):
    vectors = random_vectors(60, 5, 4, 0.2, 6)
    d = distance_matrix(vectors)
    chosen = [3, 10, 20]
    picks = list(chosen)
    while len(picks) < 8:
        score = np.round(d[picks].sum(axis=0), 9)
        score[picks] = -1
        picks.append(int(score.argmax()))
    ids = spark.createDataFrame([(i,) for i in chosen], "id bigint")
    assert picked(diverse.expand_sample(items_table(spark, vectors), ids, 5)) == picks[3:]


def test_geodesic_metric(spark):
    places = {0: [0.0, 0.0], 1: [0.0, 90.0], 2: [45.0, 10.0], 3: [None, None], 4: [-60.0, -120.0]}
    found = picked(diverse.sample_maxmin(items_table(spark, places), 3, metric="geodesic"))
    assert len(set(found)) == 3 and 3 not in found


@pytest.mark.parametrize("k", [0, 6])
def test_impossible_sizes(spark, k):
    items = items_table(spark, random_vectors(5, 3, 3, 0.0, 1))
    with pytest.raises(ValueError, match="Invalid value"):
        diverse.sample_maxsum(items, k)
    relation = pairwise.pair_relation(items.withColumn("w", F.lit(1)))
    with pytest.raises(ValueError, match="Invalid value"):
        diverse.sample_from_distances(relation.select("a", "b", "d").union(relation.select("b", "a", "d")), k, "maxmin")


def test_bands_bring_no_vectors_of_every_task_to_the_driver(spark, monkeypatch):
    vectors = random_vectors(120, 6, 5, 0.2, 13)
    items = items_table(spark, vectors).withColumn("pos", F.col("id")).withColumn("w", F.lit(1)).repartition(6)
    plans, collect = [], type(items).collect
    monkeypatch.setattr(type(items), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    monkeypatch.setattr(greedy, "FIRST_BAND", 2)
    monkeypatch.setattr(greedy, "LARGEST_BAND", 8)
    assert greedy.first_pick(items).id == greedy_picks(distance_matrix(vectors), 1, "maxsum")[0]
    tops = [line for plan in plans for line in plan.splitlines() if "TakeOrderedAndProject" in line]
    assert tops and not any(re.search(r"\bx#", line) for line in tops)


def test_equal_bounds_are_dealt_by_place(spark, monkeypatch):
    """The corners of a square have one bound; each is in one band, and the first of them wins."""
    corners = [(i, 9 - i, [float(i % 2), float(i // 2)], 1) for i in range(4)]
    items = spark.createDataFrame(corners, "id bigint, pos bigint, x array<double>, w int")
    seen, means = [], greedy._mean_distances
    monkeypatch.setattr(greedy, "_mean_distances", lambda v, band, m: seen.extend(p.id for p in band) or means(v, band, m))
    monkeypatch.setattr(greedy, "FIRST_BAND", 1)
    monkeypatch.setattr(greedy, "LARGEST_BAND", 1)
    assert greedy.first_pick(items).id == 3 and seen == [3, 2, 1, 0]
