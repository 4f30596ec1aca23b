import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import distance_matrix, entropy, items_table, overlap, random_vectors
from variform.functions import kernels
from variform.operators import distance, metrics, reports, sampling
from variform.plans.methods import Inputs
from variform.session import stage


def test_against_direct_loops(spark):
    vectors = random_vectors(40, 6, 3, 0.3, 9)
    d = distance_matrix(vectors)
    samples = {0: [1, 5, 9, 20], 1: [2, 3], 2: list(range(25))}
    rows = [("m", run, len(ids), i) for run, ids in samples.items() for i in ids]
    table = spark.createDataFrame(rows, "method string, run int, k int, id bigint")
    items = items_table(spark, vectors)
    whole = distance.distance_range(items)
    for mode in metrics.FVO_MODES:
        found = {r["run"]: r for r in metrics.evaluate(table, items, whole, fvo_mode=mode).collect()}
        for run, ids in samples.items():
            x = [vectors[i] for i in ids]
            assert found[run]["fvo"] == pytest.approx(overlap(x, mode), abs=1e-9)
            mean = sum(d[a, b] for a, b in itertools.combinations(ids, 2)) / (len(ids) * (len(ids) - 1) / 2)
            assert found[run]["mpd"] == pytest.approx(mean / d.max(), abs=1e-9)
            columns = list(zip(*x))
            known = [[v for v in c if v is not None] for c in columns]
            assert found[run]["entropy_with_missing"] == pytest.approx(sum(map(entropy, map(list, columns))) / 6, abs=1e-9)
            assert found[run]["entropy_without_missing"] == pytest.approx(sum(entropy(c) if c else 0 for c in known) / 6, abs=1e-9)
            assert found[run]["fvi"] == pytest.approx(sum(len(set(c)) / 2 for c in known) / 6, abs=1e-12)
            assert found[run]["sample"] == ",".join(map(str, sorted(ids)))


def test_samples_without_a_usable_pair_score_null(spark):
    items = items_table(spark, {1: [1.0, None], 2: [None, 1.0], 3: [1.0, 1.0]})
    table = spark.createDataFrame([("a", 0, 1, 3), ("b", 0, 2, 1), ("b", 0, 2, 2)], "method string, run int, k int, id bigint")
    found = {r["method"]: r for r in metrics.evaluate(table, items).collect()}
    assert found["a"]["mpd"] is None and found["a"]["fvo"] is None and found["a"]["entropy_with_missing"] == 0
    assert found["b"]["mpd"] == 0.0 and found["b"]["fvo"] is None


def test_sample_order_and_partitions_do_not_matter(spark):
    vectors = random_vectors(30, 4, 3, 0.2, 2)
    items = items_table(spark, vectors)
    rows = [("m", 0, 10, i) for i in range(10)]
    schema = "method string, run int, k int, id bigint"
    one = metrics.evaluate(spark.createDataFrame(rows, schema), items).first()
    two = metrics.evaluate(spark.createDataFrame(rows[::-1], schema).repartition(5), items.repartition(6)).first()
    assert one["sample"] == two["sample"]
    for c in metrics.METRICS:
        assert one[c] == pytest.approx(two[c], abs=1e-12)


def test_relation_mpd_matches_vectors(spark):
    vectors = {i: v for i, v in random_vectors(25, 8, 4, 0.1, 12).items()}
    items = items_table(spark, vectors)
    relation = distance.symmetrize(distance.all_pairs(items))
    samples = spark.createDataFrame([("s", i) for i in (1, 4, 7, 9)], "run string, id bigint")
    d = distance_matrix(vectors)
    expected = sum(d[a, b] for a, b in itertools.combinations((1, 4, 7, 9), 2)) / 6
    assert metrics.relation_mpd(samples, relation, "run").first()["mpd"] == pytest.approx(expected, abs=1e-9)


def test_summary_has_no_deviation_for_deterministic_methods(spark):
    rows = [("maxsum", 0, 5, 0.5), ("random", 0, 5, 0.2), ("random", 1, 5, 0.4)]
    results = spark.createDataFrame(rows, "method string, run int, k int, mpd double")
    found = {r["method"]: r for r in reports.summarize_runs(results, metrics=["mpd"]).collect()}
    assert found["maxsum"]["mpd_std"] is None and found["maxsum"]["mpd_mean"] == 0.5
    assert found["random"]["mpd_mean"] == pytest.approx(0.3) and found["random"]["mpd_std"] == pytest.approx(0.02**0.5)


def test_running_overlap(spark):
    from variform.operators import cleaning

    wide = spark.createDataFrame([(1, 1.0, None, 0.0), (2, 1.0, 1.0, 1.0)], "id int, f double, g double, h double")
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    rows = distance.running_overlap(pairs, cleaning.to_vector(wide, ["f", "g", "h"])).orderBy("pos").collect()
    assert [(r["pos"], r["overlap"]) for r in rows] == [(0, 1.0), (1, 1.0), (2, 0.5)]


def test_equal_bit_for_bit_under_any_partitioning(spark):
    vectors = random_vectors(60, 7, 3, 0.2, 11)
    items = items_table(spark, {i: [None if v is None else v / 3 for v in x] for i, x in vectors.items()})
    rows = [("m", run, 40, (i * 7 + run) % 60) for run in range(3) for i in range(40)]
    schema = "method string, run int, k int, id bigint"
    found = []
    for parts in (1, 3, 11):
        table = spark.createDataFrame(rows[:: -1 if parts == 3 else 1], schema).repartition(parts)
        scores = [metrics.evaluate(table, items.repartition(parts), fvo_mode=mode) for mode in metrics.FVO_MODES]
        found.append([sorted(map(tuple, s.collect())) for s in scores])
        found[-1].append(sorted(map(tuple, distance.row_sums(items.repartition(parts)).collect())))
    assert found[0] == found[1] == found[2]


def test_overlap_is_the_double_next_to_the_exact_value(spark):
    """Four items, each pair a ratio of eighths or so: the mean is a number that decimals write exactly."""
    vectors = random_vectors(30, 8, 2, 0.3, 5)
    items = items_table(spark, vectors)
    drawn = items.withColumn("g", F.col("id") % 4)
    for row in metrics.feature_value_overlap(drawn, "g").where("mode = 'every_position'").collect():
        ratios = []
        for a, b in itertools.combinations([v for i, v in vectors.items() if i % 4 == row["g"]], 2):
            same = total = 0
            for x, y in zip(a, b):
                total += x is not None and y is not None
                same += x is not None and x == y
                ratios += [Fraction(same, total)] if total else []
        assert row["fvo"] == float(sum(ratios) / len(ratios))


@pytest.mark.parametrize("diagonal", [True, False])
def test_weights_of_any_size_are_counted_exactly(diagonal):
    rng = np.random.default_rng(3)
    w = np.array([1.0, 2.0, 3.0, 2.0**31 + 7, 2.0**40, 12345.0])
    v = w if diagonal else w[::-1] + 1
    parts = kernels.weight_parts(w, v, diagonal)
    cells = [[sum(int(part[i, j]) << shift for shift, part in parts) for j in range(6)] for i in range(6)]
    for i, j in itertools.product(range(6), repeat=2):
        a, b = int(w[i]), int(v[j])
        assert cells[i][j] == ((a * (a - 1) // 2 if i == j else a * b if j > i else 0) if diagonal else a * b)
    x = rng.integers(0, 2, (6, 5)).astype(float)
    x[rng.random((6, 5)) < 0.2] = np.nan
    y = x if diagonal else x[::-1]
    found = {m: (Fraction(0), 0) for m in metrics.FVO_MODES}
    for mode, shared, equal, n in kernels.overlap_counts(x, y, parts):
        found[mode] = (found[mode][0] + Fraction(equal, shared), found[mode][1] + n)
    want = (Fraction(0), 0)
    for i, j in itertools.product(range(6), repeat=2):
        same = total = 0
        for p, q in zip(x[i], y[j]):
            total += not (np.isnan(p) or np.isnan(q))
            same += p == q
            if total:
                want = (want[0] + Fraction(cells[i][j] * int(same), int(total)), want[1] + cells[i][j])
    assert found["every_position"] == want


def test_items_are_merged_by_id_and_never_broadcast(spark, monkeypatch):
    """The estimate of a table says little of its size, so a small one must be merged too."""
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(metrics, "stage", watched)
    monkeypatch.setattr(sampling, "stage", watched)
    items = spark.range(9).select("id", F.array((F.col("id") % 3).cast("double"), F.col("id").cast("double")).alias("x"))
    groups = spark.range(20).select("id", F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("group"))
    drawn = sampling.random_draws(items.select("id"), [sampling.Draw(0, 3, 1)])
    assert metrics.evaluate(drawn, items).count() == 1
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    counts = groups.groupBy("id").count().withColumnRenamed("count", "n")
    assert sampling.convenience_draws(items.select("id"), counts, [sampling.Draw(0, 3, 1)]).count() == 3
    assert "SortMergeJoin" in plans[-1] and "BroadcastHashJoin" not in plans[-1]
    framed = Inputs(items, families=groups).framed(groups)
    assert framed.count() == 9 and "SortMergeJoin" in framed._jdf.queryExecution().executedPlan().toString()
