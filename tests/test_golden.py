import pytest
from pyspark.sql import functions as F

from data import EXAMPLE_RESULTS, distance_matrix, example, items_table
from variform.operators import distance, diverse, metrics
from variform.plans.methods import Inputs
from variform.functions.columns import euclidean


@pytest.fixture(scope="module")
def items(spark):
    return items_table(spark, example()).cache()


def test_distances_of_all_forms(spark, items):
    vectors = example()
    ids = list(vectors)
    expected = distance_matrix(vectors)
    high = expected.max()
    low_high = distance.distance_range(items)
    assert low_high == pytest.approx((0.0, high), abs=1e-12)
    # column form over every pair of the small table
    a, b = items.select(F.col("id").alias("a"), F.col("x").alias("x")), items.select(F.col("id").alias("b"), F.col("x").alias("y"))
    columns = a.join(b, F.lit(True)).select("a", "b", distance.scaled(euclidean("x", "y"), *low_high).alias("d")).collect()
    assert len(columns) == 400
    for row in columns:
        assert row["d"] == pytest.approx(expected[ids.index(row["a"]), ids.index(row["b"])] / high, abs=1e-12)
    # blocked form over distinct vectors, every pair of items accounted for
    pairs = distance.all_pairs(items).collect()
    for row in pairs:
        assert row["d"] == pytest.approx(expected[ids.index(row["a"]), ids.index(row["b"])], abs=1e-9)
    n_distinct = len({tuple(v) for v in vectors.values()})
    assert len(pairs) == n_distinct * (n_distinct - 1) / 2


@pytest.mark.parametrize("method", ["maxsum", "maxmin"])
@pytest.mark.parametrize("copies", [False, True])
def test_greedy_picks(items, method, copies):
    pick = diverse.sample_maxsum if method == "maxsum" else diverse.sample_maxmin
    expected = next(r[-1] for r in EXAMPLE_RESULTS if r[0] == method)
    assert ",".join(sorted(r["id"] for r in pick(items, 5, copies=copies).collect())) == expected


def test_metrics_of_published_samples(spark, items):
    rows = [(r[0], 0, 5, i) for r in EXAMPLE_RESULTS for i in r[-1].split(",")]
    samples = spark.createDataFrame(rows, "method string, run int, k int, id string")
    found = metrics.evaluate(
        samples, items, distance.distance_range(items), fvo_mode="shared_positions", digits=None
    ).collect()
    assert len(found) == len(EXAMPLE_RESULTS)
    by_method = {r["method"]: r for r in found}
    for method, ent_with, ent_without, fvi, mpd, fvo, sample in EXAMPLE_RESULTS:
        row = by_method[method]
        assert row["sample"] == sample
        got = [row[c] for c in ("entropy_with_missing", "entropy_without_missing", "fvi", "mpd", "fvo")]
        assert got == pytest.approx([ent_with, ent_without, fvi, mpd, fvo], abs=1e-9)


def test_picks_from_a_relation_match_picks_from_vectors(items):
    profiles = items.groupBy("x").agg(F.min("id").alias("id"))
    relation = distance.symmetrize(distance.all_pairs(items), profiles)
    for objective, pick in (("maxsum", diverse.sample_maxsum), ("maxmin", diverse.sample_maxmin)):
        from_relation = [r["id"] for r in diverse.sample_from_distances(relation, 5, objective).collect()]
        assert from_relation == [r["id"] for r in pick(profiles, 5).collect()]


def test_own_method_and_unknown_method(spark, items):
    from variform.plans import methods

    def first_ids(inputs, draws):
        ranked = inputs.items.orderBy("id").limit(max(d.k for d in draws)).select("id")
        return ranked.select(F.lit("mine").alias("method"), F.lit(0).alias("run"), F.lit(draws[0].k).alias("k"), "id")

    methods.register("mine", first_ids)
    try:
        drawn = methods.draw(Inputs(items), ["mine", "unheard_of"], [methods.Draw(0, 3, 3)])
        assert sorted(r["id"] for r in drawn.collect()) == sorted(example())[:3]
    finally:
        del methods.METHODS["mine"]
    with pytest.raises(ValueError, match="Invalid value"):
        methods.draw(Inputs(items), ["unheard_of"], [methods.Draw(0, 3, 3)])
