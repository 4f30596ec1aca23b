import numpy as np
import pytest
from pyspark.sql import functions as F

from data import distance_matrix, items_table, overlap, random_vectors
from variform.operators import distance, groups, pairwise
from variform.operators.profiles import collapse, members

VECTORS = random_vectors(60, 5, 3, 0.25, 3) | {100 + i: [1.0, None, 0.0, 2.0, 1.0] for i in range(30)}
IDS = list(VECTORS)
D = distance_matrix(VECTORS)


@pytest.fixture(scope="module")
def items(spark):
    return items_table(spark, VECTORS).cache()


@pytest.fixture(scope="module")
def profiles(items):
    return collapse(items).cache()


@pytest.mark.parametrize("block_rows,tile_rows", [(4, 1024), (17, 5), (None, 7), (None, 1024)])
def test_row_sums_and_extremes(items, profiles, monkeypatch, block_rows, tile_rows):
    monkeypatch.setattr(pairwise, "TILE_ROWS", tile_rows)
    for r in pairwise.row_sums(profiles, block_rows=block_rows).collect():
        assert r["sum_d"] == pytest.approx(D[IDS.index(r["id"])].sum(), abs=1e-9)
    row = pairwise.pair_extremes(profiles, block_rows=block_rows).first()
    assert (row["min_d"], row["max_d"]) == pytest.approx((0.0, D.max()), abs=1e-12)


@pytest.mark.parametrize("block_rows,tile_rows", [(4, 1024), (20, 3), (1024, 10)])
def test_every_pair_once(profiles, monkeypatch, block_rows, tile_rows):
    monkeypatch.setattr(pairwise, "TILE_ROWS", tile_rows)
    rows = pairwise.pair_relation(profiles, block_rows=block_rows).collect()
    assert len({(r["a"], r["b"]) for r in rows}) == len(rows) == profiles.count() * (profiles.count() - 1) // 2
    for r in rows:
        assert r["a"] < r["b"] and r["d"] == pytest.approx(D[IDS.index(r["a"]), IDS.index(r["b"])], abs=1e-9)
    weights = {r["id"]: r["w"] for r in profiles.collect()}
    assert all((r["n_a"], r["n_b"]) == (weights[r["a"]], weights[r["b"]]) for r in rows)


@pytest.mark.parametrize("block_rows", [5, 1024])
def test_group_totals_with_a_hot_group_of_copies(items, block_rows):
    """A third of the rows are copies of one vector in one group."""
    grouped = items.withColumn("g", F.when(F.col("id") >= 100, 0).otherwise(F.col("id") % 4))
    found = pairwise.pair_statistics(collapse(grouped, "g"), "g", block_rows=block_rows).collect()
    for g in range(4):
        inside = [i for i in IDS if (0 if i >= 100 else i % 4) == g]
        at = [IDS.index(i) for i in inside]
        n = len(at)
        expected = {"distance": D[np.ix_(at, at)].sum() / 2 / (n * (n - 1) / 2)}
        expected |= {m: overlap([VECTORS[i] for i in inside], m) for m in ("every_position", "shared_positions", "pair_mean")}
        got = {r["stat"]: r["total"] / r["n"] for r in found if r["g"] == g}
        assert got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("block_rows,tile_rows", [(5, 1024), (30, 4), (1024, 1024)])
def test_nearest_edges_with_ties(profiles, monkeypatch, block_rows, tile_rows):
    monkeypatch.setattr(pairwise, "TILE_ROWS", tile_rows)
    edges = {(r["a"], r["b"]) for r in pairwise.nearest_edges(profiles, block_rows=block_rows).collect()}
    ids = [r["id"] for r in profiles.collect()]
    expected = set()
    for a in ids:
        row = {b: round(D[IDS.index(a), IDS.index(b)], 9) for b in ids}
        positive = [v for v in row.values() if v > 0]
        if positive:
            expected |= {(a, b) for b, v in row.items() if v == min(positive)}
    assert edges == expected


@pytest.mark.parametrize("how", ["sum", "min"])
def test_distance_to_a_set_sent_along_or_met_in_blocks(items, how):
    chosen = items.where("id % 7 = 0")
    at = [i for i, v in enumerate(IDS) if v % 7 == 0]
    expected = D[at].sum(axis=0) if how == "sum" else D[at].min(axis=0)
    for limit in (1024, 3):
        for r in pairwise.score_against(items, chosen, how, limit=limit, block_rows=7).collect():
            assert r["score"] == pytest.approx(expected[IDS.index(r["id"])], abs=1e-9)


def test_larger_tables_get_larger_blocks_within_their_memory(spark):
    cases = [(1, 64), (1024, 64), (60_000, 64), (1_000_000, 64), (100_000_000, 64), (100_000_000, 201), (10_000, 100_000)]
    rows = spark.createDataFrame(cases, "n long, width int")
    found = [r[0] for r in rows.select(pairwise.n_blocks(F.col("n"), F.col("width"), None)).collect()]
    assert found == [1, 1, 59, 62, 1526, 4883, 10]


def test_members_lead_back_to_all_items(items, profiles):
    back = members(items, profiles).collect()
    assert sorted(r["id"] for r in back) == sorted(IDS)
    assert all(VECTORS[r["id"]] == VECTORS[r["profile"]] for r in back)


def test_purity_counts_pairs_of_items(items):
    grouped = items.withColumn("g", F.when(F.col("id") % 5 != 0, F.col("id") % 3))
    group = {i: None if i % 5 == 0 else i % 3 for i in IDS}
    inside = outside = 0
    for a, row in enumerate(np.round(D, 9)):
        positive = row[row > 0]
        for b in np.flatnonzero(row == positive.min()) if len(positive) else ():
            same = group[IDS[a]] == group[IDS[b]]
            inside, outside = inside + same, outside + (not same)
    found = groups.neighbour_group_purity(grouped, "g").first()
    assert (found["in_group"], found["out_group"], found["total"]) == (inside, outside, inside + outside)


def test_relation_helpers(spark, items):
    relation = distance.all_pairs(items)
    ids = collapse(items).select("id")
    both = distance.symmetrize(relation, ids).cache()
    n = ids.count()
    assert both.count() == n * n
    wide = distance.to_wide(both, sorted(r["id"] for r in ids.collect()))
    assert wide.count() == n and len(wide.columns) == n + 1
    back = distance.from_wide(wide).withColumn("b", F.col("b").cast("bigint"))
    assert back.exceptAll(both.select("a", "b", "d")).isEmpty()
    scaled = distance.normalize(both).agg(F.min("d"), F.max("d")).first()
    assert tuple(scaled) == (0.0, 1.0)
    sums = {r["id"]: r["sum_d"] for r in distance.relation_row_sums(both).collect()}
    kept = [IDS.index(i) for i in sums]
    assert sums == pytest.approx({IDS[i]: D[i, kept].sum() for i in kept}, abs=1e-9)
    frame = ids.limit(3).withColumn("pos", F.col("id"))
    assert distance.sub_distances(both, frame).count() == 9
    pairs = spark.createDataFrame([(3, 8), (5, 100)], "a bigint, b bigint")
    for r in distance.pair_distances(pairs, items).collect():
        assert r["d"] == pytest.approx(D[IDS.index(r["a"]), IDS.index(r["b"])], abs=1e-12)
    unknown = spark.createDataFrame([(-1, 0)], "id bigint, pos int")
    with pytest.raises(KeyError):
        distance.sub_distances(both, unknown)


def test_equal_distances_cannot_be_scaled(spark):
    same = items_table(spark, {1: [1.0], 2: [1.0]})
    low, high = distance.distance_range(same)
    assert (low, high) == (0.0, 0.0)
    flat = spark.createDataFrame([(1, 2, 0.0)], "a int, b int, d double")
    assert distance.normalize(flat).first()["d"] is None
