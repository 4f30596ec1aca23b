import numpy as np
import pytest
from pyspark.sql import functions as F

from data import distance_matrix, items_table, random_vectors
from variform.functions import kernels
from variform.operators import groups, neighbours
from variform.operators.profiles import collapse
from variform.session import stage


def brute(vectors):
    """Edges to the nearest others at positive distance, over distinct vectors."""
    first = {}
    for i, v in vectors.items():
        first.setdefault(tuple(v), i)
    ids = list(first.values())
    d = np.round(distance_matrix({i: vectors[i] for i in ids}), 9)
    edges = set()
    for a, row in enumerate(d):
        positive = row[row > 0]
        if len(positive):
            edges |= {(ids[a], ids[b], float(row[b])) for b in np.flatnonzero(row == positive.min())}
    return edges


def clustered(n, width, missing, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 50), width)) * 8
    x = np.round(centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width)), 3)
    x[rng.random(x.shape) < missing] = np.nan
    return {i: [None if np.isnan(v) else float(v) for v in row] for i, row in enumerate(x)}


def found(spark, vectors, **more):
    search = neighbours.search(stage(collapse(items_table(spark, vectors).repartition(5))), **more)
    rows = [(r["a"], r["b"], r["d"]) for r in search.edges.collect()]
    assert len(rows) == len(set(rows))
    return search, set(rows)


@pytest.mark.parametrize("width,missing", [(3, 0.0), (8, 0.0), (8, 0.15), (12, 0.6)])
def test_equals_brute_force_over_many_blocks(spark, width, missing):
    vectors = clustered(400, width, missing, width)
    vectors |= {1000: [None] * width, 1001: [1e6] * width, 1002: [None] * (width - 1) + [3.0]}
    search, edges = found(spark, vectors, block_rows=20, route_rows=50)
    assert search.blocks > 8
    assert {(a, b) for a, b, _ in edges} == {(a, b) for a, b, _ in brute(vectors)}


def test_ties_over_blocks_and_copies(spark):
    vectors = random_vectors(300, 5, 3, 0.2, 7) | {500 + i: [1.0, None, 0.0, 2.0, 1.0] for i in range(40)}
    search, edges = found(spark, vectors, block_rows=12, route_rows=7)
    assert search.blocks > 4 and {(a, b) for a, b, _ in edges} == {(a, b) for a, b, _ in brute(vectors)}
    items = items_table(spark, vectors)
    near = {r["id"]: (r["nearest_d"], r["n_nearest"]) for r in groups.nearest_with_ties(items).collect()}
    d = np.round(distance_matrix(vectors), 9)
    for row, i in zip(d, vectors):
        least = row[row > 0].min(initial=np.inf)
        assert near.get(i) == (None if np.isinf(least) else (pytest.approx(least), int((row == least).sum())))


def test_pairs_grow_much_less_than_with_the_square(spark):
    """Ten times the rows, in ten times the clusters: far fewer than a hundred times the pairs."""
    pairs = []
    for n in (400, 4000):
        vectors = clustered(n, 6, 0.0, 3)
        search, edges = found(spark, vectors, block_rows=32)
        pairs.append(search.pairs)
        if n == 400:
            assert edges == brute(vectors)
    assert pairs[1] < 35 * pairs[0] and pairs[1] < 0.15 * 4000**2


def test_pairs_grow_less_with_missing_cells_too(spark):
    pairs = []
    for n in (400, 4000):
        search, _ = found(spark, clustered(n, 30, 0.08, 4), block_rows=32)
        pairs.append(search.pairs)
    assert pairs[1] < 60 * pairs[0]


@pytest.mark.parametrize("missing", [0.0, 0.1, 0.5])
def test_no_distance_is_below_the_bound_of_its_box(missing):
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = rng.normal(size=(6, 5)) * 2, rng.normal(size=(4, 5)) + 3 * rng.normal(size=5)
        x[rng.random(x.shape) < missing] = np.nan
        y[rng.random(y.shape) < missing] = np.nan
        d = kernels.euclidean_block(x, y)
        bound = neighbours.Box.of(y).bound(x)
        assert ((d == 0) | (d >= bound[:, None] - 1e-9)).all()


def test_text_ids_and_large_leaves(spark):
    """One value in nearly all features: no centre parts the rows, so a leaf is cut in blocks of bounded size."""
    rows = [(f"i{k:03d}", [1.0, 1.0, float(k % 3 == 0), k / 1000]) for k in range(200)]
    profiles = stage(collapse(spark.createDataFrame(rows, "id string, x array<double>")))
    edges = {(r["a"], r["b"]) for r in neighbours.search(profiles, block_rows=2).edges.collect()}
    x = np.array([v for _, v in rows])
    d = np.round(kernels.euclidean_block(x, x), 9)
    d[d <= 0] = np.inf
    assert edges == {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(d == d.min(axis=1, keepdims=True)))}


def test_single_row_and_empty_table(spark):
    assert found(spark, {1: [1.0, 2.0]})[1] == set()
    empty = stage(spark.createDataFrame([], "id bigint, x array<double>"))
    assert neighbours.search(empty).edges.collect() == []


def test_kilometres_meet_all_blocks(spark):
    places = items_table(spark, {0: [0.0, 0.0], 1: [0.0, 10.0], 2: [0.0, 30.0]})
    edges = neighbours.nearest_edges(stage(collapse(places)), "geodesic").select("a", "b").where(F.col("a") == 2).collect()
    assert [tuple(r) for r in edges] == [(2, 1)]
