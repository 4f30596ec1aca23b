import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from data import distance_matrix, random_vectors
from variform.functions import kernels


def as_matrix(vectors):
    return np.array([[np.nan if v is None else v for v in row] for row in vectors.values()])


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10_000), n=st.integers(1, 12), width=st.integers(1, 6), missing=st.floats(0, 0.9))
def test_block_and_point_forms_agree_with_a_direct_loop(seed, n, width, missing):
    vectors = random_vectors(n, width, 4, missing, seed)
    x = as_matrix(vectors)
    expected = distance_matrix(vectors)
    assert np.allclose(kernels.euclidean_block(x, x), expected, atol=1e-9)
    for i in range(n):
        assert np.allclose(kernels.euclidean_point(x, x[i]), expected[i], atol=1e-12)


def test_nearly_equal_points_keep_their_digits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8)) + 1e4
    y = x + rng.normal(size=x.shape) * 1e-5
    direct = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert np.allclose(kernels.euclidean_block(x, y), direct, rtol=1e-6)


def test_geodesic_known_value_and_edges():
    newport, cleveland = [41.49008, -71.312796], [41.499498, -81.695391]
    points = np.array([newport, cleveland, [np.nan, 3.0], [0.0, 0.0], [0.0, 180.0]])
    d = kernels.geodesic_block(points, points)
    assert abs(d[0, 1] - 866.455) < 0.001
    assert (np.diag(d) == 0).all() and (d[2] == 0).all()
    assert np.allclose(d, d.T)
    assert 19_900 < d[3, 4] < 20_040
