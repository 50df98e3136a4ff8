"""The transform: goldens, convergence, invariances, neighbourhoods."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permafield.functions import tree
from permafield.functions.design import connectivity_of
from permafield.operators import maps
from permafield.sources import files


def smooth(shape, sigma, seed):
    """White noise smoothed by a Gaussian and scaled to unit deviation."""
    v = np.random.default_rng(seed).normal(size=shape)
    w = min(6, (min(shape) - 1) // 2)
    x = np.arange(-w, w + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    for axis in range(len(shape)):
        v = np.apply_along_axis(np.convolve, axis, v, k / k.sum(), "same")
    return v / v.std()


def brute(values, space, e=0.5, h=2.0):
    """The level form, component by component."""
    v = tree.clean(values)
    out = np.zeros(len(v))
    for sign in (1, -1):
        d = sign * v
        levels = np.unique(d[d > 0])[::-1].astype(float)
        for hi, lo in zip(levels, [*levels[1:], 0.0]):
            label = tree.labels(space, d >= np.float32(hi))
            inside = label >= 0
            size = np.bincount(label[inside], minlength=len(v))
            out[inside] += sign * size[label[inside]].astype(float) ** e * (hi ** (h + 1) - lo ** (h + 1)) / (h + 1)
    return out


def test_goldens():
    g = np.zeros((9, 9, 9))
    g[4, 4, 4], g[4, 5, 4] = 3, 2
    assert tree.tfce(g.ravel(), tree.Grid((9, 9, 9))).max() == pytest.approx((27 - 8) / 3 + math.sqrt(2) * 8 / 3, rel=1e-6)
    mesh = tree.Mesh(4, *tree.faces_to_edges([[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]], 4))
    assert np.allclose(tree.tfce([3, 1, 0, 0], mesh, 1.0, 2.0), [9.333333, 0.6666667, 0, 0])
    one = np.zeros(27)
    one[13] = 2.0
    assert tree.tfce(one, tree.Grid((3, 3, 3)))[13] == pytest.approx(8 / 3)
    flat = np.full(24, 1.5)
    assert np.allclose(tree.tfce(flat, tree.Grid((2, 3, 4))), math.sqrt(24) * 1.5**3 / 3)
    assert not tree.tfce(np.zeros(27), tree.Grid((3, 3, 3))).any() and tree.tfce(np.zeros(8), tree.Grid((2, 2, 2))).dtype == np.float32


def test_axis_order_and_signs():
    v = np.zeros((4, 6, 8))
    v[0, 5, 7] = 5.0
    out = tree.tfce(v.ravel(order="F"), tree.Grid((4, 6, 8))).reshape((4, 6, 8), order="F")
    assert out[0, 5, 7] > 0 and (out != 0).sum() == 1
    n = np.zeros((5, 5, 5))
    n[2, 2, 2] = -3.0
    space = tree.Grid((5, 5, 5))
    assert tree.tfce(n.ravel(), space)[62] < 0 and not tree.tfce(n.ravel(), space, two_sided=False).any()
    a = np.abs(np.random.default_rng(0).normal(size=216))
    assert np.array_equal(tree.tfce(a, tree.Grid((6, 6, 6))), tree.tfce(a, tree.Grid((6, 6, 6)), two_sided=False))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([6, 18, 26]), st.sampled_from([None, 0, 1]), st.sampled_from([(0.5, 2.0), (1.0, 2.0), (0.7, 0.5)]))
def test_exact_on_random_maps(seed, connectivity, digits, exponents):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(1, 7, 3).tolist())
    v = rng.normal(size=math.prod(shape))
    v = v if digits is None else np.round(v, digits)  # many ties
    space = tree.Grid(shape, connectivity)
    assert np.allclose(tree.tfce(v, space, *exponents), brute(v, space, *exponents), rtol=1e-5, atol=1e-6)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_exact_on_random_meshes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    space = tree.Mesh(n, rng.integers(0, n, 3 * n), rng.integers(0, n, 3 * n))
    v = np.round(rng.normal(size=n), 1)
    assert np.allclose(tree.tfce(v, space, 1.0, 2.0), brute(v, space, 1.0, 2.0), rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("connectivity", [6, 26])
def test_steps_converge_at_first_order(connectivity):
    v = smooth((16, 18, 14), 1.6, 1).ravel()
    space = tree.Grid((14, 18, 16), connectivity)
    exact = tree.tfce(v, space).astype(float)
    steps = [50, 100, 200, 400]
    error = [np.abs(tree.stepped(v, space, n) - exact).max() / np.abs(exact).max() for n in steps]
    slope = np.polyfit(np.log(steps), np.log(error), 1)[0]
    assert -1.25 < slope < -0.75


def test_connectivity_matters_and_is_checked():
    v = smooth((12, 12, 12), 1.2, 4).ravel()
    six, all_ = tree.tfce(v, tree.Grid((12, 12, 12), 6)), tree.tfce(v, tree.Grid((12, 12, 12), 26))
    assert not np.array_equal(six, all_) and all_.max() > six.max()
    for bad in (0, 8, 27):
        with pytest.raises(ValueError):
            tree.Grid((3, 3, 3), bad)
    for e, h in ((math.nan, 2), (0.5, -1), (0.5, math.inf)):
        with pytest.raises(ValueError):
            tree.tfce(np.zeros(8), tree.Grid((2, 2, 2)), e, h)
    with pytest.raises(ValueError):
        tree.tfce(np.zeros(9), tree.Grid((2, 2, 2)))
    with pytest.raises(TypeError):
        tree.tfce(np.zeros(8, complex), tree.Grid((2, 2, 2)))
    v[5] = np.inf
    v[6] = np.nan
    assert np.isfinite(tree.tfce(v, tree.Grid((12, 12, 12)))).all()


def test_faces():
    src, dst = tree.faces_to_edges([[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]], 4)
    assert np.bincount(src).tolist() == [3, 3, 3, 3] and (np.diff(src) >= 0).all()
    for faces, error in (([[1, 2, 99]], ValueError), ([[0, 1, 2]], ValueError), ([[1, 2]], ValueError)):
        with pytest.raises(error):
            tree.faces_to_edges(faces, 4)
    with pytest.raises(ValueError):
        tree.Mesh(3, [0], [3])
    with pytest.raises(ValueError):
        tree.Mesh.from_csr([0, 1], [0, 0])


def test_tree_nodes_sum_to_the_transform():
    v = np.round(smooth((6, 7, 5), 1.0, 8).ravel(), 1)
    space = tree.Grid((5, 7, 6))
    nodes = tree.tree_nodes(v, space)
    assert all(p == -1 or p > k for k, (p, *_) in enumerate(nodes))
    top = max(range(len(nodes)), key=lambda k: nodes[k][2])
    total, k = 0.0, top
    while k != -1:
        p, size, birth, death = nodes[k]
        total += math.sqrt(size) * (birth**3 - death**3) / 3
        k = p
    assert total == pytest.approx(float(tree.tfce(v, space)[v.argmax()]), rel=1e-5)


def test_structuring_elements():
    s = np.zeros((3, 3, 3))
    s[1, 1, :] = s[1, :, 1] = s[:, 1, 1] = 1
    assert connectivity_of(s) == 6 and connectivity_of(np.ones((3, 3, 3))) == 26
    for bad in (np.zeros((3, 3, 3)), np.ones((3, 3)), np.eye(3)[None].repeat(3, 0)):
        with pytest.raises(ValueError):
            connectivity_of(bad)


def test_batch_is_single_and_partitions_do_not_matter(spark):
    a = np.stack([smooth((12, 13, 11), 1.4, 20 + k) for k in range(5)], -1)
    a[..., 1], a[..., 3] = np.abs(a[..., 1]), np.abs(a[..., 3])
    space = tree.Grid((12, 13, 11))
    packed = files.maps_from_array(spark, a)
    single = np.stack([tree.tfce(a[..., k].ravel(order="F"), space) for k in range(5)], -1)
    for parts in (1, 5):
        got = files.maps_to_array(maps.tfce_packed(packed.repartition(parts), space), (12, 13, 11))
        assert np.array_equal(got.reshape(-1, 5, order="F"), single)
    long = maps.tfce(maps.unpack(packed), (12, 13, 11)).orderBy("map_id", "element_id").toPandas()
    assert np.array_equal(long["enh"].to_numpy().reshape(5, -1).T, single)


def test_adapter(spark):
    a = smooth((10, 11, 9, 3), 1.3, 5)
    full = np.ones((3, 3, 3))
    one = maps.calculate_tfce(a, full)
    assert one.shape == a.shape and np.array_equal(one, maps.calculate_tfce(a, full, dh=0.1, spark=spark))
    assert maps.calculate_tfce(a, full, two_sided_test=False).min() >= 0
    with pytest.raises(ValueError):
        maps.calculate_tfce(a[..., 0], full)


def test_operators_match_kernels(spark):
    edges = maps.grid_edges(spark, (4, 3, 5), 18).toPandas()
    src, dst = tree.edges_of(tree.Grid((4, 3, 5), 18), np.ones(60, bool))
    want = set(zip(src.tolist(), dst.tolist())) | set(zip(dst.tolist(), src.tolist()))
    assert set(zip(edges["src"], edges["dst"])) == want and len(edges) == len(want)
    faces = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4), (2, 2, 3, 4)], "face_id int, v1 int, v2 int, v3 int")
    got = maps.adjacency_from_faces(faces, 4).orderBy("src", "dst").toPandas()
    s, t = tree.faces_to_edges([[1, 2, 3], [2, 3, 4]], 4)
    assert got["src"].tolist() == s.tolist() and got["dst"].tolist() == t.tolist()
    with pytest.raises(Exception, match="outside"):
        maps.adjacency_from_faces(faces, 3).count()
    v = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(np.random.default_rng(2).normal(size=4))], "map_id int, element_id int, value double")
    by_edges = maps.tfce(v, adjacency=maps.adjacency_from_faces(faces, 4), n=4, E=1.0).orderBy("element_id").toPandas()["enh"]
    assert np.array_equal(by_edges, tree.tfce(v.toPandas()["value"], tree.Mesh(4, s, t), 1.0))
    with pytest.raises(ValueError):
        maps.tfce(v)
    with pytest.raises(Exception, match="outside"):
        maps.tfce(v, (1, 1, 3)).count()


def test_labels_are_components():
    keep = np.random.default_rng(3).random(1000) < 0.35
    space = tree.Grid((10, 10, 10), 6)
    label = tree.labels(space, keep)
    src, dst = tree.edges_of(space, keep)
    assert (label[src] == label[dst]).all() and (label[keep] <= np.flatnonzero(keep)).all() and (label[~keep] == -1).all()
    seen = {int(x) for x in label[keep]}
    assert all(label[x] == x for x in seen)
