"""Models, designs and permutations against explicit least squares."""

import math

import numpy as np
import pytest

from permafield.functions import design, linear
from permafield.operators import models


def naive(y, x, c):
    c = c[:, None] if np.ndim(c) == 1 else np.asarray(c)
    beta, *_ = np.linalg.lstsq(x, y.T, rcond=None)
    df = len(x) - np.linalg.matrix_rank(x)
    ms = ((y.T - x @ beta) ** 2).sum(0) / df
    cov = np.linalg.pinv(x.T @ x)
    if c.shape[1] == 1:
        return (c.T @ beta)[0] / np.sqrt(ms * (c.T @ cov @ c)[0, 0])
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    q = u[:, s > 1e-10]
    b = q.T @ beta
    return np.einsum("qe,qp,pe->e", b, np.linalg.inv(q.T @ cov @ q), b) / q.shape[1] / ms


def two_groups(seed=7, n=40, elements=300):
    rng = np.random.default_rng(seed)
    g = np.arange(n) % 2
    x = np.column_stack([g, 1 - g, rng.normal(size=n), rng.normal(size=n)])
    return rng.normal(size=(elements, n)) + 0.3 * g, x, np.array([1.0, -1, 0, 0])


def test_t_and_f_equal_least_squares():
    y, x, c = two_groups()
    rng = np.random.default_rng(1)
    assert np.allclose(linear.PermutedGLM(y, x, c).fit(), naive(y, x, c), rtol=1e-9)
    p = rng.permutation(40)
    assert np.allclose(linear.PermutedGLM(y, x, c).fit(p), naive(y[:, p], x, c), rtol=1e-9)
    x3 = np.column_stack([np.kron(np.eye(3), np.ones((15, 1))), rng.normal(size=45)])
    y3 = rng.normal(size=(200, 45))
    c3 = np.array([[1, 0], [-1, 1], [0, -1], [0, 0]], float)
    assert np.allclose(linear.PermutedGLM(y3, x3, c3).fit(), naive(y3, x3, c3), rtol=1e-8)
    s = rng.choice([-1, 1], 30)
    y1 = rng.normal(size=(200, 30)) + 0.2
    assert np.allclose(linear.PermutedGLM(y1, np.ones((30, 1)), [1]).fit_signs(s), naive(y1 * s, np.ones((30, 1)), np.array([1.0])), rtol=1e-9)
    deficient = np.array([[1, -1], [-1, 1], [0, 0], [0, 0]], float)
    assert np.allclose(linear.PermutedGLM(y3, x3, deficient).fit(), linear.PermutedGLM(y3, x3, deficient[:, 0]).fit() ** 2, rtol=1e-6)
    assert np.allclose(linear.explicit_glm(y, x, c), linear.PermutedGLM(y, x, c, shrink=1e-3, eps_inside=False).fit(), rtol=1e-6)


def test_null_statistics_follow_t():
    from permafield.functions.special import t_sf

    y = np.random.default_rng(21).normal(size=(5000, 30))
    x = np.column_stack([np.arange(30) % 2, 1 - np.arange(30) % 2]).astype(float)
    u = np.sort(t_sf(linear.PermutedGLM(y, x, [1, -1]).fit(), 28))
    assert np.abs(u - (np.arange(5000) + 0.5) / 5000).max() < 1.63 / math.sqrt(5000)


def test_shapes_are_checked():
    for y, x, c in ((np.ones((3, 4)), np.ones((5, 1)), [1]), (np.ones((3, 2)), np.eye(2), [1, 0]), (np.ones((3, 4)), np.ones((4, 1)), [1, 0])):
        with pytest.raises(ValueError):
            linear.PermutedGLM(y, x, c)


def test_dataframe_fit_equals_kernel(spark):
    y, x, c = two_groups(elements=60)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "element_id long, y array<double>")
    perms = np.array([np.arange(40), np.random.default_rng(3).permutation(40)])
    for method in ("raw", "ds", "smith", "freedman_lane", "freedman_lane_exact"):
        got = models.fit_glm(rows, x, c, perms=perms, method=method).toPandas()
        for k, p in enumerate(perms):
            own = got[got["perm_id"] == k].sort_values("element_id")["t"]
            assert np.allclose(own, linear.fit_nuisance(y, x, c, p, method), rtol=1e-8)
    shrunk = models.fit_glm(rows, x, c, shrink=1e-3).orderBy("element_id").toPandas()["t"]
    assert np.allclose(shrunk, linear.PermutedGLM(y, x, c, shrink=1e-3).fit(), rtol=1e-9)


def test_freedman_lane_forms_differ():
    y, x, c = two_groups()
    p = np.random.default_rng(5).permutation(40)
    assert np.allclose(linear.fit_nuisance(y, x, c, p, "freedman_lane"), linear.PermutedGLM(y, x, c).fit(p))
    assert not np.allclose(linear.fit_nuisance(y, x, c, p, "freedman_lane_exact"), linear.PermutedGLM(y, x, c).fit(p), rtol=1e-2)
    with pytest.raises(ValueError):
        linear.fit_nuisance(y, x, c, p, "other")


@pytest.mark.parametrize("method", ["ds", "smith", "freedman_lane_exact"])
def test_nuisance_methods_keep_the_error_rate(method):
    rng = np.random.default_rng(2)
    g = np.kron([0, 1], np.ones(15))
    z = rng.normal(size=30)
    x = np.column_stack([g, 1 - g, z])
    y = rng.normal(size=(1500, 30)) + 3 * z
    c = np.array([1.0, -1, 0])
    t0 = np.abs(linear.PermutedGLM(y, x, c).fit())
    if method == "ds":
        x = np.column_stack([g - g.mean(), np.ones(30), z])
        c = np.array([1.0, 0, 0])
    hits = sum(np.abs(linear.fit_nuisance(y, x, c, rng.permutation(30), method)) >= t0 - 1e-12 for _ in range(200))
    assert abs(((hits + 1) / 201 <= 0.05).mean() - 0.05) < 0.02


def test_voxel_covariates_equal_a_loop():
    rng = np.random.default_rng(4)
    y, cov = rng.normal(size=(300, 30)), 0.5 + 0.1 * rng.normal(size=(300, 30))
    cov[:20] = 0.5  # constant: singular with the intercept
    x = np.column_stack([np.ones(30), np.ones(30)])
    for columns, c in (([0], [1.0, 0]), ([0], [0, 1.0])):
        p = rng.permutation(30)
        got = linear.voxel_covariate_glm(y, cov, x, columns, c, p)
        for e in range(0, 300, 7):
            xi = x.copy()
            xi[:, 0] = cov[e][p] if c[0] else cov[e]
            ye = y[e] if c[0] else y[e][p]
            assert got[e] == pytest.approx(linear.PermutedGLM(ye[None], xi, c).fit()[0], rel=1e-5, abs=1e-6)


def test_partition_and_factors():
    x = np.zeros((4, 3))
    used, rest = linear.partition(x, [[1, 0], [0, 0], [0, 2]])
    assert used.tolist() == [0, 2] and rest.tolist() == [1]
    two = np.column_stack([np.kron(np.eye(2), np.ones((4, 1))), np.tile(np.eye(2), (4, 1))])
    assert design.split_factors(two, [0, 1, 2, 3]) == [[0, 1], [2, 3]]
    with pytest.raises(ValueError):
        design.split_factors(np.tile(np.eye(2), (4, 3)), [0, 1, 2, 3, 4, 5])


def test_recognition():
    g = np.kron(np.eye(2), np.ones((6, 1)))
    s = design.recognise(design.Design(g, [0, 1]), [1, -1])
    assert (s.kind, s.n_cond, s.half, design.possible(s)) == ("groups", 2, True, math.comb(12, 6))
    s = design.recognise(design.Design(np.ones((9, 1)), [0]), [1], supplied_blocks=np.ones(9))
    assert (s.kind, design.possible(s), s.blocks) == ("sign_flip", 512, None)
    s = design.recognise(design.Design(np.column_stack([np.arange(7), np.ones(7)]), [], [0], [], [1]), [1, 0])
    assert (s.kind, s.n_cond, design.possible(s)) == ("regression", 0, 5040)
    three = design.Design(np.kron(np.eye(3), np.ones((4, 1))), [0, 1, 2])
    assert design.recognise(three, np.eye(3)).n_cond == 3
    paired = design.Design(np.column_stack([np.tile(np.eye(2), (5, 1)), np.kron(np.eye(5), np.ones((2, 1)))]), [0, 1], [], [2, 3, 4, 5, 6])
    s = design.recognise(paired, [1, -1, 0, 0, 0, 0, 0])
    assert s.method == "ds" and design.possible(s) == 2**5 and not s.half
    with pytest.raises(ValueError):
        design.recognise(paired, [1, -1, 1, 0, 0, 0, 0])
    withz = design.Design(np.column_stack([g, np.arange(12)]), [0, 1], [2])
    assert design.recognise(withz, [1, -1, 0]).method == "smith"


def test_drawing():
    g = np.kron(np.eye(2), np.ones((4, 1)))
    s = design.recognise(design.Design(g, [0, 1]), [1, -1])
    all_ = design.draw(s, 1000, seed=1)
    assert len(all_) == 70 and len({tuple(r) for r in all_}) == 70 and all_[0].tolist() == list(range(8))
    design.verify(all_)
    assert len(design.draw(s, 1000, seed=1, half=True, tries=3000)) == 35
    one = design.recognise(design.Design(np.ones((5, 1)), [0]), [1])
    signs = design.draw(one, 100, seed=2)
    assert len(signs) == 32 and (signs[0] == 1).all()
    design.verify(signs, signs=True)
    blocks = np.array([1, 1, 1, 2, 2, 2])
    r = design.recognise(design.Design(np.column_stack([np.arange(6), np.ones(6)]), [], [0], [], [1]), [1, 0], supplied_blocks=blocks)
    inside = design.draw(r, 100, seed=3)
    design.verify(inside, blocks)
    assert len(inside) == 36
    with pytest.raises(ValueError):
        design.verify([[1, 0, 3, 2, 5, 4]], blocks=[1, 2, 1, 2, 1, 2])
    with pytest.raises(ValueError):
        design.verify([[0, 0, 1]])
    with pytest.raises(ValueError):
        design.verify([[1, 0]], signs=True)
    assert design.exchange_matrix([1, 0], [0, 2], 3).tolist() == [[0, 0, 1], [0, 0, 0], [1, 0, 0]]


def test_block_labels():
    assert design.check_blocks([5, 5, 9, 9]).tolist() == [1, 1, 2, 2]
    for bad in ([1, 2, 3], [1.5, 1.5], [np.nan, 1]):
        with pytest.raises(ValueError):
            design.check_blocks(bad)
    with pytest.raises(ValueError):
        design.block_labels(np.array([[1, 1], [0, 1.0]]), [0, 1])


def test_mirror_negates():
    y, x, c = two_groups(n=30)
    g = x[:, 0].astype(bool)
    swap = np.empty(30, int)
    swap[g], swap[~g] = np.flatnonzero(~g), np.flatnonzero(g)
    glm = linear.PermutedGLM(y, x[:, :2], c[:2])
    p = np.random.default_rng(6).permutation(30)
    assert np.allclose(glm.fit(p[swap]), -glm.fit(p), atol=1e-10)


def test_trace_moments_equal_those_of_all_permutations():
    import itertools

    for n, seed in ((2, 1), (4, 2), (6, 3)):
        rng = np.random.default_rng(seed)
        a, w = rng.normal(size=(n, n)) + 1, rng.normal(size=(n, n)) + np.diag(rng.normal(size=n))
        t = np.array([np.trace(a @ w[np.ix_(p, p)]) for p in map(list, itertools.permutations(range(n)))])
        want = t.mean(), t.var(), ((t - t.mean()) ** 3).mean()
        assert np.allclose(linear.trace_moments(a, w), want, rtol=1e-8, atol=1e-9)
    x = rng.normal(size=(40, 2))
    mean, var, _ = linear.trace_moments(x @ x.T, np.ones((40, 40)))
    assert np.isclose(mean, (x @ x.T).sum()) and abs(var) < 1e-6
