"""The plan by blocks and waves against the plan for small data; bounded tails; preconditions and covariates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.functions import design, linear, tails, tree
from permafield.operators import inference, models
from permafield.plans import blocks
from permafield.plans.job import Job, estimate
from permafield.plans.permutation import permutation_test


def frame(spark, y, c=None):
    rows = [(k, v.tolist(), None if c is None else c[k].tolist()) for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "element_id long, y array<double>, c array<double>").repartition(5)


def same(a, b):
    x, y = (o.result.orderBy("measure", "element_id").toPandas() for o in (a, b))
    for col in ("element_id", "sign", "cnt", "n_draws", "p_source"):
        assert (x[col] == y[col]).all(), col
    for col in ("stat", "enh", "p_unc", "p_fwe", "p_fdr", "null_sum"):
        assert np.allclose(x[col], y[col], atol=1e-6, rtol=1e-6, equal_nan=True), col
    m, n = (o.null.orderBy("perm_id").toPandas() for o in (a, b))
    assert np.allclose(m[["t_max", "t_min", "e_max", "e_min"]], n[["t_max", "t_min", "e_max", "e_min"]], rtol=1e-9)


RNG = np.random.default_rng(4)
N_OBS = 18
X = np.column_stack([RNG.normal(size=N_OBS), np.ones(N_OBS), RNG.normal(size=N_OBS)])
GROUPS = np.column_stack([np.arange(N_OBS) % 3 == k for k in range(3)]).astype(float)
PERMS = np.array([np.arange(N_OBS), *(RNG.permutation(N_OBS) for _ in range(69))])
SIGNS = np.array([np.ones(N_OBS), *(RNG.choice([-1, 1], N_OBS) for _ in range(69))])


@pytest.mark.parametrize(
    "x, c, exchanges, options",
    [
        (X, [1.0, 0, 0], PERMS, {"method": "smith"}),
        (X, [1.0, 0, 0], PERMS, {"method": "ds", "fwe": "per_sign"}),
        (X, [1.0, 0, 0], PERMS, {"method": "freedman_lane", "shrink": 1e-3}),
        (GROUPS, np.eye(3)[:, :2] - np.eye(3)[:, 1:], PERMS, {"half": False}),
        (np.ones((N_OBS, 1)), [1.0], SIGNS, {"signs": True, "half": True}),
    ],
)
def test_blocks_and_waves_equal_the_small_plan(spark, x, c, exchanges, options):
    y = RNG.normal(size=(105, N_OBS)) + 1.2 * (np.arange(105)[:, None] < 12) * x[:, 0]
    y[50] = 0  # an element without a statistic
    space, rows = tree.Grid((7, 5, 3)), frame(spark, y)
    small = permutation_test(rows, x, c, exchanges, space, n_tail=30, **options)
    large = blocks.test_by_blocks(rows, x, c, exchanges, space, n_tail=30, wave=None, block=16, **options)
    same(small, large)
    assert large.info["elements"] == 105 and large.info["permutations"] == small.info["permutations"]
    kept = blocks.WAVE
    blocks.WAVE = 25  # several waves, one state
    try:
        waves = blocks.test_by_blocks(rows, x, c, exchanges, space, n_tail=30, block=64, **options)
    finally:
        blocks.WAVE = kept
    same(small, waves)
    assert waves.info["waves"] == 3


def test_draws_of_the_same_sum_count_as_equal(spark):
    """Sums in whole cents say which draws reach the observed one; t in doubles differs in its last bits where they are equal."""
    rng, n, m = np.random.default_rng(8), 12, 300
    perms = np.array([np.arange(n), *(rng.permutation(n) for _ in range(29))])
    odd = np.arange(n) % 2 == 1
    cents = rng.integers(10**6, 10**7, (m, n))
    for e in range(m):  # one value makes the sum of one draw's group that of the observed group
        drawn = perms[1 + e % 29][odd]
        own = np.setdiff1d(drawn, np.flatnonzero(odd))
        cents[e, own[:1]] += cents[e, odd].sum() - cents[e, drawn].sum()
    sums = np.stack([cents[:, p[odd]].sum(1) for p in perms], 1)
    sign = np.sign(2 * sums[:, :1] - cents.sum(1, keepdims=True))
    right = (sign * sums >= sign * sums[:, :1]).sum(1)
    x = np.column_stack([odd, ~odd]).astype(float)
    _, _, per, _ = blocks.reductions(frame(spark, cents / 100), x, [1, -1], perms, n_tail=5, wave=12, block=64)
    found = per.where("measure = 'stat'").orderBy("element_id").toPandas()["cnt"].to_numpy()
    assert (found == right).all()
    assert (sums[:, 1:] == sums[:, :1]).sum() >= m
    small = permutation_test(frame(spark, cents / 100), x, [1, -1], perms, n_tail=5).result.where("measure = 'stat'").orderBy("element_id").toPandas()
    assert (small["cnt"].to_numpy() == right).all()


def test_waves_stop_where_the_small_plan_stops(spark):
    y = RNG.normal(size=(40, N_OBS))
    signs = np.array([np.ones(N_OBS), *(RNG.choice([-1, 1], N_OBS) for _ in range(799))])
    rows = frame(spark, y)
    small = permutation_test(rows, np.ones((N_OBS, 1)), [1.0], signs, None, signs=True, n_tail=20, wave=300, alpha=1e-4)
    large = blocks.test_by_blocks(rows, np.ones((N_OBS, 1)), [1.0], signs, None, signs=True, n_tail=20, wave=300, alpha=1e-4, block=8)
    assert small.info["stopped"] and large.info["stopped"] and small.info["permutations"] == large.info["permutations"] < 800
    same(small, large)


def test_a_break_keeps_what_was_run(spark):
    y = RNG.normal(size=(30, N_OBS))
    y -= y.mean(1, keepdims=True)
    calm, x = frame(spark, y), np.ones((N_OBS, 1))
    for test in (permutation_test, lambda *a, **k: blocks.test_by_blocks(*a, block=8, **k)):
        early = test(calm, x, [1.0], SIGNS, None, signs=True, n_tail=20, break_after=40)
        assert early.info["permutations"] == 40 and early.info["stopped"] and early.null.count() == 40
        strong = test(frame(spark, y + 5), x, [1.0], SIGNS, None, signs=True, n_tail=20, break_after=40)
        whole = permutation_test(frame(spark, y + 5), x, [1.0], SIGNS, None, signs=True, n_tail=20)
        assert strong.info["permutations"] == 70 and not strong.info["stopped"]
        same(strong, whole)


def test_gaps_and_wrong_lengths_are_refused(spark):
    rows = frame(spark, RNG.normal(size=(20, N_OBS)))
    for bad in (rows.where("element_id <> 7"), rows.where("element_id < 16 or element_id > 17"), rows.unionByName(rows.where("element_id = 3")), rows.withColumn("y", F.slice("y", 1, 5))):
        with pytest.raises(Exception, match="numbered|needs"):
            blocks.test_by_blocks(bad, X, [1.0, 0, 0], PERMS[:3], None, block=8)


def test_covariate_of_each_element_in_the_whole_test(spark):
    """The null, draw by draw, is that of a loop over elements with explicit designs."""
    y, cov = RNG.normal(size=(24, N_OBS)), RNG.normal(size=(24, N_OBS))
    y[3] += 2 * cov[3]
    x = np.column_stack([np.ones(N_OBS), np.ones(N_OBS)])  # the first column is the covariate's place
    for c in ([1.0, 0.0], [0.0, 1.0]):

        def loop(p):
            out = []
            for yy, cc in zip(y, cov):
                own = np.column_stack([cc[p] if c[0] else cc, np.ones(N_OBS)])
                data = yy if c[0] else yy[p]
                beta, *_ = np.linalg.lstsq(own, data, rcond=None)
                ms = ((data - own @ beta) ** 2).sum() / (N_OBS - 2)
                out.append(np.dot(c, beta) / np.sqrt(ms * (np.array(c) @ np.linalg.inv(own.T @ own) @ np.array(c))))
            return np.array(out)

        want = np.array([loop(p) for p in PERMS[:12]])
        rows = frame(spark, y, cov)
        small = permutation_test(rows, x, c, PERMS[:12], None, n_tail=5, columns=[0])
        large = blocks.test_by_blocks(rows, x, c, PERMS[:12], None, n_tail=5, columns=[0], block=10)
        same(small, large)
        null = small.null.orderBy("perm_id").toPandas()
        assert np.allclose(null["t_max"], want.max(1)) and np.allclose(null["t_min"], want.min(1))
    job = Job(design.Design(x + [0, 0], [], [0], [], [1]), {"cov": np.array([1.0, 0])}, n_perm=60, covariate=rows.select("element_id", "c"), columns=[0], options={"n_tail": 20})
    out = estimate(rows.select("element_id", "y"), job, None)["cov"].result.where("measure = 'stat'").orderBy("p_unc").first()
    assert out["element_id"] == 3


def test_precondition_of_the_fast_form(spark):
    """Whitening a design can part it from nuisance columns taken out before; then the explicit form is run, draw by draw."""
    n = 16
    x = np.column_stack([RNG.normal(size=n), np.ones(n), RNG.normal(size=n)])
    c = np.array([1.0, 0, 0])
    w = np.eye(n) + 0.4 * np.eye(n, k=1)
    perms = np.array([np.arange(n), *(RNG.permutation(n) for _ in range(20))])
    rz = linear.residual_maker(x[:, 1:])
    assert linear.fast_form_holds(x, rz, perms) and linear.fast_form_holds(x, rz, np.sign(RNG.normal(size=(4, n))))
    assert not linear.fast_form_holds(w @ x, rz, perms)
    assert linear.fast_form_holds(w @ x, linear.residual_maker(w @ x[:, 1:]), perms)
    assert not linear.fast_form_holds(x, rz, np.array([[0] * n]))  # draws one observation over and over
    y = RNG.normal(size=(9, n))

    def explicit(design_, data):
        beta = data @ np.linalg.pinv(design_).T
        ms = ((data - beta @ design_.T) ** 2).sum(1) / (n - 3)
        return beta[:, 0] / np.sqrt(ms * np.linalg.inv(design_.T @ design_)[0, 0])

    for design_, holds in ((x, True), (w @ x, False)):
        null = permutation_test(frame(spark, y), design_, c, perms, None, n_tail=5, method="freedman_lane", rz=rz).null.orderBy("perm_id").toPandas()
        # The unexchanged data are taken as they are exchanged: with nuisance out.
        want = np.array([explicit(design_, y[:, p] @ rz) for p in perms])
        assert np.allclose(null["t_max"], want.max(1)), holds
    job = Job(design.Design(x, [1], [0, 2]), {"up": c}, n_perm=40, nuisance="freedman_lane", whitening=w, options={"n_tail": 10})
    assert not estimate(frame(spark, y).select("element_id", "y"), job, None)["up"].info["fast"]


def test_jobs_with_a_mask_scaling_and_numbers_for_each_contrast(spark):
    x = np.column_stack([np.arange(N_OBS) % 2, 1 - np.arange(N_OBS) % 2]).astype(float)
    y = RNG.normal(size=(20, N_OBS)) + 3 * x[:, 0]
    factors = RNG.uniform(1, 2, N_OBS)
    mask = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(20)], "element_id long, mask int")
    rows = frame(spark, y / factors).select("element_id", "y")
    job = Job(design.Design(x, [0, 1]), {"a": np.array([1.0, -1]), "b": np.array([-1.0, 1])}, n_perm={"a": 80, "b": 50}, mask=mask, scaling=factors, options={"n_tail": 20})
    out = estimate(rows, job, None)
    assert out["a"].info["permutations"] == 80 and out["b"].info["permutations"] == 50
    got = out["a"].result.where("measure = 'stat'").orderBy("element_id").toPandas()
    want = linear.PermutedGLM(y, x, [1.0, -1]).fit()
    assert np.allclose(got["stat"], np.where(np.arange(20) % 4 != 0, want, 0), rtol=1e-5)
    assert out["a"].info["corr_p"] is None or -1 <= out["a"].info["corr_p"] <= 1.0001
    assert out["a"].info["calibration"] in ("too_narrow", "fine", "too_wide")


@pytest.mark.parametrize("bound", [64, 1000, 20_000, 10_000_000])
def test_largest_draws_at_any_bound(bound):
    rng = np.random.default_rng(bound)
    held, out = tails.LargestDraws(7, bound), []
    e, v = rng.integers(0, 50, 9000), rng.integers(0, 400, 9000).astype(float)
    for at in range(0, 9000, 1300):
        if (given := held.add(e[at : at + 1300], v[at : at + 1300])) is not None:
            out.append(given)
    out.append(held.rest())
    assert held.peak <= max(bound, 64)
    e2, v2 = (np.concatenate(x) for x in zip(*out))
    for k in range(50):
        assert sorted(v2[e2 == k])[-7:] == sorted(v[e == k])[-7:]


def test_tails_are_the_same_at_any_bound_and_with_a_pilot(spark):
    t = RNG.normal(size=(300, 40)).round(2)
    stats = spark.createDataFrame([(p, e, float(t[p, e])) for p in range(300) for e in range(40)], "perm_id int, element_id long, t double").repartition(6)
    obs = stats.where("perm_id = 0").select("element_id", "t")
    want = {e: sorted((np.sign(t[0, e]) * t[:, e]).tolist())[::-1][:9] for e in range(40) if t[0, e] != 0}
    for options in ({}, {"most_bytes": 256}, {"prune": True}, {"prune": True, "most_bytes": 1000}):
        got = {r["element_id"]: r["top"] for r in inference.tail_topk(stats, obs, 9, **options).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[e], want[e]) for e in got), options


def test_shrinkage_takes_the_largest_variance_of_all_elements(spark):
    y = RNG.normal(size=(50, N_OBS)) * np.linspace(1, 9, 50)[:, None]
    got = models.fit_glm(frame(spark, y), X, [1.0, 0, 0], perms=PERMS[:4], shrink=0.01).orderBy("perm_id", "element_id").toPandas()
    want = [linear.PermutedGLM(y, X, [1.0, 0, 0], shrink=0.01).fit(p) for p in PERMS[:4]]
    assert np.allclose(got["t"].to_numpy().reshape(4, 50), want)
