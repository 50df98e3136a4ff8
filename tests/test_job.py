"""Whole jobs from design to exported maps."""

import numpy as np

import pytest

from permafield.functions import design, linear, tree
from permafield.plans.job import Job, estimate, export
from permafield.plans.permutation import _partials, permutation_test, statistics


def test_job_runs_stores_and_exports(spark, tmp_path):
    rng = np.random.default_rng(5)
    g = np.kron([1.0, 0.0], np.ones(10))
    age = rng.normal(size=20)
    y = rng.normal(size=(125, 20)) + 0.5 * age
    y[60:65] += 4 * g
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "element_id long, y array<double>")
    d = design.Design(np.column_stack([g, 1 - g, age]), [0, 1], [2])
    space = tree.Grid((5, 5, 5))
    job = Job(d, {"up": np.array([1.0, -1, 0]), "age": np.array([0, 0, 1.0])}, n_perm=120, options={"n_tail": 40})
    out = estimate(rows, job, space, f"{tmp_path}")
    assert set(out) == {"up", "age"} and out["up"].info["method"] == "smith" and out["age"].info["scheme"] == "regression"
    hit = {r["element_id"] for r in out["up"].result.where("measure = 'enh' and p_fwe < 0.05 and sign = 1").collect()}
    assert hit >= set(range(60, 65))
    got = export(spark, f"{tmp_path}", ["up"], space, u=0.05, k=2, kinds=("thresholded", "binary", "nary"))
    assert {r["value"] for r in got["up", "binary"].collect()} == {1.0} and got["up", "nary"].count() == got["up", "thresholded"].count() >= 5


def test_break_without_a_hit(spark):
    y = np.random.default_rng(9).normal(size=(27, 16))
    y -= y.mean(1, keepdims=True)  # no element has an effect
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "element_id long, y array<double>")
    job = Job(design.Design(np.ones((16, 1)), [0]), {"mean": np.array([1.0])}, n_perm=300, n_perm_break=60)
    out = estimate(rows, job, tree.Grid((3, 3, 3)))["mean"]
    assert out.info["permutations"] == 60 and out.info["stopped"] and out.info["contrast"] == "mean" and out.info["scheme"] == "sign_flip"


@pytest.mark.parametrize("method", ["ds", "smith", "freedman_lane"])
def test_jobs_run_the_nuisance_method_they_name(spark, method):
    """The maxima of a job are those of the method's own statistic, exchange by exchange."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=24), np.ones(24), rng.normal(size=24)])
    c = np.array([1.0, 0, 0])
    y = rng.normal(size=(20, 24)) + 2 * x[:, 2]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "element_id long, y array<double>")
    perms = np.array([np.arange(24), *(rng.permutation(24) for _ in range(15))])
    null = {r["perm_id"]: r["t_max"] for r in permutation_test(rows, x, c, perms, method=method).null.collect()}
    want = [linear.fit_nuisance(y, x, c, p, method).max() for p in perms]
    assert np.allclose([null[k] for k in range(16)], want)
    job = Job(design.Design(x, [1], [0, 2]), {"up": c}, n_perm=40, nuisance=method)
    out = estimate(rows, job, None)["up"]
    own = design.draw(design.recognise(job.design, c, None, method), 40, 0)
    null = {r["perm_id"]: r["t_max"] for r in out.null.collect()}
    assert np.allclose([null[k] for k in range(len(own))], [linear.fit_nuisance(y, x, c, p, out.info["method"]).max() for p in own])


def test_family_wise_error_with_a_strong_covariate():
    rng = np.random.default_rng(12)
    hits = 0
    for _ in range(200):
        z = rng.normal(size=20)
        x = np.column_stack([rng.normal(size=20) + z, np.ones(20), z])
        y = rng.normal(size=(5, 20)) + 3 * z
        fit, _ = statistics(y, x, [1.0, 0, 0], method="smith")
        null = [np.abs(fit(np.arange(20) if k == 0 else rng.permutation(20))).max() for k in range(60)]
        hits += sum(v >= null[0] for v in null) <= 3
    assert 2 <= hits <= 20  # 10 of 200


def test_largest_draws_are_kept_in_a_bounded_table():
    rng = np.random.default_rng(1)
    y, x = rng.normal(size=(6, 10)), np.column_stack([np.ones(10), np.arange(10.0)])
    perms = np.array([np.arange(10), *(rng.permutation(10) for _ in range(40))])
    t = np.array([linear.PermutedGLM(y, x, [0.0, 1]).fit(p) for p in perms])
    _, cnt, tops, _ = _partials(perms, list(range(41)), y, x, [0.0, 1], False, t[0], t[0], None, 0.5, 2.0, 7, {"method": "raw", "interaction": False}, {})
    s = np.sign(t[0])
    assert (cnt["stat"] == (s * t >= s * t[0]).sum(0)).all()
    assert np.allclose(np.sort(tops["stat"], 1)[:, -7:], np.sort((s * t).T, 1)[:, -7:])
