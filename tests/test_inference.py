"""Special functions, tails, p-values, results and the whole test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.functions import design, linear, special, tails, tree
from permafield.operators import inference, results
from permafield.plans.permutation import permutation_test, permutation_test_by_blocks
from permafield.sources import files
from permafield.streaming.waves import stream_maxima


def test_special_functions():
    assert special.gammainc_upper(3.5, 2.7) == pytest.approx(0.6112715, abs=1e-7)
    assert special.gammainc_upper(1.0, np.array([0.0, 1.0, 50.0, np.inf])) == pytest.approx([1, math.exp(-1), math.exp(-50), 0])
    assert special.t_sf(np.array([0.0, 2.228139, -2.228139]), 10) == pytest.approx([0.5, 0.025, 0.975], abs=1e-6)
    assert special.f_sf(3.4928, 2, 20) == pytest.approx(0.05, abs=1e-4)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    x = np.linspace(0.01, 0.99, 9)
    assert special.betainv(special.betainc(2.5, 1.5, x), 2.5, 1.5) == pytest.approx(x, abs=1e-9)
    assert special.betainc(2, 3, np.array([0, 1, 0.5])) == pytest.approx([0, 1, 0.6875])
    z = special.to_z(np.array([-40.0, -2, 0, 2, 40]), "t", df2=30)
    assert np.allclose(z, -z[::-1]) and np.isfinite(z).all()
    assert np.isinf(special.equivalent_z(np.array([1e-17, 0.05]))).tolist() == [True, False]
    for kind in ("t", "F", "z", "X", "R", "R2"):
        assert 0 < special.statistic_sf(0.4, kind, 1, 20) < 1
    with pytest.raises(ValueError):
        special.statistic_sf(1, "Q")


def test_gamma_law_of_maxima():
    for n, seed in ((500, 10), (2000, 11), (20_000, 12)):
        rng = np.random.default_rng(seed)
        gumbel = lambda k: (-np.log(-np.log(rng.random((k, 200))))).max(1)
        null, q = gumbel(n), np.quantile(gumbel(20_000), [0.9, 0.95, 0.99])
        p = tails.gamma_pvalue(q, null)
        for got, want in zip(p, (0.1, 0.05, 0.01)):
            assert abs(got - want) < 3 * math.sqrt(want * (1 - want) / n) + 0.25 * want
    null = np.random.default_rng(1).gumbel(size=500)
    assert 0 < tails.gamma_pvalue(np.array([100.0]), null)[0] <= 1 / 500 and tails.gamma_pvalue(np.array([100.0]), null, floor=0)[0] < 1e-9
    assert tails.gamma_pvalue(np.array([-100.0]), null)[0] == 1
    left = -null
    assert tails.gamma_pvalue(np.array([0.0]), left)[0] == pytest.approx(tails.count_pvalue([0.0], left)[0])
    assert tails.gamma_pvalue(np.array([0.0]), left, mode="reflect")[0] == pytest.approx(tails.count_pvalue([0.0], left)[0], abs=0.05)
    with pytest.raises(ValueError):
        tails.gamma_pvalue([1.0], [1.0, 2.0])


def test_generalised_pareto():
    rng = np.random.default_rng(20)
    for k, scale in ((0.2, 1.5), (-0.3, 2.0), (0.0, 1.0)):
        u = rng.random((4000, 200))
        y = np.sort(-np.log(u) * scale if k == 0 else scale * (1 - u**k) / k, 1)
        kk, ss = tails.gpd_fit(y)
        assert np.median(kk) == pytest.approx(k, abs=0.05) and np.median(ss) == pytest.approx(scale, abs=0.1)
    z = np.linspace(0, 5, 50)
    assert (np.diff(tails.gpd_sf(z, -0.2, 1.0)) < 0).all() and tails.gpd_sf(3.0, 0.5, 1.0) == 0 and tails.gpd_sf(0.0, 0.3, 1.0) == 1


def test_pareto_beats_counting():
    rng = np.random.default_rng(13)
    y = rng.normal(size=(400, 40))
    glm = linear.PermutedGLM(y, np.ones((40, 1)), [1])
    draws = np.array([glm.fit_signs(rng.choice([-1, 1], 40)) for _ in range(20_000)])
    first = draws[:1000]
    tail = np.sort(first, 0)[::-1][:100].T
    for q, floor in ((3e-3, 0.8), (1e-3, 0.65)):
        stat = np.quantile(draws, 1 - q, axis=0)
        cnt = (first >= stat).sum(0)
        p, fitted = tails.pareto_pvalue(stat, tail, cnt, 1000)
        within = lambda v: ((v > q / 2) & (v < 2 * q)).mean()
        assert 0.5 < np.median(p / q) < 2 and within(p) >= max(floor, within(cnt / 1000) - 0.05) and fitted.mean() > 0.5
    few, fitted = tails.pareto_pvalue(np.array([3.0]), tail[:1, :20], np.array([2]), 1000)
    assert few[0] == 0.002 and not fitted[0]


def test_moments_and_steps(spark, monkeypatch):
    m = tails.moments([1, 2, 4, 9])
    assert m[:3] == pytest.approx((4, 12.6666667, 1.3309377))
    row = inference.moments(spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "t_max double")).first()
    assert row["skew"] == pytest.approx(1.3309377)
    assert tails.bh_adjust([0.01, 0.02, 0.03, 0.5]) == pytest.approx([0.04, 0.04, 0.04, 0.5])
    p = np.random.default_rng(0).random(400)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)] + [(999, float("nan"))], "element_id int, p double")
    got = inference.fdr(df).orderBy("element_id").toPandas()
    assert len(got) == 400 and np.allclose(got["q"], tails.bh_adjust(p))
    monkeypatch.setattr(inference, "WINDOW_ROWS", 60)
    split = inference.fdr(df).orderBy("element_id").toPandas()
    assert np.allclose(split["q"], tails.bh_adjust(p))
    two = inference.fdr(df.withColumn("sign", F.col("element_id") % 2), ["sign"]).where("sign = 1").orderBy("element_id").toPandas()
    assert np.allclose(two["q"], tails.bh_adjust(p[1::2]))
    assert np.isnan(tails.bh_adjust([np.nan, 0.1])).tolist() == [True, False]
    assert tails.bh_conjunction(np.array([2.0, 3.0]), special.normal_sf, 2) == pytest.approx(tails.bh_adjust(special.normal_sf(np.array([2.0, 3.0])) ** 2))


def test_sequential_rule(spark):
    null = spark.createDataFrame([(k, 1.0, -1.0) for k in range(700)], "perm_id int, t_max double, t_min double")
    s = inference.sequential_stop(null, 1.0)
    assert s.where("stop").agg(F.min("perm_id")).first()[0] == 499
    assert inference.sequential_stop(null, 2.0).where("stop").count() == 0


def test_signed_logs(spark):
    df = spark.createDataFrame([(0.01, 2.0), (0.01, -2.0), (1.0, 0.0), (0.5, float("nan"))], "p double, t double")
    got = [r[0] for r in df.select(inference.log10_signed(F.col("p"), F.col("t"))).collect()]
    assert got[:3] == [2, -2, 0] and math.isnan(got[3])


def test_registered_functions(spark):
    inference.register_functions(spark)
    assert spark.sql("SELECT gpd_tail(3D, 0.5D, 1D), gamma_tail(1D, 0D, 1D, 0D)").first()[0] == 0
    n = spark.sql("SELECT count(*) FROM grid_neighbours(13, 3, 3, 3, 18)").first()[0]
    assert n == 18


def blob_test(spark, **options):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(20, 10, 10, 10))
    k = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 1.5**2))
    for axis in (1, 2, 3):
        y = np.apply_along_axis(np.convolve, axis, y, k / k.sum(), "same")
    y = y / y.std()
    y[:, 3:7, 3:7, 3:7] += 1.4
    flat = y.reshape(20, -1).T
    rows = spark.createDataFrame([(e, v.tolist()) for e, v in enumerate(flat)], "element_id long, y array<double>").repartition(4)
    scheme = design.recognise(design.Design(np.ones((20, 1)), [0]), [1])
    return rows, np.ones((20, 1)), design.draw(scheme, options.pop("n", 200), seed=1), tree.Grid((10, 10, 10)), options


def test_whole_test_finds_the_blob(spark):
    rows, x, signs, space, _ = blob_test(spark)
    out = permutation_test(rows, x, [1], signs, space, signs=True, n_tail=50)
    r = out.result.where("measure = 'enh'").orderBy("element_id").toPandas()
    inside = np.zeros((10, 10, 10), bool)
    inside[3:7, 3:7, 3:7] = True
    near = np.zeros((10, 10, 10), bool)
    near[1:9, 1:9, 1:9] = True
    hit = (r["p_fwe"].to_numpy() < 0.05) & (r["sign"].to_numpy() > 0)
    assert hit[inside.ravel()].mean() > 0.8 and not hit[~near.ravel()].any()
    assert (r["p_unc"] <= 0.6).all() and r["p_unc"].min() < 1 / 200 and (r["p_source"] == "pareto").any()
    assert out.info["permutations"] == 200 and out.null.count() == 200
    # Counts and maxima do not depend on how permutations are dealt out: one task after another gives the same.
    glm = linear.PermutedGLM(np.stack(rows.orderBy("element_id").toPandas()["y"]), x, [1])
    t0 = glm.fit()
    e = np.array([tree.tfce(glm.fit_signs(s), space) for s in signs])
    s0 = np.sign(t0)
    assert np.array_equal(r["cnt"], (s0 * e >= np.sign(e[0]) * e[0]).sum(0))
    assert np.allclose(out.null.orderBy("perm_id").toPandas()["e_max"], e.max(1))


def test_sequential_waves_equal_one_run(spark):
    rows, x, signs, space, _ = blob_test(spark, n=700)
    noise = rows.withColumn("y", F.transform("y", lambda v: v * F.when(F.col("element_id") % 2 == 0, 1).otherwise(-1)))
    out = permutation_test(noise, x, [1], signs, space, signs=True, wave=200, n_tail=40, alpha=0.0001)
    n = out.info["permutations"]
    whole = permutation_test(noise, x, [1], signs[:n], space, signs=True, n_tail=40)
    a, b = (o.result.orderBy("measure", "element_id").toPandas() for o in (out, whole))
    assert np.array_equal(a["cnt"], b["cnt"]) and np.allclose(a["p_unc"], b["p_unc"])


def test_blocks_of_elements_give_the_same(spark):
    rows, x, signs, space, _ = blob_test(spark, n=30)
    obs, null, per = permutation_test_by_blocks(rows, x, [1], signs, space, signs=True, k=10)
    out = permutation_test(rows, x, [1], signs, space, signs=True)
    a = null.orderBy("perm_id").toPandas()
    b = out.null.orderBy("perm_id").toPandas()
    assert np.allclose(a["t_max"], b["e_max"], rtol=1e-5) and per.count() == 1000 and obs.count() == 1000


def test_results_layer(spark, tmp_path):
    res = spark.createDataFrame([(1, k, 1 if k != 3 else -1, float(10 - k), 0.01 * k, 0.02 * k, 0.03 * k) for k in range(6)], "contrast_id int, element_id int, sign int, stat double, p_unc double, p_fwe double, p_fdr double")
    assert [r["element_id"] for r in results.threshold(res, "fwe", 0.05).orderBy("element_id").collect()] == [0, 1, 2]
    assert results.threshold(res, "none", 0.05, inverse=True).count() == 1 and results.threshold(res, "none", 7.5).count() == 3
    with pytest.raises(ValueError):
        results.threshold(res, "all")
    c = results.clusters(res.where("element_id in (0, 1, 3, 5)"), tree.Grid((6, 1, 1), 6))
    assert {(r["element_id"], r["cluster_id"], r["size"]) for r in c.collect()} == {(0, 0, 2), (1, 0, 2), (3, 3, 1), (5, 5, 1)}
    assert results.clusters(res.where("element_id in (0, 1, 3, 5)"), tree.Grid((6, 1, 1), 6), 2).count() == 2
    assert {(r["element_id"], r["value"]) for r in results.export_map(c, "nary").collect()} == {(0, 1), (1, 1), (3, 2), (5, 3)}
    assert {r["value"] for r in results.export_map(c, "binary").collect()} == {1.0}
    with pytest.raises(ValueError):
        results.export_map(c, "other")
    peaks = spark.createDataFrame([(1, 7, 9, 1, 5.0, 0.0, 0.0, 0.0), (1, 7, 9, 2, 4.0, 1.0, 0.0, 0.0), (1, 7, 9, 3, 3.0, 20.0, 0.0, 0.0), (1, 7, 9, 4, 2.0, 40.0, 0.0, 0.0), (1, 8, 1, 5, 9.0, 90.0, 0.0, 0.0)], "contrast_id int, cluster_id int, size int, element_id int, value double, x_mm double, y_mm double, z_mm double")
    table = results.peak_table(peaks, 2, 8.0)
    assert [(r["cluster"], r["peak"], r["element_id"]) for r in table.orderBy("cluster", "peak").collect()] == [(1, 1, 5), (2, 1, 1), (2, 2, 3)]
    frame, footer = results.table_with_footer(table, 23.0, 100, (3.0, 3.0, 3.0), 10)
    assert len(frame) == 3 and footer["volume_mm3"] == 270
    atlas = spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0), (1, "a", 5.0, 0.0, 0.0), (2, "b", 9.9, 0.0, 0.0), (3, "b", 10.1, 0.0, 0.0)], "element_id int, label string, x_mm double, y_mm double, z_mm double")
    got = {(r["element_id"], r["label"]): r["share"] for r in results.sphere_labels(peaks.limit(1), atlas).collect()}
    assert got == {(1, "a"): pytest.approx(2 / 3), (1, "b"): pytest.approx(1 / 3)}
    files.write_result(res, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 6
    files.write_table(table, f"{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == 3
    files.write_info(spark, {"permutations": 5}, f"{tmp_path}/i")
    assert files.read_info(spark, f"{tmp_path}/i") == {"permutations": 5}


def test_images_and_designs(spark, tmp_path):
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    affine = np.array([[-3, 0, 0, 90], [0, 3, 0, -126], [0, 0, 3, -72], [0, 0, 0, 1.0]])
    (tmp_path / "a.nii").write_bytes(files.write_nifti(v, affine))
    got, a = files.parse_nifti((tmp_path / "a.nii").read_bytes())
    assert np.array_equal(got, v) and np.array_equal(a, affine)
    mask = (v % 2 == 1).astype(int)
    df = files.read_images(spark, f"file://{tmp_path}/a.nii", mask).orderBy("element_id").toPandas()
    assert np.array_equal(df["value"], v.ravel(order="F")[v.ravel(order="F") % 2 == 1])
    with pytest.raises(ValueError):
        files.parse_nifti(b"no")
    gii = b'<GIFTI><DataArray DataType="NIFTI_TYPE_INT32" Dimensionality="2" Dim0="2" Dim1="3" Encoding="ASCII" Endian="LittleEndian"><Data>0 1 2 1 2 3</Data></DataArray></GIFTI>'
    (tmp_path / "m.gii").write_bytes(gii)
    assert [tuple(r)[1:] for r in files.read_faces(spark, f"file://{tmp_path}/m.gii").collect()] == [(1, 2, 3), (2, 3, 4)]
    (tmp_path / "d.json").write_text('{"x": [[1, 0], [0, 1], [1, 0]], "roles": {"conditions": [0, 1]}, "contrasts": {"a": [1, -1]}}')
    x, meta = files.read_design(f"file://{tmp_path}/d.json", spark)
    assert x.shape == (3, 2) and meta["contrasts"]["a"].tolist() == [1, -1]
    (tmp_path / "b.txt").write_text("3\n3\n7\n7\n")
    assert files.read_block_labels(spark, f"file://{tmp_path}/b.txt", 4).tolist() == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        files.read_block_labels(spark, f"file://{tmp_path}/b.txt", 5)
    same = files.resample(v.astype(float), affine, (2, 3, 4), affine)
    assert np.allclose(same, v)
    with pytest.raises(ValueError):
        files.resolve_mask(np.ones((2, 2)), None, (2, 3))
    with pytest.raises(ValueError):
        files.maps_from_array(spark, np.zeros((2, 2)))


def test_stream_stops_like_the_batch(spark, tmp_path):
    for k in range(6):
        spark.range(k * 150, k * 150 + 150).withColumnRenamed("id", "perm_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ids")
    maxima = lambda ids: ids.select("perm_id", (F.pmod(F.xxhash64("perm_id"), F.lit(10)) / 10).alias("t_max"), F.lit(0.0).alias("t_min"))
    got = stream_maxima(spark, f"{tmp_path}/ids", maxima, f"{tmp_path}/out", f"{tmp_path}/ck", 0.5)
    want = inference.sequential_stop(maxima(spark.range(900).withColumnRenamed("id", "perm_id")), 0.5).where("stop").agg(F.min("perm_id")).first()[0]
    assert want is not None and got is not None and got >= want - 150


def test_step_up_over_ties_groups_and_ranges(spark, monkeypatch):
    """Counted p that most rows share, null groups, and ranges of few rows: as the array form, row by row."""
    rng = np.random.default_rng(4)
    p = np.where(rng.random(300) < 0.5, 0.01, np.ceil(rng.random(300) * 100) / 100)
    group = [None if k % 3 == 0 else k % 3 for k in range(300)]
    df = spark.createDataFrame([(k, group[k], float(v), 7.0) for k, v in enumerate(p)] + [(300, 1, None, 7.0), (301, 1, float("nan"), 7.0)], "element_id long, sign int, p double, q double")
    for rows in (inference.WINDOW_ROWS, 20):
        monkeypatch.setattr(inference, "WINDOW_ROWS", rows)
        got = {r["element_id"]: r["q"] for r in inference.fdr(df).collect()}
        assert len(got) == 300 and np.allclose([got[k] for k in range(300)], tails.bh_adjust(p))
        got = {r["element_id"]: r["q"] for r in inference.fdr(df, ["sign"]).collect()}
        for g in (None, 1, 2):
            own = [k for k in range(300) if group[k] == g]
            assert np.allclose([got[k] for k in own], tails.bh_adjust(p[own]))
    assert inference.fdr(df.limit(0)).count() == 0
