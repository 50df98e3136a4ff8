"""Step-up values at any p, smoothness, maxima on meshes, and the rule over a stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permafield.functions import special, tails, tree
from permafield.operators import inference, models, results
from permafield.streaming import waves

RNG = np.random.default_rng(12)


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_step_up_values_at_any_p(spark, monkeypatch, rows):
    monkeypatch.setattr(inference, "WINDOW_ROWS", rows)
    p = np.round(RNG.random(400) ** 2, 3)
    group = RNG.integers(0, 3, 400)
    at = np.round(RNG.random(150), 3)
    points = spark.createDataFrame([(k, int(k % 3), float(v)) for k, v in enumerate(at)] + [(150, 0, None), (151, 0, float("nan")), (152, 1, 1.5), (153, 7, 0.1)], "k long, g int, p double")
    image = spark.createDataFrame([(int(g), float(v)) for g, v in zip(group, p)] + [(0, None), (1, float("nan"))], "g int, p double")

    def want(own, v):
        s = np.sort(own)
        q = s * len(s) / np.arange(1, len(s) + 1)
        i = np.searchsorted(s, v)
        return 1.0 if i == len(s) else min(1.0, q[i:].min())

    got = {r["k"]: r["q"] for r in inference.fdr_at(points, image).collect()}
    assert len(got) == 154 and got[150] is None and got[151] is None and got[152] == 1.0
    assert np.allclose([got[k] for k in range(150)], [want(p, v) for v in at])
    got = {r["k"]: r["q"] for r in inference.fdr_at(points, image, ["g"]).collect()}
    assert np.allclose([got[k] for k in range(150)], [want(p[group == k % 3], v) for k, v in enumerate(at)]) and got[153] == 1.0
    assert inference.fdr_at(points.limit(0), image).count() == 0


def test_p_of_every_kind_and_conjunction(spark):
    t = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0.01, 0.3, 0.9])], "k int, t double")
    for kind, df1, df2 in (("z", 1, 1), ("t", 1, 9), ("F", 3, 9), ("X", 4, 1), ("R", 1, 9), ("P", 1, 1)):
        one = np.array([0.01, 0.3, 0.9]) if kind == "P" else special.statistic_sf(np.array([0.01, 0.3, 0.9]), kind, df1, df2)
        for n, power in ((1, 1), (3, 1), (-1, 1), (-3, 3)):
            got = inference.statistic_p(t, kind, df1, df2, n).orderBy("k").toPandas()["p"]
            assert np.allclose(got, one**power), (kind, n)
    z = RNG.normal(size=60)
    image = inference.statistic_p(spark.createDataFrame([(float(v),) for v in z], "t double"), "z", n=-2)
    got = inference.fdr_at(image, image.select("p")).toPandas()
    assert np.allclose(np.sort(got["q"]), np.sort(tails.bh_conjunction(z, special.normal_sf, 2)))


def gaussian(shape, fwhm, n):
    out = RNG.normal(size=(n, *shape))
    for axis, w in enumerate(fwhm, 1):
        if w:
            s = w / np.sqrt(8 * np.log(2))
            k = np.exp(-0.5 * (np.arange(-20, 21) / s) ** 2)
            out = np.apply_along_axis(lambda v, k=k: np.convolve(v, k, "same"), axis, out)
    return out[:, 8:-8, 8:-8, :] if shape[2] == 1 else out[:, 8:-8, 8:-8, 8:-8]


def test_smoothness_of_known_fields(spark):
    for shape, fwhm in (((36, 34, 32), (4.0, 5.0, 6.0)), ((40, 44, 1), (5.0, 3.5, 0))):
        data = gaussian(shape, fwhm, 24)
        grid = data.shape[1:]
        flat = data.transpose(0, 3, 2, 1).reshape(24, -1).T + 10
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(flat)], "element_id long, y array<double>").repartition(8)
        got = results.smoothness(models.residuals(rows, np.ones((24, 1))), grid).first()
        for a, w in zip("xyz", fwhm):
            assert got[f"fwhm_{a}"] is None if not w else got[f"fwhm_{a}"] == pytest.approx(w, rel=0.1), (a, w)
        assert got["resels"] == pytest.approx(np.prod(grid) / np.prod([w for w in fwhm if w]), rel=0.25) and got["n"] == np.prod(grid)
    white = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(RNG.normal(size=(1000, 40)))], "element_id long, y array<double>")
    got = results.smoothness(models.residuals(white, np.ones((40, 1))), (10, 10, 10)).first()
    for a in "xyz":  # neighbours of white noise share nothing: the variance of a difference is 2
        assert got[f"fwhm_{a}"] == pytest.approx(np.sqrt(4 * np.log(2) / 2), rel=0.1)
    _, footer = results.table_with_footer(spark.createDataFrame([(1, 1)], "cluster int, peak int"), 5.0, 10, (2.0, 2.0, 3.0), 100, smooth=results.smoothness(models.residuals(white, np.ones((40, 1))), (10, 10, 10)))
    assert footer["fwhm_mm"][2] == pytest.approx(3 * footer["fwhm"][2]) and footer["resels"] > 0


def lattice_edges(spark, k):
    e = [(a, a + s) for a in range(k * k) for s, ok in ((1, a % k < k - 1), (k, a < k * k - k), (k + 1, a % k < k - 1 and a < k * k - k)) if ok]
    return spark.createDataFrame([x for a, b in e for x in ((a, b), (b, a))], "src long, dst long"), e


def test_maxima_on_a_mesh(spark):
    k = 14
    edges, pairs = lattice_edges(spark, k)
    near = {v: set() for v in range(k * k)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    v = np.round(RNG.normal(size=k * k) + 0.4, 1)  # with equal values
    values = spark.createDataFrame([(m, e, float(x)) for m in (1, 2) for e, x in enumerate(v * (1 if m == 1 else -1)) if x > 0], "map_id int, element_id long, value double")
    space = tree.Mesh(k * k, *zip(*pairs))
    for m in (1, 2):
        own = {e: x * (1 if m == 1 else -1) for e, x in enumerate(v) if x * (1 if m == 1 else -1) > 0}
        key = lambda e: (own[e], -e)

        def climb(e):
            up = max((n for n in near[e] if n in own), key=key, default=e)
            return climb(up) if key(up) > key(e) else e

        got = {r["element_id"]: r["peak"] for r in results.ascents(values, edges).where(F.col("map_id") == m).collect()}
        assert got == {e: climb(e) for e in own}
        comp = {}
        for e in own:
            if e not in comp:
                stack, seen = [e], {e}
                while stack:
                    for n in near[stack.pop()]:
                        if n in own and n not in seen:
                            seen.add(n)
                            stack.append(n)
                comp |= {s: frozenset(seen) for s in seen}
        for reach in (0, 3):
            rows = [r for r in results.mesh_peaks(values, edges, space, reach, 2).collect() if r["map_id"] == m]
            want = {p for p in set(got.values()) if len(comp[p]) >= 2}
            if reach:
                listed = []
                for p in sorted(want, key=key, reverse=True):
                    front, seen = {p}, {p}
                    for _ in range(reach):
                        front = {n for f in front for n in near[f] if n in own} - seen
                        seen |= front
                    if not seen & set(listed):
                        listed.append(p)
                want = set(listed)
            assert {r["element_id"] for r in rows} == want
            for r in rows:
                assert r["size"] == len(comp[r["element_id"]]) and r["cluster_id"] == min(comp[r["element_id"]]) and r["basin"] == sum(p == r["element_id"] for p in got.values())
            tops = sorted((r for r in rows if r["rank"] == 1), key=lambda r: r["cluster"])
            assert [r["element_id"] for r in tops] == sorted((r["element_id"] for r in tops), key=key, reverse=True)
    clustered = results.clusters(values, space, 2, "map_id")
    some = clustered.where("map_id = 1").first()
    one = results.peaks_of_cluster(results.mesh_peaks(values, edges, space, 0, 2), some["element_id"], clustered)
    assert {r["cluster_id"] for r in one.where("map_id = 1").collect()} == {some["cluster_id"]}


def test_the_rule_over_a_stream_survives_a_restart(spark, tmp_path):
    """The same stop as the batch rule, with the counts of each contrast in Spark's state, before and after a restart."""
    top = {c: RNG.normal(size=1200) for c in ("a", "b")}
    null = {c: pd.DataFrame({"perm_id": np.arange(1200), "t_max": v, "t_min": -RNG.normal(size=1200)}) for c, v in top.items()}
    observed = {"a": (1.0, None), "b": (0.8, -0.9)}
    want = {}
    for c, frame in null.items():
        rule = inference.sequential_stop(spark.createDataFrame(frame), observed[c][0], 0.01, observed_min=observed[c][1])
        want[c] = rule.where("stop").agg(F.min("perm_id")).first()[0]
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def wave(k):
        part = pd.concat([f.iloc[k * 200 : k * 200 + 200].sample(frac=1, random_state=1).assign(contrast=c) for c, f in null.items()])
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("perm_id long, t_max double, t_min double, contrast string").option("maxFilesPerTrigger", 1).parquet(source)
        keep = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
        q = waves.sequential_stream(stream, observed, 0.01).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(3):
        wave(k)
    run()
    half = {r["contrast"]: r for r in spark.read.parquet(target).where("m > 0").groupBy("contrast").agg(F.max("m").alias("m"), F.max("stop").alias("stop")).collect()}
    assert all(half[c]["m"] == 600 if want[c] is None or want[c] >= 600 else half[c]["stop"] == want[c] for c in want)
    for k in range(3, 6):
        wave(k)
    run()
    last = {r["contrast"]: r["stop"] for r in spark.read.parquet(target).groupBy("contrast").agg(F.max("stop").alias("stop")).collect()}
    assert want["a"] is not None and last == {c: -1 if w is None else w for c, w in want.items()}


def test_counts_tell_where_the_rule_stops(spark):
    t = RNG.normal(size=900)
    rule = inference.sequential_stop(spark.createDataFrame([(k, float(v), float(-v)) for k, v in enumerate(t)], "perm_id long, t_max double, t_min double"), 1.2, 0.01).where("stop").agg(F.min("perm_id")).first()[0]
    state = (0, 0, 0, -1)
    for at in range(0, 900, 130):
        own = RNG.permutation(np.arange(at, min(900, at + 130)))
        state = waves.advance(state, own, t[own], -t[own], 1.2, None, 0.01)
    assert state[3] == rule is not None
