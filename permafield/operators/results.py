"""Queries over results: thresholds, clusters, peaks, tables, labels.

``result(contrast_id, measure, element_id, sign, stat, enh, p_unc, p_fwe, p_fdr)``; measure is stat or enh.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permafield.functions.special import equivalent_z
from permafield.operators.maps import components

P_COLUMNS = {"fwe": "p_fwe", "fdr": "p_fdr", "none": "p_unc"}


def inverse_contrast(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: -F.col(c) for c in cols})


def threshold(result: DataFrame, on: str = "fwe", u: float = 0.05, inverse: bool = False, stat: str = "stat") -> DataFrame:
    """Elements of the contrast's own sign whose p is below ``u``; with ``on="none"`` and ``u`` of 1 or more, whose statistic is above it."""
    if on not in P_COLUMNS:
        raise ValueError(f"threshold on fwe, fdr or none, not {on!r}")
    side = F.col("sign") == (-1 if inverse else 1)
    if on == "none" and u >= 1:
        return result.where(side & ((-F.col(stat) if inverse else F.col(stat)) > u))
    return result.where(side & (F.col(P_COLUMNS[on]) < u))


def clusters(survivors: DataFrame, space, k: int = 0, by: str = "contrast_id") -> DataFrame:
    """Survivors with ``cluster_id`` and ``size``, of clusters of ``k`` elements or more."""
    found = components(survivors, space, by)
    return survivors.join(found, [by, "element_id"]).where(F.col("size") >= k)


def cluster_ranks(clustered: DataFrame, by: str = "contrast_id") -> DataFrame:
    """Clusters by size, largest first (ties: smallest id): ``by, cluster_id, size, rank``."""
    one = clustered.select(by, "cluster_id", "size").distinct()
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("size"), "cluster_id")))


def local_maxima(values: DataFrame, edges: DataFrame, by: str = "map_id", col: str = "value") -> DataFrame:
    """Elements with no neighbour of a larger value among ``values``."""
    near = values.select(F.col(by), F.col("element_id").alias("dst"), F.col(col).alias("other"))
    beaten = values.join(edges, values["element_id"] == edges["src"]).join(near, [by, "dst"]).where(F.col("other") > F.col(col)).select(by, "element_id").distinct()
    return values.join(beaten, [by, "element_id"], "left_anti")


def to_mm(df: DataFrame, affine) -> DataFrame:
    """``x_mm, y_mm, z_mm`` of ``x, y, z`` by the first three rows of a 4 by 4 matrix."""
    a = np.asarray(affine, float)
    return df.withColumns({f"{n}_mm": float(a[i, 0]) * F.col("x") + float(a[i, 1]) * F.col("y") + float(a[i, 2]) * F.col("z") + float(a[i, 3]) for i, n in enumerate("xyz")})


def peak_table(maxima: DataFrame, num: int = 3, min_dist: float = 8.0, by: str = "contrast_id") -> DataFrame:
    """Peaks cluster by cluster, the cluster of the largest value first: its largest, then up to ``num`` in all that lie more
    than ``min_dist`` from those listed. ``maxima`` have ``cluster_id, size, element_id, value, x_mm, y_mm, z_mm``.

    The choice within a cluster depends on its order, so each cluster is one group; ties go to the smaller element.
    """
    kind = maxima.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "element_id"], ascending=[False, True])
        at = pdf[["x_mm", "y_mm", "z_mm"]].to_numpy(float)
        listed = [0]
        for i in range(1, len(pdf)):
            if len(listed) >= num:
                break
            if np.sqrt(((at[listed] - at[i]) ** 2).sum(1)).min() > min_dist:
                listed.append(i)
        out = pdf.iloc[listed][[by, "cluster_id", "size", "element_id", "value", "x_mm", "y_mm", "z_mm"]].copy()
        out["peak"] = np.arange(1, len(out) + 1)
        return out

    picked = maxima.groupBy(by, "cluster_id").applyInPandas(one, f"{by} {kind}, cluster_id int, size int, element_id int, value double, x_mm double, y_mm double, z_mm double, peak int")
    best = picked.where("peak = 1").select(by, "cluster_id", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), "element_id")).alias("cluster"))
    return picked.join(best, [by, "cluster_id"])


def nearest_element(df: DataFrame, point: tuple[float, float, float]) -> DataFrame:
    """The row nearest to a point, ties to the smaller element."""
    d = sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(("x_mm", "y_mm", "z_mm"), point))
    return df.withColumn("distance", F.sqrt(d)).orderBy("distance", "element_id").limit(1)


def members_of_cluster(clustered: DataFrame, element_id: int, by: str = "contrast_id") -> DataFrame:
    """All elements of the clusters that hold an element."""
    own = clustered.where(F.col("element_id") == element_id).select(by, "cluster_id").distinct()
    return clustered.join(own, [by, "cluster_id"])


def atlas_shares(clustered: DataFrame, atlas: DataFrame, by: str = "contrast_id") -> DataFrame:
    """``by, cluster_id, label, share``: what part of each cluster lies in each atlas region; elements outside count as no label."""
    labelled = clustered.join(atlas.select("element_id", "label"), "element_id", "left").groupBy(by, "cluster_id", "size", "label").agg(F.count("*").alias("n"))
    return labelled.select(by, "cluster_id", F.coalesce("label", F.lit("none")).alias("label"), (F.col("n") / F.col("size")).alias("share"))


def sphere_labels(points: DataFrame, atlas: DataFrame, radius: float = 10.0) -> DataFrame:
    """``element_id, label, share`` of atlas elements within ``radius`` of each peak; cells of that width limit the pairs compared."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    p = points.select("element_id", *[F.col(c).alias("p" + c) for c in ("x_mm", "y_mm", "z_mm")])
    p = p.withColumns({f"c{c}": F.floor(F.col("p" + c) / radius) for c in ("x_mm", "y_mm", "z_mm")})
    for c in ("x_mm", "y_mm", "z_mm"):
        p = p.withColumn("step", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("step")).drop("step")
    a = atlas.select("label", "x_mm", "y_mm", "z_mm", *[cell(c).alias(f"c{c}") for c in ("x_mm", "y_mm", "z_mm")])
    d = sum((F.col(c) - F.col("p" + c)) ** 2 for c in ("x_mm", "y_mm", "z_mm"))
    inside = p.join(a, ["cx_mm", "cy_mm", "cz_mm"]).where(d <= radius * radius).groupBy("element_id", "label").agg(F.count("*").alias("n"))
    return inside.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("element_id"))).drop("n")


def smoothness(residuals: DataFrame, grid: tuple[int, int, int], col: str = "y") -> DataFrame:
    """``n, n_inner, resels, fwhm_x, fwhm_y, fwhm_z``: the smoothness of residual fields ``element_id, y`` (one value for each observation), in elements.

    Residuals are scaled to a unit sum of squares at each element; differences to the next element on each axis estimate the covariance of
    the fields' spatial derivatives, averaged over elements that have all these neighbours. A Gaussian field has a width at half maximum of
    sqrt(4 ln 2 / variance of its derivative), and its resels follow from the determinant of the covariance. Axes of one element are left
    out (their width is null); elements without residuals take no part. One equi-join for each axis.
    """
    step = {"x": 1, "y": grid[0], "z": grid[0] * grid[1]}
    place = {"x": F.col("element_id") % grid[0], "y": F.floor(F.col("element_id") / grid[0]) % grid[1], "z": F.floor(F.col("element_id") / (grid[0] * grid[1]))}
    axes = [a for a, g in zip("xyz", grid) if g > 1]
    length = F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, v: s + v * v))
    u = residuals.select("element_id", F.col(col), length.alias("len")).where("len > 0").select("element_id", F.transform(col, lambda v: v / F.col("len")).alias("u"))
    at = u
    for a, g in zip("xyz", grid):
        if a in axes:
            near = u.select((F.col("element_id") - step[a]).alias("element_id"), F.col("u").alias(f"u{a}"))
            at = at.where(place[a] < g - 1).join(near, "element_id")
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    change = lambda a: F.zip_with(f"u{a}", "u", lambda p, q: p - q)
    products = [F.avg(F.aggregate(F.zip_with(change(a), change(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)).alias(a + b) for a, b in pairs]
    one = F.lit(1).alias("one")
    cov = at.agg(F.count("*").alias("n_inner"), *products).select("*", one).join(u.agg(F.count("*").alias("n")).select("*", one), "one")
    m = lambda a, b: F.col(a + b if a + b in {p + q for p, q in pairs} else b + a)
    det = {
        1: lambda i: m(i, i),
        2: lambda i, j: m(i, i) * m(j, j) - m(i, j) ** 2,
        3: lambda i, j, k: m(i, i) * (m(j, j) * m(k, k) - m(j, k) ** 2) - m(i, j) * (m(i, j) * m(k, k) - m(j, k) * m(i, k)) + m(i, k) * (m(i, j) * m(j, k) - m(j, j) * m(i, k)),
    }
    four = 4 * np.log(2)
    density = F.sqrt(F.greatest(det[len(axes)](*axes), F.lit(0.0)) / four ** len(axes)) if axes else F.lit(1.0)
    width = [(F.sqrt(F.try_divide(F.lit(four), m(a, a))) if a in axes else F.lit(None).cast("double")).alias(f"fwhm_{a}") for a in "xyz"]
    return cov.select("n", "n_inner", (F.col("n") * density).alias("resels"), *width)


def ascents(values: DataFrame, edges: DataFrame, by: str = "map_id", col: str = "value") -> DataFrame:
    """``values`` with ``peak``: the maximum that steepest ascent over ``edges(src, dst)`` ends in, so elements of one peak are a watershed basin.

    Every element points to its highest neighbour among ``values`` if that is higher than itself (of equal values the smaller id is higher);
    pointers are doubled, a join and a written table a round, until none moves: as many rounds as the logarithm of the longest ascent.
    """
    from permafield.sources.files import drop_scratch, scratch

    near = values.select(F.col(by), F.col("element_id").alias("dst"), F.col(col).alias("other"))
    own = values.select(by, F.col("element_id").alias("src"), F.col(col).alias("value"))
    higher = (F.col("other") > F.col("value")) | ((F.col("other") == F.col("value")) & (F.col("dst") < F.col("src")))
    best = own.join(edges.select("src", "dst"), "src").join(near, [by, "dst"]).where(higher).groupBy(by, "src").agg(F.max_by("dst", F.struct("other", -F.col("dst"))).alias("up"))
    ways = scratch(own.select(by, "src").join(best, [by, "src"], "left").select(by, "src", F.coalesce("up", "src").alias("up")), "ascent")
    while True:
        next_ = ways.select(by, F.col("src").alias("up"), F.col("up").alias("further"))
        new = scratch(ways.join(next_, [by, "up"]).select(by, "src", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), "ascent")
        moved = new.where("moved").isEmpty()
        drop_scratch(ways)
        ways = new.drop("moved")
        ways._written_at = new._written_at
        if moved:
            break
    return values.join(ways.select(by, F.col("src").alias("element_id"), F.col("up").alias("peak")), [by, "element_id"])


def mesh_peaks(values: DataFrame, edges: DataFrame, space, min_dist: float = 0.0, k: int = 0, by: str = "map_id", col: str = "value") -> DataFrame:
    """Maxima on a mesh: ``by, cluster, cluster_id, size, rank, element_id, value, basin``, components by their highest peak, peaks by value.

    ``basin`` counts the elements whose steepest ascent ends in the peak. A peak within ``min_dist`` along the mesh (edges have their ``length``, or
    one) of a higher one that is listed is not listed. Components have ``k`` elements or more. Distances are spread from the peaks no
    further than ``min_dist``; the choice is made in rounds, in each of which peaks that no open higher peak is near are listed.
    """
    from permafield.sources.files import scratch

    found = clusters(values, space, k, by)
    climbed = ascents(found.select(by, "element_id", col), edges, by, col)
    basins = climbed.groupBy(by, F.col("peak").alias("element_id")).agg(F.count("*").alias("basin"))
    peaks = scratch(found.select(by, "element_id", F.col(col).alias("value"), "cluster_id", "size").join(basins, [by, "element_id"]), "peaks")
    if min_dist > 0:
        weighted = edges.select("src", "dst", (F.col("length") if "length" in edges.columns else F.lit(1.0)).alias("length"))
        near = scratch(peaks.select(by, F.col("element_id").alias("peak"), "element_id", F.lit(0.0).alias("dist")), "near")
        while True:
            inside = found.select(by, "element_id")
            step = near.join(weighted, near["element_id"] == weighted["src"]).select(by, "peak", F.col("dst").alias("element_id"), (F.col("dist") + F.col("length")).alias("dist")).where(F.col("dist") <= min_dist)
            all_ = near.unionByName(step.join(inside, [by, "element_id"], "left_semi").select(near.columns)).groupBy(by, "peak", "element_id").agg(F.min("dist").alias("dist"))
            new = scratch(all_, "near")
            before, after = (x.agg(F.count("*"), F.round(F.sum("dist"), 6)).first() for x in (near, new))
            near = new
            if before == after:
                break
        value = peaks.select(by, "element_id", "value")
        rival = near.where("peak <> element_id").join(value, [by, "element_id"]).withColumnRenamed("value", "v").join(value.select(by, F.col("element_id").alias("peak"), F.col("value").alias("other")), [by, "peak"])
        beats = (F.col("other") > F.col("v")) | ((F.col("other") == F.col("v")) & (F.col("peak") < F.col("element_id")))
        rival = scratch(rival.where(beats).select(by, "element_id", "peak"), "rivals")  # a listed ``peak`` keeps ``element_id`` out
        open_, listed = peaks.select(by, "element_id"), None
        while not open_.isEmpty():
            waits = rival.join(open_.select(by, F.col("element_id").alias("peak")), [by, "peak"], "left_semi").select(by, "element_id").distinct()
            chosen = open_.join(waits, [by, "element_id"], "left_anti")
            out = rival.join(chosen.select(by, F.col("element_id").alias("peak")), [by, "peak"], "left_semi").select(by, "element_id").distinct()
            listed = chosen if listed is None else listed.unionByName(chosen)
            listed = scratch(listed, "listed")
            open_ = scratch(open_.join(listed, [by, "element_id"], "left_anti").join(out, [by, "element_id"], "left_anti"), "open")
        peaks = peaks.join(listed, [by, "element_id"], "left_semi") if listed is not None else peaks
    order = Window.partitionBy(by, "cluster_id").orderBy(F.desc("value"), "element_id")
    ranked = peaks.withColumn("rank", F.row_number().over(order))
    tops = ranked.where("rank = 1").select(by, "cluster_id", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), "element_id")).alias("cluster"))
    return ranked.join(tops, [by, "cluster_id"]).select(by, "cluster", "cluster_id", "size", "rank", "element_id", "value", "basin")


def peaks_of_cluster(peaks: DataFrame, element_id: int, clustered: DataFrame, by: str = "map_id") -> DataFrame:
    """The rows of :func:`mesh_peaks` or :func:`peak_table` of the clusters that hold an element."""
    own = clustered.where(F.col("element_id") == element_id).select(by, "cluster_id").distinct()
    return peaks.join(own, [by, "cluster_id"], "left_semi")


def conjunction(maps: DataFrame, cols: list[str]) -> DataFrame:
    """``value``: the least of several statistics of each element."""
    return maps.withColumn("value", F.least(*cols))


def table_with_footer(peaks: DataFrame, df: float, n_perm: int, voxel_mm: tuple[float, float, float], n_elements: int, p: str | None = None, smooth: DataFrame | None = None) -> tuple[pd.DataFrame, dict]:
    """The peaks as a local table with equivalent Z, and what a printed table states below it. Peaks are bounded by clusters. ``smooth``: the row of
    :func:`smoothness`, whose widths are stated in elements and mm."""
    rows = peaks.orderBy("cluster", "peak").toPandas()
    if p:
        rows["z"] = equivalent_z(rows[p].to_numpy(float))
    size = float(np.prod(voxel_mm))
    footer = {}
    if smooth is not None:
        w = smooth.first()
        fwhm = tuple(w[f"fwhm_{a}"] for a in "xyz")
        footer = {"fwhm": fwhm, "fwhm_mm": tuple(None if f is None else f * v for f, v in zip(fwhm, voxel_mm)), "resels": w["resels"]}
    return rows, footer | {"df": df, "permutations": n_perm, "voxel_mm": tuple(voxel_mm), "voxel_mm3": size, "volume_mm3": size * n_elements, "elements": n_elements}


def export_map(df: DataFrame, kind: str = "thresholded", by: str = "contrast_id", stat: str = "stat") -> DataFrame:
    """``by, element_id, value`` of survivors: their statistic, 1 (binary) or their cluster's rank (nary)."""
    if kind == "thresholded":
        return df.select(by, "element_id", F.col(stat).cast("float").alias("value"))
    if kind == "binary":
        return df.select(by, "element_id", F.lit(1.0).cast("float").alias("value"))
    if kind == "nary":
        return df.join(cluster_ranks(df, by).select(by, "cluster_id", "rank"), [by, "cluster_id"]).select(by, "element_id", F.col("rank").cast("float").alias("value"))
    raise ValueError(f"export thresholded, binary or nary maps, not {kind!r}")
