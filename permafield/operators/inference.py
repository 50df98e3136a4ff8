"""Reductions over permutations, and p-values, as DataFrame operators.

``stats(perm_id, element_id, t)`` holds permuted statistics, ``obs(element_id, t)`` the observed ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permafield.functions import special, tails

#: Most maxima that are sent to every task: one for each permutation.
MOST_NULL = 5_000_000
#: Rows up to which groups are ranked in one window each, and groups that are done one by one beyond that.
WINDOW_ROWS, FEW_GROUPS = 1_000_000, 64


def clean_stat(c: Column, f_map: bool = False) -> Column:
    """Non-finite statistics as 0, and negative ones too if they are F."""
    ok = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    return F.greatest(ok, F.lit(0.0)) if f_map else ok


def sign_masks(df: DataFrame, col: str = "t") -> DataFrame:
    """``mask``: P, N, 0 or NaN of each statistic, taken before cleaning."""
    c = F.col(col)
    return df.withColumn("mask", F.when(F.isnan(c), "NaN").when(c > 0, "P").when(c < 0, "N").otherwise("0"))


def max_null(stats: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """``perm_id, t_max, t_min`` over elements whose observed statistic is not 0."""
    s = stats if obs is None else stats.join(obs.where("t <> 0").select("element_id"), "element_id", "left_semi")
    return s.groupBy("perm_id").agg(F.max("t").alias("t_max"), F.min("t").alias("t_min"))


def exceedances(stats: DataFrame, obs: DataFrame) -> DataFrame:
    """``element_id, sign, cnt, n_draws``: permutations in which ``sign * t`` reaches the observed ``sign * t``."""
    o = obs.where("t <> 0").select("element_id", F.col("t").alias("t0"), F.signum("t").cast("int").alias("sign"))
    hit = F.col("sign") * F.col("t") >= F.col("sign") * F.col("t0")
    return stats.join(o, "element_id").groupBy("element_id", "sign").agg(F.count_if(hit).alias("cnt"), F.count("*").alias("n_draws"))


#: Bytes that a task holds of largest draws, and the share of permutations (one in so many) that a pilot takes.
TAIL_BYTES, PILOT = 64 << 20, 16


def tail_topk(stats: DataFrame, obs: DataFrame, k: int, most_bytes: int = TAIL_BYTES, prune: bool = False) -> DataFrame:
    """``element_id, top``: the ``k`` largest ``sign * t`` of each element, descending.

    Tasks reduce their own draws first, within ``most_bytes``: what does not fit is given on and merged later, so the rows are the same at any
    bound. ``prune``: a pilot over one permutation in PILOT sets a threshold for each element (its ``k``-th largest there, which no
    larger set can fall below), and draws under it are passed over before they are reduced; it comes with the observed statistics, in
    the same join.
    """
    o = obs.where("t <> 0").select("element_id", F.signum("t").alias("sign"))
    kind = stats.schema["element_id"].dataType.simpleString()

    def reduced(s: DataFrame, o: DataFrame) -> DataFrame:
        signed = s.join(o, "element_id").withColumn("v", F.col("sign") * F.col("t"))
        signed = (signed.where("floor_v is null or v >= floor_v") if "floor_v" in o.columns else signed).select("element_id", "v")

        def rows(pair):
            e, v = pair
            if len(e):
                cut = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                yield pd.DataFrame({"element_id": e[cut], "part": [p.tolist() for p in np.split(v, cut[1:])]})

        def partial(batches):
            held = tails.LargestDraws(k, most_bytes)
            for pdf in batches:
                if (given := held.add(pdf["element_id"].to_numpy(), pdf["v"].to_numpy(float))) is not None:
                    # An element given up twice within one call has two runs: they are rows of their own.
                    yield from rows(given)
            yield from rows(held.rest())

        parts = signed.mapInPandas(partial, f"element_id {kind}, part array<double>")
        return parts.groupBy("element_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("part")), asc=False), 1, k).alias("top"))

    if prune:
        pilot = reduced(stats.where(F.pmod(F.xxhash64("perm_id"), F.lit(PILOT)) == 0), o).where(F.size("top") == k)
        o = o.join(pilot.select("element_id", F.col("top")[k - 1].alias("floor_v")), "element_id", "left")
    return reduced(stats, o)


def null_map(stats: DataFrame) -> DataFrame:
    """``element_id, null_t``: sum of permuted statistics over the root of their number less one."""
    n = F.count("*")
    return stats.groupBy("element_id").agg((F.sum("t") / F.sqrt(n - 1)).alias("null_t"))


def running_thresholds(null: DataFrame, alphas=(0.05, 0.01, 0.001), col: str = "t_max") -> DataFrame:
    """``alpha, threshold``: the order statistic ``ceil((1 - alpha) n)`` of the maxima."""
    n = null.count()
    ranked = null.select(F.col(col).alias("threshold"), F.row_number().over(Window.orderBy(col)).alias("r"))  # a row for each permutation
    want = null.sparkSession.createDataFrame([(float(a), int(np.ceil(round((1 - a) * n, 9)))) for a in alphas], "alpha double, r int")
    return ranked.join(F.broadcast(want), "r").select("alpha", "threshold")


def histogram(null: DataFrame, bins: int = 100, col: str = "t_max") -> DataFrame:
    """``bin, n`` of equal bins between the least and the largest value; empty bins are left out."""
    lo, hi = null.agg(F.min(col), F.max(col)).first()
    span = (hi - lo) or 1.0
    b = F.least(F.floor((F.col(col) - lo) / span * bins), F.lit(bins - 1)).cast("int")
    return null.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def moments(null: DataFrame, col: str = "t_max") -> DataFrame:
    """``n, mean, var, skew`` with the unbiased variance and the bias-corrected skewness."""
    n = F.count(col)
    return null.agg(n.alias("n"), F.avg(col).alias("mean"), F.var_samp(col).alias("var"), (F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))


def mirrored(null: DataFrame) -> DataFrame:
    """The maxima of half the permutations with those of their mirror images: ``-min`` and ``-max``."""
    return null.select("perm_id", F.lit(0).alias("half"), "t_max", "t_min").unionByName(null.select("perm_id", F.lit(1).alias("half"), (-F.col("t_min")).alias("t_max"), (-F.col("t_max")).alias("t_min")))


def count_unc(cnt: DataFrame) -> DataFrame:
    """``p``: counted exceedances over draws."""
    return cnt.withColumn("p", F.col("cnt") / F.col("n_draws"))


def _null_values(null: DataFrame, col: str) -> np.ndarray:
    n = null.count()
    if n > MOST_NULL:
        raise ValueError(f"{n} maxima are more than can be sent to every task ({MOST_NULL})")
    return np.sort(null.select(col).toPandas()[col].to_numpy(float))


def count_fwe(obs: DataFrame, null: DataFrame, stat: str = "t", col: str = "t_max") -> DataFrame:
    """``p``: share of the maxima that reach each statistic. The maxima, one for each permutation, go to every task."""
    values = _null_values(null, col)
    n = len(values)

    @F.pandas_udf(T.DoubleType())
    def p(x: pd.Series) -> pd.Series:
        return pd.Series((n - np.searchsorted(values, x.to_numpy(float), "left")) / n)

    return obs.withColumn("p", p(F.col(stat).cast("double")))


def gamma_fwe(obs: DataFrame, null: DataFrame, floor: float | None = None, mode: str = "clip", stat: str = "t", col: str = "t_max", fwe: str = "two_sided") -> DataFrame:
    """``p``: family-wise p from the Gamma law of the maxima; only their moments leave the cluster unless they must be counted.

    ``fwe="per_sign"``: negative statistics are judged by the law of the negated minima ``t_min``.
    """

    def law(c: Column):
        m = moments(null.select(c.alias("v")), "v").first()
        n, skew = m["n"], m["skew"]
        sample = None
        if n < 3:
            raise ValueError("a Gamma fit needs three finite maxima at least")
        if mode != "reflect" and not (skew is not None and skew > 0):
            sample = _null_values(null.select(c.alias("v")), "v")
        return (m["mean"], m["var"], skew if skew is not None else 0.0), sample, (1 / n if floor is None else floor)

    laws = {1: law(F.col(col))}
    if fwe == "per_sign":
        laws[-1] = law(-F.col("t_min"))

    @F.pandas_udf(T.DoubleType())
    def p(x: pd.Series) -> pd.Series:
        x = x.to_numpy(float)
        out = np.empty(len(x))
        for s in (1, -1):
            on = x >= 0 if s == 1 else x < 0
            if s not in laws:
                on = np.zeros(len(x), bool) if s == -1 else np.ones(len(x), bool)
            if on.any():
                fit, sample, least = laws[s]
                v = s * x[on] if len(laws) == 2 else x[on]
                q = tails.count_pvalue(v, sample) if sample is not None else tails.gamma_sf(v, *fit, mode)
                out[on] = np.clip(q, least, 1)
        return pd.Series(out)

    return obs.withColumn("p", p(F.col(stat).cast("double")))


def gpd_shapes(tail: DataFrame, n_shape: int = 20_000) -> dict[int, float]:
    """Median shapes by tail size over at most ``n_shape`` elements, evenly taken by a hash: the shape is a pooled estimate."""
    n = tail.count()
    step = max(1, n // n_shape)
    rows = tail.where(F.pmod(F.xxhash64("element_id"), F.lit(step)) == 0).select("top").limit(2 * n_shape)
    k = rows.select(F.size("top")).first()
    if k is None:
        return {}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shapes(top: pd.Series) -> pd.Series:
        t = np.sort(np.stack(top.to_numpy()), 1)[:, ::-1]
        cols = [tails.gpd_fit(tails._excess(t, m)[1])[0] for m in tails.tail_sizes(t.shape[1])]
        return pd.Series(list(np.stack(cols, 1)) if cols else [[]] * len(t))

    sizes = tails.tail_sizes(k[0])
    fitted = rows.select(shapes("top").alias("s"))
    if not sizes:
        return {}
    finite = [F.expr(f"percentile(CASE WHEN NOT isnan(s[{i}]) AND abs(s[{i}]) < double('infinity') THEN s[{i}] END, 0.5)").alias(f"m{m}") for i, m in enumerate(sizes)]
    row = fitted.agg(*finite).first()
    return {m: row[f"m{m}"] if row[f"m{m}"] is not None else float("nan") for m in sizes}


def pareto_unc(obs: DataFrame, tail: DataFrame, cnt: DataFrame, n_perm: int, least: int = 25, worst: float = 5.0) -> DataFrame:
    """``element_id, p, p_source``: counted, or the fitted tail where fewer than ``least`` draws reached the statistic.

    Two passes: shapes are pooled by a median, then every element is fitted on its own.
    """
    shapes = gpd_shapes(tail)
    joined = obs.select("element_id", F.abs("t").cast("double").alias("stat")).join(tail.select("element_id", "top"), "element_id").join(cnt.select("element_id", "cnt"), "element_id")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                p, fitted = tails.pareto_pvalue(pdf["stat"], np.stack(pdf["top"].to_numpy()), pdf["cnt"], n_perm, least, shapes, worst=worst)
                yield pd.DataFrame({"element_id": pdf["element_id"], "p": p, "p_source": np.where(fitted, "pareto", "count")})

    return joined.mapInPandas(run, f"element_id {obs.schema['element_id'].dataType.simpleString()}, p double, p_source string")


def fdr(p: DataFrame, by: list[str] | None = None, col: str = "p") -> DataFrame:
    """``q``: Benjamini-Hochberg values, in each group of ``by``. NaN and null p do not count.

    Equal p have equal q, so the steps are taken over distinct p with their numbers of rows: counted p that most rows share are
    one row. Groups of few distinct p are windows of their own; a few groups of many are done one by one, by ranges.
    """
    ok = p.where(F.col(col).isNotNull() & ~F.isnan(col)).drop("q")
    keys = [*(by or []), col]
    levels = ok.groupBy(*keys).agg(F.count("*").alias("_m"))
    found = _steps(levels, by, col).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "q")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ok.join(found, same).drop(*[f"_k{i}" for i in range(len(keys))])


def _steps(levels: DataFrame, by: list[str] | None, col: str) -> DataFrame:
    """``q`` of distinct p with their numbers of rows ``_m``, in each group of ``by``.

    Without groups, ranks are taken over ranges: positions from the sizes of the ranges before, and minima carried back over those
    after, so no window holds all rows.
    """
    if by:
        groups = levels.select(*by).distinct().limit(FEW_GROUPS + 1).collect() if levels.count() > WINDOW_ROWS else []
        if 0 < len(groups) <= FEW_GROUPS:
            out = None
            for g in groups:
                own = levels
                for b in by:
                    own = own.where(F.col(b).eqNullSafe(F.lit(g[b])))
                own = _steps(own, None, col)
                out = own if out is None else out.unionByName(own)
            return out
        w = Window.partitionBy(*by)
        ranked = levels.withColumn("_v", F.col(col) * F.sum("_m").over(w) / F.sum("_m").over(w.orderBy(col)))
        # Looking back over falling p is a running minimum; looking ahead over rising p would begin anew at every row.
        return ranked.withColumn("q", F.least(F.lit(1.0), F.min("_v").over(w.orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, 0)))).drop("_v")
    many, total = levels.agg(F.count("*"), F.coalesce(F.sum("_m"), F.lit(0))).first()
    parts = max(1, min(1000, many // (WINDOW_ROWS // 2) + 1))
    split = levels.stat.approxQuantile(col, [k / parts for k in range(1, parts)], 0.001) if parts > 1 else []
    own = levels.withColumn("_part", sum([F.when(F.col(col) > v, 1).otherwise(0) for v in split], F.lit(0)))
    sizes = {r["_part"]: r["m"] for r in own.groupBy("_part").agg(F.sum("_m").alias("m")).collect()}
    before, at = {}, 0
    for k in range(parts):
        before[k] = at
        at += sizes.get(k, 0)
    first = F.create_map(*[F.lit(v) for k in before for v in (k, before[k])])
    w = Window.partitionBy("_part").orderBy(col)
    ranked = own.withColumn("_v", F.col(col) * total / (F.sum("_m").over(w) + F.element_at(first, F.col("_part"))))
    least = {r["_part"]: r["m"] for r in ranked.groupBy("_part").agg(F.min("_v").alias("m")).collect()} if parts > 1 else {}
    after, m = {}, float("inf")
    for k in range(parts - 1, -1, -1):
        after[k] = m
        m = min(m, least.get(k, float("inf")))
    back = F.create_map(*[F.lit(v) for k in after for v in (k, after[k])])
    own_min = F.min("_v").over(Window.partitionBy("_part").orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.least(F.lit(1.0), own_min, F.element_at(back, F.col("_part")))).drop("_v", "_part")


def statistic_p(df: DataFrame, kind: str, df1: float = 1.0, df2: float = 1.0, n: int = 1, stat: str = "t", name: str = "p") -> DataFrame:
    """``name``: the upper-tail p of a statistic of ``kind`` z, t, F, X, R, R2 or P (already a p). A conjunction of ``-n`` statistics under the
    global null (negative ``n``) takes it to the power ``-n``; under the conjunction null (positive ``n``) it is that of the least one."""
    power = max(1, -n)
    if kind == "P":
        return df.withColumn(name, F.pow(F.col(stat).cast("double"), F.lit(power)))
    return parametric_p(df, kind, df1, df2, stat, name).withColumn(name, F.pow(name, F.lit(power)))


def fdr_at(points: DataFrame, image: DataFrame, by: list[str] | None = None, col: str = "p") -> DataFrame:
    """``points`` with ``q``: the step-up value, among the p of ``image``, of the smallest one that is no less than the point's own; 1 where none is.

    The image's p are taken once each with their numbers; points find theirs by a running look back over falling p, in ranges of p where
    the image has many, so no window holds all. NaN and null p of points have no q; those of the image do not count.
    """
    from permafield.sources.files import scratch

    by = by or []
    levels = scratch(image.where(F.col(col).isNotNull() & ~F.isnan(col)).groupBy(*by, col).agg(F.count("*").alias("_m")), "levels")
    steps = scratch(_steps(levels, by or None, col).select(*by, F.col(col).cast("double").alias("_p"), F.col("q").alias("_q")), "steps")
    many = steps.count()
    pieces = max(1, min(1000, many // (WINDOW_ROWS // 2) + 1))
    cuts = steps.stat.approxQuantile("_p", [k / pieces for k in range(1, pieces)], 0.001) if pieces > 1 else []
    both = steps.withColumn("_point", F.lit(0)).unionByName(points.withColumn("_p", F.col(col).cast("double")).withColumn("_point", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_part", sum((F.when(F.col("_p") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    falling = Window.partitionBy(*by, "_part").orderBy(F.desc("_p"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_q", ignorenulls=True).over(falling))
    # Steps do not fall with p: where a part has no level above the point, the least of the parts above is the next.
    rest = both.groupBy(*by, "_part").agg(F.min("_q").alias("_least"))
    rest = rest.withColumn("_next", F.min("_least").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    same = F.col("_part") == F.col("_rpart")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    rest = rest.select(*(F.col(b).alias(f"_r_{b}") for b in by), F.col("_part").alias("_rpart"), "_next")
    q = F.when(F.col("_p").isNotNull() & ~F.isnan("_p"), F.coalesce("_own", "_next", F.lit(1.0)))
    return found.where("_point = 1").join(F.broadcast(rest) if not by else rest, same, "left").select(*points.columns, q.alias("q"))


def log10_signed(p: Column, stat: Column) -> Column:
    """``-log10(p)`` with the statistic's sign: 0 where it is 0, NaN where it is not a number."""
    return F.when(F.isnan(stat), float("nan")).when(stat == 0, 0.0).otherwise(-F.log10(p) * F.signum(stat))


def back_from_log10(level: Column) -> Column:
    return F.pow(F.lit(10.0), -level)


def sequential_stop(null: DataFrame, observed: float, alpha: float = 0.05, least_perm: int = 500, least_hits: int = 20, sigmas: float = 3.0, observed_min: float | None = None) -> DataFrame:
    """``perm_id, hits, p, se, stop`` after each permutation: stop once the smallest family-wise p is surely above ``alpha``.

    With ``observed_min`` both signs are counted and the fewer hits decide.
    """
    w = Window.orderBy("perm_id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each permutation
    hits = F.sum(F.when(F.col("t_max") >= observed, 1).otherwise(0)).over(w)
    if observed_min is not None:
        hits = F.least(hits, F.sum(F.when(-F.col("t_min") >= -observed_min, 1).otherwise(0)).over(w))
    m = F.row_number().over(Window.orderBy("perm_id"))
    d = null.select("perm_id", hits.alias("hits"), m.alias("m")).withColumn("p", F.col("hits") / F.col("m"))
    d = d.withColumn("se", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("m")))
    return d.withColumn("stop", (F.col("m") >= least_perm) & (F.col("hits") >= least_hits) & (F.col("p") - sigmas * F.col("se") > alpha))


def calibration(p: DataFrame, p_col: str = "p", low: float = 0.01, high: float = 0.09) -> DataFrame:
    """``p_hi``, the share of ``2 |p| > 0.95``, and its verdict: too_narrow below ``low``, too_wide above ``high``, else fine."""
    hi = F.avg((2 * F.abs(p_col) > 0.95).cast("double"))
    return p.agg(hi.alias("p_hi")).withColumn("verdict", F.when(F.col("p_hi") < low, "too_narrow").when(F.col("p_hi") > high, "too_wide").otherwise("fine"))


def parametric_p(df: DataFrame, kind: str, df1: float = 1.0, df2: float = 1.0, stat: str = "t", name: str = "p_param") -> DataFrame:
    """Upper-tail p of each statistic from its parametric law."""

    @F.pandas_udf(T.DoubleType())
    def sf(x: pd.Series) -> pd.Series:
        return pd.Series(special.statistic_sf(x.to_numpy(float), kind, df1, df2))

    return df.withColumn(name, sf(F.col(stat).cast("double")))


def z_equivalent(df: DataFrame, p: str = "p", name: str = "z") -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def z(x: pd.Series) -> pd.Series:
        return pd.Series(special.equivalent_z(x.to_numpy(float)))

    return df.withColumn(name, z(F.col(p)))


def parametric_agreement(p: DataFrame, obs: DataFrame, kind: str = "t", df1: float = 1.0, df2: float = 1.0) -> DataFrame:
    """``corr_p, corr_n``: the correlation of permuted and parametric one-sided p over the elements above and below 0.

    ``p(element_id, p)`` holds the permuted p in the direction of each element's sign, ``obs(element_id, t)`` the statistic.
    Elements of no statistic, or with a parametric p of 0.5 or 1, take no part. A value below 0.85 points to a design or
    nuisance method that does not fit; null where fewer than two elements, or equal values, are left.
    """
    fitted = parametric_p(obs.select("element_id", F.abs("t").alias("t"), F.signum("t").alias("side")).where("side <> 0"), kind, df1=df1, df2=df2)
    both = fitted.join(p.select("element_id", "p"), "element_id").where("p_param <> 0.5 and p_param <> 1")

    def of(side: int) -> Column:
        a, b = (F.when(F.col("side") == side, F.col(name)) for name in ("p", "p_param"))
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    return both.agg(of(1).alias("corr_p"), of(-1).alias("corr_n"))


def register_functions(spark) -> None:
    """``gpd_tail(z, k, scale)``, ``gamma_tail(x, mean, var, skew)`` and ``grid_neighbours(id, nx, ny, nz, connectivity)`` for SQL."""

    @F.pandas_udf(T.DoubleType())
    def gpd_tail(z: pd.Series, k: pd.Series, scale: pd.Series) -> pd.Series:
        return pd.Series(tails.gpd_sf(z, k, scale))

    @F.pandas_udf(T.DoubleType())
    def gamma_tail(x: pd.Series, mean: pd.Series, var: pd.Series, skew: pd.Series) -> pd.Series:
        return pd.Series(tails.gamma_sf(x, mean, var, skew, "reflect"))

    @F.udtf(returnType="dst: bigint")
    class GridNeighbours:
        def eval(self, element: int, nx: int, ny: int, nz: int, connectivity: int):
            reach = {6: 1, 18: 2, 26: 3}[connectivity]
            x, y, z = element % nx, element // nx % ny, element // (nx * ny)
            for c in range(max(0, z - 1), min(nz, z + 2)):
                for b in range(max(0, y - 1), min(ny, y + 2)):
                    for a in range(max(0, x - 1), min(nx, x + 2)):
                        if 0 < abs(a - x) + abs(b - y) + abs(c - z) <= reach:
                            yield (a + nx * b + nx * ny * c,)

    spark.udf.register("gpd_tail", gpd_tail)
    spark.udf.register("gamma_tail", gamma_tail)
    spark.udtf.register("grid_neighbours", GridNeighbours)
