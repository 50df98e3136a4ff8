"""The permutation test: which plan runs, and what it returns.

Small data (their size is checked) go to every task, which fits, enhances and reduces its own permutations: only partial
aggregates are shuffled. Larger data are fitted in blocks of elements, shuffled once by permutation, enhanced and reduced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permafield.functions import linear, tree
from permafield.operators import inference

#: Bytes of data that are sent to every task at most, and of stored tails before only counts are kept.
BROADCAST, TAIL_BYTES = 256 << 20, 4 << 30


@dataclass
class Outcome:
    result: DataFrame
    null: DataFrame
    info: dict


def statistics(y, x, c, signs: bool = False, method: str = "raw", interaction: bool = False, cov=None, columns=None, rz=None, **options):
    """A function from one exchange (a row of ids, or of signs) to the statistic of every element, and whether it is t; see
    :class:`permafield.functions.linear.Exchanged` for the methods. Norms of the data and the design's factors are made once."""
    y = np.atleast_2d(np.asarray(y, float))
    norms = (y * y).sum(1)
    kind = {"signs": signs, "method": method, "interaction": interaction, "rz": rz, "columns": columns, **options}
    base = None if columns is not None else linear.PermutedGLM(np.zeros((0, y.shape[1])), x, c, **options)
    linear.Exchanged(x, c, None, base=base, **kind)  # the method is checked here
    return lambda e: linear.Exchanged(x, c, e, base=base, **kind).statistic(y, norms, cov=cov), linear.contrast_matrix(c, np.shape(x)[1]).shape[1] == 1


def moved_by(x, exchanges, method: str, interaction: bool = False, rz=None, columns=None) -> dict:
    """What :func:`statistics` needs besides data and design. ``rz`` is left out where it changes nothing."""
    if rz is not None and (method not in ("raw", "freedman_lane") or linear.fast_form_holds(x, rz, exchanges)):
        rz = None
    return {"method": method, "interaction": interaction, "rz": rz, "columns": None if columns is None else list(columns)}


def _partials(rows: np.ndarray, ids: list[int], y, x, c, signs: bool, t0, e0, space, E, H, k, method, options, cov=None):
    """Maxima of each permutation, and counts, largest draws and sums of each element, over a task's permutations."""
    fit, is_t = statistics(y, x, c, signs, **method, cov=cov, **options)
    n = len(t0)
    s = np.sign(t0)
    on = s != 0
    # Two measures of 2k columns, filled one by one and halved when full.
    maxima, tops, filled = [], {name: np.empty((n, 2 * k)) for name in ("stat", "enh")}, 0
    cnt = {"stat": np.zeros(n, np.int64), "enh": np.zeros(n, np.int64)}
    total = {"stat": np.zeros(n), "enh": np.zeros(n)}
    for row, perm_id in zip(rows, ids):
        t = fit(row)
        t = np.where(np.isfinite(t), t, 0.0)
        if not is_t:
            t = np.maximum(t, 0)
        e = tree.tfce(t, space, E, H).astype(float) if space is not None else t
        maxima.append((perm_id, t[on].max(initial=-np.inf), t[on].min(initial=np.inf), e[on].max(initial=-np.inf), e[on].min(initial=np.inf)))
        for name, v, v0 in (("stat", t, t0), ("enh", e, e0)):
            cnt[name] += linear.reaches(v, v0)
            total[name] += v
            tops[name][:, filled] = s * v
        filled += 1
        if filled == 2 * k:
            filled = k
            for held in tops.values():
                held.partition(k, 1)
                held[:, :k] = held[:, k:]
    return maxima, cnt, {name: held[:, :filled] for name, held in tops.items()}, total


def permutation_test(
    rows: DataFrame,
    x,
    c,
    exchanges: np.ndarray,
    space=None,
    E: float = 0.5,
    H: float = 2.0,
    signs: bool = False,
    n_tail: int = 100,
    shrink: float = 0.0,
    fwe: str = "two_sided",
    floor: float | None = None,
    wave: int | None = None,
    alpha: float = 0.05,
    contrast_id: int = 1,
    half: bool = False,
    method: str = "raw",
    interaction: bool = False,
    tail_bytes: int = TAIL_BYTES,
    rz=None,
    columns=None,
    break_after: int | None = None,
) -> Outcome:
    """Test every element of ``rows(element_id, y)``, numbered from 0 without gaps, under ``exchanges`` (a row each, the identity first).

    ``wave``: permutations in a wave; after each the sequential rule is applied to the ordered maxima, and if it stops the test
    is reduced to the permutations up to the stop, as if they had been run one by one. ``half``: each exchange stands for its
    mirror image too. ``method``: what the exchanges move, see :func:`statistics`. ``tail_bytes``: what a task may hold of the largest
    draws; where ``n_tail`` of every element need more, one is stored, uncorrected p are counted, and ``info["tail"]`` is 1. ``rz``: the residual
    maker of nuisance columns that the design need not span. ``columns``: design columns that a covariate of each element's own,
    ``rows.c``, replaces. ``break_after``: with no family-wise p below 0.05 after so many exchanges, no more are run; else the rest follow.

    Data of more than BROADCAST bytes are tested by :func:`permafield.plans.blocks.test_by_blocks`.
    """
    spark: SparkSession = rows.sparkSession
    x = np.asarray(x, float)
    options = {"shrink": shrink}
    n = rows.count()
    if n * len(x) * 8 * (1 if columns is None else 2) > BROADCAST:
        from permafield.plans import blocks

        return blocks.test_by_blocks(rows, x, c, exchanges, space, E, H, signs, n_tail, shrink, fwe, floor, wave, alpha, contrast_id, half, method, interaction, rz, columns, break_after)
    local = rows.orderBy("element_id").toPandas()  # its size is checked above
    if not (local["element_id"].to_numpy() == np.arange(n)).all():
        raise ValueError("elements must be numbered from 0 without gaps")
    y = np.stack(local["y"].to_numpy()) if n else np.zeros((0, len(x)))
    cov = None if columns is None else np.stack(local["c"].to_numpy()) if n else np.zeros((0, len(x)))
    moved = moved_by(x, exchanges, method, interaction, rz, columns)
    fit0, is_t = statistics(y, x, c, signs, **moved, cov=cov, **options)
    t0 = fit0(exchanges[0])
    t0 = np.where(np.isfinite(t0), t0, 0.0)
    t0 = t0 if is_t else np.maximum(t0, 0)
    e0 = tree.tfce(t0, space, E, H).astype(float) if space is not None else t0
    k = min(n_tail, len(exchanges) - 1) if len(exchanges) > 1 else 1
    if n * 2 * k * 8 * 2 > tail_bytes:
        k = 1
    sent = spark.sparkContext.broadcast((y, x, np.asarray(c, float), np.asarray(exchanges), t0, e0, cov))

    def run(batches):
        y, x, c, exchanges, t0, e0, cov = sent.value
        ids = [int(i) for pdf in batches for i in pdf["id"]]
        if not ids:
            return
        maxima, cnt, tops, total = _partials(exchanges[ids], ids, y, x, c, signs, t0, e0, space, E, H, k, moved, options, cov)
        yield pd.DataFrame([(0, "null", i, *m, 0, None, 0.0) for i, *m in maxima], columns=cols)
        for name in ("stat", "enh"):
            own = tops[name][:, -k:] if tops[name].shape[1] <= k else np.partition(tops[name], tops[name].shape[1] - k, 1)[:, -k:]
            yield pd.DataFrame({"kind": 1, "measure": name, "id": np.arange(len(t0)), "t_max": np.nan, "t_min": np.nan, "e_max": np.nan, "e_min": np.nan, "cnt": cnt[name], "part": list(own), "total": total[name]}, columns=cols)

    cols = ["kind", "measure", "id", "t_max", "t_min", "e_max", "e_min", "cnt", "part", "total"]
    schema = "kind int, measure string, id long, t_max double, t_min double, e_max double, e_min double, cnt long, part array<double>, total double"
    tasks = max(1, min(len(exchanges), spark.sparkContext.defaultParallelism))

    from permafield.sources.files import scratch

    def reduced(first: int, last: int) -> DataFrame:
        got = spark.range(first, last, 1, min(tasks, max(1, last - first))).mapInPandas(run, schema)
        return scratch(got, "partials")

    observed = spark.createDataFrame(pd.DataFrame({"element_id": np.arange(n), "stat": t0.astype(np.float32), "enh": e0.astype(np.float32), "t0": t0, "e0": e0}), OBSERVED)
    info = {"stopped": False, "elements": n, "tail": k}
    pieces: list[DataFrame] = []

    def outcome(used: int) -> Outcome:
        partial = pieces[0]
        for p in pieces[1:]:
            partial = partial.unionByName(p)
        null = partial.where("kind = 0").select(F.col("id").alias("perm_id"), "t_max", "t_min", "e_max", "e_min")
        per = partial.where("kind = 1").groupBy("measure", F.col("id").alias("element_id")).agg(F.sum("cnt").alias("cnt"), F.slice(F.sort_array(F.flatten(F.collect_list("part")), asc=False), 1, k).alias("top"), F.sum("total").alias("total"))
        return finish(observed, per, null, used, contrast_id, half, fwe, floor, info)

    at = 0
    if break_after and break_after < len(exchanges):
        pieces.append(reduced(0, break_after))
        at = break_after
        early = outcome(at)
        if early.result.where("p_fwe < 0.05").isEmpty():
            early.info["stopped"] = True
            return early
    while at < len(exchanges):
        end = min(at + (wave or len(exchanges)), len(exchanges))
        pieces.append(reduced(at, end))
        if wave:
            maxima = pieces[0]
            for p in pieces[1:]:
                maxima = maxima.unionByName(p)
            up, down = (float(e0.max()), float(e0.min())) if n else (0.0, 0.0)
            stop = stopped_at(maxima.where("kind = 0").select(F.col("id").alias("perm_id"), "e_max", "e_min"), up, down, alpha)
            if stop is not None:
                if stop + 1 < end:  # the last wave again, up to the stop
                    pieces[-1] = reduced(at, stop + 1) if stop >= at else pieces[-1]
                at, info["stopped"] = max(stop + 1, at), True
                break
        at = end
    return outcome(at)


OBSERVED = "element_id long, stat float, enh float, t0 double, e0 double"


def stopped_at(maxima: DataFrame, up: float, down: float, alpha: float) -> int | None:
    """The permutation after which the sequential rule stops, from ``perm_id, e_max, e_min`` and the largest and least observed value."""
    m = maxima.select("perm_id", F.col("e_max").alias("t_max"), F.col("e_min").alias("t_min"))
    rule = inference.sequential_stop(m, up, alpha, observed_min=down if down < 0 < up else None) if up > 0 else inference.sequential_stop(m.select("perm_id", (-F.col("t_min")).alias("t_max"), "t_min"), -down, alpha)
    stop = rule.where("stop").agg(F.min("perm_id")).first()[0]
    return None if stop is None else int(stop)


def finish(observed: DataFrame, per: DataFrame, null: DataFrame, used: int, contrast_id: int, half: bool, fwe: str, floor: float | None, info: dict) -> Outcome:
    """p-values of both measures from OBSERVED, ``per(measure, element_id, cnt, top, total)`` and ``null(perm_id, t_max, t_min, e_max, e_min)``."""
    from permafield.sources.files import scratch

    if half:
        null = null.withColumn("half", F.lit(0)).unionByName(null.select("perm_id", (-F.col("t_min")).alias("t_max"), (-F.col("t_max")).alias("t_min"), (-F.col("e_min")).alias("e_max"), (-F.col("e_max")).alias("e_min"), F.lit(1).alias("half")))
    draws = used * (2 if half else 1)
    out = None
    for measure, v, hi, lo in (("stat", "t0", "t_max", "t_min"), ("enh", "e0", "e_max", "e_min")):
        own = per.where(F.col("measure") == measure).withColumn("cnt", F.col("cnt") * (2 if half else 1))
        o = observed.select("element_id", "stat", "enh", F.col(v).alias("t")).withColumn("sign", F.signum("t").cast("tinyint"))
        p = inference.pareto_unc(o, own, own, draws)
        maxima = null.select(F.greatest(F.col(hi), -F.col(lo)).alias("two"), F.col(hi).alias("t_max"), F.col(lo).alias("t_min"))
        if fwe == "per_sign":
            f = inference.gamma_fwe(o, maxima, floor, fwe="per_sign")
        else:
            f = inference.gamma_fwe(o.withColumn("a", F.abs("t")), maxima, floor, stat="a", col="two").drop("a")
        joined = f.withColumnRenamed("p", "p_fwe").join(own.select("element_id", "cnt", "total"), "element_id").join(p.withColumnRenamed("p", "p_unc"), "element_id")
        joined = joined.withColumn("p_fwe", F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.col("p_fwe")))
        q = inference.fdr(joined.where("t <> 0"), ["sign"], "p_unc").select("element_id", F.col("q").alias("p_fdr"))
        m = joined.join(q, "element_id", "left").select(F.lit(contrast_id).alias("contrast_id"), F.lit(measure).alias("measure"), "element_id", "sign", "stat", "enh", "cnt", F.lit(draws).cast("long").alias("n_draws"), "p_unc", "p_source", "p_fwe", "p_fdr", (F.col("total") / np.sqrt(max(draws - 1, 1))).alias("null_sum"))
        out = m if out is None else out.unionByName(m)
    return Outcome(scratch(out, "result"), null, info | {"permutations": draws})


def permutation_test_by_blocks(rows: DataFrame, x, c, exchanges: np.ndarray, space=None, E: float = 0.5, H: float = 2.0, signs: bool = False, k: int = 100, shrink: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reductions of :func:`permafield.plans.blocks.test_by_blocks` before p-values: ``obs(element_id, t)``, the maxima, and
    ``element_id, cnt, top`` of the enhanced statistic."""
    from permafield.plans import blocks

    observed, null, per, _ = blocks.reductions(rows, x, c, exchanges, space, E, H, signs, k, shrink)
    own = per.where("measure = 'enh'").join(observed.where("t0 <> 0").select("element_id"), "element_id")
    return observed.select("element_id", F.col("e0").alias("t")), null.select("perm_id", F.col("e_max").alias("t_max"), F.col("e_min").alias("t_min")), own.select("element_id", "cnt", "top")


__all__ = ["Outcome", "permutation_test", "permutation_test_by_blocks"]
