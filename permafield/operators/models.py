"""Model operators on DataFrames: data preparation, GLM statistics, permuted statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permafield.functions import linear
from permafield.sources.files import scratch


def element_rows(long: DataFrame, n_obs: int, value: str = "y") -> DataFrame:
    """``element_id, y array<double>`` of ``n_obs`` from ``element_id, obs_id, y``; absent observations are 0. One aggregation."""
    pairs = F.map_from_entries(F.collect_list(F.struct("obs_id", value)))
    full = F.transform(F.sequence(F.lit(0), F.lit(n_obs - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return long.select("element_id", F.col("obs_id").cast("int").alias("obs_id"), F.col(value).cast("double").alias(value)).groupBy("element_id").agg(pairs.alias("m")).select("element_id", full.alias("y"))


def mask_filter(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of elements whose mask value is above 0."""
    return df.join(mask.where("mask > 0").select("element_id"), "element_id", "left_semi")


def scale_globals(long: DataFrame, factors: DataFrame) -> DataFrame:
    """Observations times their global scale ``gsf``."""
    return long.join(factors, "obs_id").withColumn("y", F.col("y") * F.col("gsf")).drop("gsf")


def mean_center(long: DataFrame, value: str = "y") -> DataFrame:
    """Values less the mean of their element."""
    return long.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy("element_id")))


def whiten(rows: DataFrame, w) -> DataFrame:
    """``element_id, y`` with each row times the whitening matrix."""
    w = np.asarray(w, float)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"element_id": pdf["element_id"], "y": list(linear.whiten(np.stack(pdf["y"].to_numpy()), w))} if len(pdf) else {"element_id": [], "y": []})

    return rows.select("element_id", "y").mapInPandas(run, rows.select("element_id", "y").schema)


def fit_glm(rows: DataFrame, x, c, perms=None, signs=None, shrink: float = 0.0, method: str = "raw", eps_inside: bool = True) -> DataFrame:
    """``perm_id, element_id, t`` of every element under every exchange (-1: none given, the data as they are).

    ``rows`` are ``element_id, y``; blocks of elements are independent, so nothing is shuffled. Shrinkage takes the largest
    residual variance over all elements, found first by one aggregation for each exchange.
    """
    x = np.asarray(x, float)
    ids, exchanges = [-1], [None]
    if perms is not None or signs is not None:
        exchanges = list(np.asarray(perms if perms is not None else signs))
        ids = list(range(len(exchanges)))
    options = {"signs": perms is None and signs is not None, "method": method, "eps_inside": eps_inside, "shrink": shrink}
    linear.prepared(x, c, [None], **options)  # shapes and degrees of freedom are checked here

    def largest(batches):
        fits, most = linear.prepared(x, c, exchanges, **options), np.zeros(len(exchanges))
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["y"].to_numpy())
                norms = (y * y).sum(1)
                most = np.maximum(most, [f.largest(y, norms) for f in fits])
        yield pd.DataFrame({"perm_id": np.asarray(ids, np.int32), "m": most})

    added: list[float | None] = [None] * len(ids)
    if shrink:  # one row a task and exchange
        found = {r["perm_id"]: r["m"] for r in rows.mapInPandas(largest, "perm_id int, m double").groupBy("perm_id").agg(F.max("m").alias("m")).collect()}
        added = [found.get(k, 0.0) for k in ids]

    def run(batches):
        fits = linear.prepared(x, c, exchanges, **options)
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["y"].to_numpy())
                norms = (y * y).sum(1)
                for k, f, most in zip(ids, fits, added):
                    yield pd.DataFrame({"perm_id": np.int32(k), "element_id": pdf["element_id"], "t": f.statistic(y, norms, most)})

    kind = rows.schema["element_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"perm_id int, element_id {kind}, t double")


def residuals(rows: DataFrame, x) -> DataFrame:
    """``element_id, y`` less what the design explains."""
    return whiten(rows, linear.residual_maker(np.asarray(x, float)))


def fit_voxel_covariate(rows: DataFrame, x, columns, c, perm=None) -> DataFrame:
    """``element_id, t`` with a covariate of each element's own: ``rows`` are ``element_id, y, c``."""
    x = np.asarray(x, float)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"element_id": pdf["element_id"], "t": linear.voxel_covariate_glm(np.stack(pdf["y"].to_numpy()), np.stack(pdf["c"].to_numpy()), x, columns, c, perm)})

    return rows.mapInPandas(run, f"element_id {rows.schema['element_id'].dataType.simpleString()}, t double")


def hashed_permutations(obs: DataFrame, n_perm: int, seed: str = "s42", within: str | None = None) -> DataFrame:
    """``perm_id, obs_id, src``: permutations by the order of md5 keys, the same in any SQL engine; inside blocks if ``within`` names one."""
    keyed = obs.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    keyed = keyed.withColumn("k", F.md5(F.concat(F.lit(seed + ":"), F.col("perm_id").cast("string"), F.lit(":"), F.col("obs_id").cast("string"))))
    inner = [within] if within else []
    by_key = _ranked(keyed.withColumn("part", F.coalesce(F.substring("k", 1, 3), F.lit(""))), ["perm_id", *inner], ["k", "obs_id"])
    by_id = _ranked(scratch(obs.repartitionByRange("obs_id").withColumn("part", F.spark_partition_id()), "places"), inner, ["obs_id"]).withColumnRenamed("obs_id", "place")
    return by_key.join(by_id.select("r", "place", *inner).hint("merge"), ["r", *inner]).select("perm_id", F.col("place").alias("obs_id"), F.col("obs_id").alias("src"))


def _ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their rank ``r`` in ``group`` by ``order``. Rows of a smaller ``part`` come first: a task ranks one part, behind the sums of those before."""
    sums = F.sum("many").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy(*group, "part").agg(F.count("*").alias("many")).select(*group, "part", F.coalesce(sums, F.lit(0)).alias("before"))
    own = rows.withColumn("r", F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)))
    return own.join(before.hint("merge"), [*group, "part"]).withColumn("r", F.col("r") + F.col("before")).drop("part", "before")


def hashed_signs(obs: DataFrame, n_perm: int, seed: str = "s42") -> DataFrame:
    """``perm_id, obs_id, s``: signs by the first digit of md5 keys."""
    keyed = obs.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    key = F.md5(F.concat(F.lit(seed + ":"), F.col("perm_id").cast("string"), F.lit(":"), F.col("obs_id").cast("string")))
    return keyed.select("perm_id", "obs_id", F.when(F.substring(key, 1, 1) < "8", 1).otherwise(-1).alias("s"))


def violations(perms: DataFrame, obs: DataFrame, block: str | None = None) -> DataFrame:
    """``perm_id, n_places, n_sources, moved_out``: what :func:`permafield.functions.design.verify` checks, as a query."""
    p = perms.join(obs.select("obs_id", *([block] if block else [])).hint("merge"), "obs_id")
    if block:
        p = p.join(obs.select(F.col("obs_id").alias("src"), F.col(block).alias("from_block")).hint("merge"), "src")
        out = F.count_if(F.col(block) != F.col("from_block"))
    else:
        out = F.lit(0)
    return p.groupBy("perm_id").agg(F.count("*").alias("n_places"), F.countDistinct("src").alias("n_sources"), out.cast("long").alias("moved_out"))


def distinct_permutations(perms: DataFrame, labels: DataFrame) -> DataFrame:
    """The first of each group of permutations that give every place the same label: ``perm_id``, and the signature shared."""
    labelled = perms.join(labels.select(F.col("obs_id").alias("src"), "label"), "src")
    sig = labelled.groupBy("perm_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("obs_id", "label"))), lambda x: x["label"].cast("string"))).alias("sig"))
    return sig.groupBy("sig").agg(F.min("perm_id").alias("perm_id"), F.count("*").alias("n_equal"))
