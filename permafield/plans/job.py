"""Whole jobs: every contrast of a design estimated and stored, and results exported for contrasts and kinds of maps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permafield.functions import design, linear, tree
from permafield.operators import inference, results
from permafield.plans.permutation import Outcome, permutation_test
from permafield.sources import files


@dataclass
class Job:
    """What a test needs: a design with roles, named contrasts, and options of the permutation test.

    ``nuisance`` is ds, smith or freedman_lane; ``kind`` (volume, mesh, skeleton) sets E and H unless given; ``sequential`` stops
    early by waves; ``n_perm_break``: with no family-wise hit at 0.05 after so many permutations, no more are run, else the rest follow.
    ``n_perm`` is one number, or one for each contrast by name. ``mask(element_id, mask)``: elements whose mask is not above 0 take no
    part. ``covariate(element_id, c)``: a covariate of each element's own, centred, which replaces the design columns ``columns``.
    ``scaling``: a factor for each observation.
    """

    design: design.Design
    contrasts: dict[str, np.ndarray]
    n_perm: int | dict[str, int] = 5000
    nuisance: str = "smith"
    kind: str = "volume"
    E: float | None = None
    H: float | None = None
    seed: int = 0
    sequential: bool = False
    n_perm_break: int | None = None
    blocks: np.ndarray | None = None
    whitening: np.ndarray | None = None
    mask: DataFrame | None = None
    covariate: DataFrame | None = None
    columns: list[int] | None = None
    scaling: np.ndarray | None = None
    options: dict = field(default_factory=dict)


def from_stored(stored, **options) -> Job:
    """The job of a design that :func:`permafield.sources.mat5.read_design` read: its roles, contrasts and whitening."""
    whitening = stored.whitening if stored.whitening is not None and not np.array_equal(stored.whitening, np.eye(len(stored.x))) else None
    return Job(**{"design": stored.design(), "contrasts": {k: c for k, (_, c) in stored.contrasts.items()}, "whitening": whitening} | options)


def checks(result: DataFrame, x, c) -> dict:
    """Whether the permuted p of the statistic agree with parametric ones (``corr_p``, ``corr_n``; below 0.85 points to a design or method that
    does not fit) and are of the right width (``p_hi`` and its verdict), in one pass each."""
    stat = result.where("measure = 'stat' and sign <> 0")
    c = linear.contrast_matrix(c, np.shape(x)[1])
    rank = int(np.linalg.matrix_rank(x))
    kind, df1 = ("t", 1.0) if c.shape[1] == 1 else ("F", float(linear.contrast_basis(c).shape[1]))
    agree = inference.parametric_agreement(stat.select("element_id", F.col("p_unc").alias("p")), stat.select("element_id", F.col("stat").cast("double").alias("t")), kind, df1, float(len(x) - rank)).first()
    wide = inference.calibration(stat.select(F.col("p_unc").alias("p"))).first()
    return {"corr_p": agree["corr_p"], "corr_n": agree["corr_n"], "p_hi": wide["p_hi"], "calibration": wide["verdict"]}


def estimate(rows: DataFrame, job: Job, space: tree.Grid | tree.Mesh | None, path: str | None = None) -> dict[str, Outcome]:
    """Recognise, draw, verify and test each contrast of ``rows(element_id, y)``; results go below ``path``, a folder each.

    Nuisance columns: Freedman-Lane exchanges the data; Draper-Stoneman exchanges the tested columns, Smith their part that the
    others do not explain, and both leave the others where they are.
    """
    if job.scaling is not None:
        factors = F.array(*map(F.lit, np.asarray(job.scaling, float).tolist()))
        rows = rows.withColumn("y", F.transform("y", lambda v, i: v * F.get(factors, i)))
    if job.mask is not None:  # an element of zeros has no statistic, and so no sign and no part
        rows = rows.join(job.mask.where("mask > 0").select("element_id", F.lit(True).alias("inside")), "element_id", "left")
        rows = rows.select("element_id", F.when(F.col("inside"), F.col("y")).otherwise(F.transform("y", lambda v: F.lit(0.0))).alias("y"))
    if job.covariate is not None:
        centred = F.transform("c", lambda v: v - F.aggregate("c", F.lit(0.0), lambda a, w: a + w) / F.size("c"))
        rows = rows.select("element_id", "y").join(job.covariate.select("element_id", centred.alias("c")), "element_id")
    whole = ["y", "c"] if job.covariate is not None else ["y"]
    if job.whitening is not None:
        from permafield.operators.models import whiten

        if job.covariate is not None:
            raise ValueError("whitening with a covariate of each element is not supported")
        rows = whiten(rows, job.whitening)
    e, h = design.default_exponents(job.kind)
    e, h = job.E if job.E is not None else e, job.H if job.H is not None else h
    out: dict[str, Outcome] = {}
    for k, (name, c) in enumerate(job.contrasts.items(), 1):
        scheme = design.recognise(job.design, c, job.blocks, job.nuisance)
        used = scheme.used
        x = job.design.x if job.whitening is None else job.whitening @ job.design.x
        x = x[used]
        n_perm = job.n_perm[name] if isinstance(job.n_perm, dict) else job.n_perm
        exchanges = design.draw(scheme, n_perm, job.seed, half=scheme.half and job.options.get("half", False))
        flips = scheme.kind == "sign_flip"
        design.verify(exchanges, scheme.blocks, flips)
        ids = F.array(*[F.lit(int(i)) for i in used])
        own = rows if len(used) == len(job.design.x) else rows.select("element_id", *(F.transform(ids, lambda i, y=y: F.get(y, i)).alias(y) for y in whole))
        method = "raw" if flips else scheme.method
        rz = None
        if job.whitening is not None and method == "freedman_lane":  # nuisance columns as they were before whitening
            rz = linear.residual_maker(job.design.x[used][:, linear.partition(job.design.x, c)[1]])
        options = {"alpha": 0.05, "method": method, "interaction": scheme.interaction, "rz": rz, "columns": job.columns if job.covariate is not None else None, **job.options}
        wave = max(100, len(exchanges) // 10) if job.sequential else None
        found = permutation_test(own, x, c, exchanges, space, e, h, flips, wave=wave, contrast_id=k, break_after=job.n_perm_break, **options)
        found.info |= {"contrast": name, "scheme": scheme.kind, "possible": str(design.possible(scheme)), "method": options["method"]}
        found.info["fast"] = rz is None or linear.fast_form_holds(x, rz, exchanges)
        found.info |= checks(found.result, x, c)
        out[name] = found
    if path:
        for name, o in out.items():
            files.write_result(o.result, f"{path}/{name}/result")
            o.null.write.mode("overwrite").parquet(f"{path}/{name}/null")
            files.write_info(rows.sparkSession, o.info, f"{path}/{name}/info")
    return out


def export(spark: SparkSession, path: str, names: list[str], space, on: str = "fwe", u: float = 0.05, k: int = 0, kinds: tuple[str, ...] = ("thresholded",), measure: str = "enh", inverse: bool = False) -> dict[tuple[str, str], DataFrame]:
    """Thresholded maps of stored contrasts, for each contrast and kind, written below ``path/name/kind`` and returned."""
    out = {}
    for name in names:
        view = results.threshold(spark.read.parquet(f"{path}/{name}/result").where(F.col("measure") == measure), on, u, inverse, measure)
        found = results.clusters(view, space, k)
        for kind in kinds:
            df = results.export_map(found, kind, stat=measure)
            df.write.mode("overwrite").parquet(f"{path}/{name}/{kind}")
            out[name, kind] = spark.read.parquet(f"{path}/{name}/{kind}")
    return out


__all__ = ["Job", "estimate", "export", "from_stored"]
