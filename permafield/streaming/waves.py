"""Permutations as a stream: waves of ids whose partial maxima are merged as they come, until the sequential rule stops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What the rule needs of all permutations before: how many, hits of the largest and of the least observed value, and where it stopped (-1: not).
STATE = "m long, hits long, low_hits long, stop long"


def advance(state: tuple[int, int, int, int], perm_id, t_max, t_min, observed: float, observed_min: float | None, alpha: float, least_perm: int = 500, least_hits: int = 20, sigmas: float = 3.0) -> tuple[int, int, int, int]:
    """The state after more permutations, given in any order and taken by id: the rule of ``inference.sequential_stop``, from counts alone."""
    m, hits, low, stop = state
    if stop >= 0 or not len(perm_id):
        return state
    by = np.argsort(perm_id, kind="stable")
    ids = np.asarray(perm_id)[by]
    n = m + np.arange(1, len(ids) + 1)
    up = hits + np.cumsum(np.asarray(t_max, float)[by] >= observed)
    down = low + np.cumsum(np.asarray(t_min, float)[by] <= observed_min) if observed_min is not None else up
    least = np.minimum(up, down)
    p = least / n
    over = (n >= least_perm) & (least >= least_hits) & (p - sigmas * np.sqrt(p * (1 - p) / n) > alpha)
    last = int(np.argmax(over)) if over.any() else len(ids) - 1
    return int(n[last]), int(up[last]), int(down[last]), int(ids[last]) if over.any() else -1


def sequential_stream(maxima: DataFrame, observed: dict[str, tuple[float, float | None]], alpha: float = 0.05, **rule) -> DataFrame:
    """A stream of ``contrast, perm_id, t_max, t_min`` as a stream of ``contrast, m, hits, low_hits, stop`` after each batch that brought some.

    The state of a contrast is a few counts, kept by Spark across batches and restarts, so a batch costs what it brings, however many
    came before. ``observed`` holds the largest statistic of each contrast, and the least one where both signs are judged. Permutations
    come in waves of rising ids; within a batch their order does not matter. What comes after a stop changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(frames))
        before = state.get if state.exists else (0, 0, 0, -1)
        after = advance(tuple(before), own["perm_id"].to_numpy(), own["t_max"].to_numpy(), own["t_min"].to_numpy(), *observed[key[0]], alpha, **rule)
        state.update(after)
        yield pd.DataFrame([(key[0], *after)], columns=["contrast", "m", "hits", "low_hits", "stop"])

    return maxima.groupBy("contrast").applyInPandasWithState(step, f"contrast string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def stream_maxima(spark: SparkSession, source: str, maxima: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, observed: float, alpha: float = 0.05, files: int = 1) -> int | None:
    """Read permutation ids (``perm_id``) as they arrive below ``source``, append their ``perm_id, t_max, t_min`` to ``target``
    (Parquet), and stop the query once the sequential rule does. Returns the permutation it stops at, or None.

    A batch that is retried rewrites its own folder, so each permutation is counted once. The counts that the rule needs are written beside each
    batch's maxima; a batch reads those of the batch before and its own maxima, nothing earlier.
    """
    stopped: list[int] = []

    def merge(batch: DataFrame, epoch: int) -> None:
        if stopped:
            return
        path = f"{target}/epoch={epoch}"
        maxima(batch).write.mode("overwrite").parquet(path)
        new = spark.read.parquet(path)
        state = (0, 0, 0, -1)
        if epoch > 0:
            state = tuple(spark.read.schema(STATE).parquet(f"{target}/_state/epoch={epoch - 1}").first())
        own = new.select("perm_id", "t_max", "t_min").toPandas()  # a row for each permutation of the batch
        state = advance(state, own["perm_id"].to_numpy(), own["t_max"].to_numpy(), own["t_min"].to_numpy(), observed, None, alpha)
        spark.createDataFrame([state], STATE).coalesce(1).write.mode("overwrite").parquet(f"{target}/_state/epoch={epoch}")
        if state[3] >= 0:
            stopped.append(state[3])

    query = spark.readStream.schema("perm_id long").option("maxFilesPerTrigger", files).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stopped[0] if stopped else None
