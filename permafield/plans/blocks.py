"""The permutation test for data too large for every task: blocks of elements by waves of exchanges, with a state that merges.

Each wave fits its exchanges block by block where the blocks lie, brings the pieces of a map together once, enhances it, takes its maxima, and sends
the pieces back to their blocks, where counts, sums and the largest draws of every element are merged into the state of the waves before.
What a task holds is a block by a wave, or one map; the state grows with the elements, not with the exchanges. The p-values are
those of :func:`permafield.plans.permutation.finish`, so both plans give the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permafield.functions import linear, tree
from permafield.plans import permutation
from permafield.sources.files import drop_scratch, scratch

#: Elements of a block, and exchanges of a wave where none is asked for.
BLOCK, WAVE = 4096, 200

BLOCKS = "block_id long, n int, y binary, c binary"
#: Pieces of maps: ``on`` marks elements with an observed effect, and the maxima are over those.
PIECES = "block_id long, perm_id int, t binary, on binary, t_max double, t_min double"
MAPS = "block_id long, perm_id int, t binary, e binary, t_max double, t_min double, e_max double, e_min double"
#: A block's state: what was observed, and both measures' counts, largest draws (descending) and sums, one after the other.
STATE = "block_id long, t0 binary, e0 binary, cnt binary, top binary, total binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def blocked(rows: DataFrame, n_obs: int, covariate: bool = False, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The data as written BLOCKS of ``block`` elements each (the last may be shorter), and the number of elements, which must be numbered
    from 0 without gaps. One shuffle, by block."""
    out = _arrow(BLOCKS)

    def gather(key, table):
        ids = table.column("element_id").to_numpy()
        order = np.argsort(ids)
        first = key[0].as_py() * block
        if not np.array_equal(ids[order], np.arange(first, first + len(ids))):
            raise ValueError("elements must be numbered from 0 without gaps")

        def stack(name):
            column = table.column(name).combine_chunks()
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(values) != len(ids) * n_obs or (np.diff(column.offsets.to_numpy()) != n_obs).any():
                raise ValueError(f"every element needs {n_obs} values")
            return values.reshape(len(ids), n_obs)[order].tobytes()

        return pa.Table.from_batches([_batch([(key[0].as_py(), len(ids), stack("y"), stack("c") if covariate else None)], out)])

    own = rows.select("element_id", "y", *(["c"] if covariate else [])).withColumn("block_id", F.floor(F.col("element_id") / block).cast("long"))
    written = scratch(own.groupBy("block_id").applyInArrow(gather, BLOCKS), "blocks")
    n, most, full = written.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.col("block_id") * block + F.col("n")), F.lit(0)), F.count_if(F.col("n") == block)).first()
    if n != most or n // block != full:
        raise ValueError("elements must be numbered from 0 without gaps")
    return written, int(n)


def largest_variances(data: DataFrame, x, c, exchanges: np.ndarray, kind: dict) -> np.ndarray:
    """The largest residual variance over all elements under each exchange, for shrinkage: one row a task and exchange is shuffled."""
    sent = data.sparkSession.sparkContext.broadcast((x, c, exchanges))

    def run(batches):
        x, c, exchanges = sent.value
        fits, most = linear.prepared(x, c, exchanges, **kind), np.zeros(len(exchanges))
        for b in batches:
            for y in b.column(0):
                y = np.frombuffer(y.as_py()).reshape(-1, len(x))
                norms = (y * y).sum(1)
                most = np.maximum(most, [f.largest(y, norms) for f in fits])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most)], names=["k", "m"])

    found = {r["k"]: r["m"] for r in data.select("y").mapInArrow(run, "k int, m double").groupBy("k").agg(F.max("m").alias("m")).collect()}
    return np.array([found.get(k, 0.0) for k in range(len(exchanges))])


def pieces(data: DataFrame, x, c, exchanges: np.ndarray, first: int, kind: dict, largest: np.ndarray | None, identity, largest0: float | None) -> DataFrame:
    """PIECES of the maps of ``exchanges``, numbered from ``first``; each task prepares the exchanges once, and a block stays where it lies."""
    sent = data.sparkSession.sparkContext.broadcast((x, c, exchanges, identity, largest))
    out = _arrow(PIECES)

    def run(batches):
        x, c, exchanges, identity, largest = sent.value
        fits, observed = linear.prepared(x, c, exchanges, **kind), linear.prepared(x, c, [identity], **kind)[0]
        is_t = linear.contrast_matrix(c, x.shape[1]).shape[1] == 1

        def clean(t):
            t = np.where(np.isfinite(t), t, 0.0)
            return t if is_t else np.maximum(t, 0)

        for b in batches:
            for block_id, y, cov in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                y = np.frombuffer(y.as_py()).reshape(-1, len(x))
                cov = None if cov.as_py() is None else np.frombuffer(cov.as_py()).reshape(-1, len(x))
                norms = (y * y).sum(1)
                on = clean(observed.statistic(y, norms, largest0, cov)) != 0
                marks, rows = np.packbits(on).tobytes(), []
                for k, f in enumerate(fits):
                    t = clean(f.statistic(y, norms, None if largest is None else float(largest[k]), cov))
                    rows.append((block_id, first + k, t.tobytes(), marks, float(t[on].max(initial=-np.inf)), float(t[on].min(initial=np.inf))))
                yield _batch(rows, out)

    return data.select("block_id", "y", "c").mapInArrow(run, PIECES)


def enhanced(parts: DataFrame, space, E: float, H: float) -> DataFrame:
    """MAPS of whole maps: the pieces of one permutation come together once; a row of block -1 holds the map's maxima."""
    out = _arrow(MAPS)

    def run(key, table):
        order = np.argsort(table.column("block_id").to_numpy())
        ids = table.column("block_id").to_numpy()[order].tolist()
        ts = [np.frombuffer(table.column("t")[int(k)].as_py()) for k in order]
        on = np.concatenate([np.unpackbits(np.frombuffer(table.column("on")[int(k)].as_py(), np.uint8), count=len(t)).astype(bool) for k, t in zip(order, ts)])
        t = np.concatenate(ts)
        e = tree.tfce(t, space, E, H)
        wide = e[on].astype(float)
        p = key[0].as_py()
        rows = [(-1, p, None, None, float(t[on].max(initial=-np.inf)), float(t[on].min(initial=np.inf)), float(wide.max(initial=-np.inf)), float(wide.min(initial=np.inf)))]
        at = 0
        for k, part in zip(ids, ts):
            rows.append((k, p, part.tobytes(), e[at : at + len(part)].tobytes(), *[None] * 4))
            at += len(part)
        return pa.Table.from_batches([_batch(rows, out)])

    if space is not None:
        return parts.groupBy("perm_id").applyInArrow(run, MAPS)
    # Without a transform both measures are the statistic, and maxima need no whole map.
    none = F.lit(None)
    maxima = parts.groupBy("perm_id").agg(F.max("t_max").alias("t_max"), F.min("t_min").alias("t_min"))
    maxima = maxima.select(F.lit(-1).cast("long").alias("block_id"), "perm_id", none.cast("binary").alias("t"), none.cast("binary").alias("e"), "t_max", "t_min", F.col("t_max").alias("e_max"), F.col("t_min").alias("e_min"))
    own = parts.select("block_id", "perm_id", "t", none.cast("binary").alias("e"), *(none.cast("double").alias(x) for x in ("t_max", "t_min", "e_max", "e_min")))
    return own.unionByName(maxima)


def merged(state: DataFrame | None, maps: DataFrame, k: int) -> DataFrame:
    """The state of every block with a wave's maps: counts, sums, and the ``k`` largest draws in the direction of the observed sign."""
    out = _arrow(STATE)
    rows = maps.where("block_id >= 0").select("block_id", "perm_id", "t", "e", *(F.lit(None).cast("binary").alias(x) for x in ("cnt", "top", "total")))
    if state is not None:
        rows = rows.unionByName(state.select("block_id", F.lit(-1).alias("perm_id"), F.col("t0").alias("t"), F.col("e0").alias("e"), "cnt", "top", "total"))

    def run(key, table):
        ids = table.column("perm_id").to_pylist()
        old = ids.index(-1) if -1 in ids else None
        base = old if old is not None else ids.index(0)

        def values(column: str, k: int, kind) -> np.ndarray:
            return np.frombuffer(table.column(column)[k].as_py(), kind)

        plain = table.column("e")[base].as_py() is None
        t0 = values("t", base, float)
        wide = np.float64 if old is not None else np.float32
        e0 = t0 if plain else values("e", base, wide).astype(float)
        n, s = len(t0), np.sign(t0)
        new = [k for k in range(len(ids)) if k != old]
        cnt = np.zeros((2, n), np.int64) if old is None else values("cnt", old, np.int64).reshape(2, n).copy()
        total = np.zeros((2, n)) if old is None else values("total", old, float).reshape(2, n).copy()
        top = [np.empty((n, 0))] * 2 if old is None else list(values("top", old, float).reshape(2, n, -1))
        for m, v0 in enumerate((t0, e0)):
            if new:
                v = np.stack([values("t", i, float) if m == 0 or plain else values("e", i, np.float32).astype(float) for i in new])
                cnt[m] += linear.reaches(v, v0).sum(0)
                total[m] += v.sum(0)
                both = np.concatenate([top[m], (s * v).T], 1)
                top[m] = both if both.shape[1] <= k else np.partition(both, both.shape[1] - k, 1)[:, -k:]
        held = np.sort(np.stack(top), 2)[:, :, ::-1]
        return pa.Table.from_batches([_batch([(key[0].as_py(), t0.tobytes(), None if plain else e0.tobytes(), cnt.tobytes(), held.tobytes(), total.tobytes())], out)])

    return rows.groupBy("block_id").applyInArrow(run, STATE)


def unpacked(state: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The observed statistics, and ``measure, element_id, cnt, top, total`` of every element, from the last state."""

    def observed(batches):
        for b in batches:
            for block_id, t, e in zip(b.column("block_id").to_pylist(), b.column("t0"), b.column("e0")):
                t = np.frombuffer(t.as_py())
                e = t if e.as_py() is None else np.frombuffer(e.as_py())
                ids = np.arange(block_id * block, block_id * block + len(t))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(t.astype(np.float32)), pa.array(e.astype(np.float32)), pa.array(t), pa.array(e)], names=["element_id", "stat", "enh", "t0", "e0"])

    def per(batches):
        for b in batches:
            for block_id, cnt, top, total in zip(b.column("block_id").to_pylist(), b.column("cnt"), b.column("top"), b.column("total")):
                total = np.frombuffer(total.as_py()).reshape(2, -1)
                n = total.shape[1]
                cnt, top = np.frombuffer(cnt.as_py(), np.int64).reshape(2, n), np.frombuffer(top.as_py()).reshape(2, n, -1)
                ids = pa.array(np.arange(block_id * block, block_id * block + n))
                for m, name in enumerate(("stat", "enh")):
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * top.shape[2])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), ids, pa.array(cnt[m]), pa.ListArray.from_arrays(offsets, pa.array(top[m].ravel())), pa.array(total[m])], names=["measure", "element_id", "cnt", "top", "total"])

    return state.mapInArrow(observed, permutation.OBSERVED), state.mapInArrow(per, "measure string, element_id long, cnt long, top array<double>, total double")


def reductions(
    rows: DataFrame, x, c, exchanges: np.ndarray, space=None, E: float = 0.5, H: float = 2.0, signs: bool = False, n_tail: int = 100, shrink: float = 0.0,
    wave: int | None = None, alpha: float | None = None, method: str = "raw", interaction: bool = False, rz=None, columns=None, block: int = BLOCK,
    check=None, check_at: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """``observed``, ``null``, ``per`` and info of a test, before p-values. With ``alpha`` the sequential rule is applied after each wave of ``wave``
    exchanges, and the state takes the maps up to the stop alone; after ``check_at`` exchanges ``check(observed, null, per, used)`` may end the test."""
    x, c, exchanges = np.asarray(x, float), np.asarray(c, float), np.asarray(exchanges)
    kind = {"signs": signs, "shrink": shrink, **permutation.moved_by(x, exchanges, method, interaction, rz, columns)}
    linear.prepared(x, c, [None], **kind)  # shapes, degrees of freedom and the method are checked here
    data, n = blocked(rows, len(x), columns is not None, block)
    if space is not None and space.n != n:
        raise ValueError(f"the maps have {n} elements, their neighbourhood {space.n}")
    k = min(n_tail, len(exchanges) - 1) if len(exchanges) > 1 else 1
    info = {"stopped": False, "elements": n, "tail": k, "waves": 0}
    state, null, at, largest0 = None, None, 0, None
    while at < len(exchanges):
        end = min(at + (wave or WAVE), len(exchanges), check_at if check_at and at < check_at else len(exchanges))
        own = exchanges[at:end]
        largest = largest_variances(data, x, c, own, kind) if shrink else None
        largest0 = float(largest[0]) if largest is not None and at == 0 else largest0
        maps = scratch(enhanced(pieces(data, x, c, own, at, kind, largest, exchanges[0], largest0), space, E, H), "maps")
        maxima = scratch(maps.where("block_id = -1").select("perm_id", "t_max", "t_min", "e_max", "e_min"), "maxima")
        null = maxima if null is None else null.unionByName(maxima)
        stop = None
        if alpha is not None and n:
            if at == 0:
                up, down = maxima.where("perm_id = 0").select("e_max", "e_min").first()
            stop = permutation.stopped_at(null, max(float(up), 0.0), min(float(down), 0.0), alpha)
            if stop is not None:
                end = max(at, min(end, stop + 1))
                null = null.where(F.col("perm_id") < end)
        new = scratch(merged(state, maps.where(F.col("perm_id") < end), k), "state")
        drop_scratch(maps)
        drop_scratch(state)
        state, at = new, end
        info["waves"] += 1
        if stop is not None:
            info["stopped"] = True
            break
        if check is not None and at == check_at:
            observed, per = unpacked(state, block)
            if not check(observed, null, per, at):
                info["stopped"] = True
                break
    drop_scratch(data)
    observed, per = unpacked(state, block)
    return observed, null, per, info | {"used": at}


def test_by_blocks(
    rows: DataFrame, x, c, exchanges: np.ndarray, space=None, E: float = 0.5, H: float = 2.0, signs: bool = False, n_tail: int = 100, shrink: float = 0.0,
    fwe: str = "two_sided", floor: float | None = None, wave: int | None = None, alpha: float = 0.05, contrast_id: int = 1, half: bool = False,
    method: str = "raw", interaction: bool = False, rz=None, columns=None, break_after: int | None = None, block: int = BLOCK,
) -> permutation.Outcome:
    """:func:`permafield.plans.permutation.permutation_test` for data of any number of elements; the same arguments, the same results.

    Only a map (8 bytes an element) must fit one task. ``info["waves"]`` says how many waves were run.
    """
    last: dict = {}

    def check(observed, null, per, used) -> bool:
        last["early"] = permutation.finish(observed, per, null, used, contrast_id, half, fwe, floor, {})
        return not last["early"].result.where("p_fwe < 0.05").isEmpty()

    early = break_after if break_after and break_after < len(exchanges) else None
    observed, null, per, info = reductions(rows, x, c, exchanges, space, E, H, signs, n_tail, shrink, wave, alpha if wave else None, method, interaction, rz, columns, block, check if early else None, early)
    used = info.pop("used")
    if early and info["stopped"] and used == early and "early" in last:
        last["early"].info.update(info)
        return last["early"]
    return permutation.finish(observed, per, null, used, contrast_id, half, fwe, floor, info)


test_by_blocks.__test__ = False  # a plan, not a test of pytest
