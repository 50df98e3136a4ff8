"""Packing documents into fixed windows: best-fit decreasing with a segment tree over the open windows' capacity."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permafield.llm.wordbpe import encoder

#: Documents and ids that one task holds before it packs them and goes on: a task's memory does not grow with its input.
CHUNK_DOCS, CHUNK_IDS = 20_000, 8_000_000


class CapacityTree:
    """Open windows by remaining capacity 1..size: a segment tree of counts whose descent finds the smallest capacity that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with room for ``need`` as (capacity, window), taken out; None if there is none."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: list[int], size: int, fill_gaps: bool = False) -> list[list[tuple[int, int, int]]]:
    """Pack items of ``lengths`` into windows of ``size``: for each window its pieces (item, start, length) in order.

    Items longer than a window are first cut into full windows; what is left of them and all others are placed
    longest first (ties: first given first) into the tightest open window. With ``fill_gaps``, windows that are still open then
    give their pieces, cut where needed, to the gaps of fuller ones, so that one window at most stays short.
    """
    windows: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        full = n // size
        windows.extend([(i, k * size, size)] for k in range(full))
        if n % size:
            rest.append((i, full * size, n % size))
    rest.sort(key=lambda x: -x[2])
    tree = CapacityTree(size)
    free: dict[int, int] = {}
    for piece in rest:
        found = tree.take(piece[2])
        if found is None:
            capacity, w = size, len(windows)
            windows.append([])
        else:
            capacity, w = found
        windows[w].append(piece)
        free[w] = capacity - piece[2]
        tree.put(free[w], w)
    if not fill_gaps:
        return windows
    order = sorted((w for w in free if free[w]), key=lambda w: (free[w], w))
    first, last = 0, len(order) - 1
    while first < last:
        to, giver = order[first], order[last]
        if not free[to]:
            first += 1
        elif not windows[giver]:
            last -= 1
        else:
            i, start, n = windows[giver].pop()
            moved = min(n, free[to])
            windows[to].append((i, start, moved))
            free[to] -= moved
            if moved < n:
                windows[giver].append((i, start + moved, n - moved))
            free[giver] += moved
    return [w for w in windows if w]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, fill_gaps: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: one row for each piece, with its ids as ``ids array<int>`` if asked.

    Every task packs its own documents in chunks of bounded size, so nothing is shuffled. Documents of at most ``size`` ids stay
    whole unless ``fill_gaps`` lets pieces be cut and moved, after which each chunk leaves one short window at most. ``sequence_id`` holds the task's partition in its upper bits. A null or empty text is the
    end id alone. Rows with equal or null ids are packed as separate documents. No rows: no pieces. Only the two
    named columns are read.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(PIECES).fields])
    if with_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))

    def packed(keys: list, ids: list[np.ndarray], first: int):
        windows = best_fit([len(x) for x in ids], size, fill_gaps)
        cols: list[list] = [[] for _ in range(7)]
        parts = []
        for w, pieces in enumerate(windows):
            offset = 0
            for i, start, n in pieces:
                part = ids[i][start : start + n]
                for c, v in zip(cols, (keys[i], start, n, zlib.crc32(part.tobytes()), len(ids[i]), first + w, offset)):
                    c.append(v)
                offset += n
                if with_ids:
                    parts.append(part)
        for k in range(0, len(cols[0]), 5000):
            arrays = [pa.array(cols[0][k : k + 5000], kind), *(pa.array(c[k : k + 5000], pa.int64()) for c in cols[1:])]
            if with_ids:
                own = parts[k : k + 5000]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own).astype("<i4"))))
            yield len(windows), pa.RecordBatch.from_arrays(arrays, names=out.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(out[0].dataType)

    def run(batches):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                keys.append(key)
                ids.append(np.frombuffer(enc.encode(text.as_py()) + end, "<u4"))
                held += len(ids[-1])
                if len(keys) >= CHUNK_DOCS or held >= CHUNK_IDS:
                    used = 0
                    for used, batch in packed(keys, ids, first):  # noqa: B007
                        yield batch
                    first, keys, ids, held = first + used, [], [], 0
        for _, batch in packed(keys, ids, first):
            yield batch

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)
