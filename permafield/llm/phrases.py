"""Phrase collocation mining: count tries of bounded depth per shard, cut into prefix ranges, merged, and scored by left and right parts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permafield.llm import common

#: Words of the longest phrase.
DEPTH = 4
#: Words that a task counts into one trie, leaves of a written block, leaves that a range gathers, and most ranges. They set memory and balance alone.
SHARD, BLOCK, RANGE, MOST_RANGES = 2_000_000, 32_768, 1_000_000, 50_000
#: Most block headers that the driver looks at to set the ranges; of more, a share by hash.
HEADERS = 200_000
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20

#: What ends a piece of text becomes the word ".", which cannot be in a piece; a tab becomes a space.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", b"." * len(_ENDS) + b" ")


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, A-Z lower-cased, with a "." at each end of a piece, a bounded number at a time."""
    text = text.lower().translate(_TABLE)
    at = 0
    while at < len(text):
        cut = len(text) if len(text) - at <= PART else text.find(b" ", at + PART)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].replace(b".", b" . ").split()
        at = cut


# A trie of DEPTH levels is kept as its sorted leaves: a column of word ranks for each level (0 ends a path early) and their counts. A
# node is a run of leaves with the same first columns, and its count is the sum of theirs.


def keys(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns packed into as few 64-bit keys as ranks of so many bits allow, the first levels highest."""
    per = max(1, 64 // max(1, bits))
    out = []
    for k in range(0, DEPTH, per):
        key = columns[k].astype(np.uint64)
        for c in columns[k + 1 : k + per]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        out.append(key)
    return out


def reduce_leaves(columns: list[np.ndarray], n: np.ndarray | None, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sort leaves and add up equal ones; without counts each leaf counts one. Sorted runs are merged by the stable sort."""
    packed = keys(columns, bits)
    if n is None and len(packed) == 1:
        key = np.sort(packed[0])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends, key = np.r_[first[1:], len(key)], key[first]
        mask = np.uint64((1 << bits) - 1)
        return [(key >> np.uint64(bits * (DEPTH - 1 - k)) & mask).astype(np.uint32) for k in range(DEPTH)], ends - first
    order = np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])
    differ = np.zeros(len(order), bool)
    differ[:1] = True
    for key in packed:
        key = key[order]
        differ[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(differ)
    ones = np.ones(len(order), np.int64) if n is None else n[order]
    return [c[order[first]] for c in columns], np.add.reduceat(ones, first) if len(first) else ones


def shard_leaves(ids: list[np.ndarray], known: dict[bytes, int]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Sorted words, leaf columns and counts of a shard's stream of word ids, where 0 ends a piece: every word starts one path of up to
    DEPTH words within its piece, so the paths are the leaves and every phrase's count is that of its node."""
    names = sorted(w for w in known if w != b".")
    rank = np.zeros(len(known), np.uint32)
    rank[np.fromiter((known[w] for w in names), np.int64, len(names))] = np.arange(1, len(names) + 1, dtype=np.uint32)
    x = rank[np.concatenate([*ids, np.zeros(DEPTH, np.uint32)])]
    at = np.flatnonzero(x)
    columns = [x[at]]
    for k in range(1, DEPTH):
        columns.append(np.where(columns[-1] > 0, x[at + k], 0).astype(np.uint32))
    return names, *reduce_leaves(columns, None, len(names).bit_length())


def starts(columns: list[np.ndarray], depth: int, before: np.ndarray | None) -> np.ndarray:
    """Whether a leaf is the first of its node at a depth, given that for the depth above."""
    c = columns[depth]
    new = np.r_[True, c[1:] != c[:-1]]
    return new if before is None else new | before


def dump(names: list[bytes], columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """A trie as bytes, level by level: each node's word and the leaves below it, then the leaves' counts and the words."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    arrays, new = [], None
    for k in range(DEPTH):
        new = starts(columns, k, new)
        first = np.flatnonzero(new)
        arrays += [np.where(columns[k][first] > 0, np.searchsorted(used, columns[k][first]) + 1, 0), np.diff(np.r_[first, len(new)])]
    arrays = [np.ascontiguousarray(a, "<u4") for a in [*arrays, n]]
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]  # like bytes next to each other
    data = np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(planes) + b" ".join([names[k - 1] for k in used])
    return np.array([len(data)], "<u8").tobytes() + pa.compress(data, "zstd", asbytes=True)


def load(data: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """What :func:`dump` wrote."""
    plain = pa.decompress(data[8:], int(np.frombuffer(data, "<u8", 1)[0]), "zstd", asbytes=True)
    lengths = np.frombuffer(plain, "<u4", 2 * DEPTH + 1)
    at, arrays = 4 * len(lengths), []
    for n in lengths.tolist():
        arrays.append(np.ascontiguousarray(np.frombuffer(plain, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return plain[at:].split(b" "), [np.repeat(arrays[2 * k], arrays[2 * k + 1]) for k in range(DEPTH)], arrays[-1].astype(np.int64)


def path(names: list[bytes], columns: list[np.ndarray], row: int) -> bytes:
    return b" ".join([names[c[row] - 1] for c in columns if c[row]])


def place(names: list[bytes], columns: list[np.ndarray], split: list[bytes]) -> int:
    """The first leaf that is not before a path."""
    low, high = 0, len(columns[0])
    for word, c in zip(split, columns):
        k = bisect_left(names, word)
        here = low + int(np.searchsorted(c[low:high], k + 1))
        if k == len(names) or names[k] != word:
            return here
        low, high = here, low + int(np.searchsorted(c[low:high], k + 2))
    return low


BLOCKS = "lang string, first binary, last binary, leaves long, trie binary"


def blocks(docs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``lang, first, last, leaves, trie``: the tries of all shards as sorted blocks of leaves. A shard is up to about ``shard`` words of one task."""

    def run(batches):
        known: dict[str, dict] = {}
        stream: dict[str, list[np.ndarray]] = {}
        held = 0
        end = np.zeros(1, np.uint32)

        def flush():
            for lang, ids in stream.items():
                if len(known[lang]) == 1:
                    continue  # no word
                names, columns, n = shard_leaves(ids, known[lang])
                rows = []
                for a in range(0, len(n), block):
                    part = [c[a : a + block] for c in columns]
                    rows.append((lang, path(names, part, 0), path(names, part, -1), len(part[0]), dump(names, part, n[a : a + block])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], names=["lang", "first", "last", "leaves", "trie"])
            known.clear()
            stream.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in known:
                    known[lang] = defaultdict(count().__next__)
                    known[lang][b"."]  # its id is 0
                    stream[lang] = []
                number, ids = known[lang].__getitem__, stream[lang]
                for part in words(text.as_py()):
                    ids.append(np.fromiter(map(number, part), np.uint32, len(part)))
                    held += len(part)
                    if held >= shard and ids[-1].size and not ids[-1][-1]:  # between pieces
                        yield from flush()
                        held = 0
                        known[lang] = defaultdict(count().__next__)
                        known[lang][b"."]
                        stream[lang] = []
                        number, ids = known[lang].__getitem__, stream[lang]
                ids.append(end)
            if held >= shard:
                yield from flush()
                held = 0
        yield from flush()

    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def ranges(written: DataFrame, reach: int = RANGE) -> dict[str, list[list[bytes]]]:
    """For each language the paths, in order, at which it is cut into ranges of about ``reach`` leaves, by the headers of all blocks (each
    stands for as many leaves of its shard); of more than HEADERS, by a share of them. It sets the balance, not the result."""
    heads = written.select("lang", "first", "leaves")
    total, many = heads.agg(F.sum("leaves"), F.count("*")).first()
    if many > HEADERS:
        heads = heads.where(F.pmod(F.xxhash64("lang", "first"), F.lit(1 << 30)) < int(HEADERS / many * (1 << 30)))
    share = max(reach, (total or 0) / MOST_RANGES) * min(1.0, HEADERS / max(1, many))
    found: dict[str, list[tuple[list[bytes], int]]] = defaultdict(list)
    for r in heads.toLocalIterator():
        found[r["lang"]].append((bytes(r["first"]).split(b" "), r["leaves"]))
    cuts: dict[str, list[list[bytes]]] = {}
    for lang, rows in found.items():
        rows.sort()
        cuts[lang], held = [], 0
        for first, leaves in rows:
            if held >= share and first != (cuts[lang] or [None])[-1]:
                cuts[lang].append(first)
                held = 0
            held += leaves
    return cuts


def cut(written: DataFrame, cuts: dict[str, list[list[bytes]]]) -> DataFrame:
    """``lang, part, trie``: every block, cut where a range ends within it."""
    sent = written.sparkSession.sparkContext.broadcast(cuts)  # at most MOST_RANGES paths

    def run(batches):
        for b in batches:
            rows = []
            for lang, first, last, trie in zip(*(c.to_pylist() for c in b.columns)):
                splits = sent.value.get(lang, [])
                low, high = bisect_right(splits, first.split(b" ")), bisect_right(splits, last.split(b" "))
                if low == high:
                    rows.append((lang, low, trie))
                    continue
                names, columns, n = load(trie)
                at = [0, *(place(names, columns, s) for s in splits[low:high]), len(n)]
                rows += [(lang, low + k, dump(names, [c[x:y] for c in columns], n[x:y])) for k, (x, y) in enumerate(zip(at, at[1:])) if x < y]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=["lang", "part", "trie"])

    return written.select("lang", "first", "last", "trie").mapInArrow(run, "lang string, part int, trie binary")


COUNTS = "lang string, phrase string, depth int, n long, " + ", ".join(f"l{k} long" for k in range(1, DEPTH)) + ", edge int"


def merge(pieces: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, depth, n, l1, l2, l3, edge``: each range's tries merged into one and walked.

    ``n`` counts the phrase, ``l1`` to ``l3`` its first one, two and three words. Where a node is the first or last of its depth in the
    range, leaves of it may lie in the next range: ``edge`` is the depth down to which a row's path is such. Returned are the nodes that
    count ``least`` or more and all at an edge (at most two of a depth), with the root at depth 0.
    """

    def run(key, table):
        tries = [load(x) for x in table.column("trie").to_pylist()]
        names = sorted(set().union(*(t[0] for t in tries)))
        number = {w: k + 1 for k, w in enumerate(names)}
        ranks = [np.fromiter((number[w] for w in t[0]), np.uint32, len(t[0])) for t in tries]
        columns = [np.concatenate([np.r_[np.uint32(0), r][t[1][k]] for r, t in zip(ranks, tries)]) for k in range(DEPTH)]
        n = np.concatenate([t[2] for t in tries])
        del tries, ranks
        columns, n = reduce_leaves(columns, n, len(names).bit_length())
        out: list[tuple] = [("", 0, int(n.sum()), *[None] * (DEPTH - 1), 0)]
        new, nodes, sums = None, [], []
        edge = np.zeros(len(n), np.int32)
        for k in range(DEPTH):
            new = starts(columns, k, new)
            node = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            edge += (columns[k] > 0) & ((node == 0) | (node == node[-1]))
            kept = np.flatnonzero((columns[k][first] > 0) & ((total >= least) | (edge[first] == k + 1)))
            rows = first[kept]
            lefts = [sums[j][nodes[j][rows]].tolist() for j in range(k)] + [[None] * len(rows)] * (DEPTH - 1 - k)
            texts = [" ".join(p) for p in zip(*([names[i - 1].decode("utf-8", "replace") for i in columns[j][rows].tolist()] for j in range(k + 1)))]
            out += zip(texts, [k + 1] * len(rows), total[kept].tolist(), *lefts, edge[rows].tolist())
            nodes.append(node)
            sums.append(total)
        types = [pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * (DEPTH - 1), pa.int32()]
        columns_out = [pa.array([key[0].as_py()] * len(out), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*out), types))]
        return pa.Table.from_arrays(columns_out, names=["lang", "phrase", "depth", "n", *(f"l{k}" for k in range(1, DEPTH)), "edge"])

    return pieces.groupBy("lang", "part").applyInArrow(run, COUNTS)


def counts(docs: DataFrame, least: int = 30, shard: int = SHARD, block: int = BLOCK, reach: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``lang, phrase, depth, n, l1, l2, l3`` of all phrases of up to DEPTH words that occur ``least`` times or more, and
    ``lang, total`` of all words."""
    written = common.materialise(blocks(docs, shard, block), "tries", "none")
    merged = common.materialise(merge(cut(written, ranges(written, reach)), least), "phrases")
    common.drop_written(written)
    # Nodes at the edges of ranges: at most 2 * DEPTH + 1 a range.
    edges = common.materialise(merged.where("edge >= depth").groupBy("lang", "phrase", "depth").agg(F.sum("n").alias("n")), "edges")
    lefts = [f"l{k}" for k in range(1, DEPTH)]
    inner = merged.where("edge < depth")
    outer = edges.where(F.col("depth") > 0).where(F.col("n") >= least).select("lang", "phrase", "depth", "n", *(F.lit(None).cast("long").alias(x) for x in lefts), F.col("depth").alias("edge"))
    every = inner.unionByName(outer)
    for k, x in enumerate(lefts, 1):
        whole = edges.where(F.col("depth") == k).select(F.col("lang").alias("elang"), F.col("phrase").alias("ephrase"), F.col("n").alias("whole"))
        same = (F.col("lang") == F.col("elang")) & (F.substring_index("phrase", " ", k) == F.col("ephrase")) & (F.col("edge") >= k) & (F.col("depth") > k)
        every = every.join(F.broadcast(whole), same, "left").withColumn(x, F.coalesce("whole", x)).drop("elang", "ephrase", "whole")
    found = common.materialise(every.drop("edge"), "counts")
    totals = common.materialise(edges.where("depth = 0").select("lang", F.col("n").alias("total")), "totals")
    for x in (merged, edges):
        common.drop_written(x)
    return found, totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, shard: int = SHARD, block: int = BLOCK, reach: int = RANGE) -> DataFrame:
    """The best ``top`` phrases of 2 to DEPTH words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. A candidate occurs ``least``
    times or more. Of its cuts into a left and a right part the one with the lowest score floor(2000000 * a / (l + r)) counts, of equal
    ones the first. A candidate within a longer one with ``inside`` percent of its count or more is dropped. Ties go by a, then by the
    phrase's bytes.

    Every task counts its words into tries (see :func:`blocks`), which are written as sorted blocks, cut into prefix ranges of about equal size
    by their headers, and merged range by range (:func:`merge`), so a very common word or pair is spread over ranges and no task holds
    more than a range (``shard``, ``block`` and ``reach`` set their sizes, not the result). Left parts come from the walk along the merged trie, right parts from the phrase without its first words. It is
    enough to look at phrases one word longer: what is within a longer candidate is within one of those, which is no rarer.

    Null texts are empty, a null ``lang`` is ``und``; ids are not read, so repeated rows count each; extra columns are not read; texts may be of
    any length (they are cut into words a part at a time); an empty table gives no rows.
    """
    found, totals = counts(docs, least, shard, block, reach)
    candidates = found.where("depth >= 2")
    cuts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.expr(f"substring_index(phrase, ' ', {k} - depth)").alias("rest"), (F.col("depth") > k).alias("real")) for k in range(1, DEPTH))))
    parts = candidates.select("lang", "phrase", F.col("n").alias("a"), cuts.alias("c")).select("lang", "phrase", "a", "c.*").where("real")
    rights = found.where(F.col("depth") < DEPTH).select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr("(2000000bd * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    scored = parts.join(rights, ["lang", "rest"]).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    longer = found.where("depth >= 3").select("lang", "n", F.explode(F.array(F.expr("substring_index(phrase, ' ', depth - 1)"), F.expr("substring_index(phrase, ' ', 1 - depth)"))).alias("phrase"))
    over = longer.groupBy("lang", "phrase").agg(F.max("n").alias("over"))
    kept = scored.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * inside))
    flat = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
