"""Near-duplicate documents by MinHash with tensored banding, every candidate verified on the full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permafield.llm.common import WORDS, allowed, bucket_components, buckets, connected_components, drop_written, free_name, materialise, release

#: Hash collections, sub-keys in each, and minima in a sub-key. Tables are keyed by pairs of sub-keys of two different
#: collections: 150 tables of 6 minima each from 60 minima in all. At a similarity of 0.8 a pair of documents meets in no table
#: with a probability of 8e-5 (two collections or more must hold an equal sub-key), at 0.85 of 1e-6.
COLLECTIONS, SIDE, ROWS = 4, 5, 3
KEYS = COLLECTIONS * SIDE
TABLES = [(i, j) for i in range(KEYS) for j in range(i + 1, KEYS) if i // SIDE != j // SIDE]
#: Bits of a parity map.
BITS = 64 * WORDS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.Philox(41))
_MASKS = _RANDOM.integers(0, 2**64, KEYS * ROWS, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_P, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-word shingles of texts that stand one after another in ``data``, and where each text's begin.

    A-Z are lower-cased; words are runs of bytes other than space and \\t to \\r. A text of fewer than ``n`` words has its
    whole sequence as one shingle; one without words has none.
    """
    size, docs = len(data), len(offsets) - 1
    starts = np.zeros(docs + 1, np.int64)
    if not size:
        return np.empty(0, np.uint64), starts
    low = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    first = np.flatnonzero(word & ~before)
    last = np.flatnonzero(word & ~after) + 1
    if not len(first):
        return np.empty(0, np.uint64), starts
    # A word's hash is its part of one running polynomial sum, moved to where the word begins.
    power, inverse = _grown(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
    words = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(offsets, first, "right") - 1
    per = np.bincount(doc, minlength=docs)
    out_parts = np.maximum(per - n + 1, (per > 0).astype(np.int64))
    starts[1:] = np.cumsum(out_parts)
    w = len(words)
    if w >= n:
        h = np.zeros(w - n + 1, np.uint64)
        for k in range(n):
            h += words[k : k + len(h)] * _PLACE[k]
        good = doc[: len(h)] == doc[n - 1 :]
        full = mix(h)[good]
    else:
        full = np.empty(0, np.uint64)
    short = np.flatnonzero((per > 0) & (per < n))
    if not len(short):
        return full, starts
    out = np.empty(int(starts[-1]), np.uint64)
    whole = np.ones(len(out), bool)
    whole[starts[short]] = False
    out[whole] = full
    at = np.concatenate([[0], np.cumsum(per)])
    for d in short:
        own = words[at[d] : at[d + 1]]
        out[starts[d]] = mix((own * _PLACE[: len(own)]).sum(dtype=np.uint64)[None] + np.uint64(len(own)))[0]
    return out, starts


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, fa, fb`` (a fingerprint of the set), ``subkeys`` and the set's parity ``map`` (both null without words)."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("n_shingles long, fa long, fb long, subkeys array<long>, map array<long>").fields])

    def run(batches):
        for b in batches:
            data, offsets = _texts(b.column(1))
            h, starts = shingles(data, offsets, n)
            count = len(offsets) - 1
            full = np.flatnonzero(np.diff(starts))
            sizes, fa, fb = np.zeros(count, np.int64), np.zeros(count, np.uint64), np.zeros(count, np.uint64)
            keys, maps = np.zeros((len(full), KEYS), np.uint64), np.zeros((len(full), WORDS), np.uint64)
            if len(full):
                at = starts[full]
                for k in range(KEYS):
                    for r in range(ROWS):
                        least = np.minimum.reduceat(h ^ _MASKS[k * ROWS + r], at)
                        keys[:, k] = mix(keys[:, k] * np.uint64(3) + least)
                for i, d in enumerate(full):
                    own = np.unique(h[starts[d] : starts[d + 1]])
                    odd = (np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
                    maps[i] = np.packbits(odd, bitorder="little").view("<u8")
                    sizes[d] = len(own)
                    fa[d] = mix(own).sum(dtype=np.uint64)
                    fb[d] = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            held = np.concatenate([[0], np.cumsum(np.diff(starts) > 0)]).astype(np.int32)
            none = pa.array(np.diff(starts) == 0)
            lists = [pa.ListArray.from_arrays(pa.array(held * x.shape[1], pa.int32()), pa.array(x.reshape(-1).view(np.int64)), mask=none) for x in (keys, maps)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), *lists], names=out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``node, items``: the sorted distinct shingle hashes of ``doc_id, text`` rows as bytes."""
    out = T.StructType([T.StructField("node", docs.schema["doc_id"].dataType), T.StructField("items", T.BinaryType())])

    def run(batches):
        for b in batches:
            data, offsets = _texts(b.column(1))
            h, starts = shingles(data, offsets, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(h[starts[d] : starts[d + 1]]).tobytes() for d in range(len(offsets) - 1)], pa.binary())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b`` those whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * same >= percent * (both - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType
    # Only the sets of these pairs are shuffled.
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x")).join(pairs.select("a"), "a", "left_semi")
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y")).join(pairs.select("b"), "b", "left_semi")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked at ``100 * intersection >= percent * union`` of their n-word shingle sets:
    ``doc_id, n_shingles, component_id`` (the smallest id reachable), ``kept`` (the document is that one).

    Equal sets are one class from the start. Sub-keys that only one class has are left out before the tables are made of pairs
    of the others: a table's key that two classes share is a pair of shared sub-keys, so that loses none. So are, once each class
    has met the smallest class of each of its sub-keys, those whose classes are one component by then. Within the tables'
    buckets links are found as :func:`~permafield.llm.common.bucket_components` says, and verified on the full sets.

    Null texts and texts without words: no shingles, linked with nothing. Null ids: in no component, kept. Rows with one id
    are one document for linking. Texts of any length are taken whole. No rows: none. Other columns are not read, whatever
    their names.
    """
    sig = materialise(signatures(docs, n, id_col, text_col), "signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("n_shingles", "fa", "fb").agg(F.min("doc_id").alias("node"), F.first("subkeys").alias("k"), F.first("map").alias("map"))
    classes = materialise(classes, "classes")
    each = classes.select("node", F.posexplode("k").alias("i", "k")).repartition("i", "k")
    several = each.groupBy("i", "k").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).where("pivot < high").select("i", "k", "pivot")
    # The hash table is of the shared sub-keys' side, a row for each, so the many others need no sort.
    alive = materialise(each.join(several.hint("shuffle_hash"), ["i", "k"]), "alive")
    prints = classes.select("node", F.col("n_shingles").alias("n"), "map")

    def sets_of(nodes: DataFrame) -> DataFrame:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        made = materialise(_sets(texts, n).dropDuplicates(["node"]), "sets")
        release(docs.sparkSession)
        return made

    # Each class meets the first of its sub-keys' others, so that large groups of near copies are one component before tables are made.
    pairs = materialise(allowed(alive.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), prints, percent), "pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = sets_of(met)
    links = materialise(_verified(pairs, first, percent), "links")
    found = connected_components(links)
    # Sub-keys of one component are left out, as every table made with them lies within it, and so are tables of one component.
    labelled = alive.join(found, "node", "left").select("node", "i", "k", F.coalesce("component", "node").alias("component"))
    apart = labelled.groupBy("i", "k").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("i", "k")
    kept = labelled.join(apart.hint("shuffle_hash"), ["i", "k"]).groupBy("node", "component").agg(F.collect_list(F.struct("i", "k")).alias("ks"))
    side = lambda x: F.floor(x["i"] / SIDE)
    tables = F.flatten(F.transform("ks", lambda x: F.transform(F.filter("ks", lambda y: (x["i"] < y["i"]) & (side(x) != side(y))), lambda y: F.xxhash64(x["i"], y["i"], x["k"], y["k"]))))
    shared = materialise(buckets(kept.select("node", "component", F.explode(tables).alias("key")), "component"), "shared")  # members of buckets with two classes or more
    release(docs.sparkSession)

    involved = shared.select("node").distinct()
    more = sets_of(involved.join(met, "node", "left_anti"))
    sets = first.unionByName(more)
    for written in (pairs, links, alive):
        drop_written(written)
    printed = materialise(prints.join(involved, "node", "left_semi"), "prints")
    final = bucket_components(shared, printed, lambda pairs: _verified(pairs, sets, percent), percent, found)
    for written in (first, more, shared, printed):
        drop_written(written)

    of_class = classes.select("n_shingles", "fa", "fb", "node").join(final, "node", "left").select("n_shingles", "fa", "fb", F.coalesce("component", "node").alias("component_id"))
    done = sig.select("doc_id", "n_shingles", "fa", "fb").join(of_class, ["n_shingles", "fa", "fb"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns. Of rows that repeat an id one stays; rows without an id all stay.

    Nulls, ties and texts of any length: as :func:`near_duplicates` says. Extra columns may have any names.
    """
    gone_name, many_name = free_name("_gone", docs.columns), free_name("_many", docs.columns)
    gone = near_duplicates(docs, n, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone_name)).distinct()
    left = docs.join(materialise(gone, "gone"), F.col(id_col) == F.col(gone_name), "left_anti")
    repeated = docs.groupBy(F.col(id_col).alias(many_name)).agg(F.count("*").alias("times")).where((F.col("times") > 1) & F.col(many_name).isNotNull()).select(many_name)
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():
        return left
    of_many = F.col(id_col) == F.col(many_name)
    return left.join(repeated, of_many, "left_anti").unionByName(left.join(repeated, of_many, "left_semi").dropDuplicates([id_col]))
