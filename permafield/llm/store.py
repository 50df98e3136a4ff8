"""A content-addressed store of id streams: content-defined chunks stored once, document recipes, Merkle manifests.

Layout below one folder: ``packs/*.ids`` (chunk bytes, one after another), ``index`` (Parquet: digest, file, offset,
n, width), ``recipes`` (Parquet, ascending id: start, length, chunk digests, Merkle root), ``manifest.json``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permafield.llm.common import drop_written, materialise
from permafield.llm.wordbpe import encoder

#: Ids in the rolling window, chunk sizes in ids (least, mean beyond it (a power of two), most): fixed values of the format.
WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 4096
#: Ids whose documents' roots are digested together.
RANGE = 10_000_000
#: Chunk digests that one task remembers so as not to send a chunk's bytes twice.
REMEMBERED = 500_000

_gear = np.random.Generator(np.random.Philox(20240229)).integers(0, 2**64, 65536, dtype=np.uint64)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one stream: where the hash of the last WINDOW ids has its low bits clear."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = _gear[ids & 0xFFFF]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint64(span)
        span *= 2
    at = np.flatnonzero((h & np.uint64((MEAN - 1) << 32)) == 0) + 1
    ends, last = [], 0
    for c in at.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def packed(ids: np.ndarray) -> tuple[bytes, int]:
    """A chunk's bytes and the bytes of an id: two where every id fits, else four; little-endian."""
    width = 2 if len(ids) == 0 or int(ids.max()) < 65536 else 4
    return ids.astype("<u2" if width == 2 else "<u4").tobytes(), width


def digest_of(data: bytes, width: int) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=b"ids%d" % width).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node is carried up. No leaves: the digest of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(level) & ~1 :]
    return level[0]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Tokenise whole documents, append ``end_id`` to each, and write the store at ``path`` (a folder every executor reaches).

    One pass over the texts; a task sends a chunk's bytes once, and only chunk bytes and recipes are shuffled: chunks by
    digest, so one that a third of all documents share is one row from each task, and recipes by root and id, so that equal documents are dealt
    out evenly. Null texts are the end id alone; null ids come first; rows with equal ids are separate documents, in the order
    of their roots. Returns the manifest.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    row = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("bytes", T.BinaryType()), T.StructField("doc_id", kind), T.StructField("digests", T.ArrayType(T.BinaryType()))])

    def chunked(batches):
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        seen: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, "<u4")
                digests, last = [], 0
                for c in cuts(ids):
                    data, width = packed(ids[last:c])
                    digests.append(d := digest_of(data, width))
                    if d not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(d)
                        rows.append((d, c - last, width, data, None, None))
                    last = c
                rows.append((merkle(digests), len(ids), None, None, key, digests))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(row)
    out = T.StructType([*row.fields[:3], T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), *row.fields[4:]])
    out_schema = to_arrow_schema(out)

    def stored(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        name = f"packs/{uuid.uuid4().hex}.ids"  # of this attempt; the committed index names only files of attempts that ended well
        sink, at, last = None, 0, None
        try:
            for b in batches:
                names, offsets, first = [], [], []
                with_bytes = b.column(3).is_valid()
                own = b.filter(with_bytes)
                for key, data in zip(own.column(0).to_pylist(), own.column(3).to_pylist()):
                    if new := key != last:
                        last = key
                        if sink is None:
                            fs.create_dir(f"{root}/packs", recursive=True)
                            sink = fs.open_output_stream(f"{root}/{name}")
                        sink.write(data)
                        names.append(name)
                        offsets.append(at)
                        at += len(data)
                    first.append(new)
                if first:
                    own = own.filter(pa.array(first, pa.bool_()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), own.column(4), own.column(5)], schema=out_schema)
                rest = b.filter(pc.invert(with_bytes))
                if rest.num_rows:
                    none = [pa.nulls(rest.num_rows, out_schema.field(k).type) for k in (3, 4)]
                    yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), rest.column(2), *none, rest.column(4), rest.column(5)], schema=out_schema)
        finally:
            if sink is not None:
                sink.close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(chunked, row)
    # A pack's rows come sorted by kind and digest: equal chunks of several tasks are neighbours, and one is stored.
    # Recipes are not looked up by their root, so they are dealt out by id too, and equal documents lie in many packs.
    dealt = F.when(F.col("bytes").isNull(), F.xxhash64("key", "doc_id")).otherwise(F.xxhash64("key"))
    all_rows = materialise(rows.repartition(dealt).sortWithinPartitions(F.col("bytes").isNull(), "key").mapInArrow(stored, out), "store")
    all_rows.where("file is not null").select(F.col("key").alias("digest"), "file", "offset", "n", "width").write.parquet(f"{path}/index")

    recipe = T.StructType([T.StructField("doc_id", kind), T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType()), T.StructField("part", T.IntegerType())])
    recipe_schema = to_arrow_schema(recipe)

    def placed(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - n), pa.array(n), b.column(2), b.column(3), pa.array(np.full(len(n), part, np.int32))], schema=recipe_schema)
            total = int(ends[-1]) if len(n) else total

    ordered = all_rows.where("file is null").select("doc_id", "n", "digests", "key").repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    ordered = materialise(ordered.mapInArrow(placed, recipe), "recipes")
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).orderBy("part").collect()  # a row for each partition
    starts, at = [], 0
    for p in parts:
        starts.append((p["part"], at))
        at += p["n"]
    offsets = spark.createDataFrame(starts, "part int, first long")
    final = ordered.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "digests", "root", "part")
    final.write.partitionBy("part").parquet(f"{path}/recipes") if parts else final.write.parquet(f"{path}/recipes")
    # A digest of each run of ids that start in one RANGE, then of a part's runs: no list grows with the input.
    listed = lambda at, of: F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat(F.format_string("%020d", at), of)))), 256).alias("root")
    runs = spark.read.parquet(f"{path}/recipes").groupBy("part", F.floor(F.col("start") / RANGE).alias("run")).agg(listed("start", F.hex("root")))
    roots = runs.groupBy("part").agg(listed("run", F.col("root"))).orderBy("part").collect()
    manifest = {"version": 1, "end_id": end_id, "documents": sum(p["docs"] for p in parts), "ids": at, "parts": {str(r["part"]): r["root"] for r in roots}, "root": merkle([bytes.fromhex(r["root"]) for r in roots]).hex()}
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{root}/packs", recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    drop_written(all_rows)
    drop_written(ordered)
    return manifest


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rebuild every document from the store's files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids array<int>``.

    One row for each document written, in no order; null and repeated ids are what was written, an empty store gives no rows.
    Every chunk's digest, every document's Merkle root and length are verified; a difference raises ``ValueError``.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    index = spark.read.parquet(f"{path}/index")
    kind = recipes.schema["doc_id"].dataType
    found = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("k", "digest")).join(index, "digest", "left")
    found = found.groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("k", "file", "offset", "n", "width", "digest"))).alias("chunks"))
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def rebuilt(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        files: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(4)
            ends = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
            chunk = lists.flatten()
            file, offset, sizes, width, digest = (chunk.field(k).to_pylist() for k in ("file", "offset", "n", "width", "digest"))
            if None in file:
                raise ValueError("a chunk is missing from the index")
            data: dict = {}
            for name, at, size in sorted({(f, o, n * w) for f, o, n, w in zip(file, offset, sizes, width)}):  # in file order
                if name not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[name] = fs.open_input_file(f"{root}/{name}")
                data[name, at] = files[name].read_at(size, at)
            counts, sums, streams, last = [], [], [], 0
            for start, n_tokens, whole, end in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), ends):
                parts = []
                for k in range(last, end):
                    got = data[file[k], offset[k]]
                    if digest_of(got, width[k]) != digest[k]:
                        raise ValueError(f"chunk {digest[k].hex()} differs from its digest")
                    parts.append(np.frombuffer(got, "<u2" if width[k] == 2 else "<u4").astype("<u4"))
                ids = np.concatenate(parts)
                if len(ids) != n_tokens or merkle(digest[last:end]) != whole:
                    raise ValueError(f"document at {start} differs from its recipe")
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
                if with_ids:
                    streams.append(ids.astype("<i4"))
                last = end
            more = [pa.array(streams, schema.field(4).type)] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), *more], schema=schema)

    return found.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(rebuilt, out)
