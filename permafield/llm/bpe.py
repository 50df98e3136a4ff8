"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters are cut at safe boundaries before they are encoded.
LONG = 65_536
#: White-space characters of a run that the library's regex is not trusted with.
SPACES = 50_000
_RUN = re.compile(r"\s{%d}" % SPACES)

_encodings: dict = {}


def encoding(path: str, pattern: str):
    """tiktoken's ``Encoding`` from a rank file (base64 bytes and rank on each line), one for each worker process."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def safe_parts(text: str, most: int = LONG) -> Iterator[str]:
    """Cut a long text where no match of the pattern can reach across: before white space that follows a non-space.

    A part without such a place stays whole, however long it is; see :func:`encode` for long runs of white space.
    """
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def by_match(enc, text: str) -> np.ndarray:
    """Ids of a text match by match, each match found by Python's regex: for runs that overflow the library's own."""
    import regex

    ids: list[int] = []
    for m in regex.finditer(enc._pat_str, text):
        ids += enc._encode_single_piece(m.group())
    return np.asarray(ids, "<u4")


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of a whole text as uint32; null and empty texts have none.

    Parts of a long text that hold a run of SPACES or more white-space characters are encoded match by match.
    """
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= LONG:
        return np.asarray(enc.encode_ordinary(text), "<u4")
    return np.concatenate([by_match(enc, p) if len(p) > LONG and _RUN.search(p) else np.asarray(enc.encode_ordinary(p), "<u4") for p in safe_parts(text)])


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, whole: ``id, ids array<int>``, one row for each input row in its own task, without a shuffle.

    Nulls: a null text has an empty list; a null id is kept. Repeated rows give repeated rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            got = [encode(enc, t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, got)]).astype("<i4")
            flat = np.concatenate(got).astype("<i4") if got else np.empty(0, "<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each list of ids as ``id, bytes``: raw bytes, whether or not they are whole characters. Null and
    empty lists decode to nothing; ids and lists may repeat and be of any length. Other columns are not read."""
    from pyspark.sql import types as T

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode_bytes(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "bytes"])

    out = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("bytes", T.BinaryType())])
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, out)


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts: 0 tokens and the digest of nothing. One row for each input row.
    """
    kind = docs.schema[id_col].dataType
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = encode(enc, t.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)
