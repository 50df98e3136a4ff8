"""Quality rules: per-document measures, and lines that too many documents of one host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permafield.llm.common import drop_written, free_name, materialise, release
from permafield.llm.neardup import near_duplicates

#: Characters that count as symbols, and the words of a repeated window: fixed values.
SYMBOLS, RUN = b"#*$%&|<>", 8
#: Similarity in percent, and words of a shingle, from which two texts count as copies of one document.
COPY, COPY_WORDS = 70, 5
#: Lines shared by many documents that are sent to every task at most.
MOST_OFTEN = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COEFFICIENTS = np.random.Generator(np.random.Philox(7)).integers(1, 2**63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text holds twice or more."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)).astype(np.uint64)
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    window = np.zeros(n, np.uint64)
    for k in range(RUN):
        window += mixed[k : k + n] * _COEFFICIENTS[k]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + RUN, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text in UTF-8."""
    words = raw.split()
    if not words:
        return 0, 0, sum(raw.count(c) for c in SYMBOLS), 0, 0
    buf = np.frombuffer(raw, np.uint8)
    chars = int(((buf & 0xC0) != 0x80).sum()) - int(_SPACE[buf].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def normalised(raw: bytes) -> list[tuple[int, int]]:
    """Signed hash and words of every line: A-Z lower-cased, digits made 0, white space collapsed."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(xxhash.xxh64_intdigest(b" ".join(w))), len(w)) for w in (x.split() for x in raw.lower().translate(_DIGITS).split(b"\n"))]


def line_hashes(raw: bytes) -> tuple[list[int], list[int]]:
    """Of each distinct normalised line with a word: its hash, and its words in all places."""
    words: dict[int, int] = {}
    for h, n in normalised(raw):
        if n:
            words[h] = words.get(h, 0) + n
    return list(words), list(words.values())


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def content_key(host: str, text: str):
    """Rows with equal host and text share this key."""
    return F.md5(F.concat(F.coalesce(F.col(host).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_docs: int = 10,
    share: float = 0.001,
    left_words: int = 20,
    left_share: float = 0.2,
) -> DataFrame:
    """Measures and verdict of every row: ``key, doc_id, ... , removed_words, kept``.

    A line is removed from a host if more than ``max(least_docs, share * documents of the host)`` distinct documents of the host
    hold it, whatever stands around it. Copies are one document: equal texts of a host, and near copies (components linked at a
    similarity of ``COPY`` percent of their ``COPY_WORDS``-word shingle sets), so the lines that copies of one document share
    are not taken for boilerplate. Pages that are a shared block but for a few words of their own are near copies. A
    document is depleted, and not kept, if removal leaves fewer than ``left_words`` words or less than ``left_share`` of its
    words; one without removed lines never is. ``base_failed``: fewer than 20 words, or over 30 % of them in repeated 8-word
    windows.

    Null text: no words, base_failed. Null host: a host of its own. Null and repeated ids: one row out for each row in.
    Counts are pre-aggregated before every shuffle, and no list of documents is gathered.
    """
    return _verdict(*_judged(docs, id_col, text_col, host_col, least_docs, share), left_words, left_share)


def _verdict(measured: DataFrame, lines: DataFrame, removed: DataFrame, left_words: int = 20, left_share: float = 0.2) -> DataFrame:
    lost = lines.join(removed, ["host", "line"]).groupBy("key").agg(F.sum("words").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    done = measured.drop("lines", "line_words", "host").join(lost, "key", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return done.withColumn("kept", ~F.col("base_failed") & ~depleted)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, least_docs: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: measures of every row, ``host, key, line, words`` of every distinct text, and the removed ``host, line``."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(f"host string, key string, {MEASURES}, lines array<long>, line_words array<long>").fields])

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(3):
                raw = raw.as_py() or b""
                m = measures(raw)
                rows.append((*m, m[0] < 20 or 100 * m[4] > 30 * m[0], *line_hashes(raw)))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=out.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), content_key(host_col, text_col).alias("key"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    measured = materialise(rows.mapInArrow(run, out), "measures")

    single = measured.groupBy("key").agg(F.first("host").alias("host"), F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    lines = materialise(single.select("host", "key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")), "lines")
    sizes = measured.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(float(least_docs)), F.lit(share) * F.col("host_docs"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    often = materialise(counted.join(sizes, "host").where(F.col("n") > limit).select("host", "line", limit.alias("limit")), "often")
    if often.isEmpty():
        return measured, lines, often.select("host", "line")
    # Only texts that hold such a line can change its count by being copies of each other.
    held = materialise(lines.join(often, ["host", "line"]).select("host", "line", "limit", F.xxhash64("key").alias("node")), "held")
    texts = materialise(_holders(docs, often, held, text_col, host_col), "held-texts")
    copies = near_duplicates(texts, COPY_WORDS, COPY, "node", "text").select(F.col("doc_id").alias("node"), "component_id").where("component_id <> node").distinct()
    of_copy = held.join(copies, "node", "left").select("host", "line", "limit", F.coalesce("component_id", "node").alias("document")).distinct()
    removed = materialise(of_copy.groupBy("host", "line").agg(F.count("*").alias("n"), F.first("limit").alias("limit")).where(F.col("n") > F.col("limit")).select("host", "line"), "removed")
    for written in (held, texts):
        drop_written(written)
    release(docs.sparkSession)
    return measured, lines, removed


def _holders(docs: DataFrame, often: DataFrame, held: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``node, text`` of the rows that hold one of the ``often`` lines of their host.

    At most MOST_OFTEN of these lines go to every task, and no text is shuffled. A line is often above a thousandth of its host's documents, so
    they grow with the lines of a text and with the hosts, not with the documents; where they are more, the rows are joined with ``held``.
    """
    node = F.xxhash64(content_key(host_col, text_col)).alias("node")
    if often.count() > MOST_OFTEN:
        return docs.select(node, F.col(text_col).alias("text")).join(held.select("node").distinct(), "node", "left_semi")
    wanted: dict[str, set[int]] = {}
    for row in often.select("host", "line").collect():
        wanted.setdefault(row["host"], set()).add(row["line"])
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        wanted, none = sent.value, frozenset()
        for b in batches:
            keep = []
            for host, text in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                own = wanted.get(host, none)
                keep.append(bool(own and text) and any(n and h in own for h, n in normalised(text.encode())))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = docs.select(node, F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    return rows.mapInArrow(run, "node long, text string")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", **limits) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns, whose texts stay whole; see there for nulls, repeats and ties.

    Extra columns may have any names.
    """
    name = free_name("_rejected", docs.columns)
    bad = materialise(judge(docs, id_col, text_col, host_col, **limits).where("not kept").select(F.col("key").alias(name)).distinct(), "rejected")
    return docs.join(bad, content_key(host_col, text_col) == F.col(name), "left_anti")


def cut_lines(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", length_col: str | None = "n_chars", least_docs: int = 10, share: float = 0.001, **limits
) -> DataFrame:
    """The documents that :func:`judge` keeps, without their removed lines, all columns kept; ``length_col`` is counted anew.

    A removed line goes from every place where its document holds it; lines without a word stay. Null and empty texts fail the
    base rules and go. Repeated rows are judged alike. No rows: none. Extra columns may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    judged = _judged(docs, id_col, text_col, host_col, least_docs, share)
    measured, lines, removed = judged
    bad = _verdict(*judged, **limits).where("not kept").select("key").distinct()
    gone = lines.join(removed, ["host", "line"]).groupBy("key").agg(F.collect_set("line").alias("_gone"))
    # One table and one join: what is rejected, and the lines to cut from the others.
    key, lost, out = (free_name(n, docs.columns) for n in ("_changed", "_gone", "_rejected"))
    changed = bad.withColumn(out, F.lit(True)).join(gone, "key", "full").select(F.col("key").alias(key), F.coalesce(out, F.lit(False)).alias(out), F.col("_gone").alias(lost))
    changed = materialise(changed, "changed")
    for written in judged:
        drop_written(written)
    left = docs.join(changed, content_key(host_col, text_col) == F.col(key), "left").where(F.col(out).isNull() | ~F.col(out)).select(*[f"`{n}`" for n in docs.columns], lost)
    schema = docs.schema
    at = schema.names.index(text_col)
    count_at = schema.names.index(length_col) if length_col in schema.names else None

    def run(batches):
        arrow = to_arrow_schema(schema)
        for b in batches:
            cols = list(b.columns)
            gone = cols.pop().to_pylist()
            texts = cols[at].to_pylist()
            lengths = cols[count_at].to_pylist() if count_at is not None else []
            for k, own in enumerate(gone):
                if own:
                    own, raw = set(own), texts[k].encode()
                    texts[k] = b"\n".join(x for x, (h, n) in zip(raw.split(b"\n"), normalised(raw)) if not n or h not in own).decode()
                    if lengths:
                        lengths[k] = len(texts[k])
            cols[at] = pa.array(texts, arrow.field(at).type)
            if lengths:
                cols[count_at] = pa.array(lengths, arrow.field(count_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return left.mapInArrow(run, schema)


__all__ = ["cut_lines", "drop_written", "judge", "keep_good", "line_hashes", "measures", "repeated_words"]
