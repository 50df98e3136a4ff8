"""WARC files as a Spark data source: record-per-member gzip or plain, written and read in parallel.

``spark.read.format("warc")`` plans a partition for each group of files, applies filters on record type and header
columns before it looks at a payload, and passes over unwanted payloads without keeping them (in plain files by seeking).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload_length long, refers_to string, payload binary"
#: WARC header of each column that filters are pushed to.
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Bytes of records after which a task begins another file, and bytes of files for one read partition.
ROLL, SPLIT = 256 << 20, 128 << 20
_BATCH_ROWS, _BATCH_BYTES = 1000, 8 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters become per cent signs and hex, as in URLs."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(record_id: str, warc_type: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the full payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if warc_type == "revisit" else http + payload
    head = [("WARC-Type", warc_type), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    head += [("WARC-Target-URI", uri)] if uri is not None else []
    head += [("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("X-Payload-Length", str(len(payload)))]
    if warc_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to or "")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


class _Bytes:
    """Reads a file's bytes in order, inflating gzip members as it goes; ``skip`` keeps nothing, and seeks in plain files."""

    def __init__(self, file, zipped: bool):
        self.file, self.zipped, self.buffer, self.inflate = file, zipped, b"", zlib.decompressobj(31) if zipped else None

    def more(self) -> bool:
        if not self.zipped:
            got = self.file.read(1 << 16)
            self.buffer += got
            return bool(got)
        while True:
            raw = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            raw = raw or self.file.read(1 << 16)
            if not raw:
                return False
            if got := self.inflate.decompress(raw):
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("a WARC record breaks off")
                return None
        got, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self.more():
                raise ValueError("a WARC record breaks off")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        if not self.zipped and n > len(self.buffer):
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self.more():
                raise ValueError("a WARC record breaks off")
        self.buffer = self.buffer[n:]


def records(file, zipped: bool, wanted, payloads: bool = True) -> Iterator[tuple]:
    """Rows of one file in SCHEMA's order. Headers are parsed first; ``wanted(row)`` sees them before the payload is read."""
    src = _Bytes(file, zipped)
    while (head := src.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(h.get("content-length", 0))
        digest = h.get("warc-payload-digest")
        length = h.get("x-payload-length")
        row = {c: h.get(name.lower()) for c, name in HEADERS.items()}
        row["payload_digest"] = digest.removeprefix("sha1:") if digest else None
        row["payload_length"] = int(length) if length else None
        if not wanted(row):
            src.skip(size + 4)
            continue
        payload = None
        if payloads and row["warc_type"] != "revisit":
            block = src.take(size)
            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            src.skip(4)
        else:
            src.skip(size + 4)
        yield (row["record_id"], row["warc_type"], row["target_uri"], row["warc_date"], row["payload_digest"], row["payload_length"], row["refers_to"], payload)


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.payloads, self.tests, self.schema = options["path"], options.get("payloads", "true") == "true", [], schema

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if len(name) == 1 and name[0] in HEADERS and isinstance(f, (EqualTo, In, IsNotNull)):
                self.tests.append((name[0], [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None))
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        manifest = f"{root}/_manifest.json"
        if fs.get_file_info(manifest).type == pafs.FileType.File:  # only files of tasks that were committed
            with fs.open_input_stream(manifest) as f:
                sizes = {f"{root}/{k}": v for k, v in json.loads(f.read()).items()}
        else:
            info = fs.get_file_info(root)
            found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
            sizes = {i.path: i.size for i in found if i.path.endswith((".warc", ".warc.gz"))}
        groups: list[list[str]] = []
        room = 0
        for name in sorted(sizes):
            if room < sizes[name] or not groups:
                groups.append([])
                room = SPLIT
            groups[-1].append(name)
            room -= sizes[name]
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        schema = to_arrow_schema(self.schema if self.schema is not None else _parse_datatype_string(SCHEMA))
        fs, _ = pafs.FileSystem.from_uri(self.path)
        tests = self.tests
        wanted = lambda row: all(row[c] is not None and (v is None or row[c] in v) for c, v in tests)
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as f:
                for r in records(f, name.endswith(".gz"), wanted, self.payloads):
                    rows.append(r)
                    size += len(r[7] or b"")
                    if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class _Written(WriterCommitMessage):
    def __init__(self, sizes: dict[str, int]):
        self.sizes = sizes


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.zipped, self.level = options["path"], options.get("compression", "gzip") == "gzip", int(options.get("level", "1"))

    def write(self, iterator):
        fs, root = pafs.FileSystem.from_uri(self.path)
        sizes: dict[str, int] = {}
        sink, name, size = None, "", 0

        def close():
            if sink is not None:
                sink.close()
                sizes[name] = size

        for batch in iterator:
            c = batch.to_pydict()
            for rid, kind, uri, date, payload, refers in zip(c["record_id"], c["warc_type"], c["target_uri"], c["warc_date"], c["payload"], c["refers_to"]):
                data = record(rid, kind, uri, date, payload or b"", refers)
                if self.zipped:
                    data = gzip.compress(data, self.level, mtime=0)
                if sink is None or size + len(data) > ROLL:
                    close()
                    name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped, 0
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(data)
                size += len(data)
        close()
        return _Written(sizes)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        manifest = f"{root}/_manifest.json"
        files: dict[str, int] = {}
        if fs.get_file_info(manifest).type == pafs.FileType.File:  # appending
            with fs.open_input_stream(manifest) as f:
                files = json.loads(f.read())
        for m in messages:
            files |= m.sizes if m else {}
        with fs.open_output_stream(manifest) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.sizes if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``payloads`` (false: none is decoded); writing: ``compression`` (gzip or none), ``level``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """WARC records of pages, one for each row, ready for ``write.format("warc")``.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response and the others
    revisit it. Null html: an empty payload. Null ids: always responses; rows that repeat the smallest id are responses too.
    The smallest id is pre-aggregated; a payload that many pages share is split by the adaptive join.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.sha2("payload", 256))
    first = p.groupBy("sha").agg(F.min("id").alias("first"))
    revisit = (F.length("payload") >= least) & (F.col("id") > F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return p.join(first, "sha").select(
        name(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_length"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        "payload",
    )


def verified(records_df: DataFrame) -> DataFrame:
    """Read records with length and digest as found in the payload of responses, and as stated by revisits; a response that differs from its header raises."""

    def run(batches):
        for b in batches:
            n, digests = [], []
            for kind, stated, size, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5)):
                data = payload.as_py()
                if kind != "revisit":
                    if len(data) != size or sha1_base32(data) != stated:
                        raise ValueError("a payload differs from its record's header")
                n.append(size)
                digests.append(stated)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), b.column(1), b.column(4)], names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records_df.select("record_id", "warc_type", "payload_digest", "payload_length", "refers_to", "payload").mapInArrow(run, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
