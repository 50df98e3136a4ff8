"""MAT-5 files as a Spark data source: nested variables as one row for each array, read with pruning, and written.

``spark.read.format("mat5").load(path)`` has a row for each array of each file, named by its path within its variable
(``SPM.xX.X``, ``SPM.xCon(2).c``, ``SPM.xX.name{3}``). The options ``variables`` and ``within`` (names, and beginnings of paths, parted by
commas) prune: an unwanted variable is not inflated beyond its name, an unwanted field is passed over by its size. They are options
and no pushed filters because Spark keeps what is pushed to a Python source with the table: another query of the same DataFrame, or
another branch of one query, would read only what the last filter left.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: One row for each array: its place, class and size; numbers in column-major order, of sparse arrays with their 0-based places ``at``.
SCHEMA = "file string, variable string, path string, class string, dims array<long>, values array<double>, at array<long>, text string"
#: Bytes of files for one read partition.
SPLIT = 64 << 20

# Fixed values of the format.
CLASSES = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED, COMPLEX, LOGICAL, NAME_LENGTH = 14, 15, 0x0800, 0x0200, 32


class Damaged(ValueError):
    """A file that is not a whole MAT-5 file."""


@dataclass
class _Part:
    """Tagged elements of a run of bytes."""

    data: memoryview
    order: str
    at: int = 0

    def more(self) -> bool:
        return self.at < len(self.data)

    def next(self) -> tuple[int, memoryview]:
        """Type and bytes of the next element."""
        if len(self.data) - self.at < 8:
            raise Damaged("an element breaks off")
        kind, size = struct.unpack_from(self.order + "2I", self.data, self.at)
        if kind >> 16:  # small: size and type share the first word, and the data the second
            kind, size, begin = kind & 0xFFFF, kind >> 16, self.at + 4
            if size > 4:
                raise Damaged("a small element is too large")
            self.at += 8
        else:
            begin = self.at + 8
            self.at = begin + size + (-size % 8 if kind != COMPRESSED else 0)
        if begin + size > len(self.data):
            raise Damaged("an element breaks off")
        return kind, self.data[begin : begin + size]

    def array(self) -> np.ndarray:
        kind, data = self.next()
        if kind not in NUMBERS:
            raise Damaged(f"numbers expected, not type {kind}")
        dtype = np.dtype(self.order + NUMBERS[kind])
        if len(data) % dtype.itemsize:
            raise Damaged("an array has a broken number")
        return np.frombuffer(data, dtype)

    def text(self) -> str:
        kind, data = self.next()
        if kind in TEXTS:
            return bytes(data).decode(TEXTS[kind] + ("" if kind == 16 else "-le" if self.order == "<" else "-be"), "replace")
        if kind not in NUMBERS:
            raise Damaged(f"text expected, not type {kind}")
        try:
            return "".join(map(chr, np.frombuffer(data, self.order + NUMBERS[kind]).tolist()))
        except (ValueError, TypeError, OverflowError) as e:
            raise Damaged(f"broken text: {e}") from e


def _header(part: _Part) -> tuple[int, int, list[int], str]:
    """Class, flags, size and name of the array whose parts follow."""
    flags = part.array()
    dims = part.array().astype(int).tolist()
    name = part.text()
    if len(flags) != 2 or len(dims) < 2 or min(dims) < 0:
        raise Damaged("an array has no proper header")
    return int(flags[0]) & 0xFF, int(flags[0]), dims, name


def _wanted_below(path: str, prefixes: list[str] | None) -> bool:
    """Whether an array at ``path`` or below it can be asked for."""
    return prefixes is None or any(path.startswith(p) or p.startswith(path) for p in prefixes)


def arrays(data: memoryview, order: str, name: str | None, prefixes: list[str] | None) -> Iterator[tuple]:
    """``path, class, dims, values, at, text`` of an array and of those within it, in file order."""
    if not len(data):  # an empty cell or field may be no more than its tag
        yield (name, "double", [0, 0], [], None, None)
        return
    part = _Part(data, order)
    kind, flags, dims, own = _header(part)
    path = own if name is None else name
    if not _wanted_below(path, prefixes):
        return
    told = CLASSES.get(kind)
    if told is None:
        raise Damaged(f"{path}: arrays of class {kind} are not supported")
    if flags & COMPLEX:
        raise TypeError(f"{path}: complex arrays are refused")
    many = int(np.prod(dims, dtype=object))

    def inner(label: Callable[[int], str]) -> Iterator[tuple]:
        kind, element = part.next()
        if kind != MATRIX:
            raise Damaged(f"{path}: an array expected, not type {kind}")
        return arrays(element, order, label, prefixes)

    if told == "cell":
        yield (path, told, dims, None, None, None)
        for k in range(many):
            yield from inner(f"{path}{{{k + 1}}}")
    elif told in ("struct", "object"):
        if told == "object":
            part.text()
        width = int(part.array()[0])
        names = part.text()
        fields = [names[k : k + width].split("\0")[0] for k in range(0, len(names), width)] if width else []
        yield (path, "struct", dims, None, None, "\n".join(fields))
        for k in range(many if fields else 0):
            base = path if many == 1 else f"{path}({k + 1})"
            for f in fields:
                yield from inner(f"{base}.{f}")
    elif told == "char":
        yield (path, told, dims, None, None, part.text() if many else "")
    elif told == "sparse":
        row, start, values = part.array().astype(np.int64), part.array().astype(np.int64), part.array().astype(float)
        if len(start) != dims[1] + 1 or (np.diff(start) < 0).any() or start[-1] > min(len(row), len(values)):
            raise Damaged(f"{path}: a sparse array's columns do not fit")
        used = int(start[-1])
        column = np.repeat(np.arange(dims[1]), np.diff(start))
        yield (path, told, dims, values[:used].tolist(), (row[:used] + dims[0] * column).tolist(), None)
    else:
        values = part.array()
        if len(values) != many:
            raise Damaged(f"{path}: {len(values)} numbers for a size of {dims}")
        yield (path, "logical" if flags & LOGICAL else told, dims, values.astype(float).tolist(), None, None)


def parse(data: bytes, variables: list[str] | None = None, prefixes: list[str] | None = None) -> Iterator[tuple]:
    """``variable, path, class, dims, values, at, text`` of the arrays of a file's bytes; ``variables`` and path ``prefixes``: only these.

    A compressed variable is inflated as far as its name first, and further only if it is wanted. Anything that is not a whole
    MAT-5 file raises :class:`Damaged`; complex arrays raise TypeError; numbers of 64-bit classes become doubles.
    """
    if len(data) < 128:
        raise Damaged("too short for a MAT-5 file")
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if order is None or struct.unpack_from(order + "H", data, 124)[0] != 0x0100:
        raise Damaged("not a MAT-5 file")
    outer = _Part(memoryview(data)[128:], order)
    while outer.more():
        kind, element = outer.next()
        try:
            if kind == COMPRESSED:
                head = zlib.decompressobj().decompress(element, 4096)
                name = _name(head, order)
                if not _wanted(name, variables, prefixes):
                    continue
                inflate = zlib.decompressobj()
                whole = inflate.decompress(element)
                if not inflate.eof:
                    raise Damaged("a compressed variable breaks off")
                kind, element = _Part(memoryview(whole), order).next()
            else:
                name = _name(element, order, False)
                if not _wanted(name, variables, prefixes):
                    continue
        except zlib.error as e:
            raise Damaged(f"a compressed variable is broken: {e}") from e
        if kind != MATRIX:
            raise Damaged(f"a variable expected, not type {kind}")
        found = arrays(element, order, None, prefixes)
        while True:
            try:
                row = next(found, None)
            except Damaged:
                raise
            except (ValueError, IndexError, OverflowError) as e:
                raise Damaged(f"{name} is broken: {e}") from e
            if row is None:
                break
            if prefixes is None or any(row[0].startswith(p) for p in prefixes):
                yield (name, *row)


def _name(data, order: str, tagged: bool = True) -> str:
    """A variable's name from the first bytes of its element."""
    part = _Part(memoryview(data)[8:] if tagged else data, order)
    return _header(part)[3]


def _wanted(name: str, variables: list[str] | None, prefixes: list[str] | None) -> bool:
    return (variables is None or name in variables) and _wanted_below(name, prefixes)


# --- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class _Node:
    """An array of a tree to be written: its row, and the arrays within by field or cell."""

    row: tuple | None = None
    inner: dict[tuple[int, str], _Node] = field(default_factory=dict)


_STEP = re.compile(r"(?:\((\d+)\))?\.(\w+)|\{(\d+)\}")


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<2I", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _dump(node: _Node, name: str) -> bytes:
    """The matrix element of a node."""
    told, dims, values, at, text = node.row or ("double", [0, 0], [], None, None)
    code = {v: k for k, v in CLASSES.items()}["uint8" if told == "logical" else told]
    head = lambda flags, most=0: _element(6, struct.pack("<2I", flags, most)) + _element(5, np.asarray(dims, "<i4").tobytes()) + _element(1, name.encode())
    many = int(np.prod(dims))
    if told == "cell":
        body = head(code) + b"".join(_dump(node.inner.get((k, ""), _Node()), "") for k in range(many))
    elif told == "struct":
        fields = [f for f in (text or "").split("\n") if f]
        if any(len(f) >= NAME_LENGTH for f in fields):
            raise ValueError(f"names of fields have less than {NAME_LENGTH} characters")
        body = head(code) + _element(5, struct.pack("<i", NAME_LENGTH)) + _element(1, b"".join(f.encode().ljust(NAME_LENGTH, b"\0") for f in fields))
        body += b"".join(_dump(node.inner.get((k, f), _Node()), "") for k in range(many) for f in fields)
    elif told == "char":
        body = head(code) + _element(16, (text or "").encode())
    elif told == "sparse":
        row, column = np.asarray(at, np.int64) % max(1, dims[0]), np.asarray(at, np.int64) // max(1, dims[0])
        sort = np.lexsort((row, column))
        start = np.searchsorted(column[sort], np.arange(dims[1] + 1))
        body = head(code, len(row)) + _element(5, row[sort].astype("<i4").tobytes()) + _element(5, start.astype("<i4").tobytes()) + _element(9, np.asarray(values, "<f8")[sort].tobytes())
    else:
        kind = {"double": 9, "single": 7, "int8": 1, "uint8": 2, "int16": 3, "uint16": 4, "int32": 5, "uint32": 6, "int64": 12, "uint64": 13, "logical": 2}[told]
        body = head(code | (LOGICAL if told == "logical" else 0)) + _element(kind, np.asarray(values, float).astype("<" + NUMBERS[kind]).tobytes())
    return _element(MATRIX, body)


def dump(rows: list[tuple], compress: bool = True) -> bytes:
    """A MAT-5 file of ``path, class, dims, values, at, text`` rows (structs and cells have a row of their own, fields in ``text``)."""
    roots: dict[str, _Node] = {}
    for path, *row in rows:
        name = re.match(r"\w+", path)
        if name is None:
            raise ValueError(f"{path!r} is no path of an array")
        node, at = roots.setdefault(name.group(), _Node()), name.end()
        while at < len(path):
            step = _STEP.match(path, at)
            if step is None:
                raise ValueError(f"{path!r} is no path of an array")
            index, name_, cell = step.groups()
            node = node.inner.setdefault((int(cell) - 1, "") if cell else (int(index or 1) - 1, name_), _Node())
            at = step.end()
        node.row = tuple(row)
    out = b"MATLAB 5.0 MAT-file, written by permafield".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"
    for name, node in roots.items():
        element = _dump(node, name)
        if compress:
            packed = zlib.compress(element)
            element = struct.pack("<2I", COMPRESSED, len(packed)) + packed
        out += element
    return out


# --- the data source --------------------------------------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _schema() -> pa.Schema:
    """SCHEMA as Arrow's."""
    kinds = {"string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in SCHEMA.split(", "))])


class Mat5Reader(DataSourceReader):
    """Plans groups of files; reads the arrays that the options ask for."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.variables, self.prefixes = ([x.strip() for x in options[k].split(",") if x.strip()] if options.get(k) else None for k in ("variables", "within"))

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.path.endswith(".mat") and "/_" not in i.path.removeprefix(root)]
        groups: list[list[str]] = []
        room = 0
        for i in sorted(found, key=lambda i: i.path):
            if room < i.size or not groups:
                groups.append([])
                room = SPLIT
            groups[-1].append(i.path)
            room -= i.size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        schema = _schema()
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with fs.open_input_file(name) as f:
                data = f.read()
            try:
                rows = [(name, *row) for row in parse(data, self.variables, self.prefixes)]
            except Damaged as e:
                raise Damaged(f"{name}: {e}") from e
            if rows:
                yield _batch(rows, schema)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Mat5Writer(DataSourceArrowWriter):
    """A file for each value of ``file`` (its last part); all rows of one file must be in one partition. A task writes under names of its own
    attempt, and the driver moves committed ones into place, so a task that is run again leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.compress = options["path"], overwrite, options.get("compress", "true") == "true"

    def write(self, batches):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        held: dict[str, list[tuple]] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["file"], []).append((r["path"], r["class"], r["dims"], r["values"], r["at"], r["text"]))
        names = []
        for file, rows in held.items():
            attempt = f"{uuid.uuid4().hex}-{file.rsplit('/', 1)[-1].removesuffix('.mat')}.mat"
            with fs.open_output_stream(f"{root}/_attempts/{attempt}", compression=None) as f:
                f.write(dump(rows, self.compress))
            names.append(attempt)
        return _Written(names)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        moved = [n for m in messages if m is not None for n in m.names]
        finals = [n.partition("-")[2] for n in moved]
        if len(set(finals)) < len(finals):
            raise ValueError("the rows of a file must be in one partition")
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if i.path.endswith(".mat"):
                    fs.delete_file(i.path)
        for n, final in zip(moved, finals):
            fs.move(f"{root}/_attempts/{n}", f"{root}/{final}")
        self.abort(messages)

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/_attempts").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_attempts")


class Mat5(DataSource):
    @classmethod
    def name(cls):
        return "mat5"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Mat5Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Mat5Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mat5)


def from_bytes(files: DataFrame, variables: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """The same rows from ``path, content`` (``spark.read.format("binaryFile")``): for stores that only Spark's own readers open."""

    def run(batches):
        schema = _schema()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(name, *row) for row in parse(content.as_py(), variables, prefixes)]
                if rows:
                    yield _batch(rows, schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


# --- designs ----------------------------------------------------------------------------------------------------------


def matrix_rows(read: DataFrame, path: str) -> DataFrame:
    """``file, row, col, value`` (numbered from 0) of the full numeric array at ``path`` of every file."""
    one = read.where(F.col("path") == path).select("file", "dims", F.posexplode("values").alias("k", "value"))
    return one.select("file", (F.col("k") % F.col("dims")[0]).cast("long").alias("row"), F.floor(F.col("k") / F.col("dims")[0]).cast("long").alias("col"), "value")


def mask_elements(read: DataFrame, variable: str = "SPM") -> DataFrame:
    """``file, element_id`` of the elements of each file's ``xVol.XYZ`` (three rows of voxels, from 1) on its grid ``xVol.DIM``; x varies fastest."""
    dims = read.where(F.col("path") == f"{variable}.xVol.DIM").select("file", F.transform("values", lambda v: v.cast("long")).alias("d"))
    voxels = read.where(F.col("path") == f"{variable}.xVol.XYZ").select("file", F.posexplode("values").alias("k", "v"))
    # The axis of a number is its place modulo 3; sums of one voxel's three terms give its element.
    term = F.when(F.col("k") % 3 == 0, 1).when(F.col("k") % 3 == 1, F.col("d")[0]).otherwise(F.col("d")[0] * F.col("d")[1])
    own = voxels.join(dims, "file").groupBy("file", F.floor(F.col("k") / 3).alias("voxel")).agg(F.sum((F.col("v").cast("long") - 1) * term).alias("element_id"))
    return own.select("file", "element_id")


@dataclass
class Stored:
    """A design as stored: matrix, column names and roles, contrasts as ``name: (kind, weights)``, whitening, paths of images and covariates."""

    x: np.ndarray
    names: list[str]
    conditions: list[int]
    covariates: list[int]
    blocks: list[int]
    nuisance: list[int]
    contrasts: dict[str, tuple[str, np.ndarray]]
    whitening: np.ndarray | None
    images: list[str]
    covariate_images: list[str]
    affine: np.ndarray | None

    def design(self):
        """The design with its roles. Where the columns that are neither covariates nor nuisance fall into two factors, the first holds the
        conditions and the second the blocks, whatever the stored roles say."""
        from permafield.functions import design

        rest = [k for k in range(self.x.shape[1]) if k not in self.covariates + self.nuisance]
        factors = design.split_factors(self.x, rest)
        conditions, blocks = (factors[0], factors[1]) if len(factors) == 2 else (self.conditions, self.blocks)
        return design.Design(self.x, conditions, self.covariates, blocks, self.nuisance)


def read_design(read: DataFrame, variable: str = "SPM") -> Stored:
    """The design, contrasts and whitening of one file's rows. Only arrays of the design are brought to the driver.

    It raises for a model that was not estimated (no ``xVol``), one with a temporal filter, and one without contrasts.
    """
    v = variable
    own = read.where((F.col("variable") == v) & (F.col("path").startswith(f"{v}.xX.") | F.col("path").startswith(f"{v}.xCon") | F.col("path").startswith(f"{v}.xC") | F.col("path").startswith(f"{v}.xY.P") | F.col("path").isin(f"{v}.xVol", f"{v}.xVol.M")))
    rows = {r["path"]: r for r in own.collect()}  # a design: observations by columns, and contrasts
    if len({r["file"] for r in rows.values()}) > 1:
        raise ValueError("several files: choose one")
    if f"{v}.xVol" not in rows:
        raise ValueError("this model has not been estimated")
    if f"{v}.xX.X" not in rows:
        raise ValueError("no design matrix")
    if (k := rows.get(f"{v}.xX.K")) is not None and k["class"] == "struct":
        raise ValueError("designs with a temporal filter are not supported")

    def matrix(path: str) -> np.ndarray | None:
        r = rows.get(path)
        if r is None or r["values"] is None or 0 in r["dims"]:
            return None
        if r["at"] is not None:
            full = np.zeros(int(np.prod(r["dims"])))
            full[r["at"]] = r["values"]
            return full.reshape(r["dims"], order="F")
        return np.asarray(r["values"]).reshape(r["dims"], order="F")

    def indices(path: str) -> list[int]:
        m = matrix(path)
        return [] if m is None else [int(k) - 1 for k in m.ravel()]

    def several(path: str) -> list[str]:
        r = rows.get(path)
        if r is None:
            return []
        if r["class"] == "char":  # rows of one width, stored by columns
            n, w = r["dims"]
            text = (r["text"] or "").ljust(n * w)
            return ["".join(text[k::n]).rstrip() for k in range(n)]
        return [rows[f"{path}{{{k + 1}}}"]["text"] for k in range(int(np.prod(r["dims"]))) if f"{path}{{{k + 1}}}" in rows]

    x = matrix(f"{v}.xX.X")
    con = rows.get(f"{v}.xCon")
    n = int(np.prod(con["dims"])) if con is not None else 0
    contrasts = {}
    for k in range(n):
        base = f"{v}.xCon" if n == 1 else f"{v}.xCon({k + 1})"
        c = matrix(f"{base}.c")
        if c is None or c.shape[0] != x.shape[1]:
            raise ValueError(f"contrast {k + 1} does not fit the design")
        name = rows[f"{base}.name"]["text"] if f"{base}.name" in rows else f"contrast {k + 1}"
        contrasts[name] = (rows[f"{base}.STAT"]["text"] if f"{base}.STAT" in rows else "T", c[:, 0] if c.shape[1] == 1 else c)
    if not contrasts:
        raise ValueError("a design needs at least one contrast")
    images = several(f"{v}.xC.P") or next((several(p) for p in sorted(rows) if re.fullmatch(rf"{re.escape(v)}\.xC\(\d+\)\.P", p) and several(p)), [])
    return Stored(x, several(f"{v}.xX.name"), indices(f"{v}.xX.iH"), indices(f"{v}.xX.iC"), indices(f"{v}.xX.iB"), indices(f"{v}.xX.iG"), contrasts, matrix(f"{v}.xX.W"), several(f"{v}.xY.P"), images, matrix(f"{v}.xVol.M"))
