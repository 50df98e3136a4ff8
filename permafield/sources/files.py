"""Readers and writers: maps, designs, images, meshes, labels, results, tables; and written intermediates."""

from __future__ import annotations

import gzip
import json
import struct
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: NIfTI-1 and Analyze data types: fixed values of the format.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that is unset, a temporary folder serves a local session; on a cluster it raises, as executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="permafield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/permafield-{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to :func:`scratch_path` and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def drop_scratch(df: DataFrame | None) -> None:
    """Remove what :func:`scratch` wrote for ``df``; nothing may read it any more."""
    if path := getattr(df, "_written_at", None):
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def maps_from_array(spark: SparkSession, data, mesh: bool = False) -> DataFrame:
    """``map_id, values`` from an array: (x, y, z[, map]) or, for a mesh, (vertex[, map]); x varies fastest."""
    a = np.asarray(data)
    if np.iscomplexobj(a):
        raise TypeError("complex maps are refused")
    whole = 1 if mesh else 3
    if a.ndim not in (whole, whole + 1):
        raise ValueError(f"a {'mesh' if mesh else 'volume'} map has {whole} dimensions, or {whole + 1} with several maps, not {a.ndim}")
    flat = a.reshape(-1, 1, order="F") if a.ndim == whole else a.reshape(-1, a.shape[-1], order="F")
    return spark.createDataFrame([(k, flat[:, k].astype(np.float32).tolist()) for k in range(flat.shape[1])], "map_id int, values array<float>")


def maps_to_array(packed: DataFrame, shape: tuple[int, ...], col: str = "values") -> np.ndarray:
    """The maps as one float32 array of ``shape`` (one map) or ``shape`` and the number of maps."""
    rows = packed.orderBy("map_id").collect()
    out = np.stack([np.asarray(r[col], np.float32) for r in rows], 1)
    return out.reshape(shape, order="F") if len(rows) == 1 else out.reshape((*shape, len(rows)), order="F")


def read_design(path: str, spark: SparkSession) -> tuple[np.ndarray, dict]:
    """A design stored as JSON: ``x`` (rows), ``roles`` and ``contrasts`` by name; read through Spark, so from any store."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    d = json.loads(text)
    if "x" not in d or "contrasts" not in d or not d["contrasts"]:
        raise ValueError("a design needs x and at least one contrast")
    return np.asarray(d["x"], float), {"roles": d.get("roles", {}), "contrasts": {k: np.asarray(v, float) for k, v in d["contrasts"].items()}}


def read_block_labels(spark: SparkSession, path: str, n: int) -> np.ndarray:
    """Exchangeability labels, one whole number on each line, for ``n`` observations."""
    from permafield.functions.design import check_blocks

    lines = [x.strip() for r in spark.read.text(path, wholetext=True).collect() for x in r[0].splitlines() if x.strip()]
    try:
        values = [float(x) for x in lines]
    except ValueError as e:
        raise ValueError(f"{path} holds something other than numbers") from e
    if len(values) != n:
        raise ValueError(f"{path} has {len(values)} labels for {n} observations")
    return check_blocks(values)


def parse_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Data (x, y, z, ...) scaled as its header says, and the 4 by 4 matrix to mm, of a single-file NIfTI-1 image."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < 352:
        raise ValueError("not a NIfTI image: too short")
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348 or data[344:347] != b"n+1":
        raise ValueError("not a single-file NIfTI-1 image")
    dim = struct.unpack_from(order + "8h", data, 40)
    kind = NIFTI_TYPES.get(struct.unpack_from(order + "h", data, 70)[0])
    if kind is None:
        raise ValueError("this NIfTI data type is not supported")
    at, slope, shift = struct.unpack_from(order + "3f", data, 108)
    pixdim = struct.unpack_from(order + "8f", data, 76)
    shape = dim[1 : dim[0] + 1]
    values = np.frombuffer(data, order + kind, int(np.prod(shape)), int(at)).reshape(shape, order="F").astype(float)
    if slope not in (0.0,) and np.isfinite(slope) and (slope != 1 or shift != 0):
        values = values * slope + shift
    affine = np.eye(4)
    if struct.unpack_from(order + "h", data, 254)[0] > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4)
    else:
        affine[[0, 1, 2], [0, 1, 2]] = pixdim[1:4]
    return values, affine


def write_nifti(values, affine, slope: float = 1.0) -> bytes:
    """A float32 NIfTI-1 image."""
    v = np.asarray(values, np.float32)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, v.ndim, *v.shape, *[1] * (7 - v.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, *[abs(affine[k][k]) or 1 for k in range(3)], 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, slope, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + v.tobytes(order="F")


def parse_gifti(data: bytes) -> list[np.ndarray]:
    """The data arrays of a GIFTI file (ASCII, base64, or gzipped base64; row-major)."""
    import base64
    from xml.etree import ElementTree

    kinds = {"NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_FLOAT64": "f8"}
    out = []
    for node in ElementTree.fromstring(data).iter("DataArray"):
        kind = kinds[node.attrib["DataType"]]
        shape = [int(node.attrib[f"Dim{k}"]) for k in range(int(node.attrib["Dimensionality"]))]
        text, how = node.find("Data").text or "", node.attrib["Encoding"]
        if how == "ASCII":
            a = np.array(text.split(), float).astype(kind)
        else:
            raw = base64.b64decode(text)
            raw = zlib.decompress(raw) if how.startswith("GZip") else raw
            a = np.frombuffer(raw, ("<" if node.attrib["Endian"].startswith("Little") else ">") + kind)
        out.append(a.reshape(shape, order="C" if node.attrib.get("ArrayIndexingOrder", "RowMajorOrder") == "RowMajorOrder" else "F"))
    return out


def read_images(spark: SparkSession, paths: list[str] | str, mask=None) -> DataFrame:
    """``path, element_id, value`` of NIfTI and GIFTI images, parsed in the tasks; with ``mask`` (an array) only where it is above 0."""
    keep = None if mask is None else np.flatnonzero(np.asarray(mask).ravel(order="F") > 0)
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                v = parse_gifti(content)[0].ravel() if path.endswith((".gii", ".gii.gz")) else parse_nifti(content)[0].ravel(order="F")
                at = np.arange(len(v)) if keep is None else keep
                if keep is not None and len(keep) and keep[-1] >= len(v):
                    raise ValueError(f"{path} is smaller than the mask")
                yield pd.DataFrame({"path": path, "element_id": at, "value": v[at].astype(np.float32)})

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.mapInPandas(run, "path string, element_id long, value float")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """``face_id, v1, v2, v3`` numbered from 1, from a GIFTI surface."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    f = next(a for a in parse_gifti(content) if a.ndim == 2 and a.dtype.kind == "i") + 1
    return spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(f)], "face_id int, v1 int, v2 int, v3 int")


def resample(values: np.ndarray, affine: np.ndarray, shape: tuple[int, int, int], to: np.ndarray) -> np.ndarray:
    """A volume on another grid by trilinear interpolation; 0 outside."""
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1).reshape(-1, 3)
    at = np.c_[grid, np.ones(len(grid))] @ (np.linalg.inv(affine) @ to).T[:, :3]
    at = np.where(np.abs(at - np.round(at)) < 1e-9, np.round(at), at)
    low = np.floor(at).astype(int)
    out = np.zeros(len(at))
    for corner in range(8):
        step = np.array([corner & 1, corner >> 1 & 1, corner >> 2])
        p = low + step
        w = np.prod(np.where(step == 1, at - low, 1 - (at - low)), 1)
        ok = ((p >= 0) & (p < values.shape[:3])).all(1) & (w > 0)
        out[ok] += w[ok] * values[tuple(p[ok].T)]
    outside = ((at < 0) | (at > np.array(values.shape[:3]) - 1)).any(1)
    out[outside] = 0
    return out.reshape(shape)


def resolve_mask(mask, default, shape: tuple[int, ...], affine=None, mask_affine=None) -> np.ndarray:
    """The mask given, else the default one; it must have the data's shape and position."""
    m = mask if mask is not None else default
    if m is None:
        raise ValueError("no mask was given and there is no default one")
    m = np.asarray(m)
    if m.shape != tuple(shape):
        raise ValueError(f"the mask is {m.shape}, the data are {tuple(shape)}")
    if affine is not None and mask_affine is not None and not np.allclose(affine, mask_affine, atol=1e-4):
        raise ValueError("the mask and the data differ in position")
    return m > 0


def write_result(result: DataFrame, path: str) -> None:
    """A result set as Parquet, a folder for each contrast."""
    result.write.mode("overwrite").partitionBy("contrast_id").parquet(path)


def write_info(spark: SparkSession, info: dict, path: str) -> None:
    """Counts of permutations and the like, as one JSON row."""
    spark.createDataFrame([(json.dumps(info),)], "value string").write.mode("overwrite").text(path)


def read_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A results table as CSV with a header, or as tab-separated text."""
    if kind not in ("csv", "text"):
        raise ValueError(f"write csv or text tables, not {kind!r}")
    df.write.mode("overwrite").option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)


def read_values_at(values: DataFrame, points: DataFrame) -> DataFrame:
    """Values at given elements."""
    return values.join(points.select("element_id").distinct(), "element_id")


def aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Several maps side by side on the elements that all of them have."""
    for o in others:
        first = first.join(o, "element_id")
    return first


def masked(df: DataFrame, inclusive: DataFrame | None = None, exclusive: DataFrame | None = None) -> DataFrame:
    """Elements inside one set and outside another."""
    if inclusive is not None:
        df = df.join(inclusive.select("element_id"), "element_id", "left_semi")
    return df if exclusive is None else df.join(exclusive.select("element_id"), "element_id", "left_anti")


