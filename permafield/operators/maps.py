"""Operators on maps: neighbourhoods, the exact transform, components, tree nodes.

Relations: ``maps(map_id, element_id, value)`` in long form, ``map_arr(map_id, values)`` packed, ``edges(src, dst)``.
Elements of a grid are numbered from 0 with x fastest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permafield.functions import tree
from permafield.functions.tree import REACH, Grid, Mesh

#: Elements in a mesh or grid whose neighbourhood is sent to every task (about 200 MB of edges at 26 neighbours).
MOST_ELEMENTS = 2_000_000


def with_xyz(df: DataFrame, grid: tuple[int, int, int], col: str = "element_id") -> DataFrame:
    nx, ny, _ = grid
    e = F.col(col)
    return df.withColumns({"x": (e % nx).cast("int"), "y": (F.floor(e / nx) % ny).cast("int"), "z": F.floor(e / (nx * ny)).cast("int")})


def grid_edges(spark: SparkSession, grid: tuple[int, int, int], connectivity: int = 26) -> DataFrame:
    """``src, dst``: all directed neighbour pairs of a grid, clipped at its borders."""
    nx, ny, nz = grid
    reach = REACH.get(connectivity)
    if reach is None:
        raise ValueError(f"connectivity must be 6, 18 or 26, not {connectivity}")
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cells = with_xyz(spark.range(nx * ny * nz).withColumnRenamed("id", "src"), grid, "src")
    near = cells.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("dz", F.explode(step))
    steps = F.abs("dx") + F.abs("dy") + F.abs("dz")
    inside = (F.col("x") + F.col("dx")).between(0, nx - 1) & (F.col("y") + F.col("dy")).between(0, ny - 1) & (F.col("z") + F.col("dz")).between(0, nz - 1)
    return near.where((steps > 0) & (steps <= reach) & inside).select("src", (F.col("src") + F.col("dx") + nx * F.col("dy") + nx * ny * F.col("dz")).alias("dst"))


def adjacency_from_faces(faces: DataFrame, n_vertices: int) -> DataFrame:
    """``src, dst``: distinct directed edges of triangles ``v1, v2, v3`` numbered from 1; a vertex outside 1..n raises."""
    wrong = F.raise_error(F.lit(f"a face names a vertex outside 1..{n_vertices}"))
    checked = [F.when(F.col(v).between(1, n_vertices), F.col(v).cast("long") - 1).otherwise(wrong.cast("long")).alias(v) for v in ("v1", "v2", "v3")]
    f = faces.select(*checked)
    ways = [("v1", "v2"), ("v2", "v3"), ("v3", "v1"), ("v2", "v1"), ("v3", "v2"), ("v1", "v3")]
    pairs = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in ways]))
    return f.select(pairs.alias("e")).select("e.src", "e.dst").distinct()


def csr(edges: DataFrame) -> DataFrame:
    """``element_id, nbrs``: sorted neighbours of each element."""
    return edges.groupBy(F.col("src").alias("element_id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))


def pack(maps: DataFrame, n: int) -> DataFrame:
    """Long maps as one array of ``n`` values for each map; absent elements are 0, an element outside 0..n-1 raises."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf["element_id"].to_numpy()
        if len(e) and (e.min() < 0 or e.max() >= n):
            raise ValueError(f"an element lies outside 0..{n - 1}")
        v = np.zeros(n, np.float32)
        v[e] = pdf["value"].to_numpy(np.float32)
        return pd.DataFrame({"map_id": [pdf["map_id"].iloc[0]], "values": [v]})

    return maps.select("map_id", "element_id", "value").groupBy("map_id").applyInPandas(one, f"map_id {maps.schema['map_id'].dataType.simpleString()}, values array<float>")


def unpack(packed: DataFrame, col: str = "values", name: str = "value") -> DataFrame:
    return packed.select("map_id", F.posexplode(col).alias("element_id", name))


def neighbourhood(grid: tuple[int, int, int] | None, adjacency: DataFrame | tuple | Mesh | None, connectivity: int, n: int | None = None):
    """The neighbourhood object that tasks use: of a grid, or of a mesh from edges, a CSR pair or a scipy-like matrix."""
    if adjacency is None:
        if grid is None:
            raise ValueError("either a grid or an adjacency is needed")
        return Grid(grid, connectivity)
    if isinstance(adjacency, Mesh):
        return adjacency
    if isinstance(adjacency, DataFrame):
        if n is None:
            raise ValueError("a mesh given by edges needs its number of vertices")
        if n > MOST_ELEMENTS:
            raise ValueError(f"meshes of more than {MOST_ELEMENTS} vertices cannot be sent to every task")
        e = adjacency.select("src", "dst").where("src < dst").unionByName(adjacency.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src < dst")).distinct().toPandas()
        return Mesh(n, e["src"], e["dst"])
    if hasattr(adjacency, "indptr"):
        return Mesh.from_csr(adjacency.indptr, adjacency.indices)
    return Mesh.from_csr(*adjacency)


def tfce_packed(packed: DataFrame, space, E: float = 0.5, H: float = 2.0, two_sided: bool = True) -> DataFrame:
    """The transform of each map of ``map_id, values``, in the task that holds it: no shuffle."""
    tree.tfce(np.zeros(space.n, np.float32), space, E, H)  # exponents are checked here, not in the tasks

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"map_id": pdf["map_id"], "values": [tree.tfce(v, space, E, H, two_sided) for v in pdf["values"]]})

    return packed.select("map_id", "values").mapInPandas(run, packed.select("map_id", F.col("values").cast("array<float>").alias("values")).schema)


def tfce(maps: DataFrame, grid: tuple[int, int, int] | None = None, adjacency=None, connectivity: int = 26, E: float | None = None, H: float = 2.0, two_sided: bool = True, n: int | None = None) -> DataFrame:
    """The exact threshold-free cluster transform of long maps: ``map_id, element_id, value, enh`` for the elements given.

    E is 0.5 by default. One shuffle by map, in which each map becomes whole; elements that are absent count as 0,
    non-finite values as 0. A map must fit one task; maps are independent of each other and of how they are partitioned.
    """
    space = neighbourhood(grid, adjacency, connectivity, n)
    e = 0.5 if E is None else E
    tree.tfce(np.zeros(space.n, np.float32), space, e, H)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["element_id"].to_numpy()
        if len(at) and (at.min() < 0 or at.max() >= space.n):
            raise ValueError(f"an element lies outside 0..{space.n - 1}")
        v = np.zeros(space.n, np.float32)
        v[at] = pdf["value"].to_numpy(np.float32)
        return pdf.assign(enh=tree.tfce(v, space, e, H, two_sided)[at])

    kind = maps.schema["map_id"].dataType.simpleString()
    return maps.select("map_id", F.col("element_id").cast("int").alias("element_id"), F.col("value").cast("float").alias("value")).groupBy("map_id").applyInPandas(one, f"map_id {kind}, element_id int, value float, enh float")


def tfce_stepped(maps: DataFrame, space, steps: int, E: float = 0.5, H: float = 2.0, rule: str = "right") -> DataFrame:
    """The transform by ``steps`` thresholds, to compare the exact one with."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(space.n, np.float32)
        at = pdf["element_id"].to_numpy()
        v[at] = pdf["value"].to_numpy(np.float32)
        return pdf.assign(enh=tree.stepped(v, space, steps, E, H, rule)[at])

    kind = maps.schema["map_id"].dataType.simpleString()
    return maps.select("map_id", F.col("element_id").cast("int").alias("element_id"), F.col("value").cast("float").alias("value")).groupBy("map_id").applyInPandas(one, f"map_id {kind}, element_id int, value float, enh double")


def tree_nodes(maps: DataFrame, space) -> DataFrame:
    """``map_id, node_id, parent, size, birth, death`` of every map's positive part."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(space.n, np.float32)
        v[pdf["element_id"].to_numpy()] = pdf["value"].to_numpy(np.float32)
        nodes = tree.tree_nodes(v, space)
        out = pd.DataFrame(nodes, columns=["parent", "size", "birth", "death"])
        out.insert(0, "node_id", np.arange(len(nodes)))
        out.insert(0, "map_id", pdf["map_id"].iloc[0])
        return out

    kind = maps.schema["map_id"].dataType.simpleString()
    return maps.groupBy("map_id").applyInPandas(one, f"map_id {kind}, node_id int, parent int, size int, birth float, death float")


def components(survivors: DataFrame, space, by: str = "map_id") -> DataFrame:
    """``by, element_id, cluster_id`` (its smallest element) ``, size`` of the connected survivors of each map."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(space.n, bool)
        at = pdf["element_id"].to_numpy()
        keep[at] = True
        label = tree.labels(space, keep)
        size = np.bincount(label[label >= 0], minlength=space.n)
        return pd.DataFrame({by: pdf[by], "element_id": at, "cluster_id": label[at], "size": size[label[at]]})

    kind = survivors.schema[by].dataType.simpleString()
    return survivors.select(by, F.col("element_id").cast("int").alias("element_id")).groupBy(by).applyInPandas(one, f"{by} {kind}, element_id int, cluster_id int, size int")


def calculate_tfce(arr4d, bin_struct, E: float = 0.5, H: float = 2.0, dh="auto", two_sided_test: bool = True, spark: SparkSession | None = None):
    """The transform of a 4-D array (x, y, z, map) with the neighbourhood of a structuring element; ``dh`` has no meaning here."""
    from permafield.functions.design import connectivity_of

    arr = np.asarray(arr4d)
    if arr.ndim != 4:
        raise ValueError("a 4-D array is needed")
    space = Grid(arr.shape[:3], connectivity_of(bin_struct))
    flat = arr.reshape(-1, arr.shape[3], order="F").astype(np.float32)
    if spark is None:
        got = [tree.tfce(flat[:, k], space, E, H, two_sided_test) for k in range(flat.shape[1])]
    else:
        df = spark.createDataFrame([(k, flat[:, k].tolist()) for k in range(flat.shape[1])], "map_id int, values array<float>")
        got = [r["values"] for r in tfce_packed(df.repartition(min(64, flat.shape[1])), space, E, H, two_sided_test).orderBy("map_id").collect()]
    return np.stack([np.asarray(g, np.float32) for g in got], 1).reshape(arr.shape, order="F")
