"""The engine's queries on the driver's tables, each with the same result in SQL where SQL can express it.

Cells of a 7 x 12 x 5 grid are year, month and priority of orders; observations are the 25 nations of their customers. The 64
components of the embeddings are elements with a draw for each vector; hours of days are the elements of the events.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permafield.functions import design, linear, tails, tree
from permafield.operators import inference, maps, models, results, tiles
from permafield.plans.permutation import permutation_test
from permafield.sources import files, mat5

GRID, N, OBS, PERMS = (7, 12, 5), 420, 25, 40
AFFINE = [[-3, 0, 0, 90], [0, 3, 0, -126], [0, 0, 3, -72], [0, 0, 0, 1]]
GROUPS = np.array([[k % 2, 1 - k % 2] for k in range(OBS)], float)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def big(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- data -------------------------------------------------------------------------------------------------------------


def cells(spark: SparkSession, d: str) -> DataFrame:
    """``element_id, obs_id, y``: the filled cells only."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    element = (F.year("o_orderdate") - 1995) + 7 * (F.month("o_orderdate") - 1) + 84 * (F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return o.groupBy(element.cast("long").alias("element_id"), F.col("c_nationkey").cast("long").alias("obs_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))


def rows(spark: SparkSession, d: str) -> DataFrame:
    """``element_id, y``: all 420 elements with 25 values each."""
    full = spark.range(N).withColumnRenamed("id", "element_id").join(models.element_rows(cells(spark, d), OBS), "element_id", "left")
    return full.select("element_id", F.coalesce("y", F.array_repeat(F.lit(0.0), OBS)).alias("y"))


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("element_id", F.posexplode("y").alias("obs_id", "y")).withColumn("obs_id", F.col("obs_id").cast("long"))


def t_map(spark: SparkSession, d: str) -> DataFrame:
    """``map_id, element_id, value``: the two-group t of each cell, rounded to 4 digits and then made float32."""
    t = models.fit_glm(rows(spark, d), GROUPS, [1, -1])
    return t.select(F.lit(1).alias("map_id"), "element_id", r("t").cast("float").alias("value"))


def obs(spark: SparkSession) -> DataFrame:
    return spark.range(OBS).select(F.col("id").alias("obs_id"), (F.col("id") % 5).alias("block"), (F.col("id") % 2).alias("label"))


def hashed(spark: SparkSession, n: int = PERMS) -> np.ndarray:
    """The hash-keyed permutations as rows: their number is fixed."""
    out = np.zeros((n, OBS), int)
    for p in models.hashed_permutations(obs(spark).select("obs_id"), n).collect():
        out[p["perm_id"], p["obs_id"]] = p["src"]
    return out


def perm_stats(spark: SparkSession, d: str) -> DataFrame:
    s = models.fit_glm(rows(spark, d), GROUPS, [1, -1], perms=hashed(spark))
    return s.select("perm_id", "element_id", r("t", 6).alias("t"))


def observed(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_glm(rows(spark, d), GROUPS, [1, -1]).select("element_id", r("t", 6).alias("t"))


def draws(spark: SparkSession, d: str) -> DataFrame:
    """``perm_id, element_id, t``: vectors as draws, components as elements."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("perm_id"), F.posexplode("embedding").alias("element_id", "t")).select("perm_id", F.col("element_id").cast("long").alias("element_id"), F.col("t").cast("double").alias("t"))


def first_draw(spark: SparkSession, d: str) -> DataFrame:
    return draws(spark, d).where("perm_id = 0").select("element_id", "t")


def draw_maxima(spark: SparkSession, d: str) -> DataFrame:
    return inference.max_null(draws(spark, d))


def lattice(spark: SparkSession, k: int = 21) -> DataFrame:
    """``face_id, v1, v2, v3`` of a triangulated k by k lattice, numbered from 1."""
    q = spark.range((k - 1) * (k - 1)).select((F.floor(F.col("id") / (k - 1)) * k + F.col("id") % (k - 1) + 1).alias("a"), "id")
    face = F.explode(F.array(F.struct((2 * F.col("id")).alias("face_id"), F.col("a").alias("v1"), (F.col("a") + 1).alias("v2"), (F.col("a") + k).alias("v3")), F.struct((2 * F.col("id") + 1).alias("face_id"), (F.col("a") + 1).alias("v1"), (F.col("a") + k + 1).alias("v2"), (F.col("a") + k).alias("v3"))))
    return q.select(face.alias("f")).select("f.*")


Y = f"""cells AS (SELECT (year(o_orderdate)-1995) + 7*(month(o_orderdate)-1) + 84*(CAST(substr(o_orderpriority,1,1) AS INT)-1) AS element_id,
  c_nationkey AS obs_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
y AS (SELECT CAST(e.i AS BIGINT) AS element_id, CAST(n.i AS BIGINT) AS obs_id, coalesce(v, 0.0) AS y FROM (SELECT unnest(range({N})) AS i) e
  CROSS JOIN (SELECT unnest(range({OBS})) AS i) n LEFT JOIN cells ON cells.element_id = e.i AND cells.obs_id = n.i)"""


def two_group(source: str, key: str = "element_id", group: str = "obs_id % 2") -> str:
    """Pooled t of group 1 against group 0 for each key, 0 where nothing varies."""
    return f"""SELECT {key}, CASE WHEN v = 0 THEN 0.0 ELSE (m1 - m0) / sqrt(v * (1.0/n1 + 1.0/n0)) END AS t FROM (SELECT {key},
  avg(y) FILTER ({group} = 1) AS m1, avg(y) FILTER ({group} = 0) AS m0, count(*) FILTER ({group} = 1) AS n1, count(*) FILTER ({group} = 0) AS n0,
  (var_samp(y) FILTER ({group} = 1) * (count(*) FILTER ({group} = 1) - 1) + var_samp(y) FILTER ({group} = 0) * (count(*) FILTER ({group} = 0) - 1)) / (count(*) - 2) AS v
  FROM {source} GROUP BY {key}) q"""


TMAP = f"{Y}, tmap AS (SELECT element_id AS id, CAST(round(t, 4) AS FLOAT) AS t FROM ({two_group('y')}))"
XYZ_OF = "xyz AS (SELECT CAST(i AS BIGINT) AS id, i % 7 AS x, (i // 7) % 12 AS y, i // 84 AS z FROM (SELECT unnest(range(420)) AS i))"
XYZ = "SELECT CAST(i AS BIGINT) AS id, i % 7 AS x, (i // 7) % 12 AS y, i // 84 AS z FROM (SELECT unnest(range(420)) AS i)"


def edges_sql(reach: int) -> str:
    return f"SELECT a.id AS src, b.id AS dst FROM xyz a JOIN xyz b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1 AND a.id <> b.id AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z) <= {reach}"


LATTICE = """faces AS (SELECT 2*i AS face_id, a AS v1, a+1 AS v2, a+21 AS v3 FROM (SELECT i, (i//20)*21 + i%20 + 1 AS a FROM (SELECT unnest(range(400)) AS i))
  UNION ALL SELECT 2*i+1, a+1, a+22, a+21 FROM (SELECT i, (i//20)*21 + i%20 + 1 AS a FROM (SELECT unnest(range(400)) AS i))),
adj AS (SELECT DISTINCT CAST(p - 1 AS BIGINT) AS src, CAST(q - 1 AS BIGINT) AS dst FROM (SELECT v1 p, v2 q FROM faces UNION ALL SELECT v2, v3 FROM faces UNION ALL SELECT v3, v1 FROM faces
  UNION ALL SELECT v2, v1 FROM faces UNION ALL SELECT v3, v2 FROM faces UNION ALL SELECT v1, v3 FROM faces))"""


def tfce_sql(source: str, edges: str, ctes: str, e: str = "sqrt(n)", h: int = 2, signs: str = "(1), (-1)", key: str = "") -> str:
    """The level form: the size of an element's component at each of its map's levels, summed. ``source`` has id, t (and a key)."""
    k = f"{key}, " if key else ""
    on = (lambda a, b: f" AND {a}.{key} = {b}.{key}") if key else (lambda a, b: "")
    return f"""WITH RECURSIVE {ctes}, e AS ({edges}), d AS (SELECT {k}s, id, s * t AS v FROM {source}, (VALUES {signs}) w(s) WHERE s * t > 0),
lev AS (SELECT {k}s, v AS h, coalesce(lead(v) OVER (PARTITION BY {k}s ORDER BY v DESC), 0) AS lo FROM (SELECT DISTINCT {k}s, v FROM d)),
act AS (SELECT {'d.' + k if key else ''}d.s, h, lo, id FROM lev JOIN d ON d.s = lev.s{on('d', 'lev')} AND v >= h),
cc({k}s, h, id, comp) USING KEY ({k}s, h, id) AS (SELECT {k}s, h, id, id FROM act UNION
  SELECT {'b.' + k if key else ''}b.s, b.h, b.id, min(a.comp) FROM cc a JOIN e ON e.src = a.id JOIN recurring.cc b ON b.s = a.s{on('b', 'a')} AND b.h = a.h AND b.id = e.dst WHERE a.comp < b.comp GROUP BY ALL),
sz AS (SELECT {k}s, h, comp, count(*) AS n FROM cc GROUP BY ALL),
part AS (SELECT {'cc.' + k if key else ''}cc.s, cc.id, CAST(sum({e} * (CAST(cc.h AS DOUBLE)**{h + 1} - CAST(lo AS DOUBLE)**{h + 1}) / {h + 1}) AS FLOAT) AS x FROM cc
  JOIN sz ON sz.s = cc.s{on('sz', 'cc')} AND sz.h = cc.h AND sz.comp = cc.comp JOIN lev ON lev.s = cc.s{on('lev', 'cc')} AND lev.h = cc.h GROUP BY ALL)"""


ENH = "SELECT m.id AS element_id, round(CAST(m.t AS DOUBLE), 4) AS value, round(CAST(coalesce(p.x, 0) - coalesce(q.x, 0) AS DOUBLE), 4) AS enh FROM tmap m LEFT JOIN part p ON p.s = 1 AND p.id = m.id LEFT JOIN part q ON q.s = -1 AND q.id = m.id"


def enhanced(df: DataFrame) -> DataFrame:
    return big(df, "element_id").select("element_id", r("value").alias("value"), r("enh").alias("enh"))


# --- scans ------------------------------------------------------------------------------------------------------------


@query(f"WITH {Y} SELECT element_id, obs_id, y FROM y")
def grid_map_scan(spark, d):
    return long_rows(spark, d)


@query(f"WITH {Y} SELECT element_id, obs_id, y FROM y WHERE element_id IN (SELECT element_id FROM cells GROUP BY 1 HAVING count(*) > 15)")
def mask_filter(spark, d):
    mask = cells(spark, d).groupBy("element_id").agg((F.count("*") - 15).alias("mask"))
    return models.mask_filter(long_rows(spark, d), mask)


@query(f"WITH {Y} SELECT element_id, obs_id, round(y - avg(y) OVER (PARTITION BY element_id), 3) AS y FROM y")
def mean_center(spark, d):
    return models.mean_center(long_rows(spark, d)).withColumn("y", r("y", 3))


@query(f"WITH {Y} SELECT element_id, obs_id, round(y * (1 + obs_id / 100.0), 4) AS y FROM y")
def global_scaling(spark, d):
    factors = obs(spark).select("obs_id", (1 + F.col("obs_id") / 100).alias("gsf"))
    return models.scale_globals(long_rows(spark, d), factors).select("element_id", "obs_id", r("y", 4).alias("y"))


@query(f"WITH {Y} SELECT element_id, obs_id, round(0.5*y + 0.25*(lag(y,1,0.0) OVER w + lead(y,1,0.0) OVER w), 4) AS y FROM y WINDOW w AS (PARTITION BY element_id ORDER BY obs_id)")
def whitening(spark, d):
    w = 0.5 * np.eye(OBS) + 0.25 * (np.eye(OBS, k=1) + np.eye(OBS, k=-1))
    return models.whiten(rows(spark, d), w).select("element_id", F.posexplode("y").alias("obs_id", "y")).select("element_id", F.col("obs_id").cast("long").alias("obs_id"), r("y", 4).alias("y"))


@query(f"WITH {Y} SELECT element_id, obs_id, y FROM y WHERE element_id % 50 = 7")
def point_lookup(spark, d):
    points = spark.range(7, N, 50).withColumnRenamed("id", "element_id")
    return files.read_values_at(long_rows(spark, d), points)


# --- neighbourhoods ---------------------------------------------------------------------------------------------------


def _neighbours(c: int):
    def f(spark, d):
        of = rows(spark, d) if c == 6 else cells(spark, d).where("y > 300000")
        return maps.grid_edges(spark, GRID, c).join(of.select(F.col("element_id").alias("src")).distinct(), "src", "left_semi")

    f.__name__ = f"grid_neighbors_{c}"
    query(f"WITH {Y}, xyz AS ({XYZ}) {edges_sql({6: 1, 18: 2, 26: 3}[c])} AND a.id IN (SELECT element_id FROM {'y' if c == 6 else 'cells WHERE v > 300000'})")(f)


for _c in (6, 18, 26):
    _neighbours(_c)


WIDE = 20


def vector_faces(spark: SparkSession, d: str) -> DataFrame:
    """``face_id, v1, v2, v3`` of a mesh with a vertex for each vector: rows of WIDE vertices, two triangles for each square whose corners are all there."""
    v = table(spark, d, "embeddings").where("vec_id is not null").select(F.col("vec_id").cast("long").alias("a")).distinct()
    square = v.where(F.col("a") % WIDE < WIDE - 1)
    for step in (1, WIDE, WIDE + 1):
        square = square.join(v.select((F.col("a") - step).alias("a")), "a", "left_semi")
    p, q, s_, t = F.col("a") + 1, F.col("a") + 2, F.col("a") + WIDE + 1, F.col("a") + WIDE + 2
    face = F.explode(F.array(F.struct((2 * F.col("a")).alias("face_id"), p.alias("v1"), q.alias("v2"), s_.alias("v3")), F.struct((2 * F.col("a") + 1).alias("face_id"), q.alias("v1"), t.alias("v2"), s_.alias("v3"))))
    return square.select(face.alias("f")).select("f.*")


def vertices(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


VECTOR_MESH = f"""v AS (SELECT DISTINCT vec_id AS a FROM embeddings WHERE vec_id IS NOT NULL), sq AS (SELECT a FROM v WHERE a % {WIDE} < {WIDE - 1} AND a + 1 IN (SELECT a FROM v) AND a + {WIDE} IN (SELECT a FROM v) AND a + {WIDE + 1} IN (SELECT a FROM v)),
faces AS (SELECT 2*a AS face_id, a+1 AS v1, a+2 AS v2, a+{WIDE + 1} AS v3 FROM sq UNION ALL SELECT 2*a+1, a+2, a+{WIDE + 2}, a+{WIDE + 1} FROM sq),
adj AS (SELECT DISTINCT CAST(p - 1 AS BIGINT) AS src, CAST(q - 1 AS BIGINT) AS dst FROM (SELECT v1 p, v2 q FROM faces UNION ALL SELECT v2, v3 FROM faces UNION ALL SELECT v3, v1 FROM faces
  UNION ALL SELECT v2, v1 FROM faces UNION ALL SELECT v3, v2 FROM faces UNION ALL SELECT v1, v3 FROM faces))"""


@query(f"WITH {VECTOR_MESH} SELECT src, dst FROM adj")
def mesh_adjacency(spark, d):
    return maps.adjacency_from_faces(vector_faces(spark, d), vertices(spark, d))


@query(f"WITH {VECTOR_MESH} SELECT src AS element_id, count(*) AS degree FROM adj GROUP BY src")
def mesh_degree(spark, d):
    return maps.csr(maps.adjacency_from_faces(vector_faces(spark, d), vertices(spark, d))).select("element_id", F.size("nbrs").cast("long").alias("degree"))


@query(f"WITH {VECTOR_MESH} SELECT count(*) FILTER (least(v1,v2,v3) < 1 OR greatest(v1,v2,v3) > (SELECT max(vec_id) FROM embeddings)) AS bad, count(*) AS n FROM faces")
def face_range_check(spark, d):
    bad = (F.least("v1", "v2", "v3") < 1) | (F.greatest("v1", "v2", "v3") > vertices(spark, d) - 1)
    return vector_faces(spark, d).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))


# --- the transform ----------------------------------------------------------------------------------------------------


def _volume(c: int):
    def f(spark, d):
        return enhanced(maps.tfce(t_map(spark, d), GRID, connectivity=c))

    f.__name__ = f"tfce_volume_{c}"
    query(tfce_sql("tmap", edges_sql({6: 1, 18: 2, 26: 3}[c]), f"{TMAP}, xyz AS ({XYZ})") + ENH)(f)


for _c in (26, 6, 18):
    _volume(_c)


@query(tfce_sql("tmap", edges_sql(3), f"{TMAP}, xyz AS ({XYZ})", signs="(1)") + "SELECT m.id AS element_id, round(CAST(m.t AS DOUBLE), 4) AS value, round(CAST(coalesce(p.x, 0) AS DOUBLE), 4) AS enh FROM tmap m LEFT JOIN part p ON p.id = m.id")
def tfce_one_sided(spark, d):
    return enhanced(maps.tfce(t_map(spark, d), GRID, two_sided=False))


TIES = f"{Y}, tmap AS (SELECT element_id AS id, CAST(round(t) AS FLOAT) AS t FROM ({two_group('y')}))"


@query(tfce_sql("tmap", edges_sql(2), f"{TIES}, xyz AS ({XYZ})") + ENH)
def tfce_ties(spark, d):
    return enhanced(maps.tfce(_rounded(spark, d), GRID, connectivity=18))


def _rounded(spark, d):
    t = models.fit_glm(rows(spark, d), GROUPS, [1, -1])
    return t.select(F.lit(1).alias("map_id"), "element_id", r("t", 0).cast("float").alias("value"))


BATCH = f"{Y}, tmap AS (SELECT map_id, element_id AS id, CAST(round(t, 4) AS FLOAT) AS t FROM (" + " UNION ALL ".join(f"SELECT {k} AS map_id, * FROM ({two_group('y', group=f'CAST(obs_id % {k} = 0 AS INT)')})" for k in (2, 3, 4)) + "))"


@query(tfce_sql("tmap", edges_sql(1), f"{BATCH}, xyz AS ({XYZ})", key="map_id") + "SELECT CAST(m.map_id AS BIGINT) AS map_id, m.id AS element_id, round(CAST(coalesce(p.x, 0) - coalesce(q.x, 0) AS DOUBLE), 4) AS enh FROM tmap m LEFT JOIN part p ON p.s = 1 AND p.id = m.id AND p.map_id = m.map_id LEFT JOIN part q ON q.s = -1 AND q.id = m.id AND q.map_id = m.map_id")
def tfce_batch(spark, d):
    y, out = files.scratch(rows(spark, d), "rows"), None
    for k in (2, 3, 4):
        x = np.array([[i % k == 0, i % k != 0] for i in range(OBS)], float)
        m = models.fit_glm(y, x, [1, -1]).select(F.lit(k).alias("map_id"), "element_id", r("t").cast("float").alias("value"))
        out = m if out is None else out.unionByName(m)
    space = tree.Grid(GRID, 6)
    return maps.unpack(maps.tfce_packed(maps.pack(out, N), space), name="enh").select(F.col("map_id").cast("long").alias("map_id"), F.col("element_id").cast("long").alias("element_id"), r("enh").alias("enh"))


EVENT_MESH = """mesh_t AS (SELECT CAST(i AS BIGINT) AS id, CAST(round(coalesce(v, 0), 2) AS FLOAT) AS t FROM (SELECT unnest(range(441)) AS i) LEFT JOIN (SELECT event_id % 441 AS k, sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS v FROM events GROUP BY 1) ON k = i)"""


def event_map(spark, d):
    v = table(spark, d, "events").groupBy((F.col("event_id") % 441).alias("element_id")).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("v"))
    return spark.range(441).withColumnRenamed("id", "element_id").join(v, "element_id", "left").select(F.lit(1).alias("map_id"), "element_id", F.round(F.coalesce("v", F.lit(0.0)), 2).cast("float").alias("value"))


@query(tfce_sql("mesh_t", "SELECT src, dst FROM adj", f"{LATTICE}, {EVENT_MESH}", e="CAST(n AS DOUBLE)") + "SELECT m.id AS element_id, round(CAST(coalesce(p.x, 0) - coalesce(q.x, 0) AS DOUBLE) / 1e6, 2) AS enh FROM mesh_t m LEFT JOIN part p ON p.s = 1 AND p.id = m.id LEFT JOIN part q ON q.s = -1 AND q.id = m.id")
def tfce_mesh(spark, d):
    out = maps.tfce(event_map(spark, d), adjacency=maps.adjacency_from_faces(lattice(spark), 441), n=441, E=1.0)
    return big(out, "element_id").select("element_id", r(F.col("enh").cast("double") / 1e6, 2).alias("enh"))


@query(tfce_sql("tmap", edges_sql(3), f"{TMAP}, xyz AS ({XYZ})", signs="(1)") + """, top AS (SELECT comp, n, max(h) AS birth, min(h) AS low FROM (SELECT sz.*, c2.m FROM sz JOIN (SELECT s, h, comp, min(id) AS m FROM cc GROUP BY ALL) c2 USING (s, h, comp)) GROUP BY comp, n)
SELECT CAST(n AS BIGINT) AS size, round(CAST(birth AS DOUBLE), 4) AS birth, count(*) AS nodes FROM (SELECT DISTINCT s, comp_key, n, birth FROM (SELECT sz.s, sz.n, string_agg(CAST(cc.id AS VARCHAR), ',' ORDER BY cc.id) AS comp_key, max(sz.h) OVER (PARTITION BY string_agg(CAST(cc.id AS VARCHAR), ',' ORDER BY cc.id)) AS birth FROM sz JOIN cc USING (s, h, comp) GROUP BY sz.s, sz.h, sz.comp, sz.n)) GROUP BY ALL""")
def tree_nodes(spark, d):
    nodes = maps.tree_nodes(t_map(spark, d), tree.Grid(GRID, 26))
    return nodes.groupBy(F.col("size").cast("long").alias("size"), r("birth").alias("birth")).agg(F.count("*").alias("nodes"))


STEPS = "th AS (SELECT s, i * m / 20 AS h, m / 20 AS dh FROM (SELECT s, CAST(max(s*t) AS DOUBLE) AS m FROM tmap, (VALUES (1),(-1)) w(s) GROUP BY s), (SELECT unnest(range(1, 21)) AS i) WHERE m > 0)"


@query(f"""WITH RECURSIVE {TMAP}, xyz AS ({XYZ}), e AS ({edges_sql(1)}), {STEPS}, act AS (SELECT s, h, dh, id FROM th JOIN tmap ON s * CAST(t AS DOUBLE) >= h),
cc(s, h, id, comp) USING KEY (s, h, id) AS (SELECT s, h, id, id FROM act UNION SELECT b.s, b.h, b.id, min(a.comp) FROM cc a JOIN e ON e.src = a.id JOIN recurring.cc b ON b.s = a.s AND b.h = a.h AND b.id = e.dst WHERE a.comp < b.comp GROUP BY ALL),
sz AS (SELECT s, h, comp, count(*) AS n FROM cc GROUP BY ALL)
SELECT id AS element_id, round(coalesce(x, 0), 4) AS enh FROM (SELECT id FROM tmap) LEFT JOIN (SELECT cc.id, sum(cc.s * sqrt(n) * cc.h * cc.h * dh) AS x FROM cc JOIN sz USING (s, h, comp) JOIN th USING (s, h) GROUP BY 1) USING (id)""")
def tfce_stepped_20(spark, d):
    out = maps.tfce_stepped(t_map(spark, d), tree.Grid(GRID, 6), 20)
    return big(out, "element_id").select("element_id", r("enh").alias("enh"))


CUT = "1.0"
COMP = f"""WITH RECURSIVE {TMAP}, xyz AS ({XYZ}), e AS ({edges_sql(2)}), act AS (SELECT id FROM tmap WHERE t > {CUT}),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM act UNION SELECT b.id, min(a.comp) FROM cc a JOIN e ON e.src = a.id JOIN recurring.cc b ON b.id = e.dst WHERE a.comp < b.comp GROUP BY ALL),
cl AS (SELECT id AS element_id, comp AS cluster_id, count(*) OVER (PARTITION BY comp) AS size FROM cc)"""


def clustered(spark, d):
    s = t_map(spark, d).where(f"value > {CUT}").withColumnRenamed("map_id", "contrast_id")
    return big(results.clusters(s, tree.Grid(GRID, 18)), "element_id", "cluster_id", "size")


@query(COMP + " SELECT element_id, cluster_id, size FROM cl")
def components_at_threshold(spark, d):
    return clustered(spark, d).select("element_id", "cluster_id", "size")


@query(COMP + " SELECT DISTINCT cluster_id, size FROM cl")
def cluster_sizes(spark, d):
    return clustered(spark, d).select("cluster_id", "size").distinct()


@query(COMP + " SELECT element_id, cluster_id, size FROM cl WHERE size >= 3")
def extent_filter(spark, d):
    s = t_map(spark, d).where(f"value > {CUT}").withColumnRenamed("map_id", "contrast_id")
    return big(results.clusters(s, tree.Grid(GRID, 18), 3), "element_id", "cluster_id", "size").select("element_id", "cluster_id", "size")


@query(COMP + " SELECT element_id, CAST(r AS DOUBLE) AS value FROM cl JOIN (SELECT cluster_id, row_number() OVER (ORDER BY size DESC, cluster_id) AS r FROM (SELECT DISTINCT cluster_id, size FROM cl)) USING (cluster_id)")
def nary_labels(spark, d):
    return results.export_map(clustered(spark, d), "nary").select("element_id", F.col("value").cast("double").alias("value"))


@query(COMP + " SELECT element_id, size FROM cl WHERE cluster_id = (SELECT cluster_id FROM cl ORDER BY element_id LIMIT 1)")
def cluster_members(spark, d):
    c = clustered(spark, d)
    first = c.agg(F.min("element_id")).first()[0]
    return results.members_of_cluster(c, first if first is not None else -1).select("element_id", "size")


@query(COMP + " SELECT cluster_id, 'z' || CAST(element_id // 84 AS VARCHAR) AS label, round(count(*) / CAST(any_value(size) AS DOUBLE), 6) AS share FROM cl GROUP BY 1, 2")
def atlas_shares(spark, d):
    atlas = spark.range(N).select(F.col("id").alias("element_id"), F.concat(F.lit("z"), F.floor(F.col("id") / 84).cast("string")).alias("label"))
    return results.atlas_shares(clustered(spark, d), atlas).select("cluster_id", "label", r("share", 6).alias("share"))


@query(f"WITH {TMAP}, xyz AS ({XYZ}), e AS ({edges_sql(3)}), s AS (SELECT * FROM tmap WHERE t > {CUT}) SELECT id AS element_id, round(CAST(t AS DOUBLE), 4) AS value FROM s WHERE NOT EXISTS (SELECT 1 FROM e JOIN s o ON o.id = e.dst WHERE e.src = s.id AND o.t > s.t)")
def local_maxima(spark, d):
    s = t_map(spark, d).where(f"value > {CUT}")
    return results.local_maxima(s, maps.grid_edges(spark, GRID, 26)).select("element_id", r("value").alias("value"))


@query()
def peak_table(spark, d):
    s = clustered(spark, d).withColumnRenamed("contrast_id", "map_id")
    m = results.local_maxima(s, maps.grid_edges(spark, GRID, 18)).withColumnRenamed("map_id", "contrast_id")
    return results.peak_table(results.to_mm(maps.with_xyz(m, GRID), AFFINE).withColumn("value", F.col("value").cast("double")), 3, 8.0)


@query(f"WITH {Y}, xyz AS ({XYZ}) SELECT id AS element_id, CAST(90 - 3*x AS DOUBLE) AS x_mm, CAST(3*y - 126 AS DOUBLE) AS y_mm, CAST(3*z - 72 AS DOUBLE) AS z_mm FROM xyz WHERE id IN (SELECT element_id FROM y)")
def voxel_to_mm(spark, d):
    cell = maps.with_xyz(rows(spark, d).select("element_id"), GRID)
    return results.to_mm(cell, AFFINE).select("element_id", "x_mm", "y_mm", "z_mm")


@query(f"WITH {TMAP}, xyz AS ({XYZ}) SELECT id AS element_id, round(sqrt((90-3*x-80.0)**2 + (3*y-126+100.0)**2 + (3*z-72+65.0)**2), 4) AS distance FROM tmap JOIN xyz USING (id) WHERE t > {CUT} ORDER BY distance, id LIMIT 1")
def nearest_suprathreshold(spark, d):
    s = results.to_mm(maps.with_xyz(t_map(spark, d).where(f"value > {CUT}"), GRID), AFFINE)
    return results.nearest_element(s, (80.0, -100.0, -65.0)).select("element_id", r("distance").alias("distance"))


# --- models -----------------------------------------------------------------------------------------------------------


@query(f"WITH {Y} SELECT element_id, round(t, 4) AS t FROM ({two_group('y')})")
def glm_t_two_group(spark, d):
    return models.fit_glm(rows(spark, d), GROUPS, [1, -1]).select("element_id", r("t").alias("t"))


@query(f"WITH {Y} SELECT element_id, round(CASE WHEN var_samp(y) = 0 THEN 0 ELSE avg(y) / sqrt(var_samp(y) / count(*)) END, 4) AS t FROM y GROUP BY 1")
def glm_t_one_sample(spark, d):
    return models.fit_glm(rows(spark, d), np.ones((OBS, 1)), [1]).select("element_id", r("t").alias("t"))


@query(f"WITH {Y} SELECT element_id, round(CASE WHEN v = 0 THEN 0 ELSE b / sqrt(v / sxx) END, 4) AS t FROM (SELECT element_id, regr_slope(y, obs_id) AS b, regr_sxx(y, obs_id) AS sxx, (regr_syy(y, obs_id) - regr_sxy(y, obs_id)**2 / regr_sxx(y, obs_id)) / (count(*) - 2) AS v FROM y GROUP BY 1)")
def glm_t_covariate(spark, d):
    x = np.column_stack([np.arange(OBS), np.ones(OBS)])
    return models.fit_glm(rows(spark, d), x, [1, 0]).select("element_id", r("t").alias("t"))


ANOVA = f"WITH {Y}, g AS (SELECT element_id, obs_id % 5 AS g, avg(y) AS m, count(*) AS n, var_samp(y) * (count(*) - 1) AS w FROM y GROUP BY 1, 2), a AS (SELECT element_id, sum(n * (m - gm)**2) / 4 AS b, sum(w) / 20 AS w FROM g JOIN (SELECT element_id, avg(y) AS gm FROM y GROUP BY 1) USING (element_id) GROUP BY 1)"


@query(ANOVA + " SELECT element_id, round(b / w, 4) AS t FROM a WHERE w > 0")
def glm_f_anova(spark, d):
    x = (np.arange(OBS)[:, None] % 5 == np.arange(5)).astype(float)
    c = np.vstack([np.eye(4), -np.ones(4)])
    y = rows(spark, d).where(F.exists("y", lambda v: v != 0))
    return models.fit_glm(y, x, c).select("element_id", r("t").alias("t")).where(~F.isnan("t"))


@query(f"WITH {Y} SELECT element_id, round(t * t, 3) AS t FROM ({two_group('y')}) WHERE t <> 0")
def glm_f_one_df_is_t2(spark, d):
    y = rows(spark, d).where(F.exists("y", lambda v: v != 0))
    return models.fit_glm(y, GROUPS, [[1, -1], [-1, 1]]).select("element_id", r("t", 3).alias("t"))


@query(f"WITH {Y}, s AS (SELECT element_id, avg(y) FILTER (obs_id % 2 = 1) - avg(y) FILTER (obs_id % 2 = 0) AS b, (var_samp(y) FILTER (obs_id % 2 = 1) * 11 + var_samp(y) FILTER (obs_id % 2 = 0) * 12) / 23 AS v FROM y GROUP BY 1) SELECT element_id, round(b / sqrt((v + 1e-3 * (SELECT max(v) FROM s)) * (1.0/12 + 1.0/13)), 4) AS t FROM s")
def glm_shrunk(spark, d):
    return models.fit_glm(rows(spark, d), GROUPS, [1, -1], shrink=1e-3).select("element_id", r("t").alias("t"))


@query(f"""WITH {Y}, c AS (SELECT element_id, y, sqrt(abs(y)) + 1 AS c FROM y), m AS (SELECT element_id, count(*) AS n, regr_sxx(y, c) AS sxx, regr_sxy(y, c) AS sxy, regr_syy(y, c) AS syy FROM c GROUP BY 1)
SELECT element_id, round(CASE WHEN sxx < 1e-12 THEN 0.0 WHEN syy - sxy * sxy / sxx < 1e-9 * syy THEN sign(sxy) * 1e4 ELSE sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) END, 4) AS t FROM m""")
def voxel_covariate_t(spark, d):
    x = np.column_stack([np.arange(OBS) % 3 + 1.0, np.ones(OBS)])
    own = rows(spark, d).withColumn("c", F.transform("y", lambda v: F.sqrt(F.abs(v)) + 1))
    t = models.fit_voxel_covariate(own, x, [0], [1, 0])
    return t.select("element_id", r(F.greatest(F.lit(-1e4), F.least(F.lit(1e4), "t"))).alias("t"))  # an element of one value is fitted perfectly


def _nuisance(method: str):
    def f(spark, d):
        x = np.column_stack([np.arange(OBS) % 2, np.ones(OBS), np.arange(OBS) / OBS])
        return big(models.fit_glm(rows(spark, d), x, [1, 0, 0], perms=hashed(spark, 5), method=method), "perm_id").select("perm_id", "element_id", r("t").alias("t"))

    f.__name__ = f"nuisance_{method}"
    # t of x in y ~ x + 1 + z by sums of squares about the means, less what z explains; ``d`` holds y, x and z of each exchange.
    perm = f"k AS (SELECT p AS perm_id, i AS obs_id, md5('s42:' || p || ':' || i) AS k FROM (SELECT unnest(range(5)) AS p), (SELECT unnest(range({OBS})) AS i)), perm AS (SELECT perm_id, row_number() OVER (PARTITION BY perm_id ORDER BY k, obs_id) - 1 AS obs_id, obs_id AS src FROM k)"
    fixed = f"{Y}, {perm}, o AS (SELECT i AS obs_id, CAST(i % 2 AS DOUBLE) AS x, i / {OBS}.0 AS z FROM (SELECT unnest(range({OBS})) AS i)), fit AS (SELECT regr_slope(x, z) AS b, avg(x) AS mx, avg(z) AS mz FROM o), res AS (SELECT obs_id, x - mx - b * (z - mz) AS x FROM o, fit)"
    data = {
        # The data come from elsewhere; the design stays.
        "freedman_lane": "SELECT p.perm_id, y.element_id, y.y, o.x, o.z FROM perm p JOIN o ON o.obs_id = p.obs_id JOIN y ON y.obs_id = p.src",
        # The tested column comes from elsewhere, whole or without what z explains.
        "ds": "SELECT p.perm_id, y.element_id, y.y, m.x, o.z FROM perm p JOIN o ON o.obs_id = p.obs_id JOIN o m ON m.obs_id = p.src JOIN y ON y.obs_id = p.obs_id",
        "smith": "SELECT p.perm_id, y.element_id, y.y, m.x, o.z FROM perm p JOIN o ON o.obs_id = p.obs_id JOIN res m ON m.obs_id = p.src JOIN y ON y.obs_id = p.obs_id",
        # Residuals of y ~ 1 + z come from elsewhere, and the fit stays.
        "freedman_lane_exact": "SELECT p.perm_id, e.element_id, e.e + g.fit AS y, o.x, o.z FROM perm p JOIN o ON o.obs_id = p.obs_id JOIN ry e ON e.obs_id = p.src JOIN ry g ON g.obs_id = p.obs_id AND g.element_id = e.element_id",
    }[method]
    ry = ", yz AS (SELECT element_id, regr_slope(y, z) AS b, avg(y) AS my, avg(z) AS mz FROM y JOIN o USING (obs_id) GROUP BY 1), ry AS (SELECT y.element_id, y.obs_id, my + b * (z - mz) AS fit, y - my - b * (z - mz) AS e FROM y JOIN o USING (obs_id) JOIN yz USING (element_id))"
    query(f"""WITH {fixed}{ry}, d AS ({data}), s AS (SELECT perm_id, element_id, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz, regr_sxx(x, y) AS yy, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS yz, regr_sxy(x, z) AS xz FROM d GROUP BY 1, 2),
q AS (SELECT perm_id, element_id, yy, xx - xz * xz / zz AS xx, yy - yz * yz / zz AS yyz, xy - xz * yz / zz AS xy FROM s)
SELECT perm_id, element_id, round(CASE WHEN yy = 0 THEN 0.0 ELSE xy / xx / sqrt((yyz - xy * xy / xx) / ({OBS} - 3) / xx) END, 4) AS t FROM q""")(f)


for _m in ("ds", "smith", "freedman_lane", "freedman_lane_exact"):
    _nuisance(_m)


# --- permutations -----------------------------------------------------------------------------------------------------

KEYS = f"k AS (SELECT p AS perm_id, i AS obs_id, md5('s42:' || p || ':' || i) AS k FROM (SELECT unnest(range({PERMS})) AS p), (SELECT unnest(range({OBS})) AS i))"
PERM = f"{KEYS}, perm AS (SELECT perm_id, row_number() OVER (PARTITION BY perm_id ORDER BY k, obs_id) - 1 AS obs_id, obs_id AS src FROM k)"
SIGN = f"{KEYS}, sgn AS (SELECT perm_id, obs_id, CASE WHEN k[1] < '8' THEN 1 ELSE -1 END AS s FROM k)"
PSTAT = f"{Y}, {PERM}, py AS (SELECT perm_id, element_id, perm.obs_id, y FROM perm JOIN y ON y.obs_id = src), st AS (SELECT perm_id, element_id, round(t, 6) AS t FROM ({two_group('py', 'perm_id, element_id')})), ob AS (SELECT element_id, round(t, 6) AS t FROM ({two_group('y')}))"


FEW = 6


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as observations, their nations as blocks, and whether they owe as labels."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("obs_id"), F.col("c_nationkey").cast("long").alias("block"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("long").alias("label"))


CUST = f"cust AS (SELECT CAST(c_custkey AS BIGINT) AS obs_id, CAST(c_nationkey AS BIGINT) AS block FROM customer), ck AS (SELECT p AS perm_id, obs_id, block, md5('s42:' || p || ':' || obs_id) AS k FROM cust, (SELECT unnest(range({FEW})) AS p))"
CPERM = f"{CUST}, cp AS (SELECT a.perm_id, b.obs_id, a.obs_id AS src, b.block AS to_block, a.block AS from_block FROM (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY k, obs_id) AS r FROM ck) a JOIN (SELECT *, row_number() OVER (ORDER BY obs_id) AS r FROM cust) b USING (r))"


@query(f"WITH {CPERM} SELECT perm_id, obs_id, src FROM cp")
def perm_draw(spark, d):
    return big(models.hashed_permutations(customers(spark, d).select("obs_id"), FEW), "perm_id")


@query(f"WITH {CUST} SELECT a.perm_id, a.block, b.obs_id, a.obs_id AS src FROM (SELECT *, row_number() OVER (PARTITION BY perm_id, block ORDER BY k, obs_id) AS r FROM ck) a JOIN (SELECT *, row_number() OVER (PARTITION BY block ORDER BY obs_id) AS r FROM cust) b USING (block, r)")
def perm_within_blocks(spark, d):
    p = models.hashed_permutations(customers(spark, d).select("obs_id", "block"), FEW, within="block")
    return big(p.join(customers(spark, d).select("obs_id", "block").hint("merge"), "obs_id"), "perm_id").select("perm_id", "block", "obs_id", "src")


@query(f"WITH {CUST} SELECT perm_id, obs_id, CAST(CASE WHEN k[1] < '8' THEN 1 ELSE -1 END AS BIGINT) AS s FROM ck")
def sign_draw(spark, d):
    return big(models.hashed_signs(customers(spark, d).select("obs_id"), FEW), "perm_id", "s")


@query(f"WITH {CPERM} SELECT perm_id, count(*) AS n_places, count(DISTINCT src) AS n_sources, count(*) FILTER (to_block <> from_block) AS moved_out FROM cp GROUP BY 1")
def perm_verify(spark, d):
    return big(models.violations(models.hashed_permutations(customers(spark, d).select("obs_id"), FEW), customers(spark, d), "block"), "perm_id")


#: Each vector's first eight components, by rank, are a permutation of eight observations of two labels.
RANKS = "rk AS (SELECT vec_id AS perm_id, i AS obs_id, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) - 1 AS src FROM (SELECT vec_id, unnest(embedding[1:8]) AS v, unnest(range(8)) AS i FROM embeddings))"


@query(f"WITH {RANKS}, g AS (SELECT perm_id, string_agg(CAST(src % 2 AS VARCHAR), ',' ORDER BY obs_id) AS sig FROM rk GROUP BY 1) SELECT CAST(min(perm_id) AS BIGINT) AS perm_id, count(*) AS n_equal FROM g GROUP BY sig")
def perm_dedupe(spark, d):
    parts = table(spark, d, "embeddings").select(F.col("vec_id").alias("perm_id"), F.posexplode(F.slice("embedding", 1, 8)).alias("obs_id", "v"))
    drawn = parts.select("perm_id", F.col("obs_id").cast("long").alias("obs_id"), (F.row_number().over(Window.partitionBy("perm_id").orderBy("v", "obs_id")) - 1).cast("long").alias("src"))
    return big(models.distinct_permutations(drawn, spark.range(8).select(F.col("id").alias("obs_id"), (F.col("id") % 2).alias("label"))).select("perm_id", "n_equal"), "perm_id")


#: Two groups of a region's nations by the number of their suppliers; how many ways there are to draw the first group.
@query("""WITH s AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL), m AS (SELECT n_regionkey, n_nationkey, n > avg(n) OVER (PARTITION BY n_regionkey) AS much FROM s),
g AS (SELECT n_regionkey, count(*) AS n, count(*) FILTER (much) AS a FROM m GROUP BY 1)
SELECT CAST(n_regionkey AS BIGINT) AS region, 'groups' AS kind, CAST(factorial(CAST(n AS INT)) // (factorial(CAST(a AS INT)) * factorial(CAST(n - a AS INT))) AS BIGINT) AS possible, n AS n_obs FROM g WHERE a BETWEEN 1 AND n - 1""")
def perm_schemes(spark, d):
    """The scheme of a two-group design for each region, with its number of exchanges; a set of them is drawn and verified."""
    s_ = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").alias("n"))
    much = s_.withColumn("much", F.col("n") > F.avg("n").over(Window.partitionBy("n_regionkey")))
    out = []
    for row in much.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "much"))).alias("o")).collect():  # a design for each region
        g = np.array([[float(x["much"]), float(not x["much"])] for x in row["o"]])
        if 0 < g[:, 0].sum() < len(g):
            scheme = design.recognise(design.Design(g, [0, 1]), [1, -1])
            drawn = design.draw(scheme, 50, seed=1)
            design.verify(drawn, scheme.blocks, scheme.kind == "sign_flip")
            out.append((row["n_regionkey"], scheme.kind, design.possible(scheme), len(g)))
    return spark.createDataFrame(out, "region long, kind string, possible long, n_obs long")


@query(f"WITH {PSTAT} SELECT perm_id, element_id, t FROM st")
def perm_t_two_group(spark, d):
    return big(perm_stats(spark, d), "perm_id")


@query(f"WITH {Y}, {SIGN}, sy AS (SELECT perm_id, element_id, s * y AS y FROM sgn JOIN y USING (obs_id)) SELECT perm_id, element_id, round(CASE WHEN var_samp(y) = 0 THEN 0 ELSE avg(y) / sqrt(var_samp(y) / count(*)) END, 4) AS t FROM sy GROUP BY 1, 2")
def perm_t_sign(spark, d):
    signs = np.ones((PERMS, OBS))
    for p in models.hashed_signs(obs(spark).select("obs_id"), PERMS).collect():
        signs[p["perm_id"], p["obs_id"]] = p["s"]
    return big(models.fit_glm(rows(spark, d), np.ones((OBS, 1)), [1], signs=signs), "perm_id").withColumn("t", r("t"))


NULL = f"WITH {PSTAT}, nl AS (SELECT perm_id, max(st.t) AS t_max, min(st.t) AS t_min FROM st JOIN ob USING (element_id) WHERE ob.t <> 0 GROUP BY 1)"


@query(NULL + " SELECT perm_id, 0::BIGINT AS half, round(t_max, 4) AS t_max, round(t_min, 4) AS t_min FROM nl UNION ALL SELECT perm_id, 1, round(-t_min, 4), round(-t_max, 4) FROM nl")
def half_perm_mirror(spark, d):
    n = inference.mirrored(inference.max_null(perm_stats(spark, d), observed(spark, d)))
    return big(n, "perm_id", "half").withColumns({"t_max": r("t_max"), "t_min": r("t_min")})


@query(NULL + " SELECT perm_id, round(t_max, 4) AS t_max, round(t_min, 4) AS t_min FROM nl")
def max_null(spark, d):
    return big(inference.max_null(perm_stats(spark, d), observed(spark, d)), "perm_id").withColumns({"t_max": r("t_max"), "t_min": r("t_min")})


@query(f"WITH {PSTAT} SELECT element_id, CAST(sign(ob.t) AS BIGINT) AS sign, count(*) FILTER (sign(ob.t) * st.t >= sign(ob.t) * ob.t) AS cnt, count(*) AS n_draws FROM st JOIN ob USING (element_id) WHERE ob.t <> 0 GROUP BY 1, 2")
def exceedance_counts(spark, d):
    return big(inference.exceedances(perm_stats(spark, d), observed(spark, d)), "sign")


DRAW = "dr AS (SELECT vec_id AS perm_id, CAST(unnest(range(64)) AS BIGINT) AS element_id, CAST(unnest(embedding) AS DOUBLE) AS t FROM embeddings), fd AS (SELECT element_id, t AS t0, sign(t) AS s FROM dr WHERE perm_id = 0 AND t <> 0)"
TAIL = f"{DRAW}, tl AS (SELECT element_id, v, row_number() OVER (PARTITION BY element_id ORDER BY v DESC) AS r FROM (SELECT element_id, s * t AS v FROM dr JOIN fd USING (element_id)) QUALIFY r <= 40)"


@query(f"WITH {TAIL} SELECT element_id, r, round(v, 6) AS v FROM tl")
def tail_topk(spark, d):
    top = inference.tail_topk(draws(spark, d), first_draw(spark, d), 40)
    return top.select("element_id", F.posexplode("top").alias("r", "v")).select("element_id", (F.col("r") + 1).cast("long").alias("r"), r("v", 6).alias("v"))


@query(f"WITH {DRAW} SELECT element_id, round(sum(t) / sqrt(count(*) - 1), 6) AS null_t FROM dr GROUP BY 1")
def null_map(spark, d):
    return inference.null_map(draws(spark, d)).withColumn("null_t", r("null_t", 6))


MAXIMA = f"WITH {DRAW}, nl AS (SELECT perm_id, max(t) AS t_max, min(t) AS t_min FROM dr GROUP BY 1)"


@query(MAXIMA + ", q AS (SELECT t_max, row_number() OVER (ORDER BY t_max) AS r, count(*) OVER () AS n FROM nl) SELECT a AS alpha, round(t_max, 6) AS threshold FROM q JOIN (VALUES (0.05::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE)) w(a) ON r = CAST(ceil(round((1 - a) * n, 9)) AS BIGINT)")
def null_threshold(spark, d):
    return inference.running_thresholds(draw_maxima(spark, d)).withColumn("threshold", r("threshold", 6))


@query(MAXIMA + " SELECT least(CAST(floor((t_max - lo) / (hi - lo) * 100) AS BIGINT), 99) AS bin, count(*) AS n FROM nl, (SELECT min(t_max) AS lo, max(t_max) AS hi FROM nl) GROUP BY 1")
def null_histogram(spark, d):
    return big(inference.histogram(draw_maxima(spark, d)), "bin")


@query(MAXIMA + " SELECT count(*) AS n, round(avg(t_max), 6) AS mean, round(var_samp(t_max), 6) AS var, round(skewness(t_max), 5) AS skew FROM nl")
def null_moments(spark, d):
    return inference.moments(draw_maxima(spark, d)).select("n", r("mean", 6).alias("mean"), r("var", 6).alias("var"), r("skew", 5).alias("skew"))


# --- p-values ---------------------------------------------------------------------------------------------------------

CNT = f"{DRAW}, ct AS (SELECT element_id, count(*) FILTER (s * t >= s * t0) AS cnt, count(*) AS n FROM dr JOIN fd USING (element_id) GROUP BY 1)"


@query(f"WITH {CNT} SELECT element_id, round(cnt / CAST(n AS DOUBLE), 8) AS p FROM ct")
def p_count_unc(spark, d):
    return inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d))).select("element_id", r("p", 8).alias("p"))


@query(MAXIMA + " SELECT element_id, round((SELECT count(*) FROM nl WHERE t_max >= 3 * t0) / CAST((SELECT count(*) FROM nl) AS DOUBLE), 8) AS p FROM fd")
def p_count_fwe(spark, d):
    o = first_draw(spark, d).where("t <> 0").withColumn("t", 3 * F.col("t"))
    return inference.count_fwe(o, draw_maxima(spark, d)).select("element_id", r("p", 8).alias("p"))


GAMMA_MODE = """, mo AS (SELECT avg(t_max) AS m, var_samp(t_max) AS v, skewness(t_max) AS g, count(*) AS n FROM nl), z AS (SELECT element_id, 4/(g*g) AS a, greatest(((x - m)/sqrt(v) + 2/g) / (g/2), 0) AS z, n FROM (SELECT element_id, x FROM xs), mo)"""


@query(MAXIMA + ", xs AS (SELECT element_id, 3 * abs(t0) AS x FROM fd)" + GAMMA_MODE + """ SELECT element_id, round(least(greatest(CASE WHEN z = 0 THEN 1 ELSE 1 - (SELECT sum(exp(a*ln(z) - z + k*ln(z) - lgamma(a + k + 1))) FROM (SELECT unnest(range(2000)) AS k)) END, 1.0/n), 1), 6) AS p FROM z""")
def p_gamma_fwe(spark, d):
    o = first_draw(spark, d).where("t <> 0").select("element_id", (3 * F.abs("t")).alias("t"))
    return inference.gamma_fwe(o, draw_maxima(spark, d)).select("element_id", r("p", 6).alias("p"))


GPD = f"WITH {TAIL}, u AS (SELECT element_id, avg(v) FILTER (r IN (30, 31)) AS u FROM tl GROUP BY 1), ex AS (SELECT element_id, v - u AS y, 31 - r AS j FROM tl JOIN u USING (element_id) WHERE r <= 30), ft AS (SELECT element_id, a0/(a0 - 2*a1) - 2 AS k, 2*a0*a1/(a0 - 2*a1) AS sc FROM (SELECT element_id, avg(y) AS a0, sum(y * (30 - j)) / (30.0 * 29) AS a1 FROM ex GROUP BY 1))"


def _gpd(spark, d) -> DataFrame:
    import pandas as pd

    top = inference.tail_topk(draws(spark, d), first_draw(spark, d), 40)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                _, y = tails._excess(np.stack(pdf["top"].to_numpy()), 30)
                k, s = tails.gpd_fit(y)
                a = tails.anderson_darling(1 - tails.gpd_sf(y, k[:, None], s[:, None]))
                yield pd.DataFrame({"element_id": pdf["element_id"], "k": k, "scale": s, "a2": a, "y": list(y)})

    return top.mapInPandas(run, "element_id long, k double, scale double, a2 double, y array<double>")


@query(GPD + " SELECT element_id, round(k, 5) AS k, round(sc, 5) AS scale FROM ft")
def gpd_pwm(spark, d):
    return _gpd(spark, d).select("element_id", r("k", 5).alias("k"), r("scale", 5).alias("scale"))


SF = "CASE WHEN abs(k) < 1e-8 THEN exp(-y/sc) WHEN 1 - k*y/sc <= 0 THEN 0 ELSE (1 - k*y/sc) ** (1/k) END"


@query(GPD + f" SELECT element_id, j, round({SF}, 6) AS sf FROM ex JOIN ft USING (element_id)")
def gpd_sf(spark, d):
    inference.register_functions(spark)
    y = _gpd(spark, d).select("element_id", "k", "scale", F.posexplode("y").alias("j", "z"))
    return y.select("element_id", (F.col("j") + 1).cast("long").alias("j"), r(F.expr("gpd_tail(z, k, scale)"), 6).alias("sf"))


@query(GPD + f", f AS (SELECT element_id, j, greatest(least(1 - ({SF}), 1 - 1e-12), 1e-12) AS f FROM ex JOIN ft USING (element_id)) SELECT a.element_id, round(-30 - sum((2*a.j - 1) * (ln(a.f) + ln(1 - b.f))) / 30, 5) AS a2 FROM f a JOIN f b ON a.element_id = b.element_id AND b.j = 31 - a.j GROUP BY 1")
def gpd_anderson(spark, d):
    return _gpd(spark, d).select("element_id", r("a2", 5).alias("a2"))


@query()
def p_pareto(spark, d):
    s, o = draws(spark, d), first_draw(spark, d)
    o = o.withColumn("t", 2.5 * F.col("t"))
    cnt = inference.exceedances(s, o)
    return inference.pareto_unc(o.where("t <> 0"), inference.tail_topk(s, o, 100), cnt, table(spark, d, "embeddings").count()).withColumn("p", r("p", 8))


@query(f"WITH {CNT}, p AS (SELECT element_id, cnt / CAST(n AS DOUBLE) AS p FROM ct), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, element_id) AS v, row_number() OVER (ORDER BY p, element_id) AS i FROM p) SELECT element_id, round(least(1, min(v) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k")
def fdr_bh(spark, d):
    p = inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d)))
    return inference.fdr(p).select("element_id", r("q", 6).alias("q"))


@query(f"WITH {CNT}, p AS (SELECT element_id, s, cnt / CAST(n AS DOUBLE) AS p FROM ct JOIN fd USING (element_id)), k AS (SELECT *, p * count(*) OVER (PARTITION BY s) / row_number() OVER (PARTITION BY s ORDER BY p, element_id) AS v, row_number() OVER (PARTITION BY s ORDER BY p, element_id) AS i FROM p) SELECT element_id, CAST(s AS BIGINT) AS sign, round(least(1, min(v) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k")
def fdr_by_sign(spark, d):
    p = inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d)))
    return big(inference.fdr(p, ["sign"]).select("element_id", "sign", r("q", 6).alias("q")), "sign")


@query(f"WITH {CNT} SELECT element_id, round(-log10(cnt / CAST(n AS DOUBLE)) * s, 6) AS level, round(cnt / CAST(n AS DOUBLE), 8) AS p FROM ct JOIN fd USING (element_id)")
def log10_signed(spark, d):
    p = inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d)))
    level = inference.log10_signed(F.col("p"), F.col("sign").cast("double"))
    return p.withColumn("level", level).select("element_id", r("level", 6).alias("level"), r(inference.back_from_log10(F.abs("level")), 8).alias("p"))


@query(MAXIMA + ", q AS (SELECT perm_id, row_number() OVER (ORDER BY perm_id) AS m, sum(CAST(t_max >= 2.4 AS INT)) OVER (ORDER BY perm_id) AS hits FROM nl) SELECT perm_id, CAST(hits AS BIGINT) AS hits, round(hits / CAST(m AS DOUBLE), 6) AS p, m >= 100 AND hits >= 20 AND hits/CAST(m AS DOUBLE) - 3*sqrt(hits/CAST(m AS DOUBLE)*(1-hits/CAST(m AS DOUBLE))/m) > 0.05 AS stop FROM q")
def sequential_stop(spark, d):
    s = inference.sequential_stop(draw_maxima(spark, d), 2.4, least_perm=100)
    return s.select("perm_id", F.col("hits").cast("long").alias("hits"), r("p", 6).alias("p"), "stop")


@query(f"WITH {CNT} SELECT round(avg(CAST(2 * cnt / CAST(n AS DOUBLE) > 0.95 AS INT)), 6) AS p_hi FROM ct")
def calibration_upper_tail(spark, d):
    p = inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d)))
    return inference.calibration(p).select(r("p_hi", 6).alias("p_hi"))


# The upper tail of Student's t with 4 degrees of freedom has a closed form.
@query(f"WITH {CNT}, b AS (SELECT s, cnt / CAST(n AS DOUBLE) AS p, abs(t0) AS a FROM ct JOIN fd USING (element_id)), g AS (SELECT s, p, 0.5 - 0.375 * (a / sqrt(1 + a * a / 4)) * (1 - a * a / (12 * (1 + a * a / 4))) AS q FROM b) SELECT round(corr(p, q) FILTER (s > 0), 6) AS corr_p, round(corr(p, q) FILTER (s < 0), 6) AS corr_n FROM g WHERE q <> 0.5 AND q <> 1")
def param_vs_perm_corr(spark, d):
    p = inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d)))
    got = inference.parametric_agreement(p, first_draw(spark, d), "t", df2=4.0)
    return got.select(r("corr_p", 6).alias("corr_p"), r("corr_n", 6).alias("corr_n"))


@query(f"WITH {CNT}, g AS (SELECT *, cnt / CAST(n AS DOUBLE) AS p FROM ct) SELECT round(avg(p), 6) AS mean_p, count(*) FILTER (p <= 0.05) AS hits FROM g")
def p_summary(spark, d):
    p = inference.count_unc(inference.exceedances(draws(spark, d), first_draw(spark, d)))
    return p.agg(r(F.avg("p"), 6).alias("mean_p"), F.count_if(F.col("p") <= 0.05).alias("hits"))


#: The normal upper tail by its series.
TAIL_Z = "0.5 - 0.3989422804014327 * list_sum(list_transform(range(0, 45), lambda i: (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END) * power(z, 2 * i + 1) / (power(2.0, i) * gamma(i + 1.0) * (2 * i + 1))))"
#: Student's t with 23 degrees of freedom in closed form; the equivalent z by halving.
T_23 = "atan(abs(t) / sqrt(23.0))"
SUM_23 = f"list_sum(list_transform(range(0, 11), lambda j: power(4.0, j) * gamma(j + 1.0) ** 2 / gamma(2.0 * j + 2) * power(cos({T_23}), 2 * j + 1)))"


@query(f"""WITH RECURSIVE {Y}, ob AS (SELECT element_id, round(t, 6) AS t FROM ({two_group('y')})), a AS (SELECT element_id, t, 2 / pi() * ({T_23} + sin({T_23}) * {SUM_23}) AS a FROM ob), p AS (SELECT element_id, t, CASE WHEN t >= 0 THEN (1 - a) / 2 ELSE (1 + a) / 2 END AS p FROM a),
h(element_id, p, lo, hi, k) AS (SELECT element_id, p, -6.0::DOUBLE, 6.0::DOUBLE, 0 FROM p UNION ALL SELECT element_id, p, CASE WHEN sf > p THEN z ELSE lo END, CASE WHEN sf > p THEN hi ELSE z END, k + 1 FROM (SELECT *, {TAIL_Z} AS sf FROM (SELECT *, (lo + hi) / 2 AS z FROM h WHERE k < 40)))
SELECT element_id, round(t, 4) AS t, round(p.p, 6) AS p_param, round((lo + hi) / 2, 4) AS z FROM h JOIN p USING (element_id) WHERE k = 40""")
def parametric_p(spark, d):
    t = inference.parametric_p(observed(spark, d), "t", df2=23.0)
    return inference.z_equivalent(t, "p_param").select("element_id", r("t").alias("t"), r("p_param", 6).alias("p_param"), r("z").alias("z"))


@query(f"WITH {DRAW} SELECT element_id, CASE WHEN t > 0 THEN 'P' WHEN t < 0 THEN 'N' ELSE '0' END AS mask, round(greatest(t, 0), 6) AS f FROM dr")
def sign_masks(spark, d):
    return inference.sign_masks(draws(spark, d)).select("element_id", "mask", r(inference.clean_stat(F.col("t"), True), 6).alias("f"))


RES = f"WITH {DRAW}, nl AS (SELECT perm_id, max(t) AS t_max FROM dr GROUP BY 1), c AS (SELECT element_id, sum(CAST(s * t >= s * t0 AS INT)) / CAST(count(*) AS DOUBLE) AS p_unc FROM dr JOIN fd USING (element_id) GROUP BY 1), f AS (SELECT element_id, t0, s, p_unc, (SELECT count(*) FROM nl WHERE t_max >= 3*abs(t0)) / CAST((SELECT count(*) FROM nl) AS DOUBLE) AS p_fwe, p_unc * count(*) OVER w / row_number() OVER (w ORDER BY p_unc, element_id) AS v, row_number() OVER (w ORDER BY p_unc, element_id) AS i FROM c JOIN fd USING (element_id) WINDOW w AS (PARTITION BY s)), g AS (SELECT *, min(v) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_fdr FROM f)"


def result_set(spark, d) -> DataFrame:
    o = first_draw(spark, d).where("t <> 0")
    p = inference.count_unc(inference.exceedances(draws(spark, d), o))
    q = inference.fdr(p, ["sign"]).select("element_id", "sign", F.col("p").alias("p_unc"), F.col("q").alias("p_fdr"))
    f = inference.count_fwe(o.withColumn("a", 3 * F.abs("t")), draw_maxima(spark, d), "a").select("element_id", F.col("t").alias("stat"), F.col("p").alias("p_fwe"))
    return f.join(q, "element_id").withColumn("contrast_id", F.lit(1))


@query(RES + " SELECT element_id, round(p_fwe, 6) AS p FROM g WHERE s = 1 AND p_fwe < 0.3")
def threshold_view_fwe(spark, d):
    return results.threshold(result_set(spark, d), "fwe", 0.3).select("element_id", r("p_fwe", 6).alias("p"))


@query(RES + " SELECT element_id, round(p_fdr, 6) AS p FROM g WHERE s = 1 AND p_fdr < 0.45")
def threshold_view_fdr(spark, d):
    return results.threshold(result_set(spark, d), "fdr", 0.45).select("element_id", r("p_fdr", 6).alias("p"))


@query(RES + " SELECT element_id, round(8 * t0, 6) AS stat FROM g WHERE s = 1 AND 8 * t0 > 1")
def threshold_view_none(spark, d):
    return results.threshold(result_set(spark, d).withColumn("stat", 8 * F.col("stat")), "none", 1.0).select("element_id", r("stat", 6).alias("stat"))


@query(RES + " SELECT element_id, round(-t0, 6) AS stat FROM g WHERE s = -1 AND p_unc < 0.2")
def inverse_contrast(spark, d):
    v = results.threshold(result_set(spark, d), "none", 0.2, inverse=True)
    return results.inverse_contrast(v, ["stat"]).select("element_id", r("stat", 6).alias("stat"))


@query("SELECT element_id, round(min(t), 6) AS value FROM (SELECT vec_id AS perm_id, CAST(unnest(range(64)) AS BIGINT) AS element_id, CAST(unnest(embedding) AS DOUBLE) AS t FROM embeddings) WHERE perm_id < 3 GROUP BY 1")
def conjunction(spark, d):
    s = draws(spark, d)
    three = files.aligned(*[s.where(f"perm_id = {k}").select("element_id", F.col("t").alias(f"t{k}")) for k in range(3)])
    return results.conjunction(three, ["t0", "t1", "t2"]).select("element_id", r("value", 6).alias("value"))


@query(f"WITH {DRAW} SELECT element_id FROM dr WHERE perm_id = 0 AND t > 0 INTERSECT SELECT element_id FROM dr WHERE perm_id = 1 AND t > 0 EXCEPT SELECT element_id FROM dr WHERE perm_id = 2 AND t > 0")
def inclusive_exclusive_masks(spark, d):
    s = draws(spark, d).where("t > 0")
    return files.masked(s.where("perm_id = 0").select("element_id"), s.where("perm_id = 1"), s.where("perm_id = 2"))


@query()
def permutation_test_volume(spark, d):
    """The whole test: 200 exchanges of the two groups, enhanced, with all p-values of both measures."""
    scheme = design.recognise(design.Design(GROUPS, [0, 1]), [1, -1])
    out = permutation_test(rows(spark, d), GROUPS, [1, -1], design.draw(scheme, 200, seed=7), tree.Grid(GRID, 26))
    return out.result


@query()
def permutation_test_sequential(spark, d):
    """The same in waves of 100 with the sequential rule, for one group's sign flips."""
    scheme = design.recognise(design.Design(np.ones((OBS, 1)), [0]), [1])
    centred = rows(spark, d).withColumn("y", F.transform("y", lambda v: v - F.aggregate("y", F.lit(0.0), lambda a, b: a + b) / OBS))
    out = permutation_test(centred, np.ones((OBS, 1)), [1], design.draw(scheme, 1200, seed=7), tree.Grid(GRID, 6), signs=True, wave=300, n_tail=50)
    return out.result


def minimum_slice(spark: SparkSession, d: str) -> DataFrame:
    """Cells, two-group t, enhanced: ``element_id, x, y, z, value, enh``."""
    return maps.with_xyz(maps.tfce(t_map(spark, d), GRID), GRID).orderBy(F.desc("enh"), "element_id")


# --- stored designs ---------------------------------------------------------------------------------------------------


def yearly_designs(spark: SparkSession, d: str) -> str:
    """A folder of MAT-5 designs, one for each year of orders: nations are observations of two groups with their customers' mean balance
    as a covariate; contrasts compare and average the groups; the volume holds the cells (month, priority) that have orders."""
    nation = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("obs_id")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("balance"))
    x = nation.agg(F.sort_array(F.collect_list(F.struct("obs_id", "balance"))).alias("o"), F.lit(1).alias("one"))  # a row for each nation
    o = table(spark, d, "orders")
    cell = F.struct(F.month("o_orderdate").alias("m"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    years = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.sort_array(F.collect_set(cell)).alias("c"), F.lit(1).alias("one")).join(x, "one")  # one row beside each year
    num = lambda path, values, *dims: F.struct(F.lit(path).alias("path"), F.lit("double").alias("class"), F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in dims]).alias("dims"), values.cast("array<double>").alias("values"), F.lit(None).cast("string").alias("text"))
    box = lambda path, many, fields: F.struct(F.lit(path).alias("path"), F.lit("struct").alias("class"), F.array(F.lit(1).cast("long"), F.lit(many).cast("long")).alias("dims"), F.lit(None).cast("array<double>").alias("values"), F.lit("\n".join(fields)).alias("text"))
    word = lambda path, text: F.struct(F.lit(path).alias("path"), F.lit("char").alias("class"), F.array(F.lit(1).cast("long"), F.lit(len(text)).cast("long")).alias("dims"), F.lit(None).cast("array<double>").alias("values"), F.lit(text).alias("text"))
    of = lambda *v: F.array(*map(F.lit, v))
    group = lambda odd: F.transform("o", lambda s: F.when(s["obs_id"] % 2 == odd, 1.0).otherwise(0.0))
    parts = [
        box("SPM", 1, ["xX", "xCon", "xVol"]),
        box("SPM.xX", 1, ["X", "iH", "iC"]),
        num("SPM.xX.X", F.concat(group(1), group(0), F.transform("o", lambda s: s["balance"])), F.size("o"), 3),
        num("SPM.xX.iH", of(1.0, 2.0), 1, 2),
        num("SPM.xX.iC", of(3.0), 1, 1),
        box("SPM.xCon", 2, ["name", "STAT", "c"]),
        *(part for k, (name, c) in enumerate([("odd against even", (1.0, -1.0, 0.0)), ("mean", (0.5, 0.5, 0.0))], 1) for part in (word(f"SPM.xCon({k}).name", name), word(f"SPM.xCon({k}).STAT", "T"), num(f"SPM.xCon({k}).c", of(*c), 3, 1))),
        box("SPM.xVol", 1, ["XYZ", "DIM"]),
        num("SPM.xVol.XYZ", F.flatten(F.transform("c", lambda s: F.array(F.lit(1), s["m"], s["p"]))), 3, F.size("c")),
        num("SPM.xVol.DIM", of(1.0, 12.0, 5.0), 3, 1),
    ]
    rows_ = years.select(F.concat(F.col("year").cast("string"), F.lit(".mat")).alias("file"), F.explode(F.array(*parts)).alias("r"))
    path = files.scratch_path(spark, "designs")
    mat5.register(spark)
    rows_.select("file", F.lit("SPM").alias("variable"), "r.path", "r.class", "r.dims", "r.values", F.lit(None).cast("array<long>").alias("at"), "r.text").repartition("file").write.format("mat5").mode("append").save(path)
    return path


@query("""WITH x AS (SELECT c_nationkey AS obs_id, CAST(c_nationkey % 2 AS DOUBLE) AS odd FROM customer GROUP BY ALL),
y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, c_nationkey AS obs_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(DISTINCT month(o_orderdate) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT)) AS n_elements,
  max(month(o_orderdate) - 1 + 12 * (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)) AS last_element FROM orders GROUP BY 1),
s AS (SELECT year, sum(v * odd) AS a, sum(v * (1 - odd)) AS b FROM y JOIN x USING (obs_id) GROUP BY 1)
SELECT year, c.name, round(CASE WHEN c.name = 'mean' THEN (a + b) / 2 ELSE a - b END, 2) AS effect, n_elements, CAST(last_element AS BIGINT) AS last_element FROM s JOIN e USING (year), (VALUES ('mean'), ('odd against even')) c(name)""")
def design_source(spark, d):
    """Designs and contrasts read from MAT-5 files, one a year, applied to the year's sums of nations; elements of the volumes read."""
    path = yearly_designs(spark, d)
    load = lambda within: spark.read.format("mat5").option("variables", "SPM").option("within", within).load(path)
    year = F.regexp_extract("file", r"(\d+)\.mat$", 1).cast("long").alias("year")
    x = mat5.matrix_rows(load("SPM.xX.X"), "SPM.xX.X").select(year, F.col("row").alias("obs_id"), "col", F.col("value").alias("x"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.col("c_nationkey").cast("long").alias("obs_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))
    xty = x.join(y, ["year", "obs_id"]).groupBy("year", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    con = load("SPM.xCon(").select(year, F.regexp_extract("path", r"\((\d+)\)", 1).alias("k"), F.regexp_extract("path", r"(\w+)$", 1).alias("field"), "values", "text")
    c = con.where("field = 'c'").select("year", "k", F.posexplode("values").alias("col", "w"))
    names = con.where("field = 'name'").select("year", "k", F.col("text").alias("name"))
    effect = xty.join(c, ["year", "col"]).groupBy("year", "k").agg(r(F.sum(F.col("v") * F.col("w")), 2).alias("effect")).join(names, ["year", "k"]).drop("k")
    mask = mat5.mask_elements(load("SPM.xVol")).groupBy(year).agg(F.count("*").alias("n_elements"), F.max("element_id").alias("last_element"))
    return effect.join(mask, "year")


# --- the large plan ---------------------------------------------------------------------------------------------------

MONTHS, SHIFTS = 12, 30
#: Revenue of parts by month; a cent times a power of two for each month keeps different groupings of months apart where sums are 0.
PARTS_SQL = f"""py AS (SELECT CAST(p_partkey AS BIGINT) AS element_id, m.i AS obs_id, coalesce(v, 0) + 0.01 * (2 ** m.i) AS y FROM part CROSS JOIN (SELECT unnest(range({MONTHS})) AS i) m
  LEFT JOIN (SELECT l_partkey, month(l_shipdate) - 1 AS i, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) s ON s.l_partkey = p_partkey AND s.i = m.i),
mk AS (SELECT p AS perm_id, i AS obs_id, md5('months:' || p || ':' || i) AS k FROM (SELECT unnest(range(1, {SHIFTS})) AS p), (SELECT unnest(range({MONTHS})) AS i)),
mp AS (SELECT perm_id, row_number() OVER (PARTITION BY perm_id ORDER BY k, obs_id) - 1 AS obs_id, obs_id AS src FROM mk UNION ALL SELECT 0, i, i FROM (SELECT unnest(range({MONTHS})) AS i)),
my AS (SELECT perm_id, element_id, mp.obs_id, y FROM mp JOIN py ON py.obs_id = src), ms AS ({two_group('my', 'perm_id, element_id')}), m0 AS (SELECT element_id, t AS t0, sign(t) AS s FROM ms WHERE perm_id = 0)"""


def months_rows(spark, d):
    """``element_id, y``: revenue of every part in each month of the year."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("element_id"), (F.month("l_shipdate") - 1).cast("long").alias("obs_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("y"))
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("element_id"))
    rows_ = parts.join(models.element_rows(sums, MONTHS), "element_id", "left")
    return rows_.select("element_id", F.transform(F.coalesce("y", F.array_repeat(F.lit(0.0), MONTHS)), lambda v, i: v + 0.01 * F.pow(F.lit(2.0), i)).alias("y"))


def months_test(spark, d):
    """The reductions of a test over all parts, by blocks of elements and waves of exchanges: revenue in odd against even months."""
    from permafield.plans import blocks

    perms = np.tile(np.arange(MONTHS), (SHIFTS, 1))
    for p in models.hashed_permutations(spark.range(MONTHS).withColumnRenamed("id", "obs_id"), SHIFTS, "months").where("perm_id > 0").collect():  # a fixed number
        perms[p["perm_id"], p["obs_id"]] = p["src"]
    x = np.array([[k % 2, 1 - k % 2] for k in range(MONTHS)], float)
    return blocks.reductions(months_rows(spark, d), x, [1, -1], perms, n_tail=5, wave=12, block=1024)


@query(f"WITH {PARTS_SQL} SELECT element_id, CAST(count(*) FILTER (s * t >= s * t0) AS BIGINT) AS cnt, round(max(s * t), 4) AS top FROM ms JOIN m0 USING (element_id) GROUP BY 1")
def blocks_counts(spark, d):
    _, _, per, _ = months_test(spark, d)
    return per.where("measure = 'stat'").select("element_id", "cnt", r(F.get("top", F.lit(0))).alias("top"))


@query(f"WITH {PARTS_SQL} SELECT CAST(perm_id AS BIGINT) AS perm_id, round(max(t), 4) AS t_max, round(min(t), 4) AS t_min FROM ms GROUP BY 1")
def blocks_maxima(spark, d):
    _, null, _, _ = months_test(spark, d)
    return null.select(F.col("perm_id").cast("long").alias("perm_id"), r("t_max").alias("t_max"), r("t_min").alias("t_min"))


# --- maps by tiles ----------------------------------------------------------------------------------------------------

ACROSS = 40
PART_EDGES = "SELECT a.id AS src, b.id AS dst FROM xyz a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dx, dy), xyz b WHERE b.x = a.x + dx AND b.y = a.y + dy"
PART_MAP = f"{PARTS_SQL}, tmap AS (SELECT element_id AS id, CAST(round(t0, 1) AS FLOAT) AS t FROM m0), xyz AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % {ACROSS} AS x, p_partkey // {ACROSS} AS y FROM part)"


@query(tfce_sql("tmap", PART_EDGES, PART_MAP) + ENH)
def tfce_tiled(spark, d):
    """The transform of a map of all parts, rows of 40 to a plane, cut into tiles of 16 by 16: no task holds the map."""
    rows_, n = months_rows(spark, d), table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    x = np.array([[k % 2, 1 - k % 2] for k in range(MONTHS)], float)
    t = models.fit_glm(rows_, x, [1, -1]).select(F.lit(0).alias("map_id"), "element_id", r("t", 1).cast("float").alias("value"))
    return enhanced(tiles.tfce_tiled(t, (ACROSS, -(-n // ACROSS), 1), (16, 16, 1), 26))


# --- step-up values of any statistic, smoothness, meshes --------------------------------------------------------------

@query(f"""WITH {DRAW}, im AS (SELECT 8 * t AS z FROM dr), ip AS (SELECT unnest([1, 2, 3]) AS n, {TAIL_Z} AS p FROM im), lv AS (SELECT n, p ** n AS p FROM ip), st AS (SELECT n, p, p * count(*) OVER (PARTITION BY n) / row_number() OVER (PARTITION BY n ORDER BY p) AS v FROM lv),
q AS (SELECT n, p, least(1.0, min(v) OVER (PARTITION BY n ORDER BY p DESC)) AS q FROM st), pt AS (SELECT element_id, 8 * t0 + 0.05 AS z FROM fd), pp AS (SELECT element_id, unnest([1, 2, 3]) AS n, {TAIL_Z} AS p FROM pt), po AS (SELECT element_id, n, p ** n AS p FROM pp)
SELECT element_id, CAST(n AS INT) AS n, round(coalesce((SELECT min(q.q) FROM q WHERE q.n = po.n AND q.p >= po.p), 1.0), 6) AS q FROM po""")
def fdr_conjunction(spark, d):
    """Step-up values of z under the global null of 1 to 3 statistics, looked up in the image of all draws."""
    out = None
    for n in (1, 2, 3):
        image = inference.statistic_p(draws(spark, d).withColumn("z", 8 * F.col("t")), "z", n=-n, stat="z")
        points = inference.statistic_p(first_draw(spark, d).where("t <> 0").withColumn("z", 8 * F.col("t") + 0.05), "z", n=-n, stat="z")
        own = inference.fdr_at(points, image.select("p")).select("element_id", F.lit(n).alias("n"), r("q", 6).alias("q"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {Y}, {XYZ_OF}, g AS (SELECT element_id, obs_id, y - avg(y) OVER (PARTITION BY element_id, obs_id % 2) AS e FROM y), l AS (SELECT element_id, sqrt(sum(e * e)) AS len FROM g GROUP BY 1), u AS (SELECT element_id AS id, obs_id, e / len AS u FROM g JOIN l USING (element_id) WHERE len > 0),
dd AS (SELECT o.id, o.obs_id, a.u - o.u AS dx, b.u - o.u AS dy, c.u - o.u AS dz FROM u o JOIN xyz USING (id) JOIN u a ON a.id = o.id + 1 AND a.obs_id = o.obs_id AND xyz.x < 6 JOIN u b ON b.id = o.id + 7 AND b.obs_id = o.obs_id AND xyz.y < 11 JOIN u c ON c.id = o.id + 84 AND c.obs_id = o.obs_id AND xyz.z < 4),
m AS (SELECT count(DISTINCT id) AS k, sum(dx*dx)/count(DISTINCT id) AS xx, sum(dy*dy)/count(DISTINCT id) AS yy, sum(dz*dz)/count(DISTINCT id) AS zz, sum(dx*dy)/count(DISTINCT id) AS xy, sum(dx*dz)/count(DISTINCT id) AS xz, sum(dy*dz)/count(DISTINCT id) AS yz FROM dd), w AS (SELECT 4 * ln(2.0) AS f)
SELECT (SELECT count(DISTINCT id) FROM u) AS n, k AS n_inner, round((SELECT count(DISTINCT id) FROM u) * sqrt((xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz)) / f**3), 4) AS resels, round(sqrt(f/xx), 6) AS fwhm_x, round(sqrt(f/yy), 6) AS fwhm_y, round(sqrt(f/zz), 6) AS fwhm_z FROM m, w""")
def smoothness(spark, d):
    s_ = results.smoothness(models.residuals(rows(spark, d), GROUPS), GRID)
    return s_.select("n", "n_inner", r("resels").alias("resels"), *(r(f"fwhm_{a}", 6).alias(f"fwhm_{a}") for a in "xyz"))


@query(f"""WITH RECURSIVE {VECTOR_MESH}, val AS (SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE), 2) AS v FROM embeddings), on_ AS (SELECT * FROM val WHERE v > 0),
up AS (SELECT o.id, n.id AS up FROM on_ o JOIN adj ON src = o.id JOIN on_ n ON n.id = dst WHERE n.v > o.v OR (n.v = o.v AND n.id < o.id) QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY n.v DESC, n.id) = 1),
walk(id, pos) AS (SELECT id, id FROM on_ UNION SELECT walk.id, up.up FROM walk JOIN up ON up.id = walk.pos), ends AS (SELECT id, pos AS peak FROM walk WHERE pos NOT IN (SELECT id FROM up)), bas AS (SELECT peak, count(*) AS basin FROM ends GROUP BY 1),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM on_ UNION SELECT b.id, min(a.comp) FROM cc a JOIN adj ON src = a.id JOIN recurring.cc b ON b.id = dst WHERE a.comp < b.comp GROUP BY ALL), sz AS (SELECT comp, count(*) AS size FROM cc GROUP BY 1),
pk AS (SELECT o.id, v, comp, size, basin, row_number() OVER (PARTITION BY comp ORDER BY v DESC, o.id) AS rank FROM bas JOIN on_ o ON o.id = peak JOIN cc ON cc.id = o.id JOIN sz USING (comp) WHERE size >= 3),
top AS (SELECT comp, row_number() OVER (ORDER BY v DESC, id) AS cluster FROM pk WHERE rank = 1)
SELECT cluster, CAST(comp AS BIGINT) AS cluster_id, size, rank, CAST(id AS BIGINT) AS element_id, v AS value, basin FROM pk JOIN top USING (comp)""")
def mesh_peaks(spark, d):
    """Maxima of a map on the mesh of all vectors, with their watershed basins, by component."""
    edges = files.scratch(maps.adjacency_from_faces(vector_faces(spark, d), vertices(spark, d)), "edges")
    value = table(spark, d, "embeddings").select(F.lit(0).alias("map_id"), F.col("vec_id").cast("long").alias("element_id"), F.round(F.get("embedding", F.lit(0)).cast("double") + F.get("embedding", F.lit(1)).cast("double"), 2).alias("value"))
    found = results.mesh_peaks(value.where("value > 0"), edges, maps.neighbourhood(None, edges, 26, vertices(spark, d)), k=3)
    return big(found.drop("map_id"), "cluster", "cluster_id", "size", "rank", "element_id", "basin")
