"""Helpers that the corpus operators share: the shared folder, written intermediates, components, linking within buckets."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \t \n \v \f \r (the ASCII white space that ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"

#: 64-bit words of a parity map; most rounds of pivots within buckets, which end sooner where a round links fewer than one of SLOW
#: members; pivots of a bucket in a round; comparisons of one group when what they leave is compared in full, and comparisons of all
#: buckets together from which pivots are worth their rounds.
WORDS, ROUNDS, SLOW, PIVOTS, WORK, FEW = 16, 8, 200, 3, 10_000_000, 20_000_000

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local session; on a cluster it raises, as executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="permafield-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/permafield-{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(clean_up, spark)
    _written[app].append(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Remove what :func:`materialise` and :func:`new_path` made in this application. Results read from it end with it."""
    jsc = spark.sparkContext._jsc
    if jsc is None:
        return
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def remove(spark: SparkSession, path: str) -> None:
    """Remove one written intermediate that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    kept = _written.get(spark.sparkContext.applicationId, [])
    if path in kept:
        kept.remove(path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def drop_written(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote for ``df``."""
    if path := getattr(df, "_written_at", None):
        remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(wanted: str, *taken: list[str]) -> str:
    """``wanted``, or it with underscores before it, that none of the lists of names holds in any case."""
    used = {n.lower() for names in taken for n in names}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows to an Arrow batch: the rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` of distinct ``u > v`` edges has one ``v``, and none is a ``v``: the components are known then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or ups = 1 and low = 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph as ``node, component`` (its smallest node), by alternating large and small stars.

    Only nodes with an edge to another node are returned; null ends and loops are ignored. Every round is two
    aggregations and two equi-joins, so a node with very many neighbours is pre-aggregated and its join can be
    split; no neighbour list is gathered. Each round ends in a written table, and the last as soon as all components
    are stars. The rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e = materialise(e, "edges")
    while not _stars(e):
        # Large star: every larger neighbour of u links to the smallest of u and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, "edges")
        drop_written(e)
        e = new
    done = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    done._written_at = e._written_at
    return done


def may_link(x: str, y: str, percent: int) -> Column:
    """False only if two sets are less similar than ``percent``, by their sizes ``n`` and parity maps ``map`` behind the prefixes.

    Bit ``h`` of a map is the parity of the set's elements that hash to ``h``. Bits that differ are at most as many as the elements
    that only one set has, and those are at most ``(100 - percent) / (100 + percent)`` of both sizes together.
    """
    differ = sum((F.bit_count(F.get(f"{x}map", F.lit(k)).bitwiseXOR(F.get(f"{y}map", F.lit(k)))) for k in range(1, WORDS)), F.bit_count(F.get(f"{x}map", F.lit(0)).bitwiseXOR(F.get(f"{y}map", F.lit(0)))))
    sizes = F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * percent
    return sizes & (differ * (100 + percent) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (100 - percent))


def buckets(keyed: DataFrame, label: str = "node") -> DataFrame:
    """``key, node, pivot`` (the key's smallest node) of the buckets of ``node, key`` rows that hold two nodes or more, or two
    values of the column ``label``.

    Of keys that hold the same nodes one is kept: it has all their pairs. So a pair that meets in many tables, or a group of
    copies, is one bucket. Members are compared by their number, ends and two 64-bit sums without a list of them.
    """
    keyed = keyed.repartition("key")
    sums = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    held = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("far"), F.count("*").alias("held"), F.min(label).alias("low"), F.max(label).alias("high"), *sums).where("low < high")
    several = held.groupBy("pivot", "far", "held", "s1", "s2").agg(F.min("key").alias("key")).select("key", "pivot")
    # The hash table is of the buckets' side, a row for each, so the many keys of one node need no sort.
    return keyed.select("key", "node").join(several.hint("shuffle_hash"), "key")


def _printed(printed: DataFrame, node: str, prefix: str) -> DataFrame:
    return printed.select(F.col("node").alias(node), F.col("n").alias(f"{prefix}n"), F.col("map").alias(f"{prefix}map"))


def _open(inner: DataFrame, found: DataFrame) -> DataFrame:
    """``key, node, component`` of the members of buckets that hold more than one component, with the bucket's largest component
    ``top``, its members ``all`` and those of the largest, ``most``."""
    labelled = inner.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    members = labelled.groupBy("key", "component").agg(F.count("*").alias("m"))
    sizes = members.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("top"), F.sum("m").alias("all"), F.max("m").alias("most"))
    return labelled.join(sizes.where(F.col("most") < F.col("all")), "key")


def across(rest: DataFrame, printed: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members of a bucket of :func:`_open` that lie in different components and whose parity maps allow a link.

    A bucket's largest component stands on one side only. Where the two sides would need more than WORK comparisons, both are dealt
    into parts, and each two parts are a group of their own, so that no task holds more, whatever a bucket's size.
    """
    keys = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))
    parts = F.ceil(F.sqrt((F.col("all") - F.col("most")) * F.col("all") / WORK)).cast("int")
    placed = rest.withColumn("parts", F.greatest(F.lit(1), parts)).join(printed, "node").join(keys, "node")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = placed.where("component <> top").select("key", part.alias("i"), all_parts.alias("j"), "top", F.col("node").alias("x"), F.col("component").alias("xc"), F.col("n").alias("xn"), F.col("map").alias("xmap"), F.col("keys").alias("xkeys"))
    y = placed.select(F.col("key").alias("ykey"), all_parts.alias("yi"), part.alias("yj"), F.col("node").alias("y"), F.col("component").alias("yc"), F.col("n").alias("yn"), F.col("map").alias("ymap"), F.col("keys").alias("ykeys"))
    same = (F.col("key") == F.col("ykey")) & (F.col("i") == F.col("yi")) & (F.col("j") == F.col("yj"))
    apart = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("top")) | (F.col("xc") < F.col("yc")))
    # Of the buckets that two members share, the one of the least key gives the pair.
    once = F.col("key") == F.array_min(F.array_intersect("xkeys", "ykeys"))
    both = x.join(y, same & apart & may_link("x", "y", percent) & once)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def allowed(pairs: DataFrame, printed: DataFrame, percent: int) -> DataFrame:
    """Those of ``a, b`` whose sizes and parity maps allow a link."""
    return pairs.join(_printed(printed, "a", "x"), "a").join(_printed(printed, "b", "y"), "b").where(may_link("x", "y", percent)).select("a", "b")


def bucket_components(shared: DataFrame, printed: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, found: DataFrame | None = None) -> DataFrame:
    """``node, component`` of all links between members of one bucket: ``shared`` holds ``key, node, pivot`` (the key's smallest node),
    ``printed`` each node's size ``n`` and parity ``map``, and ``verify`` keeps the linked of ``a, b`` pairs. ``found``: components of
    links that are known, written; they are part of the result.

    Every member meets its bucket's pivot, then, where more than FEW comparisons are left, in further rounds PIVOTS others, from the
    bucket's largest component, as long as that finds links: what is in one component by then needs no comparison. Members of many and large buckets, which most others
    are like, are the likelier pivots. What stays in several components is compared across them in full, so no link is lost and
    no group of copies is expanded into all its pairs: pairs whose maps forbid a link are never written.
    """
    inner = shared.where("node <> pivot")

    def linked(pairs: DataFrame, found: DataFrame | None) -> tuple[DataFrame, int]:
        pairs = materialise(pairs, "pairs")
        links = materialise(verify(pairs), "links")
        drop_written(pairs)
        many = links.count()
        if found is not None and not many:
            drop_written(links)
            return found, 0
        # Components found so far are as good as the links that gave them.
        edges = links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        new = connected_components(edges)
        for x in (links, found):
            drop_written(x)
        release(printed.sparkSession)
        return new, many

    found, _ = linked(allowed(inner.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), printed, percent), found)
    inner, weights = inner.select("key", "node"), None
    rest = materialise(_open(inner, found), "open")
    for turn in range(ROUNDS):
        left, work = rest.agg(F.count("*"), F.sum(F.col("all") - F.col("most"))).first()
        if not left or work <= FEW:
            break
        if weights is None:
            many_held = shared.groupBy("key").agg(F.count("*").alias("held"))
            weights = materialise(shared.select("key", "node").join(many_held, "key").groupBy("node").agg(F.sum("held").alias("weight")), "weights")
        chosen = [F.max_by("node", F.col("weight") * F.pmod(F.xxhash64("node", F.lit(turn * PIVOTS + k)), F.lit(1000))) for k in range(PIVOTS)]
        of = rest.join(weights, "node").groupBy("key", "component").agg(F.count("*").alias("m"), F.array_distinct(F.array(*chosen)).alias("ps"))
        best = of.groupBy("key").agg(F.max_by(F.struct("ps", "component"), F.struct("m", "component")).alias("best"))
        met = rest.join(best, "key").where("component <> best.component").select("node", F.explode("best.ps").alias("p")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
        found, many = linked(allowed(met.distinct(), printed, percent), found)
        if many:
            before, rest = rest, materialise(_open(rest.select("key", "node"), found), "open")
            drop_written(before)
        if many * SLOW <= left:
            break
    if left:
        found, _ = linked(across(rest, printed, percent), found)
    for x in (rest, weights):
        drop_written(x)
    return found
