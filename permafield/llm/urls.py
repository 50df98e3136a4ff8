"""URL filters with DataFrame functions only: host and path rules, and a path-template tree judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from permafield.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end.

    Null or without ``://``: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest) + 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits (its host and subdomains; the path starts with the rule's), and its verdict; else null."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for _, rule in longest:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits.append(((host == own) | host.endswith("." + own)) & path.startswith(start))
    pick = lambda k: F.coalesce(*[F.when(f, F.lit(r[k])) for f, r in zip(fits, longest)], F.lit(None).cast("string"))
    return pick(1), pick(0)


def _shape(segment: Column) -> Column:
    """The wildcard that stands for a variable segment."""
    number = segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$")
    tail = F.regexp_extract(segment, r"\.([A-Za-z]{2,5})$", 1)
    star = F.when(number, F.lit("{n}")).otherwise(F.lit("*"))
    return F.when(tail != "", F.concat(star, F.lit("."), F.lower(tail))).otherwise(star)


def templates(paths: DataFrame, depth: int | None = None, few: int = 8, share: float = 0.05, least: int = 5, z: float = 1.96) -> DataFrame:
    """``host, path, n, bad, good`` rows with ``template`` added: the tree is grown level by level for every host.

    A child of a node stays literal if it is no number and either the node has at most ``few`` children or the child holds at
    least ``share`` of the node's urls; the others become one wildcard. So that a small section labelled otherwise than its siblings is
    not averaged with them, a child also stays literal if it holds at least ``least`` examples and ``share`` of the node's blocked
    or allowed ones, and its blocked share is more than ``z`` standard errors from the node's. A node has at most ``few + 3 / share``
    literal children. With a ``depth``, segments beyond it become ``**``; without one the tree has as many levels as two paths of a host share,
    as a node of one path takes the rest of it at once (each segment would be the only child of its node).
    """
    unit = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    most = unit.agg(F.max(F.size("segments"))).first()[0] or 0
    held = ("n", "bad", "good")
    examples, p = F.col("c_bad") + F.col("c_good"), F.try_divide("all_bad", F.col("all_bad") + F.col("all_good"))
    apart = (examples >= least) & (F.abs(F.try_divide("c_bad", examples) - p) > z * F.sqrt(F.try_divide(p * (1 - p), examples)))
    held_much = lambda x: (F.col(f"c_{x}") > 0) & (F.col(f"c_{x}") >= share * F.col(f"all_{x}"))
    large = (F.col("k") <= few) | held_much("n") | (apart & (held_much("bad") | held_much("good")))
    number = lambda segment: segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$")
    level, unit = 0, unit.withColumn("deep", F.lit(False) if depth is None else F.size("segments") > depth)
    while level < (most if depth is None else min(depth, most)):
        child = F.get("segments", F.lit(level))
        here = unit.where(child.isNotNull()).withColumn("child", child)
        children = here.where(~number(child)).groupBy("host", "template", "child").agg(*[F.sum(x).alias(f"c_{x}") for x in held])
        nodes = here.groupBy("host", "template").agg(*[F.sum(x).alias(f"all_{x}") for x in held])
        wide = children.groupBy("host", "template").agg(F.count("*").alias("k"))
        literal = children.join(wide, ["host", "template"]).join(nodes, ["host", "template"]).where(large).select("host", "template", "child", F.lit(True).alias("literal"))
        grown = unit.withColumn("child", child).join(literal, ["host", "template", "child"], "left")
        step = F.when(F.col("literal"), F.col("child")).otherwise(_shape(F.col("child")))
        grown = grown.withColumn("template", F.when(F.col("child").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step)))
        level += 1
        if depth is None:
            going = F.size("segments") > level
            alone = grown.where(going).groupBy("host", "template").agg(F.count("*").alias("paths")).where("paths = 1").select("host", "template", F.lit(True).alias("alone"))
            rest = F.transform(F.slice("segments", level + 1, F.greatest(F.lit(1), F.size("segments"))), lambda x: F.when(number(x), _shape(x)).otherwise(x))
            grown = grown.join(alone, ["host", "template"], "left").withColumn("alone", going & F.coalesce("alone", F.lit(False)))
            grown = grown.withColumn("template", F.when(F.col("alone"), F.concat("template", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("template")))
            grown = grown.withColumn("segments", F.when(F.col("alone"), F.array().cast("array<string>")).otherwise(F.col("segments"))).drop("alone")
        unit = materialise(grown.drop("child", "literal"), "templates")
        if depth is None:
            most = unit.agg(F.max(F.size("segments"))).first()[0] or 0
    return unit.withColumn("template", F.when(F.col("deep"), F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("segments", "deep")


def merged(leaves: DataFrame, prior_weight: float, z: float) -> DataFrame:
    """``host, template, n, bad, good`` with ``branch``: siblings of one host and shape whose labelled shares do not differ by more
    than ``z`` standard errors from the one before, in the order of their shares, are one branch. Unlabelled ones stand alone."""
    shape = F.regexp_replace("template", r"[^/*{}.]+(?=/|$)", "?")
    labelled = F.col("bad") + F.col("good")
    p = (F.col("bad") + prior_weight / 2) / (labelled + prior_weight)
    own = leaves.where(labelled > 0).withColumn("shape", shape).withColumn("p", p).withColumn("m", labelled + prior_weight)
    order = Window.partitionBy("host", "shape").orderBy("p", "template")
    gap = F.col("p") - F.lag("p").over(order)
    both = (F.col("p") * F.col("m") + F.lag("p").over(order) * F.lag("m").over(order)) / (F.col("m") + F.lag("m").over(order))
    error = F.sqrt(both * (1 - both) * (1 / F.col("m") + 1 / F.lag("m").over(order)))
    cut = F.when(gap.isNull() | (gap <= z * error), 0).otherwise(1)
    out = own.withColumn("cut", cut).withColumn("branch", F.concat_ws("#", "shape", F.sum("cut").over(order).cast("string"))).drop("cut", "p", "m", "shape")
    alone = leaves.where(labelled == 0).withColumn("branch", F.col("template"))
    return out.unionByName(alone)


def judge(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, prior_weight: float = 4.0, z: float = 1.96, block_at: float = 0.5, depth: int | None = None) -> DataFrame:
    """Judge every url: ``id, host, path, rule, verdict, template, purity``.

    Urls with a rule take its verdict, and are the labelled examples unless ``label`` (a column of 'allow', 'block' or null)
    gives others. The others are judged by their host's path-template tree: a template's purity is its branch's share of
    blocked examples, smoothed towards the host's share, itself smoothed towards the share of all; at ``block_at`` or more it
    is rejected. Without any example all are allowed.

    All counts are over distinct (host, path) pairs with partial sums, so one host with a third of the urls is as many rows as
    it has paths, spread by path; only its literal templates, bounded by ``share`` and ``few`` at a node, meet in one window.
    Null urls: empty host and path, judged by the share of all. Null and repeated ids: a row each. Urls may be of any length, other
    columns are not read, so their names cannot clash, and an empty table gives no rows. ``depth``: see :func:`templates`.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (label if label is not None else F.lit(None).cast("string")).alias("given"))
    rule, ruled = apply_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("ruled", ruled)
    example = F.col("given") if label is not None else F.col("ruled")
    parsed = materialise(parsed.withColumn("example", example).drop("given"), "urls")
    pairs = parsed.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("example") == "block").alias("bad"), F.count_if(F.col("example") == "allow").alias("good"))
    pairs = materialise(templates(materialise(pairs, "paths"), depth), "tree")
    leaves = pairs.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    branches = materialise(merged(leaves, prior_weight, z), "branches")
    total = branches.agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).first()
    bad, good = (total["b"] or 0), (total["g"] or 0)
    overall = F.lit((bad + 0.5) / (bad + good + 1.0) if bad + good else 0.0)
    smooth = lambda b, g, towards: (b + prior_weight * towards) / (b + g + prior_weight)
    hosts = branches.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("good").alias("hg"))
    judged = branches.groupBy("host", "branch").agg(F.sum("bad").alias("bb"), F.sum("good").alias("bg")).join(hosts, "host")
    judged = judged.select("host", "branch", smooth(F.col("bb"), F.col("bg"), smooth(F.col("hb"), F.col("hg"), overall)).alias("purity"))
    by_template = branches.select("host", "template", "branch").join(judged, ["host", "branch"]).select("host", "template", "purity")
    by_path = pairs.select("host", "path", "template").join(by_template, ["host", "template"])
    done = parsed.join(by_path, ["host", "path"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= block_at, "block").otherwise("allow"))
    return done.select("id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


__all__ = ["apply_rules", "host_and_path", "judge", "merged", "templates"]
