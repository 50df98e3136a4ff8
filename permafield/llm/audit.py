"""Filter interaction audit: what each filter of a set removes in every order, from one SQL CUBE over failure flags and part."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permafield.llm import common

#: Limits of the filters A (least words), B (least percent of distinct words) and C (most percent of capitals).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


def text_failures(text: str, words: str) -> dict[str, Column]:
    """Failure of a text by itself, from the columns of its text and its words: A few words, B few distinct ones, C capitals, D a symbol."""
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * LEAST_DISTINCT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, A, B, C, D, E, n, good, toxic``: documents counted by part and by the filters that they fail.

    E fails where a smaller id has the same text (by its SHA-256), in any part. Rows of one id, then rows of one text, part and label become
    one row with a count before anything is brought together by text, so a text that a third of all rows hold is no more rows than it has
    parts and labels. Rows without an id are dealt out by a hash, have no label, and neither fail E nor make others fail it.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *(F.bool_or(F.coalesce(F.col(c) == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "bad")))
    )
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text", "part"), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), salt.alias("salt"), *(c.alias(k) for k, c in text_failures("text", "words").items()))
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    kind = ["sha", "part", "A", "B", "C", "D", "good", "bad"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    by_id = rows.groupBy("doc_id", "salt", *kind).agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    # As many rows of one text as it has parts and labels.
    least = by_kind.groupBy("sha").agg(F.min("first.doc_id").alias("least"))
    copies = F.col("with_id") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = by_kind.join(least, "sha").withColumn("copies", F.coalesce(copies, F.lit(0).cast("long")))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.lit(True).alias("E"), F.col("copies").alias("n"))))
    flat = both.select("part", "A", "B", "C", "D", "good", "bad", split.alias("s")).where("s.n > 0")
    n = F.col("s.n")
    return flat.groupBy("part", "A", "B", "C", "D", F.col("s.E").alias("E")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), n).otherwise(0)).alias("toxic")
    )


def subset_survivors(counts: DataFrame, filters: str) -> DataFrame:
    """``part, mask, n, good, toxic``: what is left of each part by each set of filters (a bit for each) that leaves anything.

    One CUBE over the flags and part: a grouping set names a subset of filters, and its row with all of these flags false counts the
    documents that pass them. ``counts`` holds a row for each part and combination of flags, so the cube's input does not grow with rows.
    """
    cube = counts.cube(*filters, "part").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.grouping("part").alias("every"), *(F.grouping(f).alias(f"no_{f}") for f in filters)
    )
    passed = cube.where("every = 0 and " + " and ".join(f"(no_{f} = 1 or not {f})" for f in filters))
    mask = sum(((1 - F.col(f"no_{f}")).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    return passed.select("part", mask.alias("mask"), "n", "good", "toxic")


def orders(counts: DataFrame, filters: str) -> DataFrame:
    """For each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` (see :func:`audit`), from ``part``, a boolean for each filter, and the counts ``n, good, toxic``.

    A step takes one set of filters to the next; each such pair of sets is joined once for a part, and the steps of all orders read it.
    """
    spark, k = counts.sparkSession, len(filters)
    every = (1 << k) - 1
    left = common.materialise(subset_survivors(counts, filters), "survivors")
    pairs = [(b, b | 1 << f, filters[f]) for b in range(every + 1) for f in range(k) if not b >> f & 1]
    literal = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(f).alias("filter")) for b, a, f in pairs))
    grid = left.where("mask = 0").select("part", F.explode(literal).alias("p")).select("part", "p.*")
    of = lambda at, x: left.select("part", F.col("mask").alias(at), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "good", "toxic")))
    both = grid.join(of("before", "in"), ["part", "before"], "left").join(of("after", "out"), ["part", "after"], "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    lost = {c: (count(f"{c}_in") - count(f"{c}_out")) for c in ("n", "good", "toxic")}
    done = both.select("part", "before", "after", "filter", count("n_out").alias("kept"), *(v.alias(f"{c}_lost") for c, v in lost.items()))
    # Orders in which a filter comes right after the set "before": of both sides, in any order.
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), F.bit_count("before").cast("int") + 1)
    sums = done.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("n_lost"))).alias("fails"),
        F.max(F.when(F.col("after") == every, F.col("n_lost"))).alias("unique_fails"),
        F.sum(F.col("n_lost") * weight).alias("shapley"),
    )
    steps = [("".join(o), i + 1, f, sum(1 << filters.index(x) for x in o[:i])) for o in permutations(filters) for i, f in enumerate(o)]
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int"))  # fixed: k! * k rows
    return (
        done.join(sums, ["part", "filter"])
        .join(table, ["filter", "before"])
        .select("part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E on whole texts, in all 120 orders: a row for each part (value of ``source``), ``filter_order`` and ``step``.

    ``kept`` and ``removed`` count the part's documents after and at the step; ``redundant`` those that fail the step's filter and were removed
    before; ``unique_fails`` those that fail it alone; ``good_lost`` and ``toxic_lost`` the removed with the label; ``shapley`` the filter's removals
    summed over all orders. ``docs`` holds ``doc_id, text, source`` and ``labels`` holds ``doc_id, quality, toxic``; other columns are not read, so their
    names cannot clash. A null text is empty, a null source is the part of the empty string, null labels are none, several labels of one id
    count if any does. Repeated rows count each, and fail E only for a smaller id. Rows without an id are neither copies nor originals. Texts
    are of any length. An empty table gives no rows.
    """
    return orders(failures(docs, labels), "ABCDE")
