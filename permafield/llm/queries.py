"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permafield.llm import ann, audit, bpe, common, linededup, neardup, packing, phrases, pieces, quality, secrets, store, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules of the URL filter as (verdict, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word of all documents, with its component and whether it is kept."""
    lines = linededup.judge_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "component_id", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    common.small_batches(spark)
    return quality.judge(_table(spark, sf_dir, "documents")).drop("key")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    judged = urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", "purity")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by their 2-word shingles."""
    common.small_batches(spark, 400)
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    common.small_batches(spark)
    return secrets.find(_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    common.small_batches(spark)
    return packing.pack(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), 2048, 1)


def op8_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to a content-addressed store and read them back."""
    common.small_batches(spark)
    path = common.new_path(spark, "ids")
    store.write(_table(spark, sf_dir, "documents"), path, _path("word_bpe_49k.json"), 2)
    return store.read(spark, path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record for each page, and read the archives back."""
    common.small_batches(spark)
    warc.register(spark)
    path = common.new_path(spark, "warc")
    warc.page_records(_table(spark, sf_dir, "pages"), 0).write.format("warc").mode("append").save(path)
    kept = spark.read.format("warc").load(path).where(F.col("warc_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    number = lambda c: F.when(F.col(c).isNotNull() & (page(c) != ""), page(c).cast("long"))
    return warc.verified(kept).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the byte-level ranks."""
    import public_tokenizers

    common.small_batches(spark)
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the piece model."""
    common.small_batches(spark)
    return pieces.round_trip_digests(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language of all documents."""
    common.small_batches(spark)
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=30, top=2000)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each source's documents, in all 120 orders."""
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_neardup": op4_neardup,
    "op5_secrets": op5_secrets,
    "op6_nearest": op6_nearest,
    "op7_packing": op7_packing,
    "op8_store": op8_store,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_pieces": op11_pieces,
    "op12_phrases": op12_phrases,
    "op13_audit": op13_audit,
}

#: What can be written in SQL as it is; the other operators' tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_neardup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
cc(id, comp) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT k.id, min(c.comp) FROM cc c JOIN e ON e.a = c.id JOIN recurring.cc k ON k.id = e.b WHERE c.comp < k.comp GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, comp AS component_id, d.doc_id = comp AS kept FROM documents d JOIN cc ON cc.id = d.doc_id LEFT JOIN n USING (doc_id)""",
    # By the definition: all phrases of one to four words counted, every cut of every candidate, every longer candidate.
    "op12_phrases": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]') AS ps FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
f AS MATERIALIZED (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS n FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, sum(n) AS total FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k, n AS a FROM f WHERE k >= 2 AND n >= 30),
g AS MATERIALIZED (SELECT lang, phrase, n FROM f WHERE n >= 30),
h AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS j FROM c),
i AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM h),
u AS (SELECT i.lang, i.phrase, a, j, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.n + y.n) AS BIGINT) AS score FROM i JOIN g x ON x.lang = i.lang AND x.phrase = lp JOIN g y ON y.lang = i.lang AND y.phrase = rp),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
v AS (SELECT lang, a, unnest(CASE WHEN k = 4 THEN [ws[1:2], ws[2:3], ws[3:4], ws[1:3], ws[2:4]] ELSE [ws[1:2], ws[2:3]] END) AS ws FROM c WHERE k > 2),
o AS (SELECT lang, array_to_string(ws, ' ') AS phrase, max(a) AS over FROM v GROUP BY 1, 2),
k AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE over IS NULL OR 100 * over < 80 * a)
SELECT lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, score FROM k JOIN t USING (lang) WHERE rank <= 2000""",
    # By the definition: each document's failures, and for each order and step those that no filter before has removed.
    "op13_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS s FROM w),
m AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY 1),
c AS (SELECT part, MAP {'A': s.A, 'B': s.B, 'C': s.C, 'D': s.D, 'E': s.E} AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN m USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS filter, o[1:step - 1] AS earlier, o[1:step - 1] || o[step + 1:5] AS others FROM p),
r AS (SELECT part, filter_order, step, filter, fails[filter] AS now, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone, len(list_filter(others, lambda x: fails[x])) > 0 AS more, n, good, bad FROM t, c),
g AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT now AND NOT gone) AS kept, sum(n) FILTER (now AND NOT gone) AS removed, sum(n) FILTER (now AND gone) AS redundant,
  sum(n) FILTER (now AND NOT more) AS unique_fails, sum(good) FILTER (now AND NOT gone) AS good_lost, sum(bad) FILTER (now AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM g""",
}
