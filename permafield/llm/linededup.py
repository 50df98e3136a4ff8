"""Fuzzy line de-duplication with DataFrame functions only: MinHash of character shingles, banding, verification, union-find."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permafield.llm.common import WORDS, bucket_components, buckets, drop_written, free_name, materialise, release

#: Characters in a shingle; sub-keys of a line and minima in each. Every two sub-keys key a table, so 12 minima give 15 tables of four.
#: Two lines with a similarity of 0.8 share a table with a probability of 0.975, of 0.9 with 0.999; unlike lines of one language
#: (0.03) with 1e-5.
SHINGLE, SUBKEYS, ROWS = 8, 6, 2
#: Shingles that one generated row holds where minima are taken, and where sets are gathered.
STEP, CHUNK = 4, 16
#: Lines whose hashes are sent to every task (8 bytes each) to pick their texts; of more, the texts are shuffled.
SENT = 5_000_000
#: What a line is trimmed by: the white space that separates words, but for the line feed.
SPACES = " \t\r\x0b\x0c"


def _masks() -> list[int]:
    """Masks that order the shingles' hashes; their first bits are as far apart as they can be, the rest is random by rule."""
    masks = []
    for k in range(SUBKEYS * ROWS):
        first = int(f"{k:05b}"[::-1], 2) << 59
        rest = (k + 1) * 0x9E3779B97F4A7C15 & ((1 << 59) - 1)
        masks.append((first | rest) - (1 << 63))
    return masks


MASKS = _masks()


def lines_of(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """``doc_id, row, line_no, norm, line``: every line with a word; ``norm`` is it without outer white space, ``line`` its 64-bit hash."""
    lines = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
    norm = F.btrim("raw", F.lit(SPACES))
    return lines.select("doc_id", "row", "line_no", norm.alias("norm")).where("norm <> ''").withColumn("line", F.xxhash64("norm"))


def _units(lines: DataFrame, keys: list[str], step: int) -> DataFrame:
    """``keys``, the line's UTF-16 ``units``, the byte ``last`` where its last shingle begins, and ``at``, every ``step`` shingles."""
    unit = lines.select(*keys, F.encode("norm", "UTF-16BE").alias("units")).select(*keys, "units", F.greatest(F.lit(1), F.length("units") - (2 * SHINGLE - 1)).alias("last"))
    return unit.select(*keys, "units", "last", F.expr(f"explode(sequence(1, last, {2 * step}))").alias("at"))


def minima(lines: DataFrame) -> DataFrame:
    """``line, m0 ...``: for each mask the least of all the shingles' hashes under it. Aggregated in the scan's own tasks first."""
    # The last row's shingles beyond the end are the last one again, which changes no minimum.
    cut = [F.xxhash64(F.expr(f"substring(units, least(at + {2 * j}, last), {2 * SHINGLE})")).alias(f"x{j}") for j in range(STEP)]
    least = lambda mask: F.min(F.least(*[F.col(f"x{j}").bitwiseXOR(F.lit(mask)) for j in range(STEP)]))
    return _units(lines, ["line"], STEP).select("line", *cut).groupBy("line").agg(*[least(m).alias(f"m{k}") for k, m in enumerate(MASKS)])


def _pieces(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, xs``: the hashes of all shingles of every ``norm``, CHUNK to a row (the last again where a row has fewer of its own)."""
    cut = [F.xxhash64(F.expr(f"substring(units, least(at + {2 * j}, last), {2 * SHINGLE})")) for j in range(CHUNK)]
    return _units(lines, keys, CHUNK).select(*keys, F.array(*cut).alias("xs"))


def prints(texts: DataFrame) -> DataFrame:
    """``node, n, map``: size and parity map (see :func:`~permafield.llm.common.may_link`) of each line's set of shingles."""
    sets = _pieces(texts.repartition("line"), ["line"]).groupBy("line").agg(F.flatten(F.collect_list("xs")).alias("all"))
    own = sets.select("line", F.explode(F.array_distinct("all")).alias("x"))
    bit = F.expr("shiftleft(1L, cast(x & 63 as int))")
    # One sum for each word first, so that a shingle meets two sums rather than one for every word of the map.
    by_word = own.select("line", F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"), bit.alias("bit")).groupBy("line", "word").agg(F.count("*").alias("n"), F.bit_xor("bit").alias("bits"))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return by_word.groupBy("line").agg(F.sum("n").alias("n"), *words).select(F.col("line").alias("node"), "n", F.array(*[f"w{k}" for k in range(WORDS)]).alias("map"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b`` those with ``100 * intersection >= percent * union`` of their whole sets of shingles."""
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("line"), F.lit(1).alias("side")), F.struct(F.col("b").alias("line"), F.lit(2).alias("side")))).alias("s"))
    held = sides.select("a", "b", "s.line", "s.side").join(texts, "line").repartition("a", "b")
    of = lambda side: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("side") == side, F.col("xs")))))
    sets = _pieces(held, ["a", "b", "side"]).groupBy("a", "b").agg(of(1).alias("x"), of(2).alias("y"))
    counts = sets.select("a", "b", F.explode(F.array(F.struct(F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n")))).alias("c"))
    return counts.where(F.col("c.i") * 100 >= (F.col("c.n") - F.col("c.i")) * percent).select("a", "b")


def classes(lines: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of distinct lines linked at ``100 * intersection >= percent * union`` of their shingle sets."""
    # A line shorter than a shingle is alone in its tables: no other line has its one shingle.
    mins = minima(lines).select("line", *[F.xxhash64(*[f"m{s + r * SUBKEYS}" for r in range(ROWS)]).alias(f"k{s}") for s in range(SUBKEYS)])
    tables = [(i, j) for i in range(SUBKEYS) for j in range(i + 1, SUBKEYS)]
    keys = F.array(*[F.xxhash64(F.lit(t), f"k{i}", f"k{j}") for t, (i, j) in enumerate(tables)])
    shared = materialise(buckets(mins.select(F.col("line").alias("node"), F.explode(keys).alias("key"))), "shared")
    release(lines.sparkSession)
    need = materialise(shared.select(F.col("node").alias("line")).distinct(), "need")
    if need.count() <= SENT:
        need = F.broadcast(need)
    texts = materialise(lines.select("line", "norm").join(need, "line", "left_semi").groupBy("line").agg(F.first("norm").alias("norm")), "texts")
    printed = materialise(prints(texts), "prints")
    found = bucket_components(shared, printed, lambda pairs: verified(pairs, texts, percent), percent)
    for x in (shared, texts, printed):
        drop_written(x)
    return found


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str, row: Column) -> tuple[DataFrame, DataFrame]:
    """Written lines as ``doc_id, row, line_no, line, component_id``, and the place of the kept line of each component that has several."""
    lines = lines_of(docs, id_col, text_col, row)
    placed = materialise(lines.select("doc_id", "row", "line_no", "line"), "placed")
    found = classes(lines, percent)
    labelled = placed.join(found, placed["line"] == found["node"], "left").select("doc_id", "row", "line_no", "line", F.coalesce("component", "line").alias("component_id"))
    first = labelled.groupBy("component_id").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"))
    return labelled, first.select(F.col("first.row").alias("row"), F.col("first.line_no").alias("line_no"))


def judge_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with a word: ``doc_id, row, line_no, line, component_id, kept``. One line of each component is kept: that of
    the smallest doc_id (null first), then row, then line number.

    ``line`` is the 64-bit hash of the line without outer white space, ``component_id`` the smallest of the component's. Equal
    lines are one node; different lines are linked if the Jaccard similarity of their character shingle sets reaches
    ``percent``. Shingles are SHINGLE characters (UTF-16 code units); a line shorter than one is linked with equal lines only. Lines
    of any length are taken whole. Null and
    empty texts have no lines; repeated rows have lines of their own, of which the first row's are kept. No rows: no lines.
    Other columns are not read, whatever their names.
    """
    labelled, first = _judged(docs, percent, id_col, text_col, F.monotonically_increasing_id())
    # By place, not by component: a component with a third of all lines is as many keys as it has lines.
    return labelled.join(first.withColumn("kept", F.lit(True)), ["row", "line_no"], "left").select("doc_id", "row", "line_no", "line", "component_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def _with_rows(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a column that names each row alike in every later read: its file and place in it, where ``docs`` is read
    from files as it is; otherwise a number, and the numbered rows are written."""
    try:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
    except AnalysisException:
        return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def remove_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", as_read: bool = False) -> DataFrame:
    """The documents without the lines that :func:`judge_lines` does not keep, all columns kept; ``length_col`` is counted anew.

    Documents that had a word and lose all their lines with one are left out; others stay, null and empty texts too. Of repeated
    rows the first keeps its lines. No rows: none. Extra columns may have any names. ``as_read`` says that ``docs`` is the rows of
    files, each once, so that they need not be written again to be told apart.
    """
    names = docs.columns
    row, key, gone_name = free_name("_row", names), free_name("_key", names), free_name("_gone", names)
    own = _with_rows(docs, row) if as_read else materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    labelled, first = _judged(own, percent, id_col, text_col, F.col(row))
    lost = labelled.join(first, ["row", "line_no"], "left_anti").groupBy("row").agg(F.collect_set("line_no").alias(gone_name)).withColumnRenamed("row", key)
    gone = materialise(lost, "gone")
    release(docs.sparkSession)
    joined = own.join(gone.hint("shuffle_hash"), own[row] == gone[key], "left")
    rest = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone_name, i)), "\n")
    text = F.when(F.col(gone_name).isNull(), F.col(text_col)).otherwise(rest)
    done = joined.withColumn(text_col, text).where(F.col(gone_name).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if length_col and length_col in names:
        done = done.withColumn(length_col, F.when(F.col(gone_name).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return done.select(*[f"`{n}`" for n in names])
