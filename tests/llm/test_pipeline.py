"""The pipeline on a small table against brute force, stage by stage composed."""

import re
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from permafield.llm import common, packing, quality  # noqa: E402
from tests.llm.test_text import WORD, brute_lines, brute_near, brute_spans  # noqa: E402


def brute(rows):
    """(doc_id, text) pairs before the secret stage; ids are distinct and no line is boilerplate in so small a table."""
    rows = [(i, t) for i, t in rows if (m := quality.measures((t or "").encode()))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    lines = brute_lines(rows)
    left = []
    for i, t in rows:
        own = t.split("\n")
        kept = [x for n, x in enumerate(own) if (i, n) not in lines or lines[i, n][1] == (i, n)]
        if len(kept) == len(own) or any(WORD.search(x) for x in kept):
            left.append((i, "\n".join(kept)))
    _, comp = brute_near(left, 5, 80)
    return {i: t for i, t in left if comp[i] == i}


def test_pipeline_matches_brute_force(spark, docs, tmp_path):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    once.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in once.collect()])
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = common.materialise(f(spark, stage, str(tmp_path)), "t")
        assert stage.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == want
    clean = corpus_pipeline.STAGES[3][1](spark, stage, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(texts) == set(want) and not any(brute_spans(t) for t in texts.values())
    unmarked = {i: t for i, t in texts.items() if "[SECRET]" not in t}
    assert all(want[i] == t for i, t in unmarked.items()) and len(unmarked) >= len(want) - 8
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    enc = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in texts.items():
        n = len(np.frombuffer(enc.encode(t), "<u4")) + 1
        at = 0
        for start, length, total in sorted(pieces[i]):
            assert start == at and total == n
            at += length
        assert at == n
    assert set(pieces) == set(texts)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, docs, empty, tmp_path, k):
    name, f = corpus_pipeline.STAGES[k]
    got = f(spark, empty, str(tmp_path))
    assert got.count() == 0
    odd = f(spark, docs, str(tmp_path))
    assert odd.count() >= 0 and (k == 4 or (got.columns == docs.columns and odd.columns == docs.columns))
    if name == "neardup":
        assert odd.where("doc_id = 2").count() <= 1
    assert re.fullmatch(r"\w+", name)
