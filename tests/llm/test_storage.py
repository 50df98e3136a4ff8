"""Packing, stores, archives, tokens, urls and neighbours: exact round trips and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.llm import ann, bpe, common, packing, store, urls, warc, wordbpe
from permafield.llm.queries import URL_RULES, op9_warc
from permafield.llm.wordbpe import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def whole_ids(text, end):
    enc = WordEncoder(WORDS)
    return [*enc.whole(text or ""), end]


def test_word_encoder_equals_the_library():
    enc, rng = WordEncoder(WORDS), random.Random(2)
    letters = "aAbBßΣςİıéÉ\u0301 \n\t\r'sT12½<|>#你.,.,’\x1c\x85"
    for _ in range(4000):
        s = rng.choice(["", "", "<|endoftext|>"]) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == enc.whole(s)


def test_words_with_the_mark_go_to_the_library_alone():
    enc, rng = WordEncoder(WORDS), random.Random(3)
    texts = ["".join(rng.choice("ab'stlAÉß.,  \n\x01\x02\u0301Σ中é<|\t12!#\x85\xa0") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in [*texts, "\x01", "a\x01b \x01", "x \x01 y", "q.\x01 \x01. z,\x01 "]:
        assert enc.encode(t) == np.asarray(enc.whole(t), "<u4").tobytes()


def test_remembered_words_are_short_and_bounded_in_bytes(monkeypatch):
    enc, rng = WordEncoder(WORDS), random.Random(11)
    blobs = ["".join(rng.choice("abcdef0123456789") for _ in range(200_000)) for _ in range(6)]
    for blob in [*blobs, *blobs]:
        text = f"a few words {blob} and more {blob[:70]}"
        assert enc.encode(text) == np.asarray(enc.whole(text), "<u4").tobytes()
    assert sum(len(w) + len(g) for d in (*enc.often, *enc.once) for w, g in d.items()) < 10_000
    monkeypatch.setattr(wordbpe, "OFTEN", 20_000)
    monkeypatch.setattr(wordbpe, "ONCE", 10_000)
    for _ in range(60):
        text = " ".join("".join(rng.choice("etaoinß") for _ in range(rng.randint(1, 5))) for _ in range(100))
        assert enc.encode(text) == np.asarray(enc.whole(text), "<u4").tobytes()
        assert max(sum(200 + 2 * len(w) + len(g) for w, g in d.items()) for d in (*enc.often, *enc.once)) < 60_000


def test_packing_is_whole_and_tight(docs, empty):
    got = packing.pack(docs, WORDS, 256, 1, with_ids=True).collect()
    want = sorted(zlib.crc32(np.asarray(whole_ids(r["text"], 1), "<u4").tobytes()) for r in docs.collect())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    unique = docs.dropDuplicates(["doc_id"])
    for r in packing.pack(unique, WORDS, 256, 1, with_ids=True).collect():
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
    for r in unique.collect():
        ids = [x for _, p, _ in sorted(pieces[r["doc_id"]]) for x in p]
        assert ids == whole_ids(r["text"], 1) and all(n == len(ids) for _, _, n in pieces[r["doc_id"]])
    assert len(want) == docs.count() and packing.pack(empty, WORDS).count() == 0


def test_best_fit_takes_the_tightest_window():
    windows = packing.best_fit([7, 6, 3, 2], 10)
    assert sorted(sorted(n for _, _, n in w) for w in windows) == [[2, 6], [3, 7]]
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(0, 30))]
        whole = packing.best_fit(lengths, 16)  # only what is longer than a window is cut, and then into full ones
        assert Counter(n for w in whole for _, _, n in w) == Counter(k for n in lengths for k in [16] * (n // 16) + [n % 16] * (n % 16 > 0))
        found = packing.best_fit(lengths, 16, fill_gaps=True)
        assert sorted((i, s + k) for w in found for i, s, n in w for k in range(n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
        assert sum(sum(n for _, _, n in w) < 16 for w in found) <= 1


def test_equal_documents_are_dealt_out(spark):
    rows = [(k, "the same text in a third of all documents" if k % 3 == 0 else f"text {k} of its own") for k in range(3000)]
    path = common.new_path(spark, "test")
    store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path, WORDS, 2)
    held = sorted(r["n"] for r in spark.read.parquet(f"{path}/recipes").groupBy("part").agg(F.count("*").alias("n")).collect())
    assert held[-1] < 3 * held[len(held) // 2]
    got = {r["doc_id"]: r["ids_crc32"] for r in store.read(spark, path).collect()}
    enc = WordEncoder(WORDS)
    assert got == {k: zlib.crc32(np.asarray([*enc.whole(t), 2], "<u4").tobytes()) for k, t in rows}


def test_store_round_trip(spark, docs, empty):
    path = common.new_path(spark, "test")
    manifest = store.write(docs, path, WORDS, 2)
    got = sorted(store.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    rows = sorted(((r["doc_id"], whole_ids(r["text"], 2)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r["doc_id"], r["n_tokens"], r["ids"], r["ids_crc32"]) for r in got] == [(i, len(x), x, zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in rows]
    assert [r["start"] for r in got] == np.cumsum([0, *(len(x) for _, x in rows)])[:-1].tolist()
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == index.select("digest").distinct().count()  # each chunk is stored once
    assert manifest["documents"] == len(rows) and manifest["ids"] == sum(len(x) for _, x in rows)
    nothing = common.new_path(spark, "test")
    store.write(empty, nothing, WORDS, 2)
    assert store.read(spark, nothing).count() == 0


def test_store_notices_damage(spark, docs):
    path = common.new_path(spark, "test")
    store.write(docs, path, WORDS, 2)
    import glob

    name = max(glob.glob(path.removeprefix("file://") + "/packs/*.ids"), key=lambda p: len(open(p, "rb").read()))
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 1
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception, match="differs"):
        store.read(spark, path).count()


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 60_000).astype("<u4")
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *store.cuts(x)], store.cuts(x))}
    moved = np.concatenate([ids[:1000], rng.integers(0, 49000, 7).astype("<u4"), ids[1000:]])
    assert len(chunks(ids) - chunks(moved)) <= 3 and store.cuts(ids)[-1] == len(ids)
    assert max(np.diff([0, *store.cuts(np.zeros(20_000, "<u4"))])) <= store.MOST


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>équal</p>"
    rows = [(5, "http://a/1", same), (3, "http://a/2\r\nX: y", same), (9, None, same), (4, "http://b", None), (6, "http://b", ""), (7, "u", "z" * 300_000), (8, "v", "HTTP/1.1\r\n\r\nx"), (None, "w", "unique null id"), (11, "w", "a\r\n\r\nWARC/1.1\r\nb"), (12, "d", "twice"), (12, "d", "twice")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, pages, compression):
    warc.register(spark)
    path = common.new_path(spark, "warc")
    warc.page_records(pages).write.format("warc").mode("append").option("compression", compression).save(path)
    back = spark.read.format("warc").load(path)
    rows = {r["record_id"]: r for r in back.collect()}
    for r in pages.collect():
        data = (r["html"] or "").encode()
        got = rows[f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>"]
        assert (got["payload_length"], got["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert got["payload"] == (None if got["warc_type"] == "revisit" else data)
    assert {k: r["refers_to"] for k, r in rows.items() if r["warc_type"] == "revisit"} == {"<urn:page:5>": "<urn:page:3>", "<urn:page:9>": "<urn:page:3>", "<urn:page:6>": "<urn:page:4>"}
    assert back.where(F.col("warc_type") == "revisit").count() == 3
    assert back.where((F.col("warc_type") == "response") & F.col("record_id").isin("<urn:page:7>", "<urn:page:5>")).count() == 1
    plan = back.where(F.col("warc_type") == "revisit")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter warc_type" not in plan and "Filter isnotnull" not in plan  # the source applies it itself
    bare = spark.read.format("warc").option("payloads", "false").load(path).collect()
    assert len(bare) == len(pages.collect()) and all(r["payload"] is None for r in bare)


def test_warc_of_small_payloads_only(spark, pages, tmp_path):
    kinds = {r["record_id"]: r["warc_type"] for r in warc.page_records(pages, least=5).collect()}
    assert kinds["<urn:page:6>"] == "response" and kinds["<urn:page:5>"] == "revisit"
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in op9_warc(spark, str(tmp_path)).collect()}
    assert got[5]["refers_to"] == 3 and got[3]["record_type"] == "response" and None in got and got[4]["payload_bytes"] == 0
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op9_warc(spark, f"{tmp_path}/none").count() == 0


def test_broken_archive_raises(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(warc.record("<r>", "response", "u", "d", b"payload", None)[:-9])
    warc.register(spark)
    with pytest.raises(Exception, match="breaks off"):
        spark.read.format("warc").load(f"file://{tmp_path}/x.warc").collect()


def test_bpe_equals_whole_texts(docs, empty):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got.collect():
        assert r["ids"] == enc.encode_ordinary(texts[r["id"]])
    for r in bpe.decode_ids(got, RANKS, public_tokenizers.PATTERN).collect():
        assert bytes(r["bytes"]) == texts[r["id"]].encode()
    for r in bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect():
        ids = np.asarray(enc.encode_ordinary(texts[r["id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["id"]].encode()).hexdigest())
    assert bpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_runs_of_white_space():
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0abcXY1's.é你😀") for _ in range(rng.randint(1, 40)))
        assert enc.encode_ordinary(t) == bpe.by_match(enc, t).tolist()
    for t in (" " * 1_200_000, "a" + " " * 400_000 + "b", "x.\n" + "\n \t" * 100_000 + "y"):
        assert enc.decode_bytes(bpe.encode(enc, t).tolist()).decode() == t


def test_safe_cuts():
    enc, rng = bpe.encoding(RANKS, public_tokenizers.PATTERN), random.Random(6)
    for _ in range(3000):
        s = "".join(rng.choice("aB é\u0301 \n\t 'st12½#你.😀\x1c\x85\u3000") for _ in range(rng.randint(0, 60)))
        assert [x for p in bpe.safe_parts(s, 7) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(s)


def test_urls(spark):
    rows = [(1, "https://Www.X.ORG/a?b"), (2, "http://example.org/es/1"), (3, "http://m.example.org/en/12#q"), (4, "http://example.org/en/2"), (5, "http://a.com/de/5"), (6, "http://a.com/fr/5"), (7, "http://xexample.org/es/"), (8, None), (9, "nothing"), (10, "http://x.org"), (11, "http://b.net?x=/1"), (12, "ftp://b.net:80#/"), (13, "x://y://z/q")]
    rows += [(100 + k, f"http://a.com/en/{k}") for k in range(30)] + [(1, "https://Www.X.ORG/a?b")]
    got = {r["id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    rule = {i: (got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 14)}
    assert rule == {
        1: ("www.x.org", "/a", "org/"), 2: ("example.org", "/es/1", "example.org/es/"), 3: ("m.example.org", "/en/12", "example.org/en/1"), 4: ("example.org", "/en/2", "org/"),
        5: ("a.com", "/de/5", "com/de/"), 6: ("a.com", "/fr/5", "com/fr/"), 7: ("xexample.org", "/es/", "org/"), 8: ("", "", None), 9: ("", "", None), 10: ("x.org", "", None),
        11: ("b.net", "", None), 12: ("b.net:80", "", None), 13: ("y:", "//z/q", None),
    }
    assert got[3]["verdict"] == "block" and got[4]["verdict"] == "allow" and len(got) == 43
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_url_templates_follow_their_labels(spark):
    rng, rows = random.Random(8), []
    for k in range(300):
        kind = rng.choice(["spam", "blog", "shop"])
        label = {"spam": "block", "blog": "allow", "shop": None}[kind]
        rows.append((k, f"http://h.net/{kind}/{rng.randint(1, 10**6)}/{''.join(rng.choice('abcdef') for _ in range(9))}.html", label if rng.random() < 0.5 else None, kind))
    df = spark.createDataFrame(rows, "page_id long, url string, lab string, kind string")
    got = {r["id"]: r for r in urls.judge(df, [], label=F.col("lab")).collect()}
    for k, _, _, kind in rows:
        assert got[k]["template"] == f"/{kind}/{{n}}/*.html"
        assert kind == "shop" or got[k]["verdict"] == {"spam": "block", "blog": "allow"}[kind]


def test_small_sections_keep_their_labels(spark):
    # 40 sections of one host, each a fortieth of its urls; one is blocked as far as it is labelled.
    rows = [(100 * k + j, f"http://h.net/sec{chr(97 + k % 26)}{chr(97 + k // 26)}/p{j}x") for k in range(40) for j in range(30)]
    rows += [(10_000 + k, f"http://unlabelled.net/s{k}x") for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    given = F.when(F.regexp_extract("url", "/p([0-9])x", 1) != "", F.when(F.col("url").contains("/secha/"), "block").otherwise("allow"))
    got = {r["id"]: r["verdict"] for r in urls.judge(df, [], label=given).collect()}
    assert len(got) == len(rows)
    assert {i for i, v in got.items() if v == "block"} == {100 * 7 + j for j in range(30)}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[100:200] = x[100]  # a group of equal vectors
    rows = [(k, v.tolist(), "z") for k, v in enumerate(x)]
    rows += [(5000, None, "z"), (5001, [0.0] * 24, "z"), (5002, [float("nan")] * 24, "z"), (5003, [None] * 24, "z"), (None, x[0].tolist(), "z"), (5004, [float("inf")] * 24, "z"), (7, x[7].tolist(), "z"), (6000, [1.0, 2.0], "z"), (6001, [2.0, 1.0], "z"), (6002, [], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(1))
    hits = 0
    for q in range(0, 1500, 50):
        score = (y * y[q]).sum(1) / (norm * norm[q])
        want = sorted((-s, k) for k, s in enumerate(score) if k != q)[:5]
        hits += len({k for _, k in want} & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in got[q]) and got[q] == sorted(got[q], key=lambda t: (-t[2], t[1]))
    assert hits >= 0.9 * 150
    assert [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]  # ties: the smallest ids
    assert [v for _, v, _ in got[6000]] == [6001] and 5001 not in got and not {5000, 5001, 5002, 5003, 5004} & {v for g in got.values() for _, v, _ in g}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(300)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    from tests.llm.test_text import components

    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_sections_part_at_any_depth(spark, empty):
    """Sections that part below the fourth level are judged apart; one path far deeper than all others costs no levels."""
    from pyspark.sql import functions as F

    rows = [(k, f"http://h.org/a/b/c/d/{'good' if k % 2 else 'bad'}/x{k}") for k in range(400)]
    rows += [(400, "http://h.org/" + "/".join(f"s{k}" for k in range(3000))), (401, "http://h.org/a/b/c/d/good/7/8.html"), (402, None), (403, "http://h.org")]
    table = spark.createDataFrame(rows, "page_id long, url string")
    label = F.when((F.col("page_id") < 400) & (F.floor(F.col("page_id") / 2) % 2 == 0), F.when(F.col("page_id") % 2 == 1, "allow").otherwise("block"))
    got = {r["id"]: r for r in urls.judge(table, [], label=label).collect()}
    assert all(got[k]["verdict"] == ("allow" if k % 2 else "block") for k in range(400)) and len(got) == 404
    assert got[400]["template"].count("/") == 3000 and got[401]["template"] == "/a/b/c/d/good/{n}/{n}.html"
    cut = {r["id"]: r["template"] for r in urls.judge(table, [], label=label, depth=4).collect()}
    assert cut[0] == "/a/b/c/d/**" and cut[403] == ""
    assert urls.judge(empty.select("doc_id", F.col("text").alias("url")), [], "doc_id").count() == 0


def test_templates_are_those_of_a_tree_grown_by_hand(spark):
    """Random trees against the rules of ``templates``, node by node."""
    import re

    number = re.compile(r"^[0-9]+(\.[A-Za-z0-9]+)?$")

    def shape(x):
        tail = re.search(r"\.([A-Za-z]{2,5})$", x)
        return ("{n}" if number.match(x) else "*") + ("." + tail[1].lower() if tail else "")

    def grow(rows, at, out, template, few=3, share=0.2, least=3, z=1.96):
        groups = defaultdict(list)
        for r in rows:
            if len(r[0]) > at:
                groups[r[0][at]].append(r)
            else:
                out[r[0]] = template
        total = [sum(r[i] for g in groups.values() for r in g) for i in (1, 2, 3)]
        literal = [c for c in groups if not number.match(c)]
        nodes = defaultdict(list)
        for c, g in groups.items():
            n, bad, good = (sum(r[i] for r in g) for i in (1, 2, 3))
            stays = c in literal and (len(literal) <= few or n >= share * total[0])
            if c in literal and not stays and bad + good >= least:
                p = total[1] / (total[1] + total[2])
                stays = abs(bad / (bad + good) - p) > z * (p * (1 - p) / (bad + good)) ** 0.5 and (0 < bad >= share * total[1] or 0 < good >= share * total[2])
            nodes[f"{template}/{c if stays else shape(c)}"] += g
        for t, g in nodes.items():
            grow(g, at + 1, out, t, few, share, least, z)

    rng = random.Random(12)
    for _ in range(3):
        paths = {tuple(rng.choice(["a", "b", "c", "d", "e", "f", "12", "7.html", "x.html", "q"]) for _ in range(rng.randint(0, 6))) for _ in range(150)}
        rows = [(p, rng.randint(1, 9), rng.choice([0, 0, 2, 5]), rng.choice([0, 0, 3])) for p in sorted(paths)]
        want: dict = {}
        grow(rows, 0, want, "")
        frame = spark.createDataFrame([("h", "/" + "/".join(p), n, b, g) for p, n, b, g in rows], "host string, path string, n long, bad long, good long")
        got = {r["path"]: r["template"] for r in urls.templates(frame, few=3, share=0.2, least=3).collect()}
        assert got == {"/" + "/".join(p): t for p, t in want.items()}
