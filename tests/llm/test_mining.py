"""Piece encoding, phrase mining and the filter audit against the library and brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.llm import audit, phrases, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- pieces -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_equal_the_library(sp):
    enc, rng = pieces.PieceEncoder(MODEL), random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab ", "aAeEsS   \n\t.,'12", "你好世界梦執ゼあアのé😀ñß́\x00�▁ ", "<s></s><0x0A>", "=-_*#/ \\", "the ing er on re  st"]
    words = list(enc.ids)
    texts = ["", " ", "  a", "a  b ", "▁a", "<s>a</s>", "<0x0A>", "\n\n", "a\0b", *(h + " " * n + t for n in range(1, 90) for h in ("", "b") for t in ("", "a", "the", "\n", "▁x"))]
    for k in range(12_000):
        a = rng.choice(alphabets)
        s = "".join(rng.choice(a) for _ in range(rng.randint(0, 60)))
        s = "".join(rng.choice(words) for _ in range(rng.randint(1, 12))).replace("▁", " " if k % 2 else "▁") if k % 3 == 0 else s
        texts.append("".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(20)) if k % 7 == 0 else s)
    for t in texts:
        assert enc.encode(t) == sp.encode(t), repr(t)


def test_long_texts_and_chunks_without_a_space(sp):
    enc, rng = pieces.PieceEncoder(MODEL), random.Random(6)
    for text in ("the cat sat on the mat, " * 40_000, "".join(rng.choice("abcdefgh") for _ in range(200_000)), " " * 100_000, "你好世界" * 30_000, "a" * 150_000, "\n" * 50_000, "=" * 99_999):
        assert enc.encode(text) == sp.encode(text)


def test_remerging_equals_merging_anew():
    enc, rng = pieces.PieceEncoder(MODEL), random.Random(7)
    known = [p for p in enc.ids if len(p) < 9]
    for _ in range(30_000):
        a, b = rng.choice(known), rng.choice(known)
        if enc.merge(a) == [a] and enc.merge(b) == [b]:
            assert enc.remerged(a, b) == (enc.merge(a + b) == [a, b]), (a, b)


def test_memory_is_bounded(sp, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 200_000)
    monkeypatch.setattr(pieces, "PAIRS", 500)
    enc, rng = pieces.PieceEncoder(MODEL), random.Random(8)
    for _ in range(300):
        t = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.choice([5, 9, 300]))) for _ in range(40))
        assert enc.encode(t) == sp.encode(t)
        assert enc.held <= 200_000 + 5_000 and len(enc.pairs) <= 501 and all(len(c) <= pieces.SHORT for c in enc.known)


def test_other_models_are_refused(tmp_path):
    data = open(MODEL, "rb").read()
    for change in (lambda d: d.replace(b"\x18\x02 \x80", b"\x18\x01 \x80", 1), lambda d: d[: len(d) // 2]):
        changed = change(data)
        assert changed != data
        (tmp_path / "m").write_bytes(changed)
        with pytest.raises(ValueError):
            pieces.PieceEncoder(f"{tmp_path}/m")


def test_pieces_of_a_table(spark, sp, docs, empty):
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    got = Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.round_trip_digests(docs, MODEL).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == Counter((len(i), sha(",".join(map(str, i))), sha(sp.decode(i) or "")) for i in (sp.encode(t) for t in texts))
    encoded = pieces.encode_texts(docs, MODEL)
    assert Counter(tuple(r["ids"]) for r in encoded.collect()) == Counter(tuple(sp.encode(t)) for t in texts)
    assert Counter(r["text"] for r in pieces.decode_ids(encoded, MODEL).collect()) == Counter(sp.decode(sp.encode(t)) or "" for t in texts)
    assert pieces.round_trip_digests(empty, MODEL).count() == pieces.encode_texts(empty, MODEL).count() == 0


# --- phrases ----------------------------------------------------------------------------------------------------------


def mined(rows, least, top, inside=80):
    """All phrases counted, all cuts, all longer candidates."""
    found, out = {}, []
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        count = found.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        count[tuple(w[i : i + k])] += 1
    for lang, f in found.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(100 * b >= inside * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "New", "york", "ci-ty", "é", "\x00"], [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]) for w in words)
        rows.append((text + " new york city. " * rng.randint(0, 2) if rng.random() < 0.9 else None, rng.choice(["en", "de", None, "und"])))
    return rows + [("a b c d e " * 300, "en"), ("x", "fr"), ("the of the of", "en"), ("", "en")]


@pytest.mark.parametrize("shard, block, reach", [(2_000_000, 32_768, 1_000_000), (500, 64, 150), (60, 7, 20)])
def test_phrases_equal_brute_force(spark, shard, block, reach):
    """Whatever the shards, blocks and ranges: prefixes are cut between ranges, and counted whole."""
    rows = corpus(shard)
    data = spark.createDataFrame([(k, t, lang, 7) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase long").repartition(5)
    for least, top in ((5, 40), (12, 2000)):
        got = phrases.collocations(data, least, top, shard=shard, block=block, reach=reach).collect()
        assert sorted(tuple(r) for r in got) == mined(rows, least, top)


def test_blocks_and_ranges(spark):
    """Blocks hold what their headers say, and a small reach gives many ranges, some within one first word."""
    data = spark.createDataFrame([(t, lang) for t, lang in corpus(3)], "text string, lang string").coalesce(1)
    written = phrases.blocks(data, 2000, 50).cache()
    for r in written.collect():
        names, columns, n = phrases.load(bytes(r["trie"]))
        assert len(n) == r["leaves"] <= 50 and phrases.path(names, columns, 0) == r["first"] and phrases.path(names, columns, -1) == r["last"]
    cuts = phrases.ranges(written, 20)
    assert set(cuts) == {"en", "de", "und", "fr"} and all(c == sorted(c) for c in cuts.values()) and len(cuts["en"]) > 20
    assert max(Counter(c[0] for c in cuts["en"]).values()) > 1
    assert phrases.ranges(written) == {lang: [] for lang in cuts}


def test_tries_are_cut_and_merged_exactly():
    from collections import defaultdict
    from itertools import count

    rng = random.Random(9)
    for _ in range(60):
        text = b"".join(rng.choice([b"a", b"B", b"cc", b" ", b" ", b".", b"\t", b"\n", b"d", b"\x00", b"\xc3\xa9"]) for _ in range(rng.randint(1, 400)))
        known = defaultdict(count().__next__)
        known[b"."]
        ids = [np.fromiter(map(known.__getitem__, p), np.uint32, len(p)) for p in phrases.words(text)]
        split = [[w for w in re.split(rb"[ \t]+", p) if w] for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", text.lower())]
        want = Counter(tuple(p[i : i + 4]) for p in split for i in range(len(p)))
        if not want:
            continue
        names, columns, n = phrases.shard_leaves(ids, known)
        paths = [tuple(phrases.path(names, columns, i).split(b" ")) for i in range(len(n))]
        assert dict(zip(paths, n.tolist())) == want and paths == sorted(paths)
        for bits in (6, 20, 33, 40):  # one, two and four keys
            c2, n2 = phrases.reduce_leaves(columns, n.astype(np.int64), bits)
            assert all((x == y).all() for x, y in zip(c2, columns)) and (n2 == n).all()
        again = phrases.load(phrases.dump(names, columns, n))
        assert [tuple(phrases.path(again[0], again[1], i).split(b" ")) for i in range(len(n))] == paths and (again[2] == n).all()
        for _ in range(20):
            at = [rng.choice([b"a", b"b", b"cc", b"d", b"zz", b"\x00", b"0"]) for _ in range(rng.randint(1, 4))]
            assert phrases.place(names, columns, at) == sum(list(p) < at for p in paths)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**12
    got = spark.sql(f"select (2000000bd * cast({big}L as decimal(20, 0))) div cast({big * 3 // 2}L + {big // 2 + 1}L as decimal(20, 0)) s").first()["s"]
    assert got == 2000000 * big // (big * 3 // 2 + big // 2 + 1)


def test_odd_tables_of_phrases(docs, empty):
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs, 10, 100).collect()) == mined(rows, 10, 100)
    assert phrases.collocations(empty).count() == 0


# --- audit ------------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    good, bad = ({i for i, q, t in labels if i is not None and (q if k == 0 else t) == 1} for k in (0, 1))
    first: dict = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    data = {}
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        data.setdefault(source or "", []).append((fails, i in good, i in bad))
    out = []
    for part, own in data.items():
        removed_by = Counter()
        table = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                fails = sum(d[0][f] for d in own)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in own)
                removed_by[f] += len(gone)
                table.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], removed_by[r[-1]]) for r in table]
    return sorted(out)


def test_audit_equals_brute_force(spark, docs, empty):
    rng = random.Random(10)
    long = " ".join(f"w{k}" for k in range(230))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    for k in range(1000, 1060):
        text = rng.choice([long, long + " x", "A" * 50 + long, long + " #", "a b " * 150, "tiny", None, ""])
        rows.append((rng.choice([k, k, 1000, None]), text, rng.choice(["p", "q", None, ""])))
    labels = [(rng.choice([i, i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows for _ in range(rng.randint(0, 2))]
    # Repeated rows of one id, with other sources too.
    rows += [rows[-1], (rows[-1][0], rows[-1][1], "other")]
    table = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "doc_id long, text string, source string, part string, A int, good boolean")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = sorted(tuple(r) for r in audit.audit(table, marks).collect())
    assert got == audited(rows, labels)
    assert audit.audit(empty, marks).count() == 0
    none = audit.audit(table, marks.where("false"))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_very_long_text_in_the_audit(spark):
    rows = [(1, "word " * 400_000, "s"), (2, "word " * 400_000, "s"), (3, "# " + "".join(f"u{k} " for k in range(300_000)), "s")]
    got = {tuple(r)[1:3]: r for r in audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 600 and got["EBDAC", 1]["removed"] == 1 and got["EBDAC", 1]["good_lost"] == 1 and got["EBDAC", 2]["removed"] == 1 and got["EBDAC", 3]["kept"] == 0
