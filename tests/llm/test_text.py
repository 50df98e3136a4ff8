"""Corpus operators on documents against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.llm import common, linededup, neardup, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_measures_match_their_definitions(docs):
    for r in docs.select("text").distinct().collect():
        t = r["text"] or ""
        words = WORD.findall(t)
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert quality.measures(t.encode()) == want


def test_quality_verdict(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    fresh = lambda n: " ".join(word() for _ in range(n))
    common = [fresh(12) for _ in range(4)]
    rows = []
    for k in range(60):  # boilerplate pages: nothing but shared lines in changing order, and a few words
        rows.append((k, "\n".join([fresh(4), *rng.sample(common, 4), fresh(3)]), "h"))
    for k in range(60, 100):  # clean, one shared line
        rows.append((k, "\n".join([fresh(30), rng.choice(common), fresh(30)]), "h"))
    copy = "\n".join(fresh(12) for _ in range(6))
    rows += [(k, copy, "h") for k in range(100, 160)]  # copies of one clean document
    near = [fresh(12) for _ in range(8)]
    rows += [(k, "\n".join([*near[:-1], fresh(12)]), "h") for k in range(160, 200)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k]["kept"] for k in range(60))
    assert all(got[k]["kept"] for k in range(60, 200))
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(60, 200)) and kept.columns == ["doc_id", "text", "source"]


def test_quality_blocks_and_near_copies(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    block = [fresh(9) for _ in range(6)]
    first = fresh(9)
    rows = [(k, "\n".join([first, fresh(40), *block, fresh(40)]), "h") for k in range(40)]  # a fixed block and a fixed first line
    rows += [(k, "\n".join([*block, fresh(38)]), "h") for k in range(40, 60)]
    words = [fresh(10).split() for _ in range(30)]
    for k in range(60, 120):  # a hot group of near copies: two words of 300 differ
        own = [list(x) for x in words]
        for _ in range(2):
            own[rng.randrange(30)][rng.randrange(10)] = fresh(1)
        rows.append((k, "\n".join(map(" ".join, own)), "h"))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] for k in range(120))
    assert {got[k]["removed_words"] for k in range(40)} == {63} and {got[k]["removed_words"] for k in range(40, 60)} == {54}
    assert {got[k]["removed_words"] for k in range(60, 120)} == {0}


def test_quality_stage_cuts_removed_lines(spark):
    import corpus_pipeline

    rng = random.Random(7)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    own = [(fresh(30), fresh(30)) for _ in range(30)]
    rows = [(k, f"{a}\n\nAll  rights é {k % 10}\n{b}\nall rights é 0", "h", 7) for k, (a, b) in enumerate(own)] + [(30, "too short", "h", 9), (31, fresh(30), None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.schema == docs.schema
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    want = {k: f"{a}\n\n{b}" for k, (a, b) in enumerate(own)}
    assert found == {k: (t, len(t)) for k, t in want.items()} | {31: (rows[31][1], 8)}


def test_quality_edges(docs, empty):
    got = quality.judge(docs).collect()
    assert len(got) == docs.count() and all(r["kept"] is not None for r in got)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def brute_near(rows, n, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_brute_force(docs, n):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes, comp = brute_near(rows, n, 80)
    got = neardup.near_duplicates(docs, n).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    left = neardup.keep_one(docs, n)
    assert {r["doc_id"] for r in left.collect()} == {c for c in comp.values()} | {None} and left.columns == docs.columns


def test_near_duplicates_chains_and_hot_buckets(spark):
    """Links that no pivot shows: a chain in which only neighbours are similar, and a star around a larger id."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows, words = [], list(base)
    for k in range(40):
        rows.append((k, " ".join(words)))
        for j in rng.sample(range(200), 8):
            words[j] = f"c{k}_{j}"
    for k in range(40, 80):
        own = [f"v{i}" for i in range(200)]
        for j in rng.sample(range(200), 9):
            own[j] = f"s{k}_{j}"
        rows.append((k, " ".join(own)))
    rows.append((90, " ".join(f"v{i}" for i in range(200))))
    _, comp = brute_near(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == comp and len(set(comp.values())) < 20


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty, 2).count() == 0


def brute_lines(rows, percent=80, k=linededup.SHINGLE):
    where = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                where[line.strip(" \t\r\x0b\x0c")].append((i, n))
    sets = {x: {x[j : j + k] for j in range(len(x) - k + 1)} or {x} for x in where}
    names = sorted(sets)
    links = [(a, b) for x, a in enumerate(names) for b in names[x + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(names, links)
    first = {}
    for x, c in comp.items():
        first[c] = min(([first[c]] if c in first else []) + where[x], key=lambda p: (p[0] is not None, p))
    return {p: (comp[x], first[comp[x]]) for x, ps in where.items() for p in ps}


def test_lines_match_brute_force(docs, empty):
    once = docs.dropDuplicates(["doc_id"])
    want = brute_lines([(r["doc_id"], r["text"]) for r in once.collect()])
    got = linededup.judge_lines(once).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == set(want)
    groups = defaultdict(set)
    for r in got:
        groups[r["component_id"]].add((r["doc_id"], r["line_no"]))
        assert r["kept"] == (want[r["doc_id"], r["line_no"]][1] == (r["doc_id"], r["line_no"]))
    expected = defaultdict(set)
    for p, (c, _) in want.items():
        expected[c].add(p)
    assert sorted(map(sorted, [[(str(a), b) for a, b in g] for g in groups.values()])) == sorted(map(sorted, [[(str(a), b) for a, b in g] for g in expected.values()]))
    assert linededup.judge_lines(empty).count() == 0


def test_lines_of_several_clusters_in_a_bucket(spark, monkeypatch):
    """Pairs of similar lines in one bucket whose two ends are like neither of them; small groups."""
    monkeypatch.setattr(common, "WORK", 500)
    rng = random.Random(8)
    family = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))

    def edited(line, n):
        for j in rng.sample(range(10, 390), n):
            line = line[:j] + rng.choice("qrstuvwxyz") + line[j + 1 :]
        return line

    rows = []
    for k in range(150):
        own = edited(family, 4)  # about 0.7 to the others, and 0.96 to its partner
        rows += [(2 * k, own), (2 * k + 1, edited(own, 1))]
    groups = defaultdict(set)
    for (i, _), (c, _) in brute_lines(rows).items():
        groups[c].add(i)
    lines = linededup.lines_of(spark.createDataFrame([(i, t, i) for i, t in rows], "d long, t string, r long"), "d", "t", F.col("r"))
    got = defaultdict(set)
    for r in lines.join(linededup.classes(lines, 80), F.col("line") == F.col("node")).collect():
        got[r["component"]].add(r["doc_id"])
    assert len(groups) > 50 and sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_lines_meet_at_every_length(spark):
    """The share of pairs of similarity 0.8 that no table shows, by length; periodic lines of any length always meet."""
    rng = random.Random(4)
    rows, missed = [], {}
    for size in (5, 15, 30, 60, 180, 240, 400):  # shingles in the union of two lines, of which the last fifth has only one
        for k in range(400):
            text = "".join(rng.choice("abcdefghijklmnop") for _ in range(size + 7))
            rows += [(size, k, 0, text), (size, k, 1, text[: size * 4 // 5 + 7])]
    periodic = [(0, k, s, p * (n // len(p))) for k, p in enumerate("- = . _ ~ * # + -= .. <> ab abc wxyz".split()) for s, n in enumerate((120, 204, 216))]
    lines = spark.createDataFrame(rows + periodic, "size int, pair int, side int, norm string").withColumn("line", F.xxhash64("size", "pair", "side"))
    mins = {r["line"]: r[1:] for r in linededup.minima(lines).collect()}
    of, n = linededup.SUBKEYS, linededup.ROWS
    at = {(r["size"], r["pair"], r["side"]): mins[r["line"]] for r in lines.collect()}
    meet = lambda x, y: sum(all(x[s + r * of] == y[s + r * of] for r in range(n)) for s in range(of)) >= 2
    for size, k, _, _ in rows[::2]:
        missed[size] = missed.get(size, 0) + (not meet(at[size, k, 0], at[size, k, 1]))
    assert all(x <= 24 for x in missed.values()) and sum(missed.values()) <= 100, missed  # 0.025 each: 10 of 400, 70 of 2,800
    assert all(meet(at[0, k, 0], at[0, k, s]) for _, k, s, _ in periodic)


def test_only_white_space_is_trimmed(spark):
    """Lines that begin and end in any ASCII character keep all but outer white space; sets count UTF-16 units."""
    rows = [(k, c + "x" + c) for k, c in enumerate(map(chr, range(1, 127))) if c != "\n"] + [(900, "off"), (901, "o"), (902, "fff"), (903, " \x0b\x0cff\t\r ")]
    got = {r["doc_id"]: r["norm"] for r in linededup.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.lit(1)).collect()}
    assert got == {k: t.strip(" \t\r\x0b\x0c") for k, t in rows}
    pairs = [(0, "c" * 200), (1, "c" * 201), (2, "😀" * 30), (3, "😀" * 31), (4, "off" * 3), (5, "o" + "off" * 2 + "o")]
    judged = {r["doc_id"]: r["component_id"] for r in linededup.judge_lines(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert judged[0] == judged[1] and judged[2] == judged[3] and judged[4] != judged[5]


def test_removed_lines(docs, empty):
    once = docs.dropDuplicates(["doc_id"])
    want = brute_lines([(r["doc_id"], r["text"]) for r in once.collect()])
    left = {r["doc_id"]: r for r in linededup.remove_lines(once).collect()}
    for r in once.collect():
        lines = (r["text"] or "").split("\n")
        kept = [x for n, x in enumerate(lines) if (r["doc_id"], n) not in want or want[r["doc_id"], n][1] == (r["doc_id"], n)]
        if len(kept) < len(lines) and not any(WORD.search(x) for x in kept):
            assert r["doc_id"] not in left
        else:
            assert left[r["doc_id"]]["text"] == (None if r["text"] is None else "\n".join(kept))
    assert linededup.remove_lines(empty).columns == empty.columns
    twice = linededup.remove_lines(docs).collect()  # of repeated rows one keeps the lines
    assert sum(r["doc_id"] == 2 for r in twice) == 1


def brute_spans(t):
    out = []
    for kind, pattern, ok in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        ("hex", "[0-9a-f]+", lambda m: len(m.group()) >= 16),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m)]
    return out


def test_secret_spans(docs, empty):
    got = secrets.find(docs).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(got) == sum(texts.values())
    by = {i: t for i, t in texts}
    for r in got:
        base = brute_spans(by[r["doc_id"]] or "")
        kinds = Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda x: (x[1], secrets.KINDS.index(x[0]))))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}
    assert secrets.find(empty).count() == 0
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert not any(brute_spans(r["text"] or "") for r in clean.collect())


def test_secrets_beyond_their_base_match():
    class Fixed:
        def spans(self, text):
            return [(text.index("Ab12"), len(text) - 1)]

    text = 'password="Ab12Cd34Ef56!xyz789"'
    base, spans = secrets.scan(text, Fixed())
    assert text[base[0][1] : base[0][2]].endswith("Ef56") and spans == [*base, ("crf", 10, 29)]
    block = "key Ab12Cd34 0123456789abcdef Zz99!"
    assert ("crf", 4, len(block) - 1) in secrets.scan(block, Fixed())[1]
    assert secrets.scan('password="Ab12Cd34Ef56"', Fixed())[1] == secrets.scan('password="Ab12Cd34Ef56"', Fixed())[0]
    assert secrets.covered(2, 9, [(0, 4), (1, 3), (4, 9)]) and not secrets.covered(2, 9, [(0, 4), (5, 9)])


def test_features_of_very_long_tokens_see_all_of_it():
    own = lambda t: set(secrets.token_features(t)[0])
    assert secrets._bucket("hexonly") in own("0a" * 3000) and secrets._bucket("hexonly") not in own("0a" * 3000 + "#x")
    assert secrets._bucket("shape=a0-") in own("0a" * 3000 + "#x") and secrets._bucket("shape=a0") not in own("0a" * 3000 + "#x")


def test_field_on_held_out_sequences():
    tagger = secrets.Tagger(*secrets.train())
    hit = found = true = 0
    for tokens, labels in secrets.synthetic(400, 99):
        spans, at, want = tagger.spans(" ".join(tokens)), 0, []
        for t, y in zip(tokens, labels):
            if y == secrets.B:
                want.append((at, at + len(t)))
            elif y == secrets.I:
                want[-1] = (want[-1][0], at + len(t))
            at += len(t) + 1
        overlap = lambda a, b: a[0] < b[1] and b[0] < a[1]
        found += len(spans)
        true += len(want)
        hit += sum(any(overlap(s, w) for w in want) for s in spans)
    assert hit / found > 0.9 and hit / true > 0.85


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    import itertools

    for _ in range(20):
        score, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        best = max(itertools.product(range(3), repeat=5), key=lambda p: sum(score[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
        assert tuple(secrets.viterbi(score, trans)) == best


def test_decoding_in_parts_is_whole_decoding():
    weights, trans = secrets.train()
    tagger = secrets.Tagger(weights, trans)
    for tokens, _ in secrets.synthetic(100, 5):
        text = " ".join(tokens)
        grid = secrets._grid(tokens)
        path = secrets.viterbi(np.array([weights[r].sum(0) for r in grid]), trans)
        spans = tagger.spans(text)
        tagged, at = [], 0
        for t, y in zip(tokens, path):
            if y:
                tagged.append((at, at + len(t)))
            at += len(t) + 1
        assert all(any(a <= s and e <= b + 1 or s <= a and b <= e for s, e in spans) for a, b in tagged)
        assert bool(spans) == bool(tagged)


def test_words_of_one_kind_have_the_same_features():
    rng = random.Random(12)
    seen = {}
    for _ in range(30_000):
        t = "".join(rng.choice("abcdeABéß*#!.,'9-") for _ in range(rng.randint(1, 9))) if rng.random() < 0.7 else rng.choice("abAE") * rng.randint(1, 30) + rng.choice(["", ".", "***", "!!"])
        kind = secrets.word_kind(t)
        if kind is not None:
            features = tuple(map(sorted, secrets.token_features(t)))
            assert seen.setdefault(kind, (t, features))[1] == features, (t, seen[kind][0])
    assert len(seen) > 300


def test_near_copies_are_one_component_before_tables_are_made(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    rows = [(d, " ".join([*base[:100], f"own{d}", *base[100:]])) for d in range(60)]
    seen, real = [], neardup.bucket_components
    monkeypatch.setattr(neardup, "bucket_components", lambda shared, *rest: seen.append(shared.count()) or real(shared, *rest))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert {r["component_id"] for r in got} == {0}
    assert seen == [0]


def test_keys_of_the_same_nodes_are_one_bucket(spark):
    rows = [(n, k) for k in range(40) for n in (1, 2)] + [(n, 100 + k) for k in range(15) for n in (1, 2, 3)] + [(7, 200), (8, 201)]
    got = defaultdict(set)
    for r in common.buckets(spark.createDataFrame(rows, "node long, key long")).collect():
        got[r["key"], r["pivot"]].add(r["node"])
    assert got == {(0, 1): {1, 2}, (100, 1): {1, 2, 3}}
    one = spark.createDataFrame([(n, k, 1 if n < 3 else n) for n, k in rows], "node long, key long, component long")
    assert {r["key"] for r in common.buckets(one, "component").collect()} == {100}


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    written, real = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name, *rest: written.append(name) or real(df, name, *rest))
    found = common.connected_components(spark.createDataFrame([(1, 2), (1, 3), (9, 8)], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert written == ["edges"]


def test_only_the_sets_of_pairs_are_verified(spark):
    sets = spark.createDataFrame([(k, bytes([k] * 8 + [9] * 72)) for k in range(50)], "node long, items binary")
    pairs = common.materialise(spark.createDataFrame([(1, 2)], "a long, b long"), "pairs")
    plan = neardup._verified(pairs, sets, 80)
    assert [tuple(r) for r in plan.collect()] == [(1, 2)]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_two_similar_lines_are_one_bucket(spark, monkeypatch):
    base = "".join(random.Random(5).choices("abcdefghij klm", k=300))
    rows = [(k, base + tail, k) for k, tail in enumerate(("x", "y"))]
    seen, real = [], linededup.bucket_components
    monkeypatch.setattr(linededup, "bucket_components", lambda shared, *rest: seen.append(shared.count()) or real(shared, *rest))
    lines = linededup.lines_of(spark.createDataFrame(rows, "d long, t string, r long"), "d", "t", F.col("r"))
    assert len({r["component"] for r in linededup.classes(lines, 80).collect()}) == 1
    assert seen == [2]
