"""Secret scanning: fixed patterns, and a linear-chain conditional random field over tokens decoded by Viterbi."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns in order, with the least length of group or match.
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
KEYWORDS = frozenset("password passwd pwd pass secret token key apikey api_key auth bearer credential credentials private access".split())
#: What makes a word's features depend on more than its letters' counts.
SPECIAL = re.compile("pass|pwd|secret|token|key|auth|bearer|cred|private|access|^http|^www|^xox|^akia|^eyj|^[a-f]{12}|[:=]")
#: Symbols that no feature names: a word with them has the features of its letters' counts too.
_MUTE = str.maketrans("", "", "*#$%&!")
#: Feature buckets; labels: outside, begin, inside.
BUCKETS, O, B, I = 4096, 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns as (kind, start, end) in code points, leftmost and non-overlapping for each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % (BUCKETS - 1) + 1


def core(token: str) -> tuple[int, int]:
    """Where a token's value stands in it: after the last ``=`` or ``:`` of a key, without quotes and closing punctuation."""
    start, end = 0, len(token)
    m = re.match(r"""["'(\[{<]*[A-Za-z_][A-Za-z0-9_.-]{0,40}["']?[:=]+(?=[^=:/])""", token)
    if m and m.end() < end:
        start = m.end()
    while start < end and token[start] in "\"'`([{<":
        start += 1
    while end > start and token[end - 1] in "\"'`)]}>,;.!?":
        end -= 1
    return (start, end) if end > start else (0, len(token))


def token_features(token: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Buckets of a token's own features, and of those that its neighbours see."""
    start, end = core(token)
    v, key = token[start:end], token[:start].lower()
    n = len(token)
    lower, upper = sum(c.islower() for c in v), sum(c.isupper() for c in v)
    digit = sum(c.isdigit() for c in v)
    other = len(v) - lower - upper - digit
    counts = [v.count(c) for c in set(v)] if len(v) < 200 else Counter(v).values()
    entropy = -sum(c / len(v) * math.log2(c / len(v)) for c in counts)
    shape = "".join("a" * (lower > 0) + "A" * (upper > 0) + "0" * (digit > 0) + "-" * (other > 0))
    size = min(12, int(math.log2(n + 1) * 2))
    switches = sum((a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()) for a, b in zip(v, v[1:]))
    word = re.sub(r"[^a-z_]", "", token.lower())
    own = [f"shape={shape}", f"size={size}", f"shape,size={shape},{size}", f"entropy={int(entropy * 2)}", f"entropy,shape={int(entropy * 2)},{shape}", f"switch={min(8, switches * 16 // (len(v) + 1))}", f"digits={digit * 8 // (len(v) + 1)}"]
    own += ["hexonly"] * bool(re.fullmatch(r"[0-9a-fA-F]{12,}", v)) + ["b64"] * bool(re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", v)) + ["number"] * bool(re.fullmatch(r"[0-9.,:/-]+", v))
    own += [f"prefix={p}" for p in ("AKIA", "ghp_", "sk-", "eyJ", "xox", "-----", "http", "www.") if v.startswith(p)] + ["mail"] * ("@" in v and "." in v) + ["path"] * (v.count("/") > 1)
    own += [f"key={any(k in key for k in KEYWORDS)}"] if start and key else []
    own += ["plain"] * v.isalpha() + ["alpha,size=%d" % size] * v.isalpha()
    seen = [f"word={word}"] * (word in KEYWORDS) + ["ends=" + token[-1]] * (token[-1] in ":=") + ["is=" + token] * (token in (":", "=", "-----BEGIN", "KEY-----")) + [f"kshape={shape}"] + ["keyword"] * any(k in word for k in KEYWORDS if len(k) > 4) + ["bigb64"] * (n >= 40 and "b64" in own)
    return tuple(map(_bucket, own)), tuple(map(_bucket, seen))


def word_kind(t: str) -> tuple | None:
    """What an ordinary word's features depend on: its length, case, and letters' counts. None for any other token."""
    if len(t) >= 40 or not t[0].isalpha() or SPECIAL.search(t.lower()):
        return None
    v = t.rstrip("\"'`)]}>,;.!?")
    letters = v.translate(_MUTE)
    if not letters.isalpha():
        return None
    case = 0 if v.islower() else 1 if v.isupper() else 2 if v[1:].islower() else 3
    if case == 3:
        return None
    return (len(t), case, v.isascii(), len(letters) < len(v), *sorted(map(v.count, set(v))))


def file_features(text: str, n_tokens: int) -> tuple[int, ...]:
    """Buckets of a file's features: its size, and how much its punctuation looks like code or settings."""
    code = sum(text.count(c) for c in "={};") * 16 // (n_tokens + 1)
    return _bucket(f"file:code={min(code, 4)}"), _bucket(f"file:size={min(8, n_tokens.bit_length() // 2)}")


def neighbour(bucket: int, side: int) -> int:
    return (bucket * 2 + side) * 2654435761 % (BUCKETS - 1) + 1


# --- training ---------------------------------------------------------------------------------------------------------


def synthetic(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Labelled token sequences made by rule: prose, settings and code with and without secrets of many kinds."""
    rng = random.Random(seed)
    syllables = "the and er in on re ti en es ou ent ción mente heit ung le la qu al st".split()
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))

    def plain() -> str:
        k = rng.random()
        if k < 0.78:
            w = word()
            return (w.capitalize() if rng.random() < 0.15 else w) + rng.choice(["", "", "", "", ",", "."])
        made = [
            lambda: str(rng.randint(0, 10**16)),
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            lambda: f"https://{word()}.example.com/{word()}/{rng.randint(1, 9999)}",
            lambda: f"{word()}@{word()}.example.org",
            lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            lambda: word() + rng.choice(["***", "###", "$$$", "%%%", "&&&", "!!"]),
            lambda: f"{word()}_{word()}()",
            lambda: f"{word()}={word()}",
            lambda: word().upper() + "!!",
            lambda: f"+{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
            lambda: text("0123456789abcdef", 6, 8),
            lambda: f"/{word()}/{word()}/{word()}.txt",
        ]
        return rng.choice(made)()

    def secret() -> tuple[list[str], list[int]]:
        value = rng.choice([lambda: text("0123456789abcdef", 24, 64), lambda: text(b64, 20, 60), lambda: "ghp_" + text(b64[:62], 30, 40), lambda: "sk-" + text(b64[:62], 24, 48), lambda: "AKIA" + text("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: text(b64[:62] + "!#%&*@", 10, 20), lambda: "eyJ" + text(b64[:62], 30, 80)])()
        kind = rng.random()
        key = rng.choice(["password", "token", "secret", "api_key", "apikey", "auth", "passwd", "pwd", "Bearer", "access_key"])
        if kind < 0.12:
            lines = [text(b64, 40, 64) for _ in range(rng.randint(1, 3))]
            return ["-----BEGIN", "PRIVATE", "KEY-----", *lines, "-----END"], [O, O, O, B, *[I] * (len(lines) - 1), O]
        if kind < 0.4:
            return [key, rng.choice("=:"), f'"{value}"'], [O, O, B]
        if kind < 0.6:
            return [f"{key}={value}"], [B]
        if kind < 0.8:
            return [f"{key}:", value], [O, B]
        return [key, value], [O, B]

    out = []
    for _ in range(n):
        tokens: list[str] = []
        labels: list[int] = []
        while len(tokens) < rng.randint(8, 26):
            if rng.random() < 0.06:
                t, y = secret()
            elif rng.random() < 0.03:
                t, y = [rng.choice(sorted(KEYWORDS)), rng.choice(["=", ":", "is", word()]), word()], [O, O, O]
            else:
                t, y = [plain()], [O]
            tokens += t
            labels += y
        out.append((tokens, labels))
    return out


def _grid(tokens: list[str]) -> list[list[int]]:
    """Buckets of every position: own, left and right neighbour's, file's."""
    feats = [token_features(t) for t in tokens]
    file = list(file_features(" ".join(tokens), len(tokens)))
    rows = []
    for k, (own, _) in enumerate(feats):
        left = [neighbour(f, 0) for f in feats[k - 1][1]] if k else []
        right = [neighbour(f, 1) for f in feats[k + 1][1]] if k + 1 < len(feats) else []
        rows.append([*own, *left, *right, *file])
    return rows


@lru_cache(maxsize=4)
def train(sequences: int = 500, seed: int = 11, rounds: int = 80, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, 3) and transitions (3, 3) of the field, by Adam on the exact log-likelihood of ``sequences`` made sequences."""
    data = synthetic(sequences, seed)
    grids = [_grid(t) for t, _ in data]
    longest, widest = max(map(len, grids)), max(len(r) for g in grids for r in g)
    x = np.zeros((len(data), longest, widest), np.int64)
    y = np.zeros((len(data), longest), np.int64)
    mask = np.zeros((len(data), longest), bool)
    for i, (g, (_, labels)) in enumerate(zip(grids, data)):
        mask[i, : len(g)], y[i, : len(g)] = True, labels
        for k, r in enumerate(g):
            x[i, k, : len(r)] = r
    w, trans = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    first = [np.zeros_like(w), np.zeros_like(trans)]
    second = [np.zeros_like(w), np.zeros_like(trans)]
    flat = x.reshape(-1)
    gold = np.eye(3)[y] * mask[..., None]
    gold_t = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    for step in range(1, rounds + 1):
        w[0] = 0
        score = w[x].sum(2)
        n = len(data)
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = lse(alpha[:, t - 1, :, None] + trans, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = lse(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        delta = np.repeat((p - gold).reshape(-1, 3), widest, 0)
        grads = [np.stack([np.bincount(flat, delta[:, c], BUCKETS) for c in range(3)], 1) / n + decay * w, (pair.sum((0, 1)) - gold_t) / n + decay * trans]
        for value, g, a, b in zip((w, trans), grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            value -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    w[0] = 0
    return w, trans


# --- decoding ---------------------------------------------------------------------------------------------------------


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels for emission scores (n, 3)."""
    n = len(score)
    best, back = score[0].copy(), np.zeros((n, 3), np.int64)
    for t in range(1, n):
        through = best[:, None] + trans
        back[t] = through.argmax(0)
        best = through.max(0) + score[t]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


class Tagger:
    """Tags a text's tokens. Scores of tokens met before are remembered (a bounded number of them)."""

    MEMORY = 200_000

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.w, self.trans = weights, trans
        #: A token whose outside score leads by more than any transitions can make up is outside on every best path.
        self.lead = 2 * float(trans.max() - trans.min())
        self.rows: dict[str, int] = {}
        self.plain: dict[tuple, int] = {}
        self.table, self.used = np.zeros((1024, 9)), 0

    def _row(self, values: np.ndarray) -> int:
        if self.used >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = values
        self.used += 1
        return self.used - 1

    def _scores(self, token: str) -> np.ndarray:
        own, seen = token_features(token)
        return np.concatenate([self.w[list(own)].sum(0), self.w[[neighbour(f, 0) for f in seen]].sum(0), self.w[[neighbour(f, 1) for f in seen]].sum(0)])

    def index(self, tokens: list[str]) -> list[int]:
        rows = self.rows
        if self.used > self.MEMORY or len(rows) > 3 * self.MEMORY:
            rows.clear()
            self.plain.clear()
            self.table, self.used = np.zeros((1024, 9)), 0
        out = []
        for t in tokens:
            r = rows.get(t)
            if r is None:
                kind = word_kind(t)
                if kind is not None:  # words of one kind have the same scores: one row serves many
                    r = self.plain.get(kind)
                    if r is None:
                        r = self.plain[kind] = self._row(self._scores(t))
                else:
                    r = self._row(self._scores(t))
                if len(t) <= 200:
                    rows[t] = r
            out.append(r)
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets as (start, end) in code points: the values of the tokens tagged begin and inside."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        own = self.table_rows(tokens)
        score = own[:, :3] + self.w[list(file_features(text, len(tokens)))].sum(0)
        score[1:] += own[:-1, 3:6]
        score[:-1] += own[1:, 6:9]
        open_ = np.flatnonzero(score[:, O] - score[:, 1:].max(1) <= self.lead)
        if not len(open_):
            return []
        # Between two tokens that are surely outside the chain falls apart: decode the runs of the others with their borders.
        tagged: dict[int, int] = {}
        groups = np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1)
        for g in groups:
            a, b = max(0, int(g[0]) - 1), min(len(tokens), int(g[-1]) + 2)
            part = score[a:b].copy()
            if a < g[0]:
                part[0, 1:] = -1e9
            if b > g[-1] + 1:
                part[-1, 1:] = -1e9
            for k, label in enumerate(viterbi(part, self.trans)):
                if label:
                    tagged[a + k] = int(label)
        if not tagged:
            return []
        found: list[tuple[int, int]] = []
        last = -2
        for k, m in enumerate(TOKEN.finditer(text)):
            label = tagged.get(k)
            if label is None:
                continue
            s, e = core(m.group())
            s, e = m.start() + s, m.start() + e
            if label == I and last == k - 1 and found:
                found[-1] = (found[-1][0], e)
            else:
                found.append((s, e))
            last = k
        return found

    def table_rows(self, tokens: list[str]) -> np.ndarray:
        rows = self.index(tokens)  # may replace the table
        return self.table[rows]


def covered(start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether sorted ``spans`` together cover all of ``start`` to ``end``."""
    for s, e in spans:
        if s <= start < e:
            start = e
    return start >= end


def scan(text: str | None, tagger: Tagger) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the field's spans that base spans do not cover in full are added, whole."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    more = [("crf", s, e) for s, e in tagger.spans(text) if not covered(s, e, taken)]
    return base, base + more


_taggers: dict[bytes, Tagger] = {}


def _tagger(weights: np.ndarray, trans: np.ndarray) -> Tagger:
    key = hashlib.md5(weights.tobytes()).digest()
    if key not in _taggers:
        _taggers[key] = Tagger(weights, trans)
    return _taggers[key]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequences: int = 500) -> DataFrame:
    """Spans of every whole text: ``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans``; one row for each row, without a shuffle.

    The field is fitted on the driver on ``sequences`` made sequences (the bound on its sample). Null text: empty. Null ids
    are kept; repeated rows give repeated rows; other columns are not read.
    """
    weights, trans = train(sequences)
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string").fields])

    def run(batches):
        tagger = _tagger(weights, trans)
        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = scan(t.as_py(), tagger)
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2))], names=out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", sequences: int = 500) -> DataFrame:
    """The same rows and columns with every span of every text replaced by ``mark`` (overlapping spans by one mark).

    Null and empty texts stay as they are; texts of any length are scanned whole; repeated rows are redacted alike; no rows: none.
    Extra columns may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    weights, trans = train(sequences)
    schema = docs.schema
    at = schema.names.index(text_col)
    names = schema.names

    def clean(text: str | None, tagger: Tagger) -> str | None:
        if text is None:
            return None
        _, spans = scan(text, tagger)
        parts, last, open_to = [], 0, -1
        for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= open_to:
                parts += [text[last:s], mark]
            last = open_to = max(open_to, e)
        return "".join([*parts, text[last:]])

    def run(batches):
        tagger = _tagger(weights, trans)
        arrow = to_arrow_schema(schema)
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t.as_py(), tagger) for t in cols[at]], arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
