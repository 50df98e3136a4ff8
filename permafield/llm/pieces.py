"""SentencePiece encoding and decoding of merge-type models: the encoder finds the library's ids by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark that stands for a space.
SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of the longest chunk that a worker remembers, about the bytes of the chunks met lately (and of those before), tests of two tokens.
SHORT, REMEMBER, PAIRS = 64, 100_000_000, 400_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``number, value`` of the fields of one message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """``piece, score, kind`` of each id of a model file; it raises for models that this encoder would not encode as the library does:
    other than merge-type ones with byte fallback, and normalisers that do more than mark spaces and add one in front."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, rules = [], {}, {}
    for k, v in fields(data):
        if k == 1:
            d = dict(fields(v))
            pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif k == 2:
            trainer = dict(fields(v))
        elif k == 3:
            rules = dict(fields(v))
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
        raise ValueError("only merge-type models with byte fallback and spaces in front of words are supported")
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("only normalisers that keep all characters, mark spaces and add one in front are supported")
    if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("models with user-defined or unused pieces are not supported")
    return pieces


class PieceEncoder:
    """``encode(text)`` returns the ids that the library's ``encode`` gives for the whole text.

    A sequence of tokens is the one that merging by score ends in if and only if merging any two neighbours again gives those two. So the
    encoder takes the longest match at each place that fits the token before it; where none fits, it marks the place in a bitfield as
    failed (the tokens up to a place are unique), and takes a shorter match for the token before. No piece goes on past a space or, in a
    model without line feeds, a line feed, so texts are cut there, and ids of short chunks are remembered, bounded in bytes. Characters
    without a piece are given by their bytes.
    """

    def __init__(self, path: str):
        import ahocorasick

        model = read_model(path)
        self.ids = {p: k for k, (p, _, kind) in enumerate(model) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in model if kind == NORMAL}
        self.bytes = [self.byte_id(model, b) for b in range(256)]
        if {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError("models with characters that are no pieces of their own are not supported")
        #: Only a piece that its own characters merge to can be a token. The last id stands for a character without a piece.
        known = {p: k for p, k in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.pieces = [p for p, _, _ in model]
        self.other, self.text = len(model), [str(k) for k in range(len(model))]
        self.sizes = [*map(len, self.pieces), 1]
        self.shorter = [-1] * (self.other + 1)
        for p, k in known.items():
            self.shorter[k] = next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1)
        self.automaton = ahocorasick.Automaton()
        for p, k in known.items():
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        feeds = "" if any("\n" in p for p in self.ids) else r"\n"
        across = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.chunks = re.compile("(?s).+" if across else rf"{feeds}{'|' * bool(feeds)}{SPACE}+[^{SPACE}{feeds}]*|[^{SPACE}{feeds}]+").findall
        self.pairs: dict[int, bool] = {}
        #: Ids of short chunks met lately and before that: where the first is full, it takes the place of the second.
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.before: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.held = 0
        self.edges: dict[str, tuple[list, list] | None] = {}

    @staticmethod
    def byte_id(model: list[tuple[str, float, int]], b: int) -> int:
        return next(k for k, (p, _, kind) in enumerate(model) if kind == BYTE and p == f"<0x{b:02X}>")

    def merge(self, text: str) -> list[str]:
        """Merge by score, highest first and leftmost of equals: the definition, for short texts."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edge(self, token: str) -> tuple[list, list] | None:
        """While a token is merged from its characters: its left parts and its right parts, each with the score of the merge that ends it.
        None where the scores of these merges do not fall, so that scores do not tell their order."""
        if token not in self.edges:
            parts, lefts, rights, last = list(token), [], [], np.inf
            falling = True
            while len(parts) > 1:
                score, at = max((self.scores.get(x + y, -np.inf), -k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
                falling &= score < last
                last = score
                if at == 0:
                    lefts.append((parts[0], score))
                if -at == len(parts) - 2:
                    rights.append((parts[-1], score))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            self.edges[token] = ([*lefts, (token, -np.inf)], [*rights, (token, -np.inf)]) if falling else None
        return self.edges[token]

    def remerged(self, a: str, b: str) -> bool:
        """Whether merging ``a`` and ``b`` again gives these two. The merges inside each are known, so only the parts that meet at the border
        need a look: they must not merge before one of them is merged into a longer one."""
        x, y = self.edge(a), self.edge(b)
        if x is None or y is None:
            return self.merge(a + b) == [a, b]
        rights, lefts, scores = x[1], y[0], self.scores
        i = j = 0
        while True:
            (right, until), (left, later) = rights[i], lefts[j]
            score = scores.get(right + left)
            # Of equal scores the leftmost merges first: one within a before the border, the border before one within b.
            if score is not None and score > until and score >= later:
                return False
            if until == later == -np.inf:
                return True
            if until >= later:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """:meth:`remerged` by ids, remembered; characters without a piece merge with nothing."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a * (self.other + 1) + b] = a == self.other or b == self.other or self.remerged(self.pieces[a], self.pieces[b])
        return found

    def tokens(self, chunk: str) -> list[int]:
        """The tokens of a chunk, by backtracking over its longest matches."""
        n, sizes, pairs, base = len(chunk), self.sizes, self.pairs, self.other + 1
        longest = [self.other] * (n + 1) if n <= SHORT else array("i", [self.other]) * (n + 1)
        for end, k in self.automaton.iter(chunk):
            longest[end - sizes[k] + 1] = k  # ends ascend, so the longest match of a start comes last
        failed: bytearray | None = None
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                good = pairs.get(out[-1] * base + token) if out else True
                if good is None:
                    good = self.fits(out[-1], token)
                if good:
                    out.append(token)
                    at, token = end, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= sizes[token]
                token = self.shorter[token]
        return out

    def chunk_ids(self, chunk: str) -> tuple[str, tuple[int, ...]]:
        """A chunk's ids, also as text."""
        ids = self.tokens(chunk)
        if self.other in ids:
            whole, at, ids = ids, 0, []
            for k in whole:
                ids += [self.bytes[b] for b in chunk[at].encode()] if k == self.other else [k]
                at += self.sizes[k]
        found = ",".join([self.text[k] for k in ids]), tuple(ids)
        if len(chunk) <= SHORT:
            self.remember(chunk, found)
        return found

    def remember(self, chunk: str, found: tuple[str, tuple[int, ...]]) -> None:
        self.held += 300 + 2 * len(chunk) + 48 * len(found[1])
        if self.held > REMEMBER:
            self.before, self.known, self.held = self.known, {}, 0
        self.known[chunk] = found

    def new(self, chunk: str) -> tuple[str, tuple[int, ...]]:
        """The ids of a chunk not met lately."""
        found = self.before.pop(chunk, None)
        if found is None:
            return self.chunk_ids(chunk)
        self.remember(chunk, found)
        return found

    def parts(self, text: str | None) -> list[tuple[str, tuple[int, ...]]]:
        """The ids of the chunks of a text; null and empty texts have none."""
        if not text:
            return []
        new = self.new
        return [self.known.get(c) or new(c) for c in self.chunks(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.parts(text)))


_encoders: dict[str, PieceEncoder] = {}
_libraries: dict = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def library(path: str):
    """The library's processor, which decodes; one for each worker process and file."""
    if path not in _libraries:
        import sentencepiece

        _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _libraries[path]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, whole: ``id, ids array<int>``, one row for each input row in its own task, without a shuffle.

    Null and empty texts have an empty list; a null id is kept; repeated rows give repeated rows; an empty table gives none. Texts may be
    of any length (a chunk without a space is held as its matches, a few dozen bytes a character). Other columns are not read, so
    their names cannot clash. Equal scores merge leftmost first, as in the library.
    """

    def run(batches):
        enc = encoder(model)
        for b in batches:
            got = [np.asarray(enc.encode(t.as_py()), "<i4") for t in b.column(1)]
            ends = np.cumsum([0, *map(len, got)]).astype("<i4")
            flat = np.concatenate(got) if got else np.empty(0, "<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def decode_ids(encoded: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text``: the library's ``decode`` of each list of ids. Null and empty lists decode to an empty text; ids and lists may repeat
    and be of any length; other columns are not read."""

    def run(batches):
        sp = library(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sp.decode(x.as_py() or []) or "" for x in b.column(1)], pa.string())], names=["id", "text"])

    out = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, out)


def round_trip_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``id, n_tokens, ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``.

    Null and empty texts: 0 tokens and the digests of nothing. One row for each input row, null ids and repeated rows included; an empty
    table gives none. Texts are encoded whole, of any length; other columns are not read.
    """

    def run(batches):
        enc, sp = encoder(model), library(model)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                parts = enc.parts(t.as_py())
                ids = list(chain.from_iterable(i for _, i in parts))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([s for s, _ in parts]).encode()).hexdigest())
                text_sha.append(hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=out.names)

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)
