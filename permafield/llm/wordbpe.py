"""Ids of a word-level BPE tokenizer, encoded word by word with a bounded memory of words met before."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Characters of the longest word that a worker remembers, and about the bytes of the words met twice or more, and of those met once lately.
LONGEST, OFTEN, ONCE = 64, 96_000_000, 64_000_000

#: A full stop or comma before white space and not after a Latin letter or digit: the pattern may take it with its neighbours.
_JOINED = re.compile(r"[.,](?<![0-9A-Za-zÀ-ÖØ-öø-ÿ].)[ \n]")
#: A character that is a piece and one id of its own between white space; new words that go to the library are parted by it.
_MARK, _TOGETHER = "\x01", 1000


class WordEncoder:
    """``encode(text)`` returns the ids as little-endian uint32 bytes, equal to the library's ``encode`` of the whole text.

    The tokenizer's pattern drops white space and no match, normalisation or merge reaches across it, so a text's
    ids are those of its pieces between ``" "`` and ``"\\n"``. New pieces go to the library in batches; texts with one
    of the added tokens' strings go to it whole. Texts in Latin-1, on which its normaliser does no more than lower the
    case, are lowered at once, their words' full stops and commas are cut off, and the library skips the normaliser.
    ``check`` refuses a tokenizer of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.mark = self.whole(_MARK)
        self.check()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        #: Of lowered Latin-1 words, and of other pieces.
        self.often: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.once: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        #: About the bytes of each.
        self.held_often, self.held_once = [0, 0], [0, 0]

    def check(self) -> None:
        probe = ["it's a 'Test' of", "Große Öfen,", "ÇA-VA?", "12 34"]
        parts = [x for p in probe for w in p.split(" ") for x in self.whole(w)]
        bare = self.bare.encode(" ".join(probe).lower(), add_special_tokens=False).ids
        marked = [self.new(t, [w for p in probe for w in p.lower().split(" ")]) for t in (self.tokenizer, self.bare)]
        same = all(b"".join(m) == np.asarray(parts, "<u4").tobytes() for m in marked)
        if len(self.mark) != 1 or not same or not self.whole(" \n".join(probe)) == parts == bare:
            raise ValueError("this tokenizer's ids depend on white space; encode whole texts instead")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def new(self, tokenizer, words: list[str]) -> list[bytes]:
        """The ids of each word, by few calls of the library; words with the mark in them go to it alone."""
        done: list[bytes] = []
        for k in range(0, len(words), _TOGETHER):
            part = words[k : k + _TOGETHER]
            (e,) = tokenizer.encode_batch_fast([f" {_MARK} ".join(part)], add_special_tokens=False)
            ids = np.asarray(e.ids, "<u4")
            at = np.flatnonzero(ids == self.mark[0]) * 4
            if len(at) == len(part) - 1:  # a mark alone in a word would add one
                data = ids.tobytes()
                done += [data[i:j] for i, j in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)])]
            else:
                done += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return done

    @staticmethod
    def latin(text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added is not None and "<|" in text and self.added.search(text):
            return np.asarray(self.whole(text), "<u4").tobytes()
        plain = self.latin(text)
        if plain:
            text = text.lower()
            if not _JOINED.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        words = text.replace("\n", " ").split(" ")
        often = self.often[not plain]
        got = list(map(often.get, words))
        if None in got:
            once, kind = self.once[not plain], int(not plain)
            if self.held_often[kind] > OFTEN:
                often.clear()
                self.held_often[kind] = 0
            if self.held_once[kind] > ONCE:
                once.clear()
                self.held_once[kind] = 0
            new, long, moved = [], [], {}
            for w in {w for w, g in zip(words, got) if g is None}:
                if w in once:
                    moved[w] = once.pop(w)
                else:
                    (new if len(w) <= LONGEST else long).append(w)
            tokenizer = self.bare if plain else self.tokenizer
            found = dict(zip(new, self.new(tokenizer, new)))
            for held, words_ in ((self.held_often, moved), (self.held_once, found)):
                held[kind] += sum(200 + 2 * len(w) + len(g) for w, g in words_.items())
            often.update(moved)
            once.update(found)
            found |= moved | dict(zip(long, self.new(tokenizer, long)))  # long words are not remembered
            got = [g if g is not None else found[w] for w, g in zip(words, got)]
        return b"".join(got)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file; it runs on the worker's own core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
