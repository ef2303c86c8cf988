"""Token identifiers of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import cache

import numpy as np

from .common import CACHES

#: Pieces learnt before the cache starts anew; about 260 MB of a Python worker.
CACHE = 1_200_000


def _class(kind: str, end: int = 0x250) -> str:
    """Ranges of a character class: code points below ``end`` whose category starts with ``kind``."""
    ranges, last = [], -2
    for c in (c for c in range(end) if unicodedata.category(chr(c))[0] == kind):
        if c == last + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
        last = c
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


class Encoder:
    """Encodes texts with the tokenizers library, one call for each new piece.

    Byte-level merges never cross the pieces that the vocabulary's pre-tokenizer cuts, so a text's ids are those of its pieces in
    order. Texts of characters below U+0250 without the end marker are cut here and each distinct piece is encoded once; any other
    text goes to the library as a whole.
    """

    def __init__(self, path: str, end_id: int = 0, cache: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.cache, self.known = Tokenizer.from_file(path), cache, {}
        self.end = np.array([end_id], "<u4").tobytes()
        let, num = _class("L"), _class("N")
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{let}]+| ?[{num}]+| ?[^\s{let}{num}]+|\s+(?!\S)|\s+").findall
        # \x1c-\x1f are white space to Python alone; the marker is one id to the library
        self.odd = re.compile("[^\0-\x1b\x20-ɏ]|<\\|").search

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        if len(self.known) > self.cache:
            self.known = {}
        known, whole, pieces, ends = self.known, {}, [], []
        for i, t in enumerate(texts):
            if t and self.odd(t):
                whole[i] = array("I", self.model.encode(t, add_special_tokens=False).ids).tobytes()
            elif t:
                pieces += self.cut(t)
            ends.append(len(pieces))
        ids = list(map(known.get, pieces))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            new = list({pieces[i] for i in gaps})
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                for p, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False)):
                    known[p] = array("I", e.ids).tobytes()
            for i in gaps:
                ids[i] = known[pieces[i]]
        return [whole[i] + self.end if i in whole else b"".join(ids[a:b]) + self.end for i, (a, b) in enumerate(zip([0, *ends], ends))]


@cache
def encoder(path: str, end_id: int = 0) -> Encoder:
    """One encoder for each Python worker: what it has learnt serves the worker's later tasks."""
    return Encoder(path, end_id)


CACHES.append(encoder.cache_clear)
