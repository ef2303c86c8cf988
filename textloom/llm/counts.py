"""Token counts by byte-pair merging: a heap of ranks and a linked list of symbols, without identifiers.

A text is cut at special strings, then into pieces by the vocabulary's pre-tokenizer; merges never cross a piece. A piece begins as one
symbol a byte. The adjacent pair of the lowest rank, the leftmost of equal ones, is merged until no pair has a rank; the piece has as many
tokens as it had symbols, less its merges.

Texts are walked in slices, so that a text of any length holds one slice of pieces at a time; a piece is never split, and takes some 60
bytes of memory a byte while it is merged. Null and empty
texts have no tokens, rows that repeat an identifier are counted one by one, and other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache, partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, small_batches, table, tidy
from .tokens import _class

LIMIT = 1024
#: Characters of a slice, pieces that a worker remembers, and the longest of those in characters.
SLICE, CACHE, LONGEST = 1 << 16, 1_200_000, 64


def _symbols() -> dict[str, int]:
    """The characters that stand for bytes in files of byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """What pairs of symbols have a rank, and what becomes of a pair of that rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut, special = told["model"], told.get("pre_tokenizer") or {}, told.get("added_tokens", [])
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or told.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"special strings that take their surroundings along: {path}")
        self.special = [t["content"] for t in special]
        # a byte is its own symbol
        known = {c: b for c, b in _symbols().items()}
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.becomes = [known.setdefault(a + b, len(known)) for a, b in merges]
        #: By left symbol, then by right symbol: the rank.
        self.ranks: list[dict[int, int]] = [{} for _ in known]
        for rank, (a, b) in enumerate(merges):
            self.ranks[known[a]][known[b]] = rank

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: its bytes less the merges. The heap holds rank * 2^32 + place of the left symbol; old entries are passed over."""
        n, ranks, becomes = len(piece), self.ranks, self.becomes
        heap = [rank << 32 | i for i, (a, b) in enumerate(zip(piece, piece[1:])) if (rank := ranks[a].get(b)) is not None]
        if not heap:
            return n
        links = list if n < 4096 else partial(array, "i")  # lists are faster, arrays are smaller
        symbol, after, before, left = links(iter(piece)), links(range(1, n + 1)), links(range(-1, n)), n
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if symbol[i] < 0 or (j := after[i]) == n or ranks[symbol[i]].get(symbol[j]) != rank:
                continue
            new = symbol[i] = becomes[rank]
            symbol[j], left = -1, left - 1
            k = after[i] = after[j]
            before[k] = i
            if k < n and (rank := ranks[new].get(symbol[k])) is not None:
                heappush(heap, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := ranks[symbol[h]].get(new)) is not None:
                heappush(heap, rank << 32 | h)
        return left


class Counts(dict):
    """Tokens by piece, counted when first asked for; long pieces are not remembered."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST:
            self[piece] = n
        return n


class Counter:
    """Counts tokens of whole texts; remembers the counts of short pieces."""

    def __init__(self, path: str, cache: int = CACHE, size: int = SLICE):
        from tokenizers import Tokenizer

        self.merges, self.cache, self.size = Merges(path), cache, size
        self.known = Counts(self.merges)
        #: The library's own cutting, for characters of which Python's expressions know other classes than the library.
        self.library = Tokenizer.from_file(path).pre_tokenizer
        let, num = _class("L"), _class("N")
        self.plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{let}]+| ?[{num}]+| ?[^\s{let}{num}]+|\s+(?!\S)|\s+").findall
        self.odd = re.compile("[^\0-\x1b\x20-ɏ]").search
        self.special = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None

    def pieces(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.plain(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def slices(self, text: str):
        """The pieces of a text, a slice at a time. What follows a slice can change its last two pieces only, so they begin the next one."""
        at, size = 0, self.size
        while at < len(text):
            some = self.pieces(text[at : at + size])
            if at + size < len(text):
                if len(some) < 4:  # a piece as long as the slice
                    size *= 2
                    continue
                some, size = some[:-2], self.size
            at += sum(map(len, some))
            yield some

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string is one token."""
        if not text:
            return 0
        if self.special is None:
            return sum(map(self._sum, self.slices(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._sum(some) for part in parts for some in self.slices(part))

    def _sum(self, pieces: list[str]) -> int:
        if len(self.known) > self.cache:
            self.known.clear()
        return sum(map(self.known.__getitem__, pieces))


@cache
def counter(path: str) -> Counter:
    """One for each Python worker; what it has counted serves the worker's later tasks."""
    return Counter(path)


CACHES.append(counter.cache_clear)


def count(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text. No shuffle: a row's counts depend on the row alone."""

    def task(batches):
        own = counter(path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                n = pa.array([own.count(t) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidy(task, caches=False), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of ``documents``."""
    import public_tokenizers

    return count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
