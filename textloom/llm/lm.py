"""Language-model scoring by a weighted backoff automaton whose arcs are counted and asked for in one exchange.

States are contexts of two, one and no words. An arc of a state reads a word and carries its smoothed probability
(c(hw) + PRIOR * p(w | shorter)) / (c(h) + PRIOR); a state's failure arc carries PRIOR / (c(h) + PRIOR) and leads to the context without
its first word. Probabilities of a state add up to one. Every n-gram of the training texts is an arc, whatever its count.

1. *Slices.* Texts are cut into slices of 200,000 tokens, once: different words and, for each token, which of them it is. They lie in
   buckets of their own and don't move again.
2. *Words and bigrams.* A slice sends each different one once, with how often its training texts have it, to a bucket by hash. A bucket
   adds up and answers each slice in the order in which it asked, so the answer is counts alone.
3. *Trigrams* the same way, of those places whose context has been met twice or by a text that is scored only. What follows a context
   that occurs once in all training texts is known without asking: it occurs once.
4. *Traversal.* Slices come together with their answers, and each text is read from left to right in the state of its last two words.

No word, context or n-gram gathers its occurrences anywhere: a bucket sees it once a slice. What crosses a shuffle are rows of a slice's
n-grams for one bucket, never more rows than different n-grams of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, plain_words, remainder, table, tidy

PRIOR = 1.0
ADD = 0.1
#: Tokens of a slice (a longer text is a slice of its own), and tokens of the corpus for each bucket.
SLICE, BUCKET = 200_000, 1 << 21
WORD, TWO, THREE = 1, 2, 3
#: Bytes of a hash that a bucket is sent, those that follow the bits which the bucket stands for.
KEY, KEY_BYTES = "key", 6
_SLICE = pa.schema([("slice", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("learns", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary())])
_ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("slice", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_DDL = "kind int, bucket long, slice long, n long, body binary"


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, a row of all first ones, then of all second ones: leading bytes of sorted or of small numbers pack well."""
    return np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T)


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    """Numbers of their planes; planes that were left out are low ones, and zero."""
    size = 8 if kind == KEY else np.dtype(kind).itemsize
    some = np.frombuffer(raw, "u1")
    n = len(some) // (KEY_BYTES if kind == KEY else size)
    out = np.zeros((n, size), "u1")
    if n:
        planes = some.reshape(-1, n)
        out[:, size - len(planes) :] = planes.T
    return out.view("<u8" if kind == KEY else kind).ravel()


def slices(docs: DataFrame) -> DataFrame:
    """Rows (slice, n, ids, learns, ends, words, tokens) of ``docs`` (doc_id, text, learns): hashes of the different words of a slice,
    ascending, and the place among them of each token of its texts, one after another, an end after each text."""
    import xxhash

    digest = xxhash.xxh64_intdigest

    def row(name: int, ids: list, learns: list, ends: list, hashes: list):
        import zstandard

        words, tokens = np.unique(np.array(hashes, np.uint64), return_inverse=True)
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_pylist([{"slice": name, "n": len(tokens), "ids": ids, "learns": learns, "ends": ends, "words": pack(_planes(words).tobytes()), "tokens": pack(_planes(tokens.astype("<u4")).tobytes())}], schema=_SLICE)

    def task(batches):
        from pyspark import TaskContext

        name, end = TaskContext.get().partitionId() << 32, digest(b"\n")
        ids, learns, ends, hashes = [], [], [], []
        for batch in batches:
            for doc, text, learn in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("learns").to_pylist()):
                hashes += map(digest, plain_words(text))
                hashes.append(end)
                ids.append(doc)
                learns.append(bool(learn))
                ends.append(len(hashes))
                if len(hashes) >= SLICE:
                    yield row(name, ids, learns, ends, hashes)
                    name, ids, learns, ends, hashes = name + 1, [], [], [], []
        if ids:
            yield row(name, ids, learns, ends, hashes)

    return docs.mapInArrow(tidy(task), "slice long, n long, ids array<long>, learns array<boolean>, ends array<long>, words binary, tokens binary")


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(32))
    x = (x + y) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC2B2AE3D27D4EB4F)


class Slice:
    """A slice's tokens; which of its different n-grams ends at each token, from the place where its text has so many words."""

    def __init__(self, row: dict):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        self.name, self.ids = row["slice"], row["ids"]
        self.words, self.tokens = _numbers(unpack(row["words"]), "<u8"), _numbers(unpack(row["tokens"]), "<u4")
        self.ends = np.array(row["ends"], np.int64)
        sizes = np.diff(self.ends, prepend=0)
        self.learns = np.repeat(np.array(row["learns"], bool), sizes)
        #: Place of each token in its text.
        self.place = np.arange(len(self.tokens)) - np.repeat(self.ends - sizes, sizes)
        hashes = self.words[self.tokens]
        self.two_at = np.flatnonzero(self.place >= 1)
        self._pairs = _mix(hashes[self.two_at - 1], hashes[self.two_at])
        self.two, self.two_of = np.unique(self._pairs, return_inverse=True)
        self._hashes = hashes

    def three(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, keys, of): tokens whose trigram is asked for, the different trigrams, and which of them ends at each.

        ``known`` are the answers for bigrams: twice the count in training texts, and one more if a text that only is scored has it.
        """
        at = np.flatnonzero(self.place >= 2)
        before = np.zeros(len(self.tokens), np.int64)
        before[self.two_at] = known[self.two_of]
        context = before[at - 1]
        at = at[np.where(self.learns[at], context >= 3, context >= 2)]
        pairs = np.zeros(len(self.tokens), np.uint64)
        pairs[self.two_at] = self._pairs
        keys, of = np.unique(_mix(pairs[at - 1], self._hashes[at]), return_inverse=True)
        return at, keys, of

    def asks(self, kind: int, keys: np.ndarray, of: np.ndarray, learns: np.ndarray, bits: int):
        """A row for each bucket: the keys, ascending, with twice the training count of each, and one more for texts only scored."""
        n = len(keys)
        counts = 2 * np.bincount(of[learns], minlength=n) + (np.bincount(of[~learns], minlength=n) > 0)
        cuts = np.concatenate((np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64), [n]))
        sent = _planes(keys << np.uint64(bits)).reshape(8, -1)[2:] if n else None
        told = _planes(counts.astype("<u8"))
        rows = [(kind, b, self.name, int(j - i), sent[:, i:j].tobytes() + told[:, i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASK)] if rows else [pa.array([], f.type) for f in _ASK], schema=_ASK)


def _totals(bodies: list[bytes], sizes: np.ndarray) -> tuple[list[bytes], int, int]:
    """The answer to each ask of one bucket; the sum of all training counts, and how many keys have one."""
    keys = np.concatenate([_numbers(x[: KEY_BYTES * n], KEY) for x, n in zip(bodies, sizes)])
    counts = np.concatenate([_numbers(x[KEY_BYTES * n :], "<u8") for x, n in zip(bodies, sizes)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    runs = np.diff(np.append(heads, len(keys)))
    del keys
    learnt = np.add.reduceat(counts >> 1, heads)
    total = 2 * learnt + (np.add.reduceat(counts & 1, heads) > 0)
    back = np.empty(len(counts), "<u8")
    back[order] = np.repeat(total, runs)
    ends = np.cumsum(sizes)
    return [_planes(back[e - n : e]).tobytes() for e, n in zip(ends, sizes)], int(learnt.sum()), int((learnt > 0).sum())


def _answers(asked: DataFrame, rows: int) -> DataFrame:
    """Each ask's totals over all slices, in its own order. Rows with slice -1 say how many keys of each bucket have a count, and their sum."""

    def task(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        kinds, buckets, names, sizes = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(4))
        bodies = [x for b in parts for x in b.column("body").to_pylist()]
        del parts
        # one bucket at a time: what is unpacked and sorted at once is a bucket's, however many a task has
        order = np.lexsort((buckets, kinds))
        cuts = np.flatnonzero((np.diff(kinds[order]) != 0) | (np.diff(buckets[order]) != 0)) + 1
        for own in np.split(order, cuts):
            told, learnt, some = _totals([bodies[i] for i in own], sizes[own])
            for i in own:
                bodies[i] = None
            kind, bucket = int(kinds[own[0]]), int(buckets[own[0]])
            out = [(kind, bucket, int(names[i]), int(sizes[i]), body) for i, body in zip(own, told)]
            out.append((kind, bucket, -1, some, np.array([learnt], "<i8").tobytes()))
            del told
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASK)], schema=_ASK)

    n = partitions(asked.sparkSession, rows, 2 * BUCKET)
    return asked.repartition(n, "kind", "bucket").mapInArrow(tidy(task), _DDL)


def _told(cut: DataFrame, *answers: DataFrame) -> DataFrame:
    """Slices with the list of their answers."""
    rows = answers[0]
    for x in answers[1:]:
        rows = rows.unionByName(x)
    lists = rows.where("slice >= 0").groupBy("slice").agg(F.collect_list(F.struct("kind", "bucket", "body")).alias("told"))
    return cut.join(lists, "slice")


def _read(told: list[dict], kind: int) -> np.ndarray:
    parts = [_numbers(x["body"], "<u8") for x in sorted(told, key=lambda x: x["bucket"]) if x["kind"] == kind]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _rows(batches):
    """Rows of batches, one after another: a slice's arrays are large."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def score(ws: Workspace, docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text; those where ``learns`` is true are trained on.

    Null and empty texts are one end. Rows that repeat an identifier or a text come back each, and count each. A null ``learns`` is
    false; extra columns are ignored. Without training texts every token is unseen and has probability one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # about four slices to a bucket; their answers come to them
    cut = ws.save_by(slices(docs), "slices", "slice", partitions(spark, chars, 24 * SLICE))
    tokens = cut.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (-(-tokens // BUCKET) - 1).bit_length())

    def short(batches):
        for row in _rows(batches):
            own = Slice(row)
            yield own.asks(WORD, own.words, own.tokens, own.learns, bits)
            yield own.asks(TWO, own.two, own.two_of, own.learns[own.two_at], bits)

    def long(batches):
        for row in _rows(batches):
            own = Slice(row)
            at, keys, of = own.three(_read(row["told"], TWO))
            yield own.asks(THREE, keys, of, own.learns[at], bits)

    first = ws.save(_answers(cut.mapInArrow(tidy(short), _DDL), 2 * tokens), "answers-short")
    ws.settle()
    second = ws.save(_answers(_told(cut, first.where(F.col("kind") == TWO)).mapInArrow(tidy(long), _DDL), tokens), "answers-long")
    ws.settle()
    known = first.where((F.col("slice") < 0) & (F.col("kind") == WORD)).select("n", "body").collect()  # a row for each bucket
    v, n = sum(r["n"] for r in known), sum(int.from_bytes(r["body"], "little") for r in known)
    total = n + ADD * (v + 1)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema = pa.schema(fields)

    def walk(batches):
        for row in _rows(batches):
            own = Slice(row)
            word = (_read(row["told"], WORD) >> 1)[own.tokens]
            answer = _read(row["told"], TWO)
            pair, triple = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            pair[own.two_at] = answer[own.two_of] >> 1
            # what a training text has after a context of its own alone
            triple[(own.place >= 2) & own.learns] = 1
            at, _, of = own.three(answer)
            triple[at] = _read(row["told"], THREE)[of] >> 1
            p = (word + ADD) / total
            base = np.log10(p)
            best = base.copy()
            # arcs of the state of one word, then of two; where there is none the failure arc's weight, then the shorter state's arc
            for count, context, where in ((pair, word, own.place >= 1), (triple, pair, own.place >= 2)):
                i = np.flatnonzero(where)
                c, h = count[i], context[i - 1]
                best[i] = np.where(c > 0, np.log10((c + PRIOR * p[i]) / (h + PRIOR)), np.log10(PRIOR / (h + PRIOR)) + best[i])
                p[i] = (c + PRIOR * p[i]) / (h + PRIOR)
            starts = np.concatenate(([0], own.ends[:-1]))
            sums = [np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64), base, best)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((own.ids, own.ends - starts, *sums), fields)], schema=schema)

    out = _told(cut, first, second).mapInArrow(tidy(walk), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, learnt from unless it is held out."""
    with Workspace(spark, "op10") as ws:
        out = score(ws, table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
        return ws.result(out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
