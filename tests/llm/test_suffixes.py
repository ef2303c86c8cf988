from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import suffix_dedup
from textloom.llm.common import Workspace
from textloom.llm.induced import suffixes

from .helpers import frame, prose, texts


def naive(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])

    def common(a, b):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        return k

    return order, [0, *(common(a, b) for a, b in zip(order, order[1:]))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 3), st.sampled_from([64, 1 << 28]))
def test_suffix_array_and_common_prefixes(t, times, memory):
    t = t * times
    order, common = naive(t)
    a, b = suffixes(np.array(t), cap=10**6, memory=memory)  # little memory: queues are mapped files
    assert (a.tolist(), b.tolist()) == (order, common)


def test_large_alphabet_and_empty():
    t = [random.Random(1).randrange(500) for _ in range(2000)] * 2
    assert suffixes(np.array(t), cap=10**6)[0].tolist() == naive(t)[0]
    assert suffixes(np.zeros(0, np.int64), cap=4)[0].tolist() == []


def brute(rows, length):
    at = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        cut = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if at[b[k : k + length]] > 1:
                cut[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, "u1")[~cut])
        out.append((i if i is not None else -1, len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def ours(spark, rows, length, crowd, **more):
    docs = suffix_dedup.keyed(frame(spark, rows))
    with Workspace(spark, "t") as ws:
        spans = suffix_dedup.repeated_spans(ws, docs, length, crowd, **more)
        return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in suffix_dedup.digests(docs, spans).collect())


@pytest.mark.parametrize("crowd", [4096, 1])
def test_matches_brute_force(spark, crowd):
    """With a crowd of one every anchor is dealt anew, down to single windows."""
    rows = texts() + [(100 + k, prose(50, 30) + prose(200 + k, 20) + prose(51, 30)) for k in range(6)]
    for length in (400, 70) if crowd > 1 else (120,):
        assert ours(spark, rows, length, crowd) == brute([(i, (t or "").encode()) for i, t in rows], length)


def test_shards_far_larger_than_memory(spark, tmp_path, monkeypatch):
    """Queues of 64 bytes: every array of a sort is a file, and the result is the same."""
    rows = texts() + [(100 + k, prose(50, 30) + prose(200 + k, 20) + prose(51, 30)) for k in range(6)]
    assert ours(spark, rows, 120, 4096, memory=64) == brute([(i, (t or "").encode()) for i, t in rows], 120)


def test_stage_takes_passages_of_over_fifty_words(spark):
    """Passages of 51 to 60 words, in different places of different documents, go by the bytes that brute force takes."""
    rows = [(k, f"{prose(300 + k, 40 + k)} {prose(400 + k // 2, 51 + k // 2)} {prose(500 + k, 30)}") for k in range(20)]
    rows += [(None, prose(600, 80)), (30, None), (31, ""), (32, prose(601, 70)), (32, prose(602, 70))]
    out = suffix_dedup.stage(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, rows).columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in out.collect())
    kept = sorted((i, h) for i, _, _, _, h in brute([(i, (t or "").encode()) for i, t in rows], suffix_dedup.PASSAGE))
    assert [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got] == kept
    for k in range(20):
        text = next(t for i, t in got if i == k)
        assert prose(400 + k // 2, 51 + k // 2)[10:-10] not in text and text.startswith(prose(300 + k, 39 + k))


def test_stage_rewrites_texts(spark):
    out = {r["doc_id"]: r for r in suffix_dedup.stage(spark, frame(spark), "").collect()}
    assert out[2]["text"] == "" and out[2]["n_chars"] == 0
    assert out[7]["text"] is None and out[10]["text"] == "one two"
    assert out[5]["text"].startswith(prose(4, 60)) and len(out[5]["text"]) < len(texts()[4][1])
    assert suffix_dedup.stage(spark, frame(spark, []), "").count() == 0


def test_windows_without_a_partner_are_not_sorted():
    """Runs of one anchor that differ beside it: what is left has all windows that two runs share, and few others."""
    r, length = np.random.default_rng(5), 60
    rows = []
    for k in range(40):
        base = r.integers(97, 123, 160, dtype=np.uint8)
        for _ in range(3):
            text = base.copy()
            text[r.integers(0, 160, 2)] = 33 + r.integers(0, 9, 2)
            first, n, key, _, _ = suffix_dedup.runs(text, length)
            rows += [(int(h), text[f : f + m - 1 + length].tobytes(), int(m)) for f, m, h in zip(first, n, key)]
    rows.sort()
    keys, texts, n = (list(x) for x in zip(*rows))
    low, high = suffix_dedup.narrowed(texts, np.array(n), np.array(keys, np.uint64), np.ones(len(n), bool), length)
    seen = Counter(w for t, m in zip(texts, n) for w in {t[i : i + length] for i in range(m)})
    shared = [[i for i in range(m) if seen[t[i : i + length]] > 1] for t, m in zip(texts, n)]
    assert any(shared) and all(a <= i < z for own, a, z in zip(shared, low, high) for i in own)
    assert sum(high - low) < 1.3 * sum(map(len, shared)) < 0.7 * sum(n)
