from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing, similar, simhash
from textloom.llm.common import Workspace
from textloom.llm.components import components

from .helpers import frame, prose, texts


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x0bé日", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_pairs_within_four_bits_meet():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    y = x.copy()
    for _ in range(4):
        y ^= np.int64(1) << rng.integers(0, 64, len(x)).astype(np.int64)
    met, rows = np.zeros(len(x), bool), 0
    for p in range(3):
        row, at, asks = simhash.anchors(x, p)
        assert asks.sum() == len(x) and len(np.unique(np.stack([row, at]), axis=1)[0]) == len(row)
        nearest = np.zeros(len(x), np.int64)
        nearest[row[asks]] = at[asks]
        row, at, _ = simhash.anchors(y, p)
        rows += len(row)
        met[row[at == nearest[row]]] = True
    assert met.all() and rows <= 190 * len(x)


@pytest.mark.parametrize("n", [2_000, 20_000, 200_000])
def test_lists_stay_short_and_rows_grow_with_the_values(n):
    """At ten and a hundred times the values an asker meets few others, and each value still has 184 rows."""
    fp = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    row, at, asks = simhash.anchors(fp, 1)
    _, of, size = np.unique(at, return_inverse=True, return_counts=True)
    assert abs(len(row) / n - 61.2) < 1
    assert size[of[asks]].mean() < 1.1 + 4 * n * 61.2 / 2**24


def closure(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


@pytest.mark.parametrize("at_once", [1, simhash.AT_ONCE])
def test_near_duplicates_match_brute_force(spark, at_once):
    """With one value at once every anchor is dealt over chunks."""
    rows = texts()
    with Workspace(spark, "t") as ws:
        got = sorted((r["doc_id"] or -1, r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(ws, frame(spark), at_once=at_once).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = closure([i for i, _ in rows], fps)
    assert got == sorted((i or -1, f, want[k]) for k, ((i, _), f) in enumerate(zip(rows, fps)))


def shingles5(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or (bool(a | b) and len(a & b) >= 0.8 * len(a | b))


def similar_roots(rows):
    sets = [shingles5(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return [min((i for (i, _), r in zip(rows, root) if r == own and i is not None), default=None) for own in root]


def variants():
    """Copies of texts with words changed, put in or left out, so that similarities lie on both sides of 0.8."""
    out = []
    for k in range(24):
        w = prose(700 + k // 6, 200 + 40 * (k // 6)).split()
        r = np.random.default_rng(k)
        for at in sorted(r.choice(len(w), k % 6 + 1 if k % 6 else 0, replace=False), reverse=True):
            w[at : at + 1] = [["other"], [], [w[at], "more"]][int(r.integers(3))]
        out.append((200 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("at_once", [3, simhash.AT_ONCE])
def test_similar_documents_match_brute_force(spark, at_once):
    rows = texts() + variants()
    with Workspace(spark, "t") as ws:
        got = Counter((r["doc_id"], r["component_id"]) for r in similar.similar_documents(ws, frame(spark, rows), at_once=at_once).collect())
    assert got == Counter(zip((i for i, _ in rows), similar_roots(rows)))


@pytest.mark.parametrize("per_block", [10, similar.PER_BLOCK])
def test_links_beside_a_forest_that_fails(spark, per_block):
    """Copies with edits around 0.8: nearest fingerprints are often not similar enough, while others of the group are."""
    r = np.random.default_rng(4)
    base, rows = [f"w{x}" for x in r.integers(0, 5000, 120)], []
    for k in range(40):
        w = list(base)
        for at in r.choice(120, 2, replace=False):
            w[at] = f"x{r.integers(0, 5000)}"
        rows.append((k, " ".join(w)))
    with Workspace(spark, "t") as ws:
        got = {x["doc_id"]: x["component_id"] for x in similar.similar_documents(ws, frame(spark, rows), per_block=per_block).collect()}
    assert got == dict(enumerate(similar_roots(rows)))


def test_links_inside_a_group_are_followed_once(spark, monkeypatch):
    """A large group of near copies has many links; after the first components only links between different roots are left."""
    seen, components = [], similar.components
    monkeypatch.setattr(similar, "components", lambda ws, links: (seen.append(links.count()), components(ws, links))[1])
    base, rows = prose(900, 200).split(), []
    for k in range(60):
        w = list(base)
        w[3 * k] = "other"
        rows.append((k, " ".join(w)))
    with Workspace(spark, "t") as ws:
        got = {x["component_id"] for x in similar.similar_documents(ws, frame(spark, rows)).collect()}
    assert got == {0}
    assert seen[0] >= 59 and sum(seen[1:]) == 0


def test_similar_recall():
    """Pairs with a similarity of 0.8 to 0.85 meet at an anchor in nearly all cases, and unrelated ones are never within the radius."""
    r, met, far = np.random.default_rng(8), 0, 0
    for _ in range(300):
        a = r.integers(1, 2**63, 200, dtype=np.uint64)
        b = np.concatenate([a[20:], r.integers(1, 2**63, 20, dtype=np.uint64)])
        fp = np.frombuffer(b"".join(similar.sketch(np.unique(x))[1] for x in (a, b, r.integers(1, 2**63, 200, dtype=np.uint64))), "<u8").reshape(3, -1)
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.82
        ok = False
        for block in range(similar.BLOCKS):
            row, at, nearest = similar.anchors(fp[:2], block)
            ok |= any(bool(set(at[(row == x) & nearest]) & set(at[row == 1 - x])) for x in (0, 1))
        met += ok and similar._apart(fp[0], fp[1]) <= similar.RADIUS
        far += similar._apart(fp[0], fp[2]) <= similar.RADIUS
    assert met >= 0.95 * 300 and not far


def test_forest_is_least():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, (4, similar.WORDS), dtype=np.uint64)
    fp = base[r.integers(0, 4, 60)]
    for row in fp:
        for bit in r.integers(0, 230, r.integers(0, 40)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    d = similar._apart(fp[:, None], fp[None])
    got = similar.forest(fp, np.ones(60, bool))
    pairs, root, want = sorted((int(d[i, j]), i, j) for i in range(60) for j in range(i) if d[i, j] <= similar.RADIUS), list(range(60)), 0
    n = 0
    for x, i, j in pairs:
        if root[i] != root[j]:
            root, want, n = [root[i] if k == root[j] else k for k in root], want + x, n + 1
    assert len(got) == n and sum(int(d[i, j]) for i, j in got) == want


def test_stage_keeps_one_of_each_group(spark):
    df = frame(spark)
    out = similar.stage(spark, df, "")
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns
    assert 1 in kept and 2 not in kept and 4 not in kept and 7 in kept and 8 not in kept
    assert similar.stage(spark, frame(spark, []), "").count() == 0


def test_links_of_dense_values(spark):
    """Many values around a few centres, more to a list than are compared side by side."""
    r = np.random.default_rng(6)
    x = np.repeat(r.integers(-(2**63), 2**63 - 1, 3), 120)
    for _ in range(5):
        x ^= np.int64(1) << r.integers(0, 64, len(x)).astype(np.int64)
    x = np.unique(x)
    with Workspace(spark, "t") as ws:
        got = simhash.links(ws, spark.createDataFrame([(int(v),) for v in x], "fp long")).collect()

    def joined(pairs):
        root = {int(v): int(v) for v in x}
        for a, b in pairs:
            old, new = root[a], root[b]
            if old != new:
                root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k, v in root.items() if v == w) for w in root.values()}

    assert joined((r["a"], r["b"]) for r in got) == joined((int(a), int(b)) for i, a in enumerate(x) for b in x[:i] if ((int(a) ^ int(b)) % 2**64).bit_count() <= 4)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, x) for x in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2030)]
    with Workspace(spark, "t") as ws:
        got = {r["node"]: r["root"] for r in components(ws, spark.createDataFrame(links, "a long, b long")).collect()}
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_fills_without_overlap(counts):
    used = defaultdict(list)
    for s in packing.plan(counts, 64):
        for k in range(s.count):
            used[s.sequence + k // s.each].append((s.offset + k % s.each * s.length, s.length))
    assert sorted(n for v in used.values() for _, n in v) == sorted(n for n, c in counts.items() for _ in range(c))
    for v in used.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64


def least(lengths, capacity):
    """The least number of sequences, by trying all ways; largest pieces first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=9))
def test_plan_is_within_11_ninths_of_the_least(lengths):
    slots = packing.plan(Counter(lengths), 16)
    n = len({s.sequence + k // s.each for s in slots for k in range(s.count)})
    assert n <= 11 / 9 * least(lengths, 16) + 6 / 9 + 1e-9


def test_packing_round_trip(spark):
    tok = pytest.importorskip("tokenizers")
    vocab = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    model, docs = tok.Tokenizer.from_file(vocab), texts()
    with Workspace(spark, "t") as ws:
        cut = ws.save(packing.pieces(frame(spark, docs), vocab, 128, with_ids=True), "p")
        rows = packing.place(cut, 128, per_bucket=2).collect()
        whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.place(cut, 128)).collect()}
    assert all(len(x) <= 128 for x in whole.values())
    seq = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seq[r["sequence_id"]]
        seq[r["sequence_id"]] += r["length"]
    # every row's pieces are there, those of rows that share an identifier or have none as well
    got = Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows)
    want = Counter()
    for i, t in docs:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 128 + 1, len(ids) + 1, 128)]
        want.update((i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert got == want
    with Workspace(spark, "t") as ws:
        assert packing.pack(ws, frame(spark, []), vocab).count() == 0
