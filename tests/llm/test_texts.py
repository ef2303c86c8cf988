from __future__ import annotations

import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import chat, compact, decontaminate, lm, quality, sstable, toxicity
from textloom.llm.common import Workspace
from textloom.llm.tokens import Encoder

from .helpers import frame, prose, texts


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


# token output


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_is_the_library(vocab):
    from tokenizers import Tokenizer

    model, enc = Tokenizer.from_file(vocab), Encoder(vocab, cache=50)
    odd = ["", None, "a\x1cb\x85c\xa0d", "it's 12²½ ǅ_–… ñ日!? \x00\x7f\xad", "x  \n\n y\t\r\n", "<|endoftext|>", "don't'll"]
    for t in odd + [t for _, t in texts()]:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == [*model.encode(t or "", add_special_tokens=False).ids, 0]


def test_shards_round_trip(spark, vocab, tmp_path):
    docs = texts()
    shards = sstable.write(frame(spark, docs), f"file://{tmp_path}/out", vocab, per_shard=4)
    rows = sstable.read(spark, f"file://{tmp_path}/out", shards).orderBy("start").collect()
    assert sum(s["entries"] for s in shards) == len(docs) == len(rows)
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"])
    enc = Encoder(vocab)
    want = Counter((i, zlib.crc32(e)) for (i, _), e in zip(docs, enc.encode([t for _, t in docs])))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in sstable.digests(spark, f"file://{tmp_path}/out", shards).collect()) == want
    assert sstable.write(frame(spark, []), f"file://{tmp_path}/none", vocab) == []
    assert sstable.digests(spark, f"file://{tmp_path}/none", []).count() == 0


def test_the_smallest_identifier_is_not_null(spark, vocab, tmp_path):
    docs = [(None, "none"), (-(2**63), "least"), (2**63 - 1, "most"), (None, "none again")]
    shards = sstable.write(frame(spark, docs), f"file://{tmp_path}/out", vocab, per_shard=100)
    rows = sstable.read(spark, f"file://{tmp_path}/out", shards).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, -(2**63), 2**63 - 1]
    f = io.BytesIO()
    w = sstable.Writer(f)
    for i, d in enumerate((None, -(2**63), 5)):
        w.add(sstable.key(d), i, np.arange(2))
    w.close()
    r = sstable.Reader(f, len(f.getvalue()))
    assert [[s for s, _ in r.get(d)] for d in (None, -(2**63), 5, 6)] == [[0], [1], [2], []]


def test_lookup_in_one_shard():
    f = io.BytesIO()
    w = sstable.Writer(f, block=200)
    for i in range(-50, 50):
        w.add(sstable.key(3 * i), i + 50, np.arange(5) + i + 50)
    w.close()
    r = sstable.Reader(f, len(f.getvalue()))
    assert len(r.index) > 5
    for i in range(-50, 50):
        assert r.get(3 * i)[0][0] == i + 50 and r.get(3 * i)[0][1].tolist() == list(range(i + 50, i + 55))
        assert r.get(3 * i + 1) == []
    with pytest.raises(ValueError, match="ascend"):
        w = sstable.Writer(io.BytesIO())
        w.add(sstable.key(2), 0, np.arange(2))
        w.add(sstable.key(1), 0, np.arange(2))


# chat


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 600, "ann", "Bye"), (2, 0, "system", "alone"), (3, 0, None, "who?"), (None, 0, "x", "lost")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = chat.rotate(df).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r["conv_id"], r["perspective"]].append(r)
    assert set(seen) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "x")}
    for own in seen.values():
        whole, loss = "", []
        for k, r in enumerate(sorted(own, key=lambda r: r["nth"])):
            assert (r["nth"], r["start"]) == (k, len(whole))
            whole += r["rendered"]
            loss += [(r["loss_start"], r["loss_end"])] if r["loss"] else []
        assert all(whole[a:b].endswith("<|end|>") for a, b in loss) and loss
    ann = "".join(r["rendered"] for r in sorted(seen[1, "ann"], key=lambda r: r["nth"]))
    assert ann == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nBye<|end|>\n"


def test_rotation_of_ties_and_repeated_rows(spark):
    """Messages that share a turn go by speaker and text, repeated rows are messages, a null turn comes first; an empty table has none."""
    kinds = "conv_id long, turn long, role string, text string, start long, loss string"
    rows = [(1, 1, "bob", "b"), (1, 1, "ann", "a"), (1, 1, "ann", "a"), (1, None, "bob", "first"), (1, 1, "ann", "A")]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], kinds)
    own = sorted((r for r in chat.rotate(df).collect() if r["perspective"] == "bob"), key=lambda r: r["nth"])
    said = ["".join(r["rendered"].split("\n")[1:-1]) for r in own]
    assert said == ["first<|end|>", "A<|end|>", "a<|end|>", "a<|end|>", "b<|end|>"]
    assert [r["start"] for r in own] == [sum(len(x["rendered"]) for x in own[:k]) for k in range(5)]
    assert chat.rotate(df.where("false")).count() == 0


# quality


def test_quality_counts(spark):
    with Workspace(spark, "t") as ws:
        got = quality.rate(ws, frame(spark)).collect()
        assert quality.rate(ws, frame(spark, [])).count() == 0
    assert len(got) == len(texts())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in texts():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        c, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered))
        assert want in [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in by[i]], i
        assert all(r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) for r in by[i] if r["n_words"] == len(w))
        assert not any(r["kept"] and r["base_failed"] for r in by[i])


def test_a_small_language_is_not_held_against_others(spark):
    """Under one percent of all words there is no reference; the same texts are judged where their share is larger."""
    rows = [(k, prose(800 + k, 400), "aa") for k in range(60)] + [(100, " ".join(chr(0x3042 + k % 80) * 8 for k in range(70)), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with Workspace(spark, "t") as ws:
        few = {r["doc_id"]: r for r in quality.rate(ws, df).collect()}
        assert few[100]["class_distance"] > quality.FAR_CLASSES and few[100]["kept"]
        odd = df.where("doc_id = 100").withColumn("lang", F.lit("aa"))
        assert [r["kept"] for r in quality.rate(ws, df.where("doc_id < 100").unionByName(odd)).where("doc_id = 100").collect()] == [False]


def test_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([3, 1, 0],), ([0, 0, 5],), ([6, 2, 0],)], "c array<bigint>")
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    got = [r[0] for r in df.select(quality.distance(F.col("c"), total, [3, 1, 0])).collect()]
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(1) and got[2] == pytest.approx(0, abs=1e-6)


# language model


def brute_scores(docs, train):
    tok = lambda t: [*words(t), b"\n"]
    c = Counter()
    for t in map(tok, train):
        for k in (1, 2, 3):
            c.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(context, w):
        if not context:
            return (c[w,] + 0.1) / (n + 0.1 * (v + 1))
        return (c[*context, w] + lm.PRIOR * p(context[1:], w)) / (c[tuple(context)] + lm.PRIOR)

    out = []
    for i, t in docs:
        t = tok(t)
        score = sum(math.log10(p(t[max(0, k - 2) : k], w)) for k, w in enumerate(t))
        out.append((-1 if i is None else i, len(t), sum(c[w,] > 0 for w in t), n, sum(math.log10(p([], w)) for w in t), score))
    return sorted(out)


def scores(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows)


@pytest.mark.parametrize(("cut", "bucket"), [(lm.SLICE, lm.BUCKET), (150, 400)])
def test_language_model_matches_brute_force(spark, cut, bucket, monkeypatch):
    """Small slices and buckets give what one of each gives; contexts that occur once in training are met by scored texts as well."""
    monkeypatch.setattr(lm, "SLICE", cut)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    docs = texts() + [(30, "brand new words only"), (31, "brand new"), (33, "brand new words again"), (32, prose(3, 50)), (34, "zig zag zog"), (35, "zag zog zig"), (36, prose(14, 40) + " " + prose(7, 60))]
    learns = lambda i: (i or 0) % 3 != 0
    with Workspace(spark, "t") as ws:
        df = frame(spark, docs)
        got = scores(lm.score(ws, df, F.col("doc_id") % 3 != 0).collect())
    want = brute_scores(docs, [t for i, t in docs if learns(i)])
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], atol=1e-9)


def test_probabilities_of_a_state_add_up_to_one():
    docs = ["a b a b c", "b a c", "c"]
    c, vocab = Counter(), "abc\n"
    for t in docs:
        t = [*t.split(), "\n"]
        for k in (1, 2, 3):
            c.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    n = sum(x for g, x in c.items() if len(g) == 1)
    p = lambda h, w: (c[*h, w] + lm.PRIOR * p(h[1:], w)) / (c[tuple(h)] + lm.PRIOR) if h else (c[w,] + 0.1) / (n + 0.1 * 5)
    unseen = lambda h: lm.PRIOR / (c[tuple(h)] + lm.PRIOR) * unseen(h[1:]) if h else 0.1 / (n + 0.1 * 5)
    for h in ([], ["a"], ["a", "b"], ["b", "a"], ["c", "a"]):
        assert sum(p(h, w) for w in vocab) + unseen(h) == pytest.approx(1)


def test_language_model_without_training(spark):
    with Workspace(spark, "t") as ws:
        got = lm.score(ws, frame(spark), F.lit(None).cast("boolean")).collect()
        assert len(got) == len(texts()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in got)
        assert lm.score(ws, frame(spark, []), F.lit(True)).count() == 0


# toxicity


def test_toxicity_held_out(spark):
    bad = ["zzgrunt", "blorfel", "kwexit", "snarvo"]
    docs = [(prose(1000 + k, 80) + (f" {bad[k % 4]} {bad[(k + 1) % 4]} " if k % 4 == 0 else " ") + prose(3000 + k, 40), int(k % 4 == 0)) for k in range(600)]
    model = toxicity.fit(docs[:450], 0.25)
    assert model == toxicity.fit(docs[:450][::-1], 0.25)
    right = sum((model.score(t) >= 0.3) == bool(y) for t, y in docs[450:])
    assert right >= 140
    rows = toxicity.score(frame(spark), model).collect()
    assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert 0 <= toxicity.fit([], None).score("any text") <= 1
    assert toxicity.fit([("a b c", 0), ("d e f", 0)], None).score("x") < 0.3


def test_toxicity_matches_a_slow_version():
    """Features from a compressor that is built anew for every window."""
    import zstandard

    bad = ["zzgrunt", "blorfel", "kwexit"]
    docs = [(prose(1000 + k, 60) + (f" {bad[k % 3]} " if k % 3 == 0 else " ") + prose(3000 + k, 20), int(k % 3 == 0)) for k in range(240)]
    model = toxicity.fit(docs, 0.3)
    assert all(w.encode() not in model.plain + model.base for w in bad) and any(w.encode()[:5] in model.toxic for w in bad)

    def size(own, window):
        d = zstandard.ZstdCompressionDict(own + model.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for text in (docs[0][0], docs[1][0], "", prose(5, 33), "x " * 50):
        ws = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        own = [b" " + b" ".join(ws[i : i + toxicity.WINDOW]) + b" " for i in range(0, len(ws), toxicity.WINDOW)] or [b""]
        gain = [size(model.plain, w) - size(model.toxic, w) for w in own]
        x = [math.log1p(100 * sum(max(s * g - m, 0) for g in gain) / len(gain)) for s in (1, -1) for m in toxicity.MARGINS]
        x += [math.log1p(max(0, *gain, 0)), sum(gain) / len(gain)]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_dictionaries_of_another_format_are_refused(monkeypatch):
    import zstandard

    class Odd:
        def as_bytes(self):
            return b"another format"

    monkeypatch.setattr(zstandard, "train_dictionary", lambda *a, **b: Odd())
    with pytest.raises(ValueError):
        toxicity._trained(100, [b"some sample"])


# decontamination


def brute_leaks(docs, items):
    grams = lambda t: [tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)]
    out = {}
    for i, t in docs:
        for j, q in items:
            a, b = grams(t), grams(q)
            n = min(len(a), len(b))
            if n:
                best = max(sum((x & y).values()) / (n + len(b) - sum((x & y).values())) for k in range(len(a) - n + 1) for x, y in [(Counter(a[k : k + n]), Counter(b))])
                if best >= 0.8 - 1e-12:
                    out[i, j] = round(best, 6)
    return out


def test_decontamination_without_identifiers(spark, tmp_path):
    item = prose(75, 30)
    docs = [(None, f"{prose(76, 20)} {item}"), (None, f"{item} {prose(77, 20)}"), (None, prose(78, 60)), (1, f"{prose(79, 20)} {item}"), (2, prose(80, 60))]
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    with Workspace(spark, "t") as ws:
        got = decontaminate.contaminated(ws, frame(spark, docs), asked).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["similarity"]) for r in got) == [(0, 0, 1.0), (0, 20, 1.0), (1, 20, 1.0)]
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontaminate.stage(spark, frame(spark, docs), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, prose(78, 60)), (2, prose(80, 60))]


def test_fingerprints_of_very_long_items(spark):
    """Counters hold more than 65535 shingles."""
    r = np.random.default_rng(9)
    h = r.integers(-(2**63), 2**63 - 1, 70_000)
    h[:68_000] |= 1 << 7
    got = spark.createDataFrame([(h.tolist(),)], "h array<bigint>").select(decontaminate.fingerprint(F.col("h"), F.size("h"))).first()[0]
    bits = np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    assert got % 2**64 == sum(1 << b for b in range(64) if 2 * bits[b] > len(h))


def test_decontamination_matches_brute_force(spark):
    item = [prose(70, 20), prose(71, 40), prose(72, 12), "too short now", None, "again " * 12]
    w = item[1].split()
    docs = texts() + [
        (40, f"{prose(80, 30)} {item[0]} {prose(81, 30)}"), (41, f"{prose(82, 9)} {' '.join([*w[:39], 'other'])} {prose(83, 9)}"), (42, f"{item[0].upper()} {item[2]}"),
        (43, " ".join(w[:36])), (44, " ".join(w[:20])), (45, item[2]), (45, item[2]), (46, "x again again again again again again again again again again again again again"),
    ]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    with Workspace(spark, "t") as ws:
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(ws, frame(spark, docs), bench).collect()}
        assert got == brute_leaks(docs, [(j, q) for j, q in enumerate(item)])
        assert decontaminate.contaminated(ws, frame(spark, []), bench).count() == 0
        assert decontaminate.contaminated(ws, frame(spark), bench.where("false")).count() == 0


# near passages


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.integers(1, 12))
def test_compact_windows(h, t):
    got = list(zip(*(x.tolist() for x in compact.compact_windows(np.array(h, np.uint64), t))))
    want = []
    for i, v in enumerate(h):
        a = b = i
        while a > 0 and h[a - 1] > v:
            a -= 1
        while b < len(h) - 1 and h[b + 1] >= v:
            b += 1
        if b - a + 1 >= t:
            want.append((a, i, b))
    assert got == want


def test_near_passages(spark):
    shared = prose(90, 70).split()
    edited = [*shared[:35], "other", *shared[36:]]
    docs = texts() + [(50, f"{prose(91, 40)} {' '.join(shared)} {prose(92, 40)}"), (51, f"{' '.join(shared)} {prose(93, 70)}"), (52, f"{prose(94, 10)} {' '.join(edited)} {prose(95, 30)}"), (53, prose(96, 300))]
    with Workspace(spark, "t") as ws:
        got = compact.near_passages(ws, frame(spark, docs)).collect()
        assert compact.near_passages(ws, frame(spark, [])).count() == 0
    linked = {(r["doc_id"], r["class_doc_id"]) for r in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (50, 50), (51, 50), (5, 5), (6, 5)} <= linked
    assert (52, 50) in linked
    assert not {r["doc_id"] for r in got} & {7, 8, 9, 10, 12, 13, 14, 53}
    r = next(r for r in got if (r["doc_id"], r["class_doc_id"]) == (51, 50))
    assert r["start"] == 0 and r["n_words"] >= 50


def test_crowded_minima_are_compared_by_chunks(spark):
    """Many variants of one passage: chunks of two find the classes that one task finds."""
    docs = []
    for k in range(12):
        w = prose(97, 80).split()
        w[5 * (k % 6) + 20] = f"own{k}"
        docs.append((60 + k, f"{prose(110 + k, 20)} {' '.join(w)} {prose(130 + k, 20)}"))
    with Workspace(spark, "t") as ws:
        whole, split = ({(r["doc_id"], r["class_doc_id"]) for r in compact.near_passages(ws, frame(spark, docs), crowd=n).collect()} for n in (compact.CROWD, 2))
    assert whole == split and {(60 + k, 60) for k in range(12)} <= whole


def around(text, other):
    """Both texts' shingles within reach and the place among them, for each shingle that the texts share."""
    a, b = ((compact.shingles(t) >> np.uint64(33)).astype(np.int32) for t in (text, other))
    for x in a[np.isin(a, b)].tolist():
        at = [t.tolist().index(x) for t in (a, b)]
        low = [max(0, p - compact.T + 1) for p in at]
        yield [t[i : p + compact.T] for t, i, p in zip((a, b), low, at)], [p - i for p, i in zip(at, low)]


@pytest.mark.parametrize("edit", range(1, 50))
@pytest.mark.parametrize("kind", ["insertion", "deletion"])
def test_passages_with_an_edit_of_length(edit, kind):
    w = [f"w{k}" for k in range(51)]
    whole, less = w, w[:edit] + w[edit + 1 :]
    a, b = (whole, less) if kind == "deletion" else (less, whole)
    for group, at in around(" ".join(a), " ".join(b)):
        want = compact.alike(group[0], at[0], group[1], at[1]) >= compact.SIMILAR
        assert compact.classes(group, at) == ([0, 0] if want else [0, 1])
        if 5 <= edit <= 45:
            assert want


def test_moved_halves_in_small_and_large_groups():
    w = [f"w{k}" for k in range(50)]
    group, at = list(around(" ".join(w), " ".join(w[25:] + w[:25])))[3]
    assert compact.alike(group[0], at[0], group[1], at[1]) >= compact.SIMILAR
    assert compact.classes(group, at) == [0, 0]
    r = np.random.default_rng(1)
    more = r.integers(1, 2**31 - 1, (1500, 2 * compact.T - 1), dtype=np.int32)
    more[:, compact.T - 1] = group[0][at[0]]
    got = compact.classes([*more, *group], [compact.T - 1] * 1500 + at)
    assert got == [*range(1500), 1500, 1500]


def test_classes_are_those_of_brute_force():
    r = np.random.default_rng(2)
    base = r.integers(1, 2**31 - 1, 2 * compact.T - 1, dtype=np.int32)
    texts_, c = [], compact.T - 1
    for k in range(40):
        x = base.copy() if k % 3 else np.resize(base[c - 2 : c + 3], len(base))
        x[r.choice(len(x), r.integers(0, 30), replace=False)] = r.integers(1, 2**31 - 1)
        x[c] = base[c]
        cut = r.integers(0, 46)
        texts_.append((x[cut:], c - cut) if k % 2 else (x[: len(x) - cut], c))
    group, at = [x for x, _ in texts_], [p for _, p in texts_]
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            if want[i] != want[j] and compact.alike(group[i], at[i], group[j], at[j]) >= compact.SIMILAR - 1e-9:
                a, b = sorted((want[i], want[j]))
                want = [a if v == b else v for v in want]
    assert compact.classes(group, at) == want


def edited(seed, kind):
    """Two texts with one passage of 50 words between words of their own; the second passage has one edit at a random place."""
    r = np.random.default_rng(seed)
    own = lambda k, n: [f"{k}{x}" for x in r.integers(0, 10**9, n)]
    p, at = own("p", 50), int(r.integers(0, 50))
    q = {"substitution": [*p[:at], "other", *p[at + 1 :]], "insertion": [*p[:at], "other", *p[at:]], "deletion": p[:at] + p[at + 1 :]}[kind]
    return [" ".join(own(f"a{i}", 60) + x + own(f"b{i}", 60)) for i, x in enumerate((p, q))]


def best_passage(a, b):
    a, b = ([tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)] for t in (a, b))
    a, b = ([set(x[i : i + compact.T]) for i in range(len(x) - compact.T + 1)] for x in (a, b))
    return max(len(x & y) / len(x | y) for x in a[40:80] for y in b[40:80])


@pytest.mark.parametrize("crowd", [2, compact.CROWD])
def test_recall_against_brute_force(spark, crowd):
    """Of pairs with a passage similarity of 0.8 or more nine of ten are linked, for each kind of edit, and no other pair is."""
    pairs = [(kind, edited(1000 * n + k, kind)) for n, kind in enumerate(("substitution", "insertion", "deletion")) for k in range(60 if crowd > 2 else 10)]
    docs = [(2 * k + i, t) for k, (_, two) in enumerate(pairs) for i, t in enumerate(two)]
    with Workspace(spark, "t") as ws:
        of = defaultdict(set)
        for r in compact.near_passages(ws, frame(spark, docs), crowd=crowd).collect():
            of[r["doc_id"]].add(r["class_doc_id"])
    found, all_ = Counter(), Counter()
    for k, (kind, (a, b)) in enumerate(pairs):
        linked = bool(of[2 * k] & of[2 * k + 1])
        if best_passage(a, b) >= compact.SIMILAR:
            all_[kind] += 1
            found[kind] += linked
        else:
            assert not linked
    print({kind: (found[kind], all_[kind]) for kind in all_})
    assert all(all_[kind] >= 5 and found[kind] >= 0.9 * all_[kind] for kind in ("substitution", "insertion", "deletion"))


def test_buckets_of_a_task_are_answered_one_at_a_time(spark):
    """Four buckets in one task: each is sorted by itself and says its own sum, so a task holds one bucket's keys whatever it is dealt."""
    asked = []
    for bucket in range(4):
        for name in (1, 2):
            keys = np.array([name << 20, 5 << 20, 9 << 20], "<u8") << np.uint64(20)
            asked.append((lm.TWO, bucket, name, 3, bytearray(lm._planes(np.sort(keys))[2:].tobytes() + lm._planes(np.array([2, 5, 1], "<u8")).tobytes())))
    df = spark.createDataFrame(asked, lm._DDL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = lm._answers(df, 1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sums = {r["bucket"]: (r["n"], int.from_bytes(r["body"], "little")) for r in got if r["slice"] < 0}
    assert sums == {b: (3, 6) for b in range(4)}
    assert all(lm._numbers(r["body"], "<u8").tolist() == [2, 9, 1] for r in got if r["slice"] > 0)
