"""Token counts against the library."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import counts

from .helpers import frame, prose, texts


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both(vocab):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocab)
    return counts.Counter(vocab, cache=200, size=50), lambda t: len(model.encode(t or "", add_special_tokens=False).ids)


ODD = [
    "", None, " ", "a\x1cb\x85c\xa0d", "it's 12²½ ǅ_–… ñ日!? \x00\x7f\xad", "x  \n\n y\t\r\n", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext", "don't'll ''re", "日本語 текст 🙂🙂  ",
    "a" * 3000, "ab" * 2000, " " * 500 + "x", "\n" * 301, "xyz" * 40 + " " + "q" * 5000 + "  end", "-" * 1000, "'" * 333 + "re", "9" * 257,
]


def test_counts_are_the_library_s(both):
    own, library = both
    for t in ODD + [t for _, t in texts()]:
        assert own.count(t) == library(t), (t or "")[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAeé st\n\t'-.,1<|>ñ日🙂 \x1c"), st.characters(codec="utf-8")), max_size=300))
def test_counts_of_any_text(both, text):
    own, library = both
    assert own.count(text) == library(text)


def test_long_pieces_without_spaces(both):
    own, library = both
    r = random.Random(5)
    for letters in ("ab", "etaoinshrdlu", "aeiouéà", "日本語"):
        t = "".join(r.choice(letters) for _ in range(20_000))
        assert own.count(t) == library(t)
    words = (prose(3, 40_000)).split()
    assert own.count("".join(words)) == library("".join(words))


def test_a_symbol_that_comes_about_in_two_ways(tmp_path):
    """The later way may bring up a lower rank, which goes before the other places."""
    from tokenizers import Tokenizer

    letters = "abcd"
    merges = [["b", "c"], ["a", "bc"], ["abc", "ab"], ["abc", "d"], ["a", "b"], ["ab", "c"], ["abcd", "ab"]]
    vocab = {c: i for i, c in enumerate(counts._symbols())}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    told = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges},
    }
    path = tmp_path / "v.json"
    r = random.Random(6)
    for _ in range(20):
        r.shuffle(merges)
        made, order, rest = set(letters), [], list(merges)
        while rest:  # a vocabulary learns a symbol before what is made of it
            i = next(i for i, (a, b) in enumerate(rest) if a in made and b in made)
            order.append(rest.pop(i))
            made.add("".join(order[-1]))
        told["model"]["merges"] = order
        path.write_text(json.dumps(told))
        model, own = Tokenizer.from_file(str(path)), counts.Counter(str(path))
        for _ in range(200):
            t = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
            assert own.count(t) == len(model.encode(t, add_special_tokens=False).ids), (order, t)


def test_counts_over_a_table(spark, vocab, both):
    docs = texts()
    rows = counts.count(frame(spark, docs), vocab, limit=50).collect()
    want = sorted((i or -1, len((t or "").encode()), both[1](t), both[1](t) > 50) for i, t in docs)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert counts.count(frame(spark, []), vocab).count() == 0


def test_other_vocabularies_are_refused():
    other = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        counts.Counter(other)
