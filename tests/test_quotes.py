"""Quotes in texts against every pair; what separators may not hide."""

from __future__ import annotations

import random

import pytest

from textloom.operators import quotes as Q
from textloom.queries import retrieval


@pytest.mark.parametrize("most", [1000, 3])
def test_every_quote_in_every_text(spark, most):
    r = random.Random(3)
    docs = [(k, "".join(r.choices("ab", k=r.choice([0, 1, 5, 9, 40, 200])))) for k in range(60)] + [(60, None), (None, "abba"), (7, "aaaa")]
    parts = [t[a : a + n] for _, t in docs if t for n in (1, 3, 7, 8, 9, 30, 31, 32, 60) for a in [r.randrange(len(t))]]
    quotes = [(k, q) for k, q in enumerate([*parts, "", None, "c", "ab" * 40, *parts[:5]])]
    got = Q.holding(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(quotes, "q long, s string"), "q", "s", most)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, {(k, d) for k, q in quotes if q for d, t in docs if t and q in t}))


def test_a_list_beyond_the_bound_is_joined_without_every_string(spark):
    text = bytes(random.Random(1).choices(range(97, 123), k=20_000))
    assert len(Q.keys(text, Q.GRAM, Q.WINDOW)) < 0.1 * len(text) and len(Q.keys(text, Q.GRAM, 1)) > 0.99 * len(text)
    assert all(Q.key(text[a : a + 40])[2] in set(Q.keys(text, Q.GRAM, Q.WINDOW).tolist()) for a in range(0, 19_900, 97))


def test_separators_hide_no_relevant_document(spark, tmp_path):
    """The longest inner word of a quote is cut otherwise in a document that has the same letters."""
    spark.createDataFrame([(1, "see the well-known example here"), (2, "so the wellknown exam ple here"), (3, "well known")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the well-known example"), (1, "The wellknown, ex-ample here"), (2, "?!"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, retrieval.relevant(spark, str(tmp_path)).collect())) == [(0, 1), (0, 2), (1, 1), (1, 2)]
