"""Names in texts against a search at every place."""

from __future__ import annotations

import random

import pytest

from textloom.operators import names as N


def brute(text, names):
    t, out = (text or "").lower(), []
    for n in {x.strip().lower() for x in names if x and x.strip()}:
        for i in range(len(t) - len(n) + 1):
            if t.startswith(n, i) and not (i and t[i - 1].isalnum() and n[0].isalnum()) and not (t[i + len(n) : i + len(n) + 1].isalnum() and n[-1].isalnum()):
                out.append((n, i))
    return out


def free(found):
    kept = []
    for n, i in sorted(found, key=lambda x: (-len(x[0]), x[1])):
        if all(i + len(n) <= j or j + len(m) <= i for m, j in kept):
            kept.append((n, i))
    return kept


def data():
    r = random.Random(2)
    syllables = ["o", "man", "ro", "ab", "é", "ab ab", "x", "12", "c++", "ni"]
    names = list({"".join(r.choices(syllables, k=r.randint(1, 3))) + r.choice(["", " one", " two", " man"]) for _ in range(300)}) + ["", "  ", None, "Oman", "ab ab ab"]
    texts = [(k, r.choice([" ", "", ", "]).join(r.choices([n for n in names if n] + syllables, k=r.randint(0, 25)))) for k in range(150)]
    return names, texts + [(900, None), (901, ""), (902, "Romania is not OMAN; oman's, woman oman"), (902, "ab ab ab ab ab"), (None, "oman"), (903, "oman " * 4000)]


@pytest.mark.parametrize("most", [10_000, 5])
@pytest.mark.parametrize("overlaps", [True, False])
def test_all_places(spark, most, overlaps):
    """By the automaton, and by the join for lists that are too long for it."""
    names, texts = data()
    rows = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "k long, text string, name string, start int")
    got = sorted((r["k"] or -1, r["name"], r["start"]) for r in N.places(rows, "k", "text", spark.createDataFrame([(n,) for n in names], "name string"), overlaps=overlaps, most=most).collect())
    found = lambda t: brute(t, names) if overlaps else free(brute(t, names))
    assert got == sorted((i or -1, n, s) for i, t in texts for n, s in found(t))


def test_no_names_or_texts(spark):
    rows, none = spark.createDataFrame([(1, "a b")], "k long, text string"), spark.createDataFrame([], "name string")
    assert N.places(rows, "k", "text", none).collect() == []
    assert N.places(rows.limit(0), "k", "text", spark.createDataFrame([("a",)], "name string")).collect() == []


def test_match_says_how_sure_it_is(spark):
    names = ["Computer Science", "Computer Science and Business Systems", "Computer Engineering", "Civil Engineering", "Data Science"]
    asked = {
        1: "a student of computer science", 2: "COMPUTER SCIENCE and business systems!", 3: "the civil one", 4: "astrophysics", 5: "engineering", 6: None, 7: "science of computers, science",
    }
    rows = spark.createDataFrame(list(asked.items()), "k long, text string")
    got = {r["k"]: (r["best"], r["kind"], r["alternatives"]) for r in N.match(rows, "k", "text", spark.createDataFrame([(n,) for n in names], "name string"), weak=("engineering", "and")).collect()}
    assert got[1][:2] == ("computer science", "exact") and "data science" in got[1][2]
    assert got[2][:2] == ("computer science and business systems", "exact")
    assert got[3] == ("civil engineering", "partial", []) and got[4] == got[5] == got[6] == (None, "none", [])
    assert got[7][1] == "partial" and got[7][0] == "data science" and got[7][2] == ["computer science"]
