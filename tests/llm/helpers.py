"""Small tables with the hard cases: nulls, empty texts, repeated rows, ties, one long text, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, th long, row long, words string, rank int"
VOCAB = [a + b for a in ("ka", "lo", "mi", "ter", "son", "vel", "qua", "bri", "dun", "fes") for b in ("n", "ra", "ste", "do", "mik", "pl", "zu", "ber")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    shared = prose(1, 90)
    near = prose(2, 900).split()
    edited = [*near[:100], "changed", *near[101:]]
    return [
        (1, prose(3, 120)), (2, prose(3, 120)), (3, " ".join(near)), (4, " ".join(edited)), (5, f"{prose(4, 60)} {shared} {prose(5, 60)}"), (6, f"{prose(6, 80)} {shared}"),
        (7, None), (8, ""), (9, " \n\t "), (10, "one two"), (11, "Ünï çödé ñ 日本語 <|endoftext|> 🙂"), (12, "with " * 300), (13, "line\n" * 40), (14, prose(7, 4000)),
        (1, prose(3, 120)), (None, prose(8, 50)), (None, None), (15, prose(9, 30) + "\r\n" + prose(9, 30)), (16, "A$$ b%% #c |d| <e> f&g " * 8),
    ]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "w", 4) for i, t in rows], SCHEMA)
