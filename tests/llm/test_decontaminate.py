from __future__ import annotations

import random

from pyspark.sql import functions as F

from textloom.llm import decontaminate
from textloom.llm.common import Workspace

from .helpers import frame, prose


def test_plans_stay_small(spark):
    """What the driver holds of a fingerprint: the list of counters was named at each of 64 bits."""
    assert len(str(decontaminate.fingerprint(F.col("h"), F.size("h")))) < 5000


def test_benchmark_is_a_table(spark):
    """A larger benchmark is joined, and not written into the plan as literals: found at its place, whichever side of the bound it is on."""
    passages = [prose(100 + i, 30) for i in range(40)]
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    docs = frame(spark, [(i, f"{prose(500 + i, random.Random(i).randint(0, 20))} {passages[i]} {prose(900 + i, 10)}") for i in range(40)] + [(99, prose(2000, 50))])
    found = []
    for bound in (decontaminate.small, lambda df: df):
        kept, decontaminate.small = decontaminate.small, bound
        try:
            with Workspace(spark, "test") as ws:
                rows = decontaminate.contaminated(ws, docs, bench)
                found.append(sorted(tuple(r) for r in rows.collect()))
        finally:
            decontaminate.small = kept
    assert found[0] == found[1] and [(r[0], r[1]) for r in found[0]] == [(i, i) for i in range(40)]
