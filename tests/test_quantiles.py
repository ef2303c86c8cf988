"""Quantiles by refined histograms against sorted values."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.operators import metrics as M


@pytest.mark.parametrize("bins", [16, 1024])
def test_quantiles_match_sorted_values(spark, bins):
    r = random.Random(4)
    rows = [("even", float(k)) for k in range(101)] + [("same", 7.0)] * 50 + [("one", -3.5)] + [("none", None)] * 3 + [(None, 1.0), (None, 2.0)]
    rows += [("skew", 10.0 ** r.uniform(-12, 12)) for _ in range(400)] + [("many", float(r.choice([1, 1, 1, 2, 3]))) for _ in range(500)] + [("many", None)]
    df = spark.createDataFrame([(g, v, 1, 2.0) for g, v in rows], "g string, v double, n int, lo double").repartition(4)
    ps = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {x["g"]: x for x in M.quantiles(df, "v", ("g",), ps, bins).collect()}
    for g in {g for g, _ in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == sum(k == g for k, _ in rows)
        if own:
            assert got[g]["q"] == pytest.approx(np.quantile(own, ps).tolist(), rel=1e-12), g
        else:
            assert got[g]["q"] is None
    every = sorted(v for _, v in rows if v is not None)
    assert M.quantiles(df, "v", (), (0.5,), bins).first()["q"][0] == pytest.approx(np.quantile(every, 0.5))
    assert M.quantiles(df.limit(0), "v", ("g",)).collect() == []
