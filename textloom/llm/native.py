"""Column expressions over words and hashes that several native operators use: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _pairs(x: Column, y: Column, step: int) -> Column:
    """Hash of x[i] and y[i + step] for every i that has both."""
    n = F.greatest(F.size(y) - step, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(y, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def with_grams(df: DataFrame, listed: Column, size: int, name: str) -> DataFrame:
    """Adds ``name``: hashes of the runs of ``size`` (a power of two, or one more) neighbours in a list of words, in order.

    Each step is a column of its own. Written as one expression, each list would be computed as often as the next step names it.
    """
    keep = [F.col(c) for c in df.columns]
    df = df.withColumn("_w1", F.transform(listed, lambda w: F.xxhash64(w)))
    step = 1
    while 2 * step <= size:
        df = df.select(*keep, "_w1", _pairs(F.col(f"_w{step}"), F.col(f"_w{step}"), step).alias(f"_w{2 * step}"))
        step *= 2
    if step < size:
        return df.select(*keep, _pairs(F.col(f"_w{step}"), F.col("_w1"), step).alias(name))
    return df.select(*keep, F.col(f"_w{step}").alias(name))
