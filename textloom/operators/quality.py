"""Data checks: every check is a row (check, failures, passed); reports are counts and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, failures: DataFrame) -> DataFrame:
    """A named check whose failures are the rows of ``failures``; they are counted where they are."""
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("passed"))


def row_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Many conditions of rows in one scan; a null condition is a failure."""
    sums = df.agg(*[F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(n) for n, c in rules.items()])
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in rules])).alias("x")
    return sums.select(parts).select("x.*", (F.col("x.failures") == 0).alias("passed"))


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def null_cells(df: DataFrame) -> DataFrame:
    cols = df.columns
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("nulls")) for c in cols])).alias("x")).select("x.*")


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """Rows beyond the first of each key, keys that have some, and all rows."""
    by = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") > 1).cast("long")).alias("keys"))


def conflicting(df: DataFrame, by: str, value: str) -> DataFrame:
    """Groups that have more than one value; nulls are no value."""
    return df.groupBy(by).agg(F.count_distinct(value).alias("values")).where("values > 1")


def not_in(df: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(col).alias(key)).join(dim.select(key), key, "left_anti")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split."""
    return conflicting(df, group, split)


def shares(df: DataFrame, by: str) -> DataFrame:
    """Counts and percentages as text with one digit; the window sees one row a value."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.format_string("%.1f", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1)))


def pivot_counts(df: DataFrame, by: str, col: str, values: list, total: bool = True) -> DataFrame:
    """Counts by two columns with zeros, and a row total."""
    out = df.groupBy(by).pivot(col, values).count().na.fill(0)
    return out.withColumn("total", sum(F.col(f"`{v}`") for v in values)) if total else out


def with_totals(df: DataFrame, by: str, *aggs: Column) -> DataFrame:
    """Aggregates of each value and of all rows, which are called TOTAL."""
    return df.rollup(by).agg(F.grouping(by).alias("_g"), *aggs).withColumn(by, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(by))).drop("_g")


def exploded_counts(df: DataFrame, col: str, sep: str, out: str) -> DataFrame:
    return df.select(F.explode(F.split(col, sep)).alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report of a few rows as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
