"""Assessment by rules: checks with their kind and what they cite, profiles with a confidence, and feeds that are advised on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("requirement", "warning", "information")


def check(rule: str, kind: str, fails: Column, cites: Column, partial: Column | None = None) -> Column:
    """One check of a row: (rule, kind, status, cites). A null condition is unknown; ``cites`` is what the verdict rests on."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    status = F.when(fails.isNull(), "unknown").when(fails, "fail")
    if partial is not None:
        status = status.when(F.coalesce(partial, F.lit(False)), "partial")
    return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), status.otherwise("pass").alias("status"), cites.cast("string").alias("cites"))


def report(checks: DataFrame, column: str = "checks") -> DataFrame:
    """How each rule came out: rule, kind, status, rows, its share of the rule's rows, and how many of them cite something."""
    rows = checks.select(F.explode(column).alias("c")).select("c.*").groupBy("rule", "kind", "status").agg(F.count("*").alias("n"), F.count("cites").alias("cited"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("rule")), 6))


def profile(df: DataFrame, key: str, fields: dict[str, Column], inferred: dict[str, Column] | None = None) -> DataFrame:
    """A profile of each row: each field as declared, else as inferred; which were inferred; the share that is known, inferred ones by half."""
    inferred = inferred or {}
    cols = {n: F.coalesce(c, inferred[n]) if n in inferred else c for n, c in fields.items()}
    guessed = F.filter(F.array(*[F.when(c.isNull() & inferred[n].isNotNull(), F.lit(n)) for n, c in fields.items() if n in inferred] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    known = sum(F.when(c.isNotNull(), 1.0).when(inferred[n].isNotNull() if n in inferred else F.lit(False), 0.5).otherwise(0.0) for n, c in fields.items())
    return df.select(key, *[c.alias(n) for n, c in cols.items()], F.array_join(guessed, "|").alias("inferred"), F.round(known / len(fields), 4).alias("confidence"))


def advise(feed: DataFrame, partner: str, order: list[str], valid: Column, score: Column, most: int = 20) -> DataFrame:
    """For each partner the best of its first ``most`` valid rows, by score, then by order; rows that are not valid are counted."""
    w = Window.partitionBy(partner)
    rows = feed.withColumns({"_ok": F.coalesce(valid, F.lit(False)), "score": F.round(score, 6)})
    bad = rows.groupBy(partner).agg(F.sum((~F.col("_ok")).cast("long")).alias("rejected"), F.count("*").alias("received"))
    first = rows.where("_ok").withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= most)
    best = first.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), *order))).where("_r = 1").select(partner, *order, "score")
    return bad.join(best, partner, "left")
