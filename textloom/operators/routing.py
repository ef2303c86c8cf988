"""Classification by rules and keywords, confidence bands, rejection, routing and decisions; the request pipeline is in ``plans``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = "out_of_scope"


def reject(label: Column, p: Column, threshold: float) -> Column:
    """Open-set rejection: a probability under the threshold, not at it, is out of scope."""
    return F.when(p < threshold, OUT).otherwise(label)


def best_label(probs: DataFrame, key: str = "row_id", without: tuple[str, ...] = ()) -> DataFrame:
    """The most probable label of each row, some labels left out; of equal ones the first by name."""
    rows = probs.where(~F.col("label").isin(*without)) if without else probs
    # the order of names turns with the sign, so compare characters by their complement
    best = F.min_by(F.struct("label", "p"), F.struct(-F.col("p"), F.col("label")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def band(p: Column, high: float = 0.75, medium: float = 0.5) -> Column:
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in keywords], F.lit(0))


def route(text: Column, rules: dict[str, list[str]]) -> Column:
    """(label, score, p): the label with most keywords, the first of equal ones; none where no keyword occurs. p is the softmax share."""
    scores = [F.struct((-keyword_score(text, ws)).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("label")) for i, (name, ws) in enumerate(rules.items())]
    best = F.array_min(F.array(*scores))
    share = F.exp(-best["n"].cast("double")) / reduce(lambda a, b: a + b, [F.exp(-s["n"].cast("double")) for s in scores])
    return F.struct(F.when(best["n"] < 0, best["label"]).otherwise(F.lit(OUT)).alias("label"), (-best["n"]).alias("score"), F.round(share, 6).alias("p"))


def ranked_labels(text: Column, rules: dict[str, list[str]], k: int) -> Column:
    """The k labels with most keywords as (label, score, p), the first of equal ones by the order of the rules."""
    scores = [F.struct((-keyword_score(text, ws)).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("label")) for i, (name, ws) in enumerate(rules.items())]
    z = reduce(lambda a, b: a + b, [F.exp(-s["n"].cast("double")) for s in scores])
    return F.transform(F.slice(F.array_sort(F.array(*scores)), 1, k), lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("score"), F.round(F.exp(-x["n"].cast("double")) / z, 6).alias("p")))


def decide(in_scope: Column, intent_p: Column, route_p: Column, missing: Column, review: float = 0.5) -> Column:
    """Action and reason: reject, clarify, review, ask for details, or route."""
    two = lambda x: F.format_string("%.2f", x)
    action = F.when(~in_scope, "reject").when(intent_p < 0.3, "clarify").when(route_p < review, "human_review").when(missing > 0, "request_details").otherwise("auto_route")
    reason = F.when(~in_scope, "outside the known topics").when(intent_p < 0.3, F.concat(F.lit("topic unclear, confidence "), two(intent_p)))
    reason = reason.when(route_p < review, F.concat(F.lit("routing confidence "), two(route_p), F.lit(" is under "), F.lit(f"{review:.2f}")))
    reason = reason.when(missing > 0, F.concat(missing.cast("string"), F.lit(" details are missing"))).otherwise(F.concat(F.lit("routing confidence "), two(route_p)))
    return F.struct(action.alias("action"), reason.alias("reason"))


def candidates(probs: DataFrame, allowed: Column, key: str = "row_id") -> DataFrame:
    """Labels that are allowed, or all of a row's where none is."""
    w = Window.partitionBy(key)
    return probs.withColumn("_a", allowed).withColumn("_any", F.max("_a").over(w)).where(F.col("_a") | ~F.col("_any")).drop("_a", "_any")


def validate(df: DataFrame, text: str = "text", most: int = 1000, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds ``error``: null where a row is valid. Length counts before trimming, blanks after; a null option is its default."""
    error = F.when(F.col(text).isNull() | (F.trim(text) == ""), "blank").when(F.length(text) > most, "too long")
    for c, (low, high) in (ranges or {}).items():
        error = error.when(~F.coalesce(F.col(c).between(low, high), F.lit(True)), f"{c} out of range")
    return df.withColumn("error", error)


def eligibility(checks: Column) -> Column:
    """Status from an array of checks (rule, status, kind): a failed requirement decides, warnings never do."""
    has = lambda s, k: F.exists(checks, lambda c: (c["status"] == s) & (c["kind"] == k))
    return F.when(has("fail", "requirement"), "not_eligible").when(has("unknown", "requirement"), "needs_review").when(F.exists(checks, lambda c: c["status"] == "partial"), "conditional").otherwise("eligible")
