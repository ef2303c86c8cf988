"""The request pipeline as one plan over a table of requests: what is invalid or out of scope skips evidence, not the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval, routing
from ..operators.entities import resolve, rule_entities

SCHEMA_VERSION = "1.0"


def analyze(requests: DataFrame, passages: DataFrame, rules: dict[str, list[str]], threshold: float = 0.25, k: int = 3, review: float = 0.5) -> DataFrame:
    """A response for each request (request_id, text).

    request_id, error, label, confidence, level, entities, details (label to texts), sources (array of doc_id, rank, score, relative),
    answer, action, reason, schema_version. Passages: doc_id, text.
    """
    rows = routing.validate(requests)
    routed = rows.withColumn("r", routing.route(F.col("text"), rules))
    routed = routed.select("request_id", "text", "error", routing.reject(F.col("r.label"), F.col("r.p"), threshold).alias("label"), F.col("r.p").alias("confidence"))
    routed = routed.withColumn("level", routing.band(F.col("confidence"))).withColumn("entities", resolve(rule_entities("text")))
    inside = (F.col("label") != routing.OUT) & F.col("error").isNull()
    asked = routed.where(inside).select(F.col("request_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieval.relative(retrieval.ranked(retrieval.overlap(passages, asked), k)).join(passages.select("doc_id", F.col("text").alias("passage")), "doc_id")
    sources = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "relative", "passage")))
    hits = hits.groupBy(F.col("query_id").alias("request_id")).agg(sources.alias("s"))
    out = routed.join(hits, "request_id", "left")
    details = F.map_from_entries(F.transform(F.array_distinct(F.transform("entities", lambda e: e["label"])), lambda x: F.struct(x.alias("label"), F.array_distinct(F.transform(F.filter("entities", lambda e: e["label"] == x), lambda e: e["text"])).alias("texts"))))
    answer = F.when(F.size("s") > 0, F.concat_ws(" ", F.lit("From"), F.concat(F.lit("passage "), F.col("s")[0]["doc_id"].cast("string"), F.lit(":")), F.substring(F.col("s")[0]["passage"], 1, 200)))
    decision = routing.decide(inside, F.col("confidence"), F.coalesce(F.col("s")[0]["relative"], F.lit(0.0)) * F.col("confidence"), F.lit(0), review)
    return out.select(
        "request_id",
        "error",
        "label",
        "confidence",
        "level",
        "entities",
        details.alias("details"),
        F.transform(F.coalesce("s", F.array()), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["rank"].alias("rank"), x["score"].alias("score"), x["relative"].alias("relative"))).alias("sources"),
        answer.alias("answer"),
        decision["action"].alias("action"),
        decision["reason"].alias("reason"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )
