"""From raw documents to packed training sequences: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, packing, similar, suffix_dedup, toxicity
from textloom.llm.common import Workspace, table

#: Each takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", similar.stage),
    ("suffix_array_dedup", suffix_dedup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: Compression, suffix sorting and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is in the shared folder and goes at the end."""
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark, "pipeline") as ws:
        for name, stage in STAGES:
            docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.keep(STAGES[-1][0])
    return docs
