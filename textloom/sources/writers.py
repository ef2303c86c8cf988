"""Sinks: tables by split, delimited text, JSON results, schemas and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import markdown

__all__ = ["by_split", "csv", "json_results", "markdown", "schema_json", "texts"]


def by_split(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """A folder for each split; rows go there by split and hash, so a large split has many files."""
    df.write.mode("overwrite").partitionBy(split).format(fmt).save(path)


def csv(df: DataFrame, path: str) -> None:
    """Delimited text; arrays become texts joined by '|'."""
    flat = [F.array_join(c, "|").alias(c) if t == "array<string>" else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(flat).write.mode("overwrite").csv(path, header=True, escape='"')


def json_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def schema_json(**tables: DataFrame) -> str:
    """The schemas of several tables as one JSON document."""
    return json.dumps({name: json.loads(df.schema.json()) for name, df in tables.items()}, indent=1, sort_keys=True)


def texts(spark, path: str, files: dict[str, str]) -> None:
    """A few small files by name below a folder, on whatever file system its path names."""
    jvm = spark._jvm
    for name, text in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(text.encode("utf-8"))
        out.close()
