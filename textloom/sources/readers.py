"""Sources: delimited text, JSON lines, YAML, whole files, binary documents, and rows that a program makes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: str | StructType, empty_is_null: bool = True) -> DataFrame:
    """Delimited text with a header and a stated schema; nothing is inferred. An empty cell is null, or an empty text."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="", emptyValue="")
    if empty_is_null:
        return df
    return df.select([F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def numbered(df: DataFrame, order: str = "text") -> DataFrame:
    """Rows with numbers 1..n in a stated order: counts of range partitions give each its first number."""
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from pyspark.sql import Window

    counts = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    base = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(base), "_p").withColumn("id", F.col("_i") - F.col("first") + F.col("before") + 1).drop("_p", "_i", "n", "first", "before")


def yaml_rows(spark: SparkSession, text: str, schema: str | StructType, pick: Callable[[object], Iterable[tuple]] = lambda x: [tuple(r.values()) for r in x]) -> DataFrame:
    """Rows of a small YAML document; ``pick`` turns the parsed document into tuples."""
    import yaml

    return spark.createDataFrame(list(pick(yaml.safe_load(text))), schema)


def query_rows(parsed: dict, defaults: dict[str, str]) -> Iterable[tuple]:
    """(branch, fact, query, kind) of a nested document: branches of facts of queries.

    A key "F1+F2" stands for several facts. A query is a text, or a mapping with ``query`` and perhaps ``kind``; what it doesn't say is the
    branch's default. One query instead of a list is a list of one.
    """
    for branch, facts in parsed.items():
        for keys, said in (facts or {}).items():
            for entry in as_list(said):
                entry = entry if isinstance(entry, dict) else {"query": entry}
                for fact in str(keys).split("+"):
                    yield branch, fact.strip(), entry["query"], entry.get("kind", defaults.get(branch, "plain"))


def as_list(value: object) -> list:
    """A scalar, a list or nothing as a list."""
    return [] if value is None else list(value) if isinstance(value, list) else [value]


def located(spans: DataFrame, texts: DataFrame, key: str, text: str = "text", span: str = "span") -> DataFrame:
    """Start and end of each span's first occurrence in its text; a span that isn't there is an error when the row is read."""
    at = F.locate_col(span, text) if hasattr(F, "locate_col") else F.expr(f"locate({span}, {text})")
    rows = spans.join(texts, key)
    start = F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("span not in text: "), F.col(span))).cast("int"))
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length(span))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Text files below topic folders: topic, name (from the file's stem), text."""
    file = F.col("_metadata.file_path")
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1), r"[_-]+|%20", " ")
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return df.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("topic"), F.initcap(stem).alias("name"), F.col("value").alias("text"))


def binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes with their kind by the first bytes and their digest."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", kind_of(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def kind_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "docx").when(F.lower(F.substring(content, 1, 512).cast("string")).rlike("<html|<!doctype"), "html").otherwise("text")


def document_text(text: Column, encoded: Column) -> Column:
    """A document's text as given, or decoded from base64 where it is plain text."""
    return F.coalesce(text, F.decode(F.unbase64(encoded), "UTF-8"))


def method_label(kind: Column, pages: Column, ocr_pages: Column) -> Column:
    """How a document's text was got."""
    return F.when(kind == "html", "html").when(F.coalesce(ocr_pages, F.lit(0)) == 0, "pdf_text").when(ocr_pages >= pages, "pdf_ocr").otherwise("pdf_text+ocr")


class RecordSource(DataSource):
    """Rows of an in-process service for tests and for services whose records a callable gives: options ``count`` and ``parts``.

    A real service subclasses this and overrides ``rows``; each partition asks for its own range, so a lost task asks again.
    """

    @classmethod
    def name(cls) -> str:
        return "textloom_records"

    def schema(self) -> str:
        return "id long, name string, ok boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Records(int(self.options.get("count", 10)), int(self.options.get("parts", 2)))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Records(DataSourceReader):
    def __init__(self, count: int, parts: int):
        self.count, self.parts = count, max(1, parts)

    def partitions(self):
        step = -(-self.count // self.parts)
        return [_Range(i, min(self.count, i + step)) for i in range(0, self.count, max(1, step))]

    def read(self, part: _Range):
        for i in range(part.first, part.last):
            yield i, f"record {i}", True


def contract_errors(df: DataFrame, required: dict[str, str]) -> list[str]:
    """What a partner's table lacks: columns and types that were agreed on."""
    have = dict(df.dtypes)
    return [f"{c}: {'missing' if c not in have else have[c] + ' is not ' + t}" for c, t in required.items() if have.get(c) != t]
