"""Parsing of documents into fields with provenance, mentions of known names, and carried context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small
from .names import places
from .sequences import forward_fill


def labelled(text, label: str):
    """The value after ``label:`` at the start of a line; the first one, null if there is none."""
    found = F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]*[:\-][ \t]*(.+?)[ \t]*$", 1)
    return F.when(found != "", found)


def parse(docs: DataFrame, key: str, text: str, fields: dict[str, str], inferred: dict | None = None) -> DataFrame:
    """Fields by label, else by the expression in ``inferred``; where they come from; the share of fields that were found."""
    cols, labels = {}, []
    for name, label in fields.items():
        own = labelled(F.col(text), label)
        labels.append(own.isNotNull())
        cols[name] = F.coalesce(own, (inferred or {}).get(name, F.lit(None).cast("string")))
    out = docs.select(key, *[c.alias(n) for n, c in cols.items()], *[x.alias(f"_l{i}") for i, x in enumerate(labels)])
    every, some = F.lit(True), F.lit(False)
    for i in range(len(labels)):
        every, some = every & F.col(f"_l{i}"), some | F.col(f"_l{i}")
    found = sum(F.col(n).isNotNull().cast("int") for n in fields)
    out = out.withColumn("provenance", F.when(every, "labelled").when(some, "mixed").otherwise("inferred")).withColumn("parse_confidence", F.round(found / len(fields), 4))
    return out.drop(*[f"_l{i}" for i in range(len(labels))])


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, name, start) of all places of known names in texts, longest first, none inside another."""
    return places(docs, key, text, names, overlaps=False)


def sections(rows: DataFrame, by: list[str], order: list[str], head: str) -> DataFrame:
    """Every row with the last header before it."""
    return forward_fill(rows, by, order, {head: "_h"}).withColumn(head, F.col("_h")).drop("_h")


def canonical(tokens: DataFrame, names: DataFrame, token: str = "token", name: str = "name", out: str = "canonical") -> DataFrame:
    """Tokens in the spelling of a list of names, or with a capital where the list has none."""
    known = names.select(F.lower(name).alias("_k"), F.col(name).alias("_c")).groupBy("_k").agg(F.min("_c").alias("_c"))
    rows = tokens.join(small(known), F.lower(token) == F.col("_k"), "left")
    return rows.withColumn(out, F.coalesce("_c", F.concat(F.upper(F.substring(token, 1, 1)), F.expr(f"substring({token}, 2)")))).drop("_k", "_c")


def page_chunks(docs: DataFrame, key: str, text: str, marker: str, size: int = 220, step: int = 200, least: int = 30) -> DataFrame:
    """(key, part, n_words, chunk): pages between markers where a text has some, else windows of words; under ``least`` words they go."""
    from ..functions.text import windows

    clean = lambda t: F.filter(F.split(t, r"[ \t\r\n]+"), lambda w: w != "")
    pages = F.transform(F.split(F.col(text), marker), clean)
    parts = F.when(F.col(text).rlike(marker), pages).otherwise(windows(clean(F.coalesce(F.col(text), F.lit(""))), size, step))
    rows = docs.select(key, F.posexplode(parts).alias("part", "w"))
    return rows.where(F.size("w") >= least).select(key, "part", F.size("w").alias("n_words"), F.array_join("w", " ").alias("chunk"))


def field_accuracy(sheets: DataFrame, key: str, text: str, gold: dict[str, str], fields: dict[str, str], transforms: dict) -> DataFrame:
    """(transform, field, n, accuracy): how often each field is found again, whatever its case, after each change of the text."""
    out = None
    for name, change in transforms.items():
        parsed = parse(sheets.select(key, change(F.col(text)).alias(text)), key, text, fields).join(sheets.select(key, *[F.col(c).alias(f"_g_{f}") for f, c in gold.items()]), key)
        same = lambda f: F.coalesce(F.lower(f) == F.lower(F.col(f"_g_{f}").cast("string")), F.lit(False)).cast("double")
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), same(f).alias("hit")) for f in fields])).alias("x")
        part = parsed.select(F.lit(name).alias("transform"), cells).select("transform", "x.*")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("transform", "field").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))
