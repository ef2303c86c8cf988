"""Deterministic text variants and perturbations, samples and splits. Every choice comes from a digest of text and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS, dedupe_key
from ..session import digest_int, small
from .sequences import running


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def casual(text: Column) -> Column:
    """Lower case without end marks, null if that changes nothing."""
    out = F.regexp_replace(F.lower(text), r"[.!?]+$", "")
    return F.when(out != text, out)


def formal(text: Column) -> Column:
    ok = ~F.lower(text).rlike(r"\b(kindly|please|request)\b")
    return F.when(ok, F.concat(F.lit("I would like to request information: "), text))


def polite(text: Column) -> Column:
    lead = F.array(*map(F.lit, ("Please tell me, ", "Could you help: ", "Kindly advise: ")))
    n = digest_int(text, F.lit("polite"))
    return F.when(~F.lower(text).startswith("please"), F.concat(F.element_at(lead, (n % 3 + 1).cast("int")), text))


def mixed(text: Column) -> Column:
    """A polite ending in another language."""
    tail = F.array(*map(F.lit, (", bitte", ", por favor", ", s'il vous plaît")))
    n = digest_int(text, F.lit("mixed"))
    return F.when(F.length(text) <= 120, F.concat(F.regexp_replace(text, r"[.!?]+$", ""), F.element_at(tail, (n % 3 + 1).cast("int"))))


def abbreviate(text: Column) -> Column:
    """Long forms back to their abbreviations, null if there are none."""
    out = F.lower(text)
    for short, whole in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"\b{whole}\b", short)
    return F.when(out != F.lower(text), out)


def typo(text: Column) -> Column:
    """Two neighbouring letters inside the text swapped, at a place that the text's digest names; null for short texts."""
    n = F.length(text)
    j = (digest_int(text, F.lit("typo")) % F.greatest(n - 2, F.lit(1)) + 2).cast("int")
    out = F.concat(F.substring(text, F.lit(1), j - 1), F.substring(text, j + 1, F.lit(1)), F.substring(text, j, F.lit(1)), F.substring(text, j + 2, n))
    return F.when((n >= 8) & (out != text), out)


VARIANTS = {"casual": casual, "abbreviated": abbreviate, "typo": typo, "formal": formal, "polite": polite, "mixed": mixed}


def first_half(text: Column) -> Column:
    w = _words(text)
    return F.array_join(F.slice(w, 1, F.greatest(F.ceil(F.size(w) / 2).cast("int"), F.lit(1))), " ")


def drop_quarter(text: Column) -> Column:
    """Every word but those whose digest says no, about a quarter."""
    kept = F.filter(F.transform(_words(text), lambda w, i: F.when(F.conv(F.substring(F.md5(F.concat_ws("|", w, i.cast("string"))), 1, 8), 16, 10).cast("long") % 4 != 0, w)), lambda w: w.isNotNull())
    return F.array_join(kept, " ")


def shuffled(text: Column) -> Column:
    keyed = F.transform(_words(text), lambda w, i: F.struct(F.md5(F.concat_ws("|", w, i.cast("string"))).alias("k"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["w"]), " ")


PERTURBATIONS = {
    "lower": F.lower,
    "upper": F.upper,
    "no_punctuation": lambda t: F.regexp_replace(t, r"[^\w\s]", ""),
    "no_spaces_around": lambda t: F.trim(t),
    "typo": lambda t: F.coalesce(typo(t), t),
    "first_half": first_half,
    "drop_quarter": drop_quarter,
    "shuffle": shuffled,
    "prefix": lambda t: F.concat(F.lit("hello, "), t),
    "repeat_marks": lambda t: F.regexp_replace(t, r"([.!?])", "$1$1"),
}


def expand(df: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """Up to ``most`` variants of each row, none that equals another text by its key. (key, kind, variant)

    Of equal variants the first by row and kind stays: a window over keys takes the place of a set seen so far.
    """
    made = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col(text)).alias("variant")) for k, f in VARIANTS.items()])
    rows = df.select(key, F.explode(made).alias("v")).select(key, "v.*").where("variant is not null").withColumn("k", dedupe_key(F.col("variant")))
    rows = rows.join(df.select(dedupe_key(F.col(text)).alias("k")), "k", "left_anti")
    first = rows.groupBy("k").agg(F.min(F.struct(key, "kind", "variant")).alias("f")).select("f.*")
    w = Window.partitionBy(key).orderBy(digest_int(F.col(key).cast("string"), F.col("kind")), "kind")
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def group_split(df: DataFrame, group: str, stratum: str, seed: int = 7) -> DataFrame:
    """(stratum, group, split): whole groups, about 70/15/15 in each stratum by digest order; under three groups all train."""
    groups = df.groupBy(group).agg(F.min(stratum).alias(stratum))
    digest = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed))))
    groups = running(groups.withColumn("_d", digest), [stratum], F.substring("_d", 1, 3), ["_d", group], {"_k": None})
    sizes = groups.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    groups = groups.join(small(sizes), F.col(stratum).eqNullSafe(F.col("_s")))
    share = (F.col("_k") - 1) / F.col("_n")
    split = F.when(F.col("_n") < 3, "train").when(share < 0.7, "train").when(share < 0.85, "validation").otherwise("test")
    return groups.withColumn("split", split).drop("_k", "_n", "_d", "_s")
