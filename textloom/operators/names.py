"""Known names in texts: all places of all names in one walk over a text, and which name a text means.

Up to ``MOST`` names make an Aho-Corasick automaton that is sent to every task; a longer list meets the texts by a join on first words
instead. Either way a name counts where no letter or digit touches it, in lower case, and every place of it counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that are sent to tasks, and their characters together.
MOST, CHARACTERS = 200_000, 10_000_000

_PLACES = "array<struct<name:string,start:int>>"


def _automaton(names: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for name in names:
        out.add_word(name, name)
    out.make_automaton()
    return out


def walk(automaton, text: str) -> list[tuple[int, str]]:
    """(start, name) of every whole occurrence, by start, then the longest first. ``text`` is in lower case."""
    out, n = [], len(text)
    for end, name in automaton.iter(text):
        start = end + 1 - len(name)
        if not (start and name[0].isalnum() and text[start - 1].isalnum()) and not (end + 1 < n and name[-1].isalnum() and text[end + 1].isalnum()):
            out.append((start, name))
    return sorted(out, key=lambda x: (x[0], -len(x[1])))


def apart(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Places that overlap none of a longer name; of equal lengths the first stays. By start."""
    taken, kept = {}, []
    for start, name in sorted(found, key=lambda x: (-len(x[1]), x[0])):
        # names come from the longest down, so one that overlaps what is taken has its first or last place in it
        if start in taken or start + len(name) - 1 in taken:
            continue
        kept.append((start, name))
        taken.update(dict.fromkeys(range(start, start + len(name))))
    return sorted(kept)


def _rows(found: list[tuple[int, str]]) -> list[dict]:
    return [{"name": name, "start": start} for start, name in found]


def places(docs: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", overlaps: bool = True, most: int = MOST) -> DataFrame:
    """(key, name, start) of every place of every name; without ``overlaps`` none that touches a longer name's. Null and empty ones have none."""
    spark = docs.sparkSession
    listed = names.select(F.lower(F.trim(name)).alias("name")).where("name <> ''").distinct()
    few = listed.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.length("name").cast("long")).alias("chars")).first()
    if few["n"] > most or (few["chars"] or 0) > CHARACTERS:
        return _joined(docs, key, text, listed, overlaps)
    sent = spark.sparkContext.broadcast(_automaton(sorted(r["name"] for r in listed.collect())) if few["n"] else None)

    @F.pandas_udf(_PLACES)
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            found = walk(sent.value, t) if t and sent.value is not None else []
            return _rows(found if overlaps else apart(found))

        return texts.map(one)

    return docs.select(key, F.explode(find(F.lower(F.coalesce(text, F.lit(""))))).alias("x")).select(key, "x.name", "x.start")


def _joined(docs: DataFrame, key: str, text: str, listed: DataFrame, overlaps: bool) -> DataFrame:
    """The same by a join: where a text's word begins, the names that begin with that word may stand."""

    @F.pandas_udf("array<struct<word:string,start:int>>")
    def begin(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"word": w, "start": s} for s, w in _words(t)])

    @F.pandas_udf(_PLACES)
    def free(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: _rows(apart([(x["start"], x["name"]) for x in xs])))

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    starts = rows.select("*", F.explode(begin("_t")).alias("w")).select("_row", "_key", "_t", "w.word", "w.start")
    first = F.udf(lambda name: _words(name)[0][1], "string")
    met = starts.join(listed.select("name", first("name").alias("word")), "word")
    after = F.substring("_t", F.col("start") + F.length("name") + 1, F.lit(1))
    whole = (F.substring("_t", F.col("start") + 1, F.length("name")) == F.col("name")) & ~(F.substring("name", -1, 1).rlike(r"[\p{L}\p{N}]") & after.rlike(r"[\p{L}\p{N}]"))
    met = met.where(whole).select("_row", "_key", "name", "start")
    if not overlaps:
        lists = met.groupBy("_row", "_key").agg(F.collect_list(F.struct("name", "start")).alias("xs"))
        met = lists.select("_key", F.explode(free("xs")).alias("x")).select("_key", "x.name", "x.start")
    return met.select(F.col("_key").alias(key), "name", "start")


def _words(text: str) -> list[tuple[int, str]]:
    """(start, word) of runs of letters and digits; every other character but white space is a word of its own."""
    out, start = [], None
    for i, c in enumerate(text + " "):
        if c.isalnum():
            start = i if start is None else start
            continue
        if start is not None:
            out.append((start, text[start:i]))
            start = None
        if not c.isspace() and i < len(text):
            out.append((i, c))
    return out


def plain(text: Column) -> Column:
    """Lower case, letters and digits alone, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def match(docs: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", weak: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """(key, best, kind, alternatives): the name that each text means. ``key`` is unique.

    ``exact``: a name stands in the text, the longest first. ``partial``: a text has all words of a name but one, at least one, and not ``weak`` ones
    alone; more shared words first, then shorter names. ``none``: best is null. Equals go by name; up to ``most`` - 1 alternatives follow in
    that order. Texts meet names by words that are not weak, so a list of any length is joined and not walked.
    """
    asked = docs.select(key, plain(F.col(text)).alias("_t"))
    listed = names.select(plain(F.col(name)).alias("name")).where("name <> ''").distinct()
    exact = places(asked, key, "_t", listed, overlaps=False).select(key, "name").distinct().withColumn("exact", F.lit(True))
    split = lambda c: F.array_distinct(F.split(c, " "))
    own, known = asked.select(key, split(F.col("_t")).alias("tw")), listed.select("name", split(F.col("name")).alias("nw"))
    strong = lambda words: F.filter(words, lambda w: ~w.isin(list(weak))) if weak else words
    met = own.select(key, F.explode(strong(F.col("tw"))).alias("w")).join(known.select("name", F.explode(strong(F.col("nw"))).alias("w")), "w").select(key, "name").distinct()
    some = met.join(own, key).join(known, "name").select(key, "name", F.size(F.array_intersect("nw", "tw")).alias("shared"), F.size("nw").alias("n"))
    some = some.where(F.col("shared") >= F.greatest(F.lit(1), F.col("n") - 1))
    every = some.join(exact, [key, "name"], "full").select(key, "name", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("shared", F.lit(0)).alias("shared"))
    size = F.length("name")
    order = Window.partitionBy(key).orderBy(F.desc("exact"), F.desc(F.when(F.col("exact"), size)), F.desc("shared"), size, "name")
    top = every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "exact", "name"))).alias("x"))
    lists = lists.select(key, F.col("x")[0]["name"].alias("best"), F.when(F.col("x")[0]["exact"], "exact").otherwise("partial").alias("kind"), F.transform(F.slice("x", 2, most), lambda x: x["name"]).alias("alternatives"))
    out = docs.select(key).join(lists, key, "left")
    return out.select(key, "best", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"))
