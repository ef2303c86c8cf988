"""Spelling variants: words one edit apart, found by a symmetric-delete join, and the more frequent form that each leads to.

Every word emits its own key and the keys of its distinct single deletions. Two words one edit apart share a key: a deletion of the longer
is the shorter, and two of a length are equal without the place at which they differ. What meets in a key is verified as exactly one edit
apart; a chance meeting of hashed keys costs a comparison and changes nothing. A word's form is its most frequent near word, if that is
frequent enough; roots come by joining forms with forms, twice as far each round.

A key's group is small whatever the corpus: the words that leave one string by a deletion are as many as places times letters. A word of
n characters emits up to n + 1 rows of two numbers, so very long words don't multiply; the words themselves travel for verification alone.

Null and empty texts have no words, a null identifier counts as an empty text, repeated rows count each, other columns are ignored; an empty
table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, table, tidy

#: Maximal runs of these are words.
RUN = "[A-Za-zÀ-ÿ]+"
#: Of so many (identifier, word) pairs one loses a letter; least length and count of a word; times by which a form is more frequent.
LOSES, LENGTH, COUNT, TIMES = 97, 5, 3, 2
#: An odd number, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), 0)


def observed(id_col: Column, word: Column) -> Column:
    """The word as counted: a checksum of identifier and word decides whether it loses a letter, and which one."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % LOSES == 0, cut).otherwise(word)


def words(docs: DataFrame, length: int = LENGTH, count: int = COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words that are long and frequent enough. Tasks count before the shuffle."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col))).alias("run")).where(F.length("run") >= length)
    each = each.select(observed(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= length)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def deletion_keys(word: str) -> np.ndarray:
    """Distinct keys of a word and of its single deletions: polynomials in ``BASE`` modulo 2^64, all of them in one pass over the word.

    Without its place i a word is what stands before i plus what stands after it, moved down by one power.
    """
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(codes) - 1, BASE, np.uint64))])
        until = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])
        without = until[:-1] + (until[-1] - until[1:]) * np.uint64(pow(BASE, -1, 2**64))
    return np.unique(np.append(without, until[-1])).view(np.int64)


def keys(listed: DataFrame) -> DataFrame:
    """key, wid for every word of ``listed`` (wid, word)."""

    def task(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                own = [deletion_keys(w) for w in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(k) for k in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(ids)], ["key", "wid"])

    return listed.select("wid", "word").mapInArrow(tidy(task), "key long, wid long")


def near(ws: Workspace, listed: DataFrame) -> DataFrame:
    """a, b: identifiers of words exactly one edit apart, each pair once. ``listed``: a stored table of wid, word.

    Keys with one word go before the self-join; pairs that share several keys meet once before the words come to them.
    """
    emitted = ws.save(keys(listed), "keys")
    x, y = emitted.alias("x"), emitted.alias("y")
    pairs = x.join(y, F.expr("x.key = y.key and x.wid < y.wid")).select(F.col("x.wid").alias("a"), F.col("y.wid").alias("b")).distinct()
    text = lambda side, name: listed.select(F.col("wid").alias(side), F.col("word").alias(name))
    met = pairs.join(text("a", "wa"), "a").join(text("b", "wb"), "b")
    return met.where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b")


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """wid, root for each row of ``forms`` (wid, form): the last word that following forms leads to.

    A form is ``TIMES`` as frequent or more, so chains end; every round joins what is known with itself and goes twice as far. Rounds
    are tables in the shared folder. Many words may lead to one root: that join's other side has a row for each word, so adaptive
    execution can split it.
    """
    known, k = ws.save(forms.select("wid", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = known.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        told = known.join(onward, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        k += 1
        told = ws.save(told, f"roots-{k}")
        ws.drop(f"roots-{k - 1}")
        known = told.select("wid", "root")
        if not told.where("moved").limit(1).count():
            return known


def group(ws: Workspace, counted: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``counted`` (word, n; words are different)."""
    spark = counted.sparkSession
    # numbers given while writing are fixed by the table written
    listed = ws.save(counted.withColumn("wid", F.monotonically_increasing_id()), "words")
    pairs = ws.save(near(ws, listed.select("wid", "word")), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = listed.select(F.col("wid").alias("b"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"), F.col("wid").alias("form_id")).alias("x"))
    best = both.join(other, "b").groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    best = listed.join(best, "wid", "left").withColumn("led", F.coalesce(-F.col("x.less") >= times * F.col("n"), F.lit(False)))
    best = best.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("led"), c).alias(a) for c, a in ((F.col("x.form"), "form"), (-F.col("x.less"), "form_n"), (F.col("x.form_id"), "form_id"))])
    best = ws.save(best, "best")
    ends = roots(ws, best.where("form_id is not null").select("wid", F.col("form_id").alias("form")))
    named = ends.join(listed.select(F.col("wid").alias("root"), F.col("word").alias("end")), "root").select("wid", "end")
    out = best.join(named, "wid", "left")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` with their forms and roots."""
    with Workspace(spark, "op13") as ws:
        return ws.result(group(ws, words(table(spark, sf_dir, "documents"))))


#: Checksums by the bitwise rule, eight steps a byte; near words by equal strings without one place, which is exact without a distance.
SQL = f"""
with recursive bits(b, k, v) as (
  select range, 0, range::ubigint from range(256)
  union all select b, k + 1, xor(v >> 1, case when v & 1 = 1 then 3988292384::ubigint else 0::ubigint end) from bits where k < 8
),
crc as (select list(v order by b) as t from bits where k = 8),
found as (
  select coalesce(cast(doc_id as varchar), '') as id, run, count(*) as n from
  (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) group by all
),
bytes as (
  select id, run, n, list_transform(string_split(id || ':', ''), lambda c: unicode(c)) || flatten(list_transform(string_split(run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)) as codes
  from found where length(run) >= {LENGTH}
),
summed as (
  select run, n, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(codes, lambda c: c::ubigint)), lambda s, c: xor(s >> 8, t[xor(s & 255, c)::int + 1]))) as h from bytes, crc
),
seen as (
  select case when h % {LOSES} = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, n from summed
),
words as (select word, cast(sum(n) as bigint) as n from seen where length(word) >= {LENGTH} group by word having sum(n) >= {COUNT}),
cut as (
  select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
),
near as (
  select x.word, y.word as other, y.n as other_n from cut x join cut y on x.rest = y.rest and x.i = y.i and x.word <> y.word
  union select x.word, y.word, y.n from cut x join words y on x.rest = y.word
  union select y.word, x.word, x.n from cut x join words y on x.rest = y.word
),
ranked as (select word, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as r from near),
led as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= {TIMES} * n then other end as form, case when other_n >= {TIMES} * n then other_n end as form_n
  from words left join (select * from ranked where r = 1) using (word)
),
walk(word, reached) as (
  select word, word from led union all select walk.word, led.form from walk join led on led.word = walk.reached where led.form is not null
),
ends as (select walk.word, reached as root from walk join led on led.word = walk.reached where led.form is null)
select word, form, root, n, cast(n_near as bigint) as n_near, form_n from led join ends using (word)
"""
