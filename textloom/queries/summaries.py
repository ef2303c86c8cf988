"""Summaries of documents and their overlap scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import summarize as S
from ..registry import query
from ..session import shared_folder, table


def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)


LEAD = r"""
p as (select doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')) as s from documents),
x as (select doc_id, s, i, s[i] as t, len(list_filter(regexp_split_to_array(s[i], '[ \t\r\n]+'), lambda w: w <> '')) as n from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from p)),
f as (select doc_id, t, min(i) as i, min(n) as n from x where n between 6 and 60 group by doc_id, t),
"""


@query("lead_summary", f"""
with {LEAD} c as (select *, sum(n) over (partition by doc_id order by i rows unbounded preceding) as upto, row_number() over (partition by doc_id order by i) as k from f)
select doc_id, string_agg(t, ' ' order by i) as summary from c where k = 1 or upto <= {S.BUDGET} group by doc_id
""")  # fmt: skip
def lead_summary(spark, d):
    return sentences(spark, d).select("doc_id", S.lead(F.col("s")).alias("summary"))


@query("textrank_summary")
def textrank_summary(spark, d):
    return sentences(spark, d).select("doc_id", S.textrank(F.col("s")).alias("summary"))


#: Characters of a text whose ranks are made in one task; longer ones are dealt over tasks.
LONG = 4_000_000


@query("sentence_ranks")
def sentence_ranks(spark, d):
    """The best ranked sentence of every document, by ten rounds: within a task, or over tables for a text too long for one."""
    docs, long = table(spark, d, "documents").select("doc_id", "text"), F.length("text") > LONG
    cut = lambda df: df.select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    best = S.best_sentences(cut(docs.where(F.coalesce(~long, F.lit(True)))), "doc_id", "s", rounds=10)
    if not docs.where(long).isEmpty():
        done = S.ranks(S.sentence_bags(cut(docs.where(long)), "doc_id", "s"), "doc_id", "pos", shared_folder(spark, "ranks"), rounds=10, store=2)
        done = done.groupBy("doc_id").agg(F.max_by(F.struct("pos", "rank"), F.struct(F.round("rank", 9), -F.col("pos"))).alias("b"), F.count("*").alias("sentences"))
        best = best.unionByName(done.select("doc_id", "sentences", F.col("b.pos").alias("pos"), F.col("b.rank").alias("rank")))
    return best.withColumn("rank", F.round("rank", 6))


@query("mmr_summary")
def mmr_summary(spark, d):
    return sentences(spark, d).select("doc_id", S.mmr(F.col("s")).alias("summary"))


@query("rouge_scores")
def rouge_scores(spark, d):
    """ROUGE-1, 2 and L of lead against TextRank summaries."""
    from ..functions.python_text import rouge

    rows = sentences(spark, d).select("doc_id", S.lead(F.col("s")).alias("a"), S.textrank(F.col("s")).alias("b"))
    rows = rows.select("doc_id", rouge(T.tokens(F.col("a")), T.tokens(F.col("b"))).alias("x"))
    return rows.select("doc_id", *[F.round(f"x.{c}", 6).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l")])


@query("sentence_counts", """
with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as s from documents)
select count(*) as sentences from s where s <> ''
""")  # fmt: skip
def sentence_counts(spark, d):
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])[ \t\r\n]+(?=[A-Z0-9(])")
    return table(spark, d, "documents").select(F.explode(parts).alias("s")).where("s <> ''").agg(F.count("*").alias("sentences"))


@query("extractive_answer", """
with r as (select item_id, text, row_number() over (order by item_id) as k from benchmark) select item_id, 'Passage ' || cast(item_id as varchar) || ': ' || coalesce(substr(text, 1, 80), '') as answer from r
""")  # fmt: skip
def extractive_answer(spark, d):
    return table(spark, d, "benchmark").select("item_id", S.with_fallback(F.lit(""), F.concat(F.lit("Passage "), F.col("item_id").cast("string"), F.lit(": "), F.coalesce(F.substring("text", 1, 80), F.lit("")))).alias("answer"))
