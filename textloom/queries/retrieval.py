"""Retrieval over documents, benchmark items and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squash, tokens
from ..operators import index
from ..operators import retrieval as R
from ..operators.quotes import holding
from ..registry import query
from ..session import small, table

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"

BM25 = f"""
docs as (select doc_id, {TOK.format("text")} as toks from documents),
lens as (select doc_id, cast(len(toks) as bigint) as len from docs),
post as (select doc_id, unnest(toks) as term from docs),
tf as (select doc_id, term, count(*) as tf from post group by all),
df as (select term, count(*) as n from tf group by term),
tot as (select count(*) as docs, avg(len) as avgdl from lens),
raw as (select term, n, ln(docs - n + 0.5) - ln(n + 0.5) as idf from df, tot),
mean as (select avg(idf) as m from raw),
idf as (select term, case when idf < 0 then 0.25 * m else idf end as idf from raw, mean),
asked as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({TOK.format("text")}) as term from benchmark) group by all),
scored as (
  select query_id, doc_id, greatest(round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6), 0.0) as score
  from asked join idf using (term) join tf using (term) join lens using (doc_id), tot group by query_id, doc_id
),
bm25 as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)
"""
RELEVANT = """
quotes as (select item_id as query_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as q from benchmark),
squashed as (select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as s from documents),
relevant as (select query_id, doc_id from quotes join squashed on contains(s, q) where q <> '')
"""
OVERLAP = f"""
overlap_scored as (
  select query_id, doc_id, count(*) as score from
  (select item_id as query_id, unnest(list_distinct({TOK.format("text")})) as term from benchmark)
  join (select doc_id, unnest(list_distinct({TOK.format("text")})) as term from documents) using (term) group by all
),
overlapped as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from overlap_scored)
"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def hits(spark: SparkSession, d: str, k: int, plain: bool = False) -> DataFrame:
    """The k best documents of every item, by BM25 or by the number of shared terms: from the stored index of ``documents``."""
    return index.of(spark, f"{d}/documents.parquet").search(items(spark, d), k, plain)


@query("bm25_top5", f"with {BM25} select query_id, doc_id, score, rank from bm25 where rank <= 5")
def bm25_top5(spark, d):
    return hits(spark, d, 5)


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """Items whose squashed text is part of a document's, wherever either has its separators."""
    asked = items(spark, d).select("query_id", squash(F.col("query")).alias("q"))
    return holding(table(spark, d, "documents").select("doc_id", squash(F.col("text")).alias("s")), "doc_id", "s", asked, "query_id", "q")


@query("quote_containment", f"with {RELEVANT} select query_id, doc_id from relevant")
def quote_containment(spark, d):
    return relevant(spark, d)


@query("bm25_recall_mrr", f"""
with {BM25}, {RELEVANT},
first as (select query_id, min(rank) as first from relevant left join (select * from bm25 where rank <= 10) using (query_id, doc_id) group by query_id)
select count(*) as queries, round(avg(coalesce(cast(first <= 1 as int), 0)), 4) as recall_1, round(avg(coalesce(cast(first <= 3 as int), 0)), 4) as recall_3,
  round(avg(coalesce(cast(first <= 5 as int), 0)), 4) as recall_5, round(avg(coalesce(cast(first <= 10 as int), 0)), 4) as recall_10, round(avg(coalesce(1 / first, 0.0)), 4) as mrr from first
""")  # fmt: skip
def bm25_recall_mrr(spark, d):
    return R.recall_mrr(hits(spark, d, 10), relevant(spark, d))


@query("token_overlap_top3", f"with {OVERLAP} select query_id, doc_id, score, rank from overlapped where rank <= 3")
def token_overlap_top3(spark, d):
    return hits(spark, d, 3, plain=True)


FUSED = """
fused as (
  select query_id, doc_id, round(sum(1 / (60 + rank)), 8) as score from
  (select query_id, doc_id, rank from bm25 where rank <= 20 union all select query_id, doc_id, rank from overlapped where rank <= 20) group by all
)
"""


def fused(spark, d):
    return R.fuse(hits(spark, d, 20), hits(spark, d, 20, plain=True))


@query("rrf_fusion", f"""
with {BM25}, {OVERLAP}, {FUSED}
select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from fused) where rank <= 5
""")  # fmt: skip
def rrf_fusion(spark, d):
    return R.ranked(fused(spark, d), 5)


@query("hybrid_boost", f"""
with {BM25}, {OVERLAP}, {FUSED},
boosted as (select query_id, doc_id, round(score * case when lang = 'en' then 1.2 else 1.0 end * case when source = 'src1' then 1.3 else 1.0 end, 8) as score from fused join (select doc_id, lang, source from documents) using (doc_id)),
top as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from boosted)
select query_id, doc_id, score, rank, round(score / max(score) over (partition by query_id), 4) as relative from top where rank <= 5
""")  # fmt: skip
def hybrid_boost(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    scored = fused(spark, d).join(docs, "doc_id")
    scored = R.boost(scored, (F.col("lang") == "en", 1.2), (F.col("source") == "src1", 1.3)).select("query_id", "doc_id", "score")
    return R.relative(R.ranked(scored, 5))


@query("rerank_pool", f"""
with {BM25}, {OVERLAP},
pool as (select query_id, doc_id from bm25 where rank <= 20),
again as (select query_id, doc_id, round(cast(coalesce(o.score, 0) as double), 6) as score from pool left join overlap_scored o using (query_id, doc_id))
select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from again) where rank <= 5
""")  # fmt: skip
def rerank_pool(spark, d):
    # twenty rows an item, and the items are a stated set
    pool = hits(spark, d, 20).drop("score").join(small(items(spark, d)), "query_id")
    pool = table(spark, d, "documents").select("doc_id", "text").join(small(pool), "doc_id")
    shared = F.size(F.array_intersect(tokens(F.col("query")), tokens(F.col("text"))))
    return R.rerank(pool, shared.cast("double")).select("query_id", "doc_id", "score", "rank")


@query("retriever_comparison", f"""
with {BM25}, {OVERLAP}, {FUSED}, {RELEVANT},
fused_ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fused),
hits as (select 'bm25' as system, query_id, doc_id, rank from bm25 where rank <= 5 union all select 'overlap', query_id, doc_id, rank from overlapped where rank <= 5 union all select 'fused', query_id, doc_id, rank from fused_ranked where rank <= 5),
systems as (select unnest(['bm25', 'overlap', 'fused']) as system),
first as (select system, query_id, min(rank) as first from systems cross join relevant left join hits using (system, query_id, doc_id) group by all)
select system, count(*) as queries, round(avg(coalesce(cast(first <= 1 as int), 0)), 4) as recall_1, round(avg(coalesce(cast(first <= 3 as int), 0)), 4) as recall_3, round(avg(coalesce(1 / first, 0.0)), 4) as mrr from first group by system
""")  # fmt: skip
def retriever_comparison(spark, d):
    rel, lexical, bm = relevant(spark, d), hits(spark, d, 20, plain=True), hits(spark, d, 20)
    systems = {"bm25": bm.where("rank <= 5"), "overlap": lexical.where("rank <= 5"), "fused": R.ranked(R.fuse(bm, lexical), 5)}
    out = None
    for name, found in systems.items():
        part = R.recall_mrr(found, rel, (1, 3)).withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("hard_negatives", f"""
with {BM25}, {RELEVANT},
rest as (select query_id, doc_id, score from bm25 where rank <= 8 and not exists (select 1 from relevant r where r.query_id = bm25.query_id and r.doc_id = bm25.doc_id))
select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rest) where rank <= 2
""")  # fmt: skip
def hard_negatives(spark, d):
    return R.mine_negatives(hits(spark, d, 8), relevant(spark, d))


KNN = """
q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 100 = 0),
sims as (select query_id, vec_id, round(list_dot_product(a, embedding::double[]), 6) as score, label from q join embeddings on vec_id <> query_id),
knn as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from sims)
"""


def asked_vectors(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0)


@query("knn_top5", f"with {KNN} select query_id, vec_id, score, rank from knn where rank <= 5")
def knn_top5(spark, d):
    return R.nearest(asked_vectors(spark, d), table(spark, d, "embeddings"), 5)


@query("knn_label_vote", f"""
with {KNN}, votes as (select query_id, label, count(*) as n from knn where rank <= 5 group by all),
best as (select *, row_number() over (partition by query_id order by n desc, label) as r from votes)
select query_id, label as predicted, gold from best join (select vec_id as query_id, label as gold from embeddings) using (query_id) where r = 1
""")  # fmt: skip
def knn_label_vote(spark, d):
    base = table(spark, d, "embeddings")
    hits = R.nearest(asked_vectors(spark, d), base, 5).join(base.select("vec_id", "label"), "vec_id")
    vote = hits.groupBy("query_id").agg(F.mode("label", True).alias("predicted"))
    return vote.join(base.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id")


@query("overlap_pairs", f"with {KNN} select query_id, vec_id, score from sims where score >= 0.3")
def overlap_pairs(spark, d):
    return R.nearest(asked_vectors(spark, d), table(spark, d, "embeddings"), 0, 0.3)


@query("same_label_neighbour", f"""
with {KNN}, gold as (select vec_id as query_id, label as gold from embeddings where vec_id % 100 = 0),
first as (select query_id, min(rank) filter (label = gold) as first from knn join gold using (query_id) where rank <= 5 group by query_id)
select count(*) as queries, round(avg(coalesce(cast(first = 1 as int), 0)), 4) as acc_1, round(avg(cast(first is not null as int)), 4) as acc_5, round(avg(coalesce(1 / first, 0.0)), 4) as mrr from first
""")  # fmt: skip
def same_label_neighbour(spark, d):
    base = table(spark, d, "embeddings")
    hits = R.nearest(asked_vectors(spark, d), base, 5).join(base.select("vec_id", "label"), "vec_id")
    gold = base.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))
    first = hits.join(gold, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).alias("first"))
    return first.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))), 4).alias("acc_1"),
        F.round(F.avg(F.col("first").isNotNull().cast("int")), 4).alias("acc_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


@query("chunk_to_document", f"""
with chunks as (select doc_id, unnest(range(0, len(w), 200)) as begin_at, w from (select doc_id, {TOK.format("text")} as w from documents) where len(w) > 0),
cut as (select doc_id, cast(begin_at // 200 as int) as pos, w[begin_at + 1 : begin_at + 220] as w from chunks),
asked as (select item_id as query_id, list_distinct({TOK.format("text")}) as q from benchmark where item_id % 100 = 0),
hits as (select query_id, doc_id, pos, count(*) as score from (select query_id, unnest(q) as term from asked) join (select doc_id, pos, unnest(list_distinct(w)) as term from cut) using (term) group by all),
best as (select *, row_number() over (partition by query_id, doc_id order by score desc, pos) as r from hits)
select * from (select query_id, doc_id, pos as chunk, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from best where r = 1) where rank <= 3
""")  # fmt: skip
def chunk_to_document(spark, d):
    from ..functions.text import windows

    cut = table(spark, d, "documents").select("doc_id", F.posexplode(windows(tokens(F.col("text")))).alias("pos", "w"))
    # the stated query set: items whose identifier is divisible by 100, against all chunks
    asked = items(spark, d).where("query_id % 100 = 0").select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    hits = cut.select("doc_id", "pos", F.explode(F.array_distinct("w")).alias("term")).join(small(asked), "term")
    hits = hits.groupBy("query_id", "doc_id", "pos").agg(F.count("*").alias("score")).withColumn("chunk", F.col("pos"))
    return R.ranked(R.best_part(hits), 3)


TURN = "conv_id * 100000 + turn"


def turn_pairs(least: float) -> str:
    return f"""
with t as (select {TURN} as id, list_sort({TOK.format("text")}) as toks from conversations),
c as (select toks, min(id) as id, count(*) as members from t where len(toks) > 0 group by toks),
tf as (select id, term, count(*) as tf from (select id, unnest(toks) as term from c) group by all),
df as (select term, count(*) as df from tf group by term),
w as (select id, term, tf * (ln((1.0 + (select count(*) from c)) / (1 + df)) + 1) as w from tf join df using (term)),
u as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from w),
p as (select a.id as a, b.id as b, round(sum(a.w * b.w), 6) as similarity from u a join u b on a.term = b.term and a.id < b.id group by all)
select a, b, similarity, x.members as members_a, y.members as members_b from p join c x on x.id = a join c y on y.id = b where similarity >= {least}
"""


@query("similar_turns", turn_pairs(0.55))
def similar_turns(spark, d):
    """All pairs of turns whose tf-idf cosine is 0.55 or more, between classes of equal tokens."""
    from ..operators.pairs import similar_pairs

    rows = table(spark, d, "conversations").select(F.expr(TURN).alias("id"), "text")
    return similar_pairs(rows, "id", "text", 0.55)


@query("copied_turns", turn_pairs(0.8))
def copied_turns(spark, d):
    """The same at 0.8."""
    from ..operators.pairs import similar_pairs

    rows = table(spark, d, "conversations").select(F.expr(TURN).alias("id"), "text")
    return similar_pairs(rows, "id", "text", 0.8)
