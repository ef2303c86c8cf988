"""Text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import table

DOCS = "documents"


@query("chunk_windows", """
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
c as (select doc_id, w, unnest(range(0, len(w), 200)) as k from w where len(w) > 0)
select doc_id, k // 200 as chunk, len(w[k + 1 : k + 220]) as n_words, md5(array_to_string(w[k + 1 : k + 220], ' ')) as digest from c
""")  # fmt: skip
def chunk_windows(spark, d):
    rows = table(spark, d, DOCS).select("doc_id", F.posexplode(T.windows(T.tokens(F.col("text")))).alias("chunk", "w"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("dedupe_keys", """
select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9%]+', ' ', 'g'))) as with_percent, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as without_percent, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as squashed from documents
""")  # fmt: skip
def dedupe_keys(spark, d):
    x = F.col("text")
    return table(spark, d, DOCS).select("doc_id", F.md5(T.dedupe_key(x)).alias("with_percent"), F.md5(T.dedupe_key(x, False)).alias("without_percent"), F.md5(T.squash(x)).alias("squashed"))


@query("token_counts", """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_different from t
""")  # fmt: skip
def token_counts(spark, d):
    w = table(spark, d, DOCS).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_different"))


@query("vocabulary_min_count", """
select w as term, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents) group by 1 having count(*) >= 20
""")  # fmt: skip
def vocabulary_min_count(spark, d):
    return table(spark, d, DOCS).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 20")


@query("composite_clean")
def composite_clean(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean(F.col("text")).alias("clean"), T.clean(F.col("text"), stop_words=True).alias("content"))


@query("preprocessing_ablation")
def preprocessing_ablation(spark, d):
    """Tokens and different tokens under each switch of the cleaner."""
    rows = table(spark, d, "conversations")
    switches = {"full": {}, "no_masking": {"masking": False}, "no_contractions": {"contractions": False}, "no_abbreviations": {"abbreviations": False}, "no_squeezing": {"squeezing": False}, "no_stop_words": {"stop_words": True}}
    cols = [F.struct(F.lit(name).alias("config"), F.split(T.clean(F.col("text"), **kw), " ").alias("w")) for name, kw in switches.items()]
    long = rows.select(F.explode(F.array(*cols)).alias("x")).select("x.config", F.explode("x.w").alias("w"))
    return long.groupBy("config", "w").agg(F.count("*").alias("n")).groupBy("config").agg(F.sum("n").alias("tokens"), F.count("*").alias("different"))


@query("word_shapes", """
with w as (select unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from conversations),
s as (select regexp_replace(regexp_replace(regexp_replace(w, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g') as s from w)
select regexp_replace(regexp_replace(regexp_replace(s, 'X{3,}', 'XX', 'g'), 'x{3,}', 'xx', 'g'), 'd{3,}', 'dd', 'g') as shape, count(*) as n from s group by 1
""")  # fmt: skip
def word_shapes(spark, d):
    w = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w"))
    return w.groupBy(T.word_shape(F.col("w")).alias("shape")).agg(F.count("*").alias("n"))


@query("url_domains", "select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as domain, count(*) as pages, cast(sum(length(html)) as bigint) as chars from pages group by 1")
def url_domains(spark, d):
    return table(spark, d, "pages").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.sum(F.length("html").cast("long")).alias("chars"))


@query("content_containment", """
with t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as a from conversations), w as (select *, lag(a) over (partition by conv_id order by turn) as b from t)
select conv_id, turn, round(case when len(a) = 0 then 0.0 else len(list_intersect(a, b)) / len(a) end, 6) as shared from w where b is not null
""")  # fmt: skip
def content_containment(spark, d):
    from pyspark.sql import Window

    w = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"), "[a-z]{3,}")).alias("a"))
    w = w.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return w.select("conv_id", "turn", F.round(T.containment(F.col("a"), F.col("b")), 6).alias("shared"))


@query("json_props", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def json_props(spark, d):
    return table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("unsupported_numbers", """
with n as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as n, substr(text, 1, 200) as evidence from documents) select doc_id, count(*) as numbers, count(*) filter (not contains(evidence, n)) as unsupported from n group by 1
""")  # fmt: skip
def unsupported_numbers(spark, d):
    n = table(spark, d, DOCS).select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0)).alias("all"), T.unsupported_numbers(F.col("text"), F.substring("text", 1, 200)).alias("bad"))
    return n.where(F.size("all") > 0).select("doc_id", F.size("all").cast("long").alias("numbers"), F.size("bad").cast("long").alias("unsupported"))


@query("row_signatures", "select n_nationkey, md5(n_name || '|' || cast(n_regionkey as varchar)) as signature from nation")
def row_signatures(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.md5(F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string"))).alias("signature"))


@query("nfkc_normalise")
def nfkc_normalise(spark, d):
    from ..functions.python_text import nfkc

    folded = nfkc(T.fold_quotes(F.col("text")))
    return table(spark, d, DOCS).select("doc_id", T.collapse_space(folded).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("html_main_text")
def html_main_text(spark, d):
    from ..functions.python_text import html_text

    t = table(spark, d, "pages").select("page_id", html_text("html").alias("t"))
    return t.select("page_id", "t", F.size(T.tokens(F.col("t"))).cast("long").alias("words")).withColumnRenamed("t", "main_text")


@query("spell_correct")
def spell_correct(spark, d):
    from ..operators.spelling import correct, vocabulary

    words = table(spark, d, DOCS).where("lang = 'en'").select(F.explode(T.tokens(F.col("text"), "[a-z]+")).alias("w"))
    asked = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"), "[a-z]+")).alias("w"))
    return correct(asked, vocabulary(words, 50))


@query("closest_spelling")
def closest_spelling(spark, d):
    """Words of the benchmark that are rare in the corpus, by similarity ratio to all of its words that occur five times."""
    from ..operators.spelling import closest, vocabulary

    words = table(spark, d, DOCS).where("lang = 'en'").select(F.explode(T.tokens(F.col("text"), "[a-z]+")).alias("w"))
    asked = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"), "[a-z]+")).alias("w"))
    return closest(asked, vocabulary(words, 5))

