"""Data-quality checks and reports over the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import dedupe_key
from ..operators import quality as Q
from ..registry import query
from ..session import table


@query("quality_checks", """
with c as (
select 'order_has_customer' as "check", count(*) as failures from orders where o_custkey not in (select c_custkey from customer)
union all select 'line_has_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'line_has_part', count(*) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'quantity_positive', count(*) from lineitem where not coalesce(l_quantity > 0, false)
union all select 'discount_in_range', count(*) from lineitem where not coalesce(l_discount between 0 and 0.1, false)
union all select 'tax_in_range', count(*) from lineitem where not coalesce(l_tax between 0 and 0.05, false)
union all select 'flag_known', count(*) from lineitem where not coalesce(l_returnflag in ('A', 'N', 'R'), false)
union all select 'unique_order', count(*) - count(distinct o_orderkey) from orders
union all select 'unique_text', count(*) - count(distinct trim(regexp_replace(lower(text), '[^a-z0-9%]+', ' ', 'g'))) from documents
union all select 'one_lang_per_source', count(*) from (select source from documents group by 1 having count(distinct lang) > 1)
union all select 'label_has_document', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'documents_not_blank', count(*) from documents where not coalesce(trim(text) <> '', false)
union all select 'line_has_supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)
union all select 'customer_has_nation', count(*) from customer where c_nationkey not in (select n_nationkey from nation)
union all select 'nation_has_region', count(*) from nation where n_regionkey not in (select r_regionkey from region)
union all select 'unique_line', coalesce(sum(n - 1), 0) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)
union all select 'price_positive', count(*) from lineitem where not coalesce(l_extendedprice > 0, false)
union all select 'chars_counted', count(*) from documents where not coalesce(n_chars = length(text), false)
union all select 'labels_binary', count(*) from labels where not coalesce(quality in (0, 1) and toxic in (0, 1), false)
) select "check", cast(failures as bigint) as failures, failures = 0 as passed from c
""")  # fmt: skip
def quality_checks(spark, d):
    t = lambda n: table(spark, d, n)
    orders, lines, docs = t("orders"), t("lineitem"), t("documents")
    surplus = lambda name, df, key: df.groupBy(key.alias("k")).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("passed"))
    return Q.all_checks(
        Q.check("order_has_customer", Q.not_in(orders, "o_custkey", t("customer"), "c_custkey")),
        Q.check("line_has_order", Q.not_in(lines, "l_orderkey", orders, "o_orderkey")),
        Q.check("line_has_part", Q.not_in(lines, "l_partkey", t("part"), "p_partkey")),
        Q.row_checks(lines, {"quantity_positive": F.col("l_quantity") > 0, "discount_in_range": F.col("l_discount").between(0, 0.1), "tax_in_range": F.col("l_tax").between(0, 0.05), "flag_known": F.col("l_returnflag").isin("A", "N", "R")}),
        surplus("unique_order", orders, F.col("o_orderkey")),
        surplus("unique_text", docs, dedupe_key(F.col("text"))),
        Q.check("one_lang_per_source", Q.conflicting(docs, "source", "lang")),
        Q.check("label_has_document", Q.not_in(t("labels"), "doc_id", docs, "doc_id")),
        Q.row_checks(docs, {"documents_not_blank": F.trim("text") != "", "chars_counted": F.col("n_chars") == F.length("text")}),
        Q.check("line_has_supplier", Q.not_in(lines, "l_suppkey", t("supplier"), "s_suppkey")),
        Q.check("customer_has_nation", Q.not_in(t("customer"), "c_nationkey", t("nation"), "n_nationkey")),
        Q.check("nation_has_region", Q.not_in(t("nation"), "n_regionkey", t("region"), "r_regionkey")),
        surplus("unique_line", lines, F.struct("l_orderkey", "l_linenumber")),
        Q.row_checks(lines, {"price_positive": F.col("l_extendedprice") > 0}),
        Q.row_checks(t("labels"), {"labels_binary": F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)}),
    )


@query("dedupe_exact", "with k as (select text, count(*) as n from documents group by 1) select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (n > 1) as keys from k")
def dedupe_exact(spark, d):
    # equal texts have equal digests, which are what is shuffled
    return Q.duplicates(table(spark, d, "documents"), F.sha2("text", 256))


@query("dedupe_normalised", """
with k as (select trim(regexp_replace(lower(text), '[^a-z0-9%]+', ' ', 'g')) as k, count(*) as n from documents group by 1) select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (n > 1) as keys from k
""")  # fmt: skip
def dedupe_normalised(spark, d):
    return Q.duplicates(table(spark, d, "documents"), F.sha2(dedupe_key(F.col("text")), 256))


@query("counts_share", "select source, count(*) as n, printf('%.1f', round(100.0 * count(*) / sum(count(*)) over (), 1)) as share from documents group by source")
def counts_share(spark, d):
    return Q.shares(table(spark, d, "documents"), "source")


LANGS = ["en", "de", "es", "fr"]


@query("pivot_counts", "select source, " + ", ".join(f"count(*) filter (lang = '{x}') as {x}" for x in LANGS) + ", count(*) filter (lang in ('en', 'de', 'es', 'fr')) as total from documents group by source")
def pivot_counts(spark, d):
    return Q.pivot_counts(table(spark, d, "documents"), "source", "lang", LANGS)


@query("rollup_totals", """
select case when grouping(o_orderpriority) = 1 then 'TOTAL' else o_orderpriority end as o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderpriority)
""")  # fmt: skip
def rollup_totals(spark, d):
    return Q.with_totals(table(spark, d, "orders"), "o_orderpriority", F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("unpivot_metrics", """
with m as (select event_type, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1)
unpivot m on mean, low, high into name metric value value
""")  # fmt: skip
def unpivot_metrics(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))
    return m.unpivot("event_type", ["mean", "low", "high"], "metric", "value")


@query("pivot_values", """
with m as (select event_type, cast(month(ts) as varchar) as m, round(sum(value), 4) as v from events group by all) select event_type, """ + ", ".join(f"max(v) filter (m = '{k}') as m{k}" for k in range(1, 4)) + " from m group by event_type")  # fmt: skip
def pivot_values(spark, d):
    m = table(spark, d, "events").groupBy("event_type", F.concat(F.lit("m"), F.month("ts").cast("string")).alias("m")).agg(F.round(F.sum("value"), 4).alias("v"))
    return m.groupBy("event_type").pivot("m", ["m1", "m2", "m3"]).agg(F.max("v"))


@query("null_cells", "select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) as \"column\", unnest([sum((event_id is null)::int), sum((ts is null)::int), sum((user_id is null)::int), sum((event_type is null)::int), sum((value is null)::int), sum((props is null)::int)])::bigint as nulls from events")
def null_cells(spark, d):
    return Q.null_cells(table(spark, d, "events"))


@query("exploded_tags", """
with t as (select string_agg(o_orderstatus, '|') as tags from orders group by o_custkey) select tag, count(*) as n from (select unnest(string_split(tags, '|')) as tag from t) group by tag
""")  # fmt: skip
def exploded_tags(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list("o_orderstatus"), "|").alias("tags"))
    return Q.exploded_counts(t, "tags", "[|]", "tag")


@query("having_counts", "select l_partkey, count(*) as n, round(avg(l_quantity), 6) as mean from lineitem group by 1 having count(*) > 40")
def having_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean")).where("n > 40")


@query("length_statistics", "select lang, count(*) as n, round(avg(n_chars), 6) as mean, round(quantile_cont(n_chars, 0.5), 6) as median, min(n_chars) as least, max(n_chars) as most from documents group by 1")
def length_statistics(spark, d):
    from ..operators.metrics import quantiles

    q = quantiles(table(spark, d, "documents"), "n_chars", ("lang",), (0.0, 0.5, 1.0))
    ends = [F.col("q")[i].cast("long").alias(c) for i, c in ((0, "least"), (2, "most"))]
    return q.select("lang", "n", F.round("mean", 6).alias("mean"), F.round(F.col("q")[1], 6).alias("median"), *ends)


@query("imbalance_ratio", "with c as (select lang, count(*) as n from documents group by 1) select max(n) as most, min(n) as least, round(max(n) / min(n), 6) as ratio from c")
def imbalance_ratio(spark, d):
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return c.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


@query("set_difference", "select distinct user_id as id from events except select c_custkey from customer where c_mktsegment = 'BUILDING'")
def set_difference(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).subtract(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("set_intersection", "select distinct user_id as id from events intersect select c_custkey from customer where c_mktsegment = 'BUILDING'")
def set_intersection(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).intersect(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("set_equality", """
with s as (select l_orderkey, list_sort(list_distinct(list(l_returnflag))) as a, list_sort(list_distinct(list(l_linestatus))) as b from lineitem group by 1) select count(*) as orders, count(*) filter (a = ['N']) as only_n, count(*) filter (len(list_intersect(a, b)) = 0) as disjoint from s
""")  # fmt: skip
def set_equality(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("a"), F.array_sort(F.collect_set("l_linestatus")).alias("b"))
    n = lambda c: F.sum(c.cast("long"))
    return s.agg(F.count("*").alias("orders"), n(F.col("a") == F.array(F.lit("N"))).alias("only_n"), n(~F.arrays_overlap("a", "b")).alias("disjoint"))


@query("union_all_rows", "select 'document' as kind, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents union all select 'benchmark', count(*), cast(sum(length(text)) as bigint) from benchmark union all select 'turn', count(*), cast(sum(length(text)) as bigint) from conversations")
def union_all_rows(spark, d):
    part = lambda kind, name: table(spark, d, name).select(F.lit(kind).alias("kind"), F.length("text").cast("long").alias("c"))
    rows = part("document", "documents").unionByName(part("benchmark", "benchmark")).unionByName(part("turn", "conversations"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("two_key_sort_limit", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 25")
def two_key_sort_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25)
