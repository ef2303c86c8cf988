"""Queries that go through sources: a program's records, and pages by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_folder, table
from ..sources import readers as S
from ..sources import writers as W


@query("record_source", "select i as id, 'record ' || cast(i as varchar) as name, true as ok, p_name from (select p_partkey as i, p_name from part where p_partkey < (select count(*) from part))")
def record_source(spark, d):
    """A service with a record for each part, asked in ranges, beside the parts themselves."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_name")
    spark.dataSource.register(S.RecordSource)
    return spark.read.format("textloom_records").option("count", part.count()).option("parts", 4).load().join(part, "id")


@query("page_kinds", "select case when regexp_matches(lower(substr(html, 1, 512)), '<html|<!doctype') then 'html' else 'text' end as kind, count(*) as pages from pages group by 1")
def page_kinds(spark, d):
    return table(spark, d, "pages").groupBy(S.kind_of(F.col("html").cast("binary")).alias("kind")).agg(F.count("*").alias("pages"))


@query("fetch_log", "select page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as domain, strlen(html) as bytes, sha256(html) as sha256 from pages")
def fetch_log(spark, d):
    from ..functions.text import domain

    return table(spark, d, "pages").select("page_id", "url", domain(F.col("url")).alias("domain"), F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))


# round trips: what is written to the shared folder and read again is what the table has


@query("csv_round_trip", "select c_custkey, nullif(case when c_custkey % 3 = 0 then '' else c_name || ', \"' || c_mktsegment || '\"' end, '') as said, c_mktsegment || '|' || c_name as tags, c_acctbal from customer")
def csv_round_trip(spark, d):
    said = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    at = shared_folder(spark, "csv")
    W.csv(table(spark, d, "customer").select("c_custkey", said.alias("said"), F.array("c_mktsegment", "c_name").alias("tags"), "c_acctbal"), at)
    return S.csv(spark, at, "c_custkey long, said string, tags string, c_acctbal double")


@query("json_round_trip", "select s_suppkey, s_name, s_acctbal from supplier")
def json_round_trip(spark, d):
    at = shared_folder(spark, "json")
    W.json_results(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), at)
    return S.json_lines(spark, at, "s_suppkey long, s_name string, s_acctbal double")


@query("numbered_lines", "select p_name || ' ' || lpad(cast(p_partkey as varchar), 8, '0') as text, row_number() over (order by p_name || ' ' || lpad(cast(p_partkey as varchar), 8, '0')) as id from part")
def numbered_lines(spark, d):
    """Lines with blanks around them and blank lines between, read, trimmed and numbered by text."""
    at = shared_folder(spark, "lines")
    line = F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("  "), line, F.lit(" ")), F.lit(""), F.lit("   "))).alias("value")).write.text(at)
    return S.numbered(S.lines(spark, at)).select("text", "id")


@query("split_folders", "select o_orderstatus as split, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1")
def split_folders(spark, d):
    at = shared_folder(spark, "splits")
    W.by_split(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), at)
    return spark.read.parquet(at).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("topic_folder", """
select r_name as topic, array_to_string(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as name, 'Nation ' || n_nationkey || ' of ' || r_name as text from nation join region on n_regionkey = r_regionkey
""")  # fmt: skip
def topic_folder(spark, d):
    """A file for each nation in a folder for each region: 25 of them, written by the driver."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()
    at = shared_folder(spark, "topics")
    W.texts(spark, at, {f"{r['r_name'].replace(' ', '-')}/{r['n_name'].replace(' ', '_')}.txt": f"Nation {r['n_nationkey']} of {r['r_name']}" for r in rows})
    return S.folder(spark, at).withColumn("topic", F.replace("topic", F.lit("-"), F.lit(" ")))


@query("nested_queries", """
select r_name as branch, 'F' || n_nationkey as fact, 'Where is ' || n_name || '?' as query, case when n_nationkey % 2 = 0 then 'asked' when r_regionkey = 0 then 'first' else 'plain' end as kind from nation join region on n_regionkey = r_regionkey
union all select r_name, 'ALL', 'Where is ' || n_name || '?', case when n_nationkey % 2 = 0 then 'asked' when r_regionkey = 0 then 'first' else 'plain' end from nation join region on n_regionkey = r_regionkey
""")  # fmt: skip
def nested_queries(spark, d):
    """Query rows of a nested YAML document: keys of several facts, plain and described queries, defaults by branch."""
    import yaml

    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    nested, defaults = {}, {}
    for r in rows:
        said = f"Where is {r['n_name']}?"
        nested.setdefault(r["r_name"], {})[f"F{r['n_nationkey']}+ALL"] = [{"query": said, "kind": "asked"}] if r["n_nationkey"] % 2 == 0 else said
        defaults[r["r_name"]] = "first" if r["r_regionkey"] == 0 else "plain"
    return S.yaml_rows(spark, yaml.safe_dump(nested), "branch string, fact string, query string, kind string", lambda x: S.query_rows(x, defaults))


@query("decoded_documents", "select conv_id, turn, text from conversations")
def decoded_documents(spark, d):
    """Texts as given, and others decoded from base64."""
    rows = table(spark, d, "conversations")
    rows = rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("t"), F.when(F.col("turn") % 2 != 0, F.base64(F.encode("text", "UTF-8"))).alias("e"))
    return rows.select("conv_id", "turn", S.document_text(F.col("t"), F.col("e")).alias("text"))


@query("fetched_pages", """
select page_id, case when page_id % 7 = 3 then null when regexp_matches(lower(substr(html, 1, 512)), '<html|<!doctype') then 'html' else 'text' end as kind, case when page_id % 7 <> 3 then strlen(html) end as bytes,
  case when page_id % 7 <> 3 then sha256(html) end as sha256, case when page_id % 7 = 3 then 2 else 1 end as attempts, page_id % 7 = 3 as failed from pages
""")  # fmt: skip
def fetched_pages(spark, d):
    """Pages fetched by address, one in seven of which leads nowhere, as the log has them."""
    from ..session import shared_folder
    from ..sources import fetch as G

    body = F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode("html", "UTF-8")))
    at = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("file:///nowhere/"), F.col("page_id").cast("string"))).otherwise(F.regexp_replace(body, "[\\r\\n]", ""))
    log = shared_folder(spark, "log")
    G.write_log(G.fetch(table(spark, d, "pages").select("page_id", at.alias("url")), keep=("page_id",), delay=0.0, retries=1, streams=64).drop("url", "body"), log)
    return G.read_log(spark, log).select("page_id", "kind", "bytes", "sha256", F.col("attempts").cast("long").alias("attempts"), F.col("error").isNotNull().alias("failed"))


WORDS = "list_filter(regexp_split_to_array(html, '[ \\t\\r\\n]+'), lambda w: w <> '')"


@query("office_round_trip", f"""
with w as (select page_id, {WORDS} as w from pages where len({WORDS}) > 0)
select page_id, 'docx' as kind, 1 as pages, sha256(array_to_string(w, ' ')) as sha256, null as created from w
union all select page_id, 'pdf', cast(ceil(len(w) / 120) as int), sha256(array_to_string(w, ' ')), 'D:2024010' || (page_id % 9 + 1) from w
""")  # fmt: skip
def office_round_trip(spark, d):
    """Pages as Word and as PDF files of 120 words a page, read back by their first bytes."""
    from ..session import small_batches
    from ..sources import office

    small_batches(spark)
    words = F.filter(F.split("html", r"[ \t\r\n]+"), lambda w: w != "")
    rows = table(spark, d, "pages").select("page_id", words.alias("w")).where("size(w) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 120).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * 120 + 1, 120), " "))
    made = F.concat(F.lit("D:2024010"), (F.col("page_id") % 9 + 1).cast("string"))
    files = rows.select("page_id", office.docx_file(F.array_join("w", "\n")).alias("f")).unionByName(rows.select("page_id", office.pdf_file(cut, made).alias("f")))
    got = files.select("page_id", office.pages("f").alias("x"))
    return got.select("page_id", "x.kind", F.size("x.pages").alias("pages"), F.sha2(F.replace(F.array_join("x.pages", " "), F.lit("\n"), F.lit(" ")), 256).alias("sha256"), "x.created")


@query("method_labels", """
select case when page_id % 4 = 0 then 'html' when page_id % 5 = 0 then 'pdf_text' when page_id % 5 >= 3 then 'pdf_ocr' else 'pdf_text+ocr' end as method, count(*) as n from pages group by 1
""")  # fmt: skip
def method_labels(spark, d):
    kind = F.when(F.col("page_id") % 4 == 0, "html").otherwise("pdf")
    return table(spark, d, "pages").groupBy(S.method_label(kind, F.lit(3), F.col("page_id") % 5).alias("method")).agg(F.count("*").alias("n"))


@query("pages_to_scan", """
with p as (select page_id, len(list_filter(regexp_split_to_array(substr(html, 1 + (page_id % 40) * 10, (page_id % 9) * 30), '[ \\t\\r\\n]+'), lambda x: x <> '')) as n from pages) select page_id, n as words, n < 15 as scan from p
""")  # fmt: skip
def pages_to_scan(spark, d):
    """Pages with too few words of their own to do without recognition of characters."""
    part = F.substring("html", (1 + (F.col("page_id") % 40) * 10).cast("int"), ((F.col("page_id") % 9) * 30).cast("int"))
    n = F.size(F.filter(F.split(part, r"[ \t\r\n]+"), lambda w: w != "")).cast("long")
    return table(spark, d, "pages").select("page_id", n.alias("words"), (n < 15).alias("scan"))


@query("pdf_dates", "select o_orderkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as created from orders")
def pdf_dates(spark, d):
    from ..functions.text import pdf_date

    raw = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000Z"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", pdf_date(raw).alias("created"))


@query("located_spans", """
with s as (select conv_id, turn, text, substr(text, cast(1 + turn % 5 as int), 9) as span from conversations where length(text) >= 14) select conv_id, turn, span, instr(text, span) - 1 as start, instr(text, span) - 1 + 9 as stop from s
""")  # fmt: skip
def located_spans(spark, d):
    rows = table(spark, d, "conversations").where("length(text) >= 14").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    spans = rows.select("id", "conv_id", "turn", F.substring("text", (1 + F.col("turn") % 5).cast("int"), F.lit(9)).alias("span"))
    out = S.located(spans, rows.select("id", "text"), "id")
    return out.select("conv_id", "turn", "span", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query("schema_catalogue", "".join(f"{'union all ' if i else ''}select '{t}' as \"table\", column_name as \"column\", case column_type when 'INTEGER' then 'integer' when 'BIGINT' then 'long' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' end as kind from (describe select * from {t}) " for i, t in enumerate(("nation", "customer", "part"))))
def schema_catalogue(spark, d):
    """The schemas of three tables, from the JSON document in which they are saved."""
    import json

    saved = json.loads(W.schema_json(**{t: table(spark, d, t) for t in ("nation", "customer", "part")}))
    rows = [(t, f["name"], f["type"]) for t, s in saved.items() for f in s["fields"]]
    return spark.createDataFrame(rows, "table string, column string, kind string")


@query("evidence_passages", "select l_orderkey as query_id, string_agg('[' || l_linenumber || '] ' || l_returnflag || l_linestatus, chr(10) order by l_linenumber) as evidence from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as k from lineitem) where k = 1 and l_linenumber <= 6 group by 1")
def evidence_passages(spark, d):
    from ..operators.joins import first_slot
    from ..operators.summarize import evidence

    lines = first_slot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return evidence(lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.concat("l_returnflag", "l_linestatus").alias("text")))
