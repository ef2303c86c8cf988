"""Entities and spans over documents and over text made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import mask
from ..operators import entities as E
from ..operators.sequences import bio_decode
from ..registry import query
from ..session import shared_folder, small, table

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query("entity_email", f"select doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) as email from documents")
def entity_email(spark, d):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(EMAIL), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("email"))


@query("entity_mask", """
with m as (select doc_id, lower(text) as t from documents),
a as (select doc_id, regexp_replace(t, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}', '<email>', 'g') as t from m),
b as (select doc_id, regexp_replace(t, 'https?://[^ \\t\\r\\n]+', '<url>', 'g') as t from a)
select doc_id, len(regexp_extract_all(t, '<email>')) as emails, len(regexp_extract_all(t, '<url>')) as urls from b
""")  # fmt: skip
def entity_mask(spark, d):
    from ..functions.text import MASKS

    t = mask(F.col("text"), MASKS[:2])
    n = lambda x: F.size(F.regexp_extract_all("t", F.lit(x), F.lit(0))).cast("long")
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", n("<email>").alias("emails"), n("<url>").alias("urls"))


def notes(spark, d):
    """A sentence for every order: the tables' own columns give amounts, dates, percents and phone numbers."""
    o = table(spark, d, "orders")
    text = F.concat(F.lit("Order ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(": paid Rs "), F.floor("o_totalprice").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" with "), (F.col("o_orderkey") % 30).cast("string"), F.lit("% off, call 98"), F.lpad((F.col("o_custkey") % 100000000).cast("string"), 8, "0"), F.lit("."))
    return o.select("o_orderkey", text.alias("text"))


NOTES = """notes as (select o_orderkey, 'Order ORD-' || lpad(cast(o_orderkey as varchar), 6, '0') || ': paid Rs ' || cast(cast(floor(o_totalprice) as bigint) as varchar) || ' on ' || strftime(o_orderdate, '%d/%m/%Y')
  || ' with ' || cast(o_orderkey % 30 as varchar) || '% off, call 98' || lpad(cast(o_custkey % 100000000 as varchar), 8, '0') || '.' as text from orders)"""
RULE_SQL = {"ID": "ORD-[0-9]+", "AMOUNT": "Rs [0-9]+", "DATE": "[0-9]{2}/[0-9]{2}/[0-9]{4}", "PERCENT": "[0-9]+%", "PHONE": "98[0-9]{8}\\.$"}


@query("entity_rules", f"with {NOTES}, found as (" + " union all ".join(
    f"select o_orderkey, '{label}' as label, rtrim(regexp_extract(text, '{p}'), '.') as m, text from notes" for label, p in RULE_SQL.items()
) + """) select o_orderkey, label, m as entity, cast(instr(text, case label when 'DATE' then 'on ' || m when 'PERCENT' then 'with ' || m when 'PHONE' then 'call ' || m else m end) - 1 + case label when 'DATE' then 3 when 'PERCENT' then 5 when 'PHONE' then 5 else 0 end as bigint) as start from found""")
def entity_rules(spark, d):
    rows = notes(spark, d).select("o_orderkey", F.explode(E.rule_entities("text")).alias("e"))
    return rows.select("o_orderkey", "e.label", F.col("e.text").alias("entity"), F.col("e.start").cast("long").alias("start"))


@query("entity_resolved")
def entity_resolved(spark, d):
    """Overlaps between rules and a number rule resolved, longest first: plain numbers inside other entities go."""
    find = E.matcher(E.RULES | {"NUMBER": r"\d+"})
    rows = notes(spark, d).select("o_orderkey", F.explode(E.resolve(find("text"), {"NUMBER": 1})).alias("e"))
    return rows.select("o_orderkey", "e.label", F.col("e.text").alias("entity"), F.col("e.start").cast("long").alias("start"))


@query("entity_details_map", f"""
with {NOTES} select o_orderkey, rtrim(regexp_extract(text, 'Rs [0-9]+'), '.') as amount, regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') as date_text, 5 as labels from notes
""")  # fmt: skip
def entity_details_map(spark, d):
    rows = notes(spark, d).select("o_orderkey", F.explode(E.rule_entities("text")).alias("e"))
    rows = rows.groupBy("o_orderkey", F.col("e.label").alias("label")).agg(F.array_sort(F.collect_set("e.text")).alias("texts"))
    rows = rows.groupBy("o_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "texts")))).alias("details"))
    return rows.select("o_orderkey", F.col("details")["AMOUNT"][0].alias("amount"), F.col("details")["DATE"][0].alias("date_text"), F.size("details").alias("labels"))


def spans(spark, d, shift: bool):
    """Spans of words of documents; the predicted ones are moved or named otherwise by their identifiers."""
    s = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(12), F.lit(25))).alias("k"))
    s = s.withColumn("label", F.when((F.col("doc_id") + F.col("k")) % 2 == 0, "A").otherwise("B")).withColumn("start", F.col("k"))
    if not shift:
        return s.select("doc_id", "start", (F.col("start") + 8).alias("end"), "label")
    s = s.where((F.col("doc_id") + F.col("k")) % 7 != 0)
    s = s.withColumn("start", F.col("start") + F.when(F.col("doc_id") % 5 == 0, 3).when(F.col("doc_id") % 11 == 0, 9).otherwise(0))
    s = s.withColumn("label", F.when(F.col("doc_id") % 3 == 0, "A").otherwise(F.col("label")))
    return s.select("doc_id", "start", (F.col("start") + 8).alias("end"), "label")


SPANS = """
base as (select doc_id, k, case when (doc_id + k) % 2 = 0 then 'A' else 'B' end as label from documents, (select unnest([0, 12, 25]) as k)),
gold as (select doc_id, k as s, k + 8 as e, label from base),
pred as (select doc_id, k + m as s, k + m + 8 as e, l as label from (select doc_id, k, case when doc_id % 5 = 0 then 3 when doc_id % 11 = 0 then 9 else 0 end as m, case when doc_id % 3 = 0 then 'A' else label end as l from base where (doc_id + k) % 7 <> 0))
"""


@query("span_overlap_join", f"with {SPANS} select p.doc_id, p.s as p_start, g.s as g_start, p.label as p_label, g.label as g_label from pred p join gold g on p.doc_id = g.doc_id and p.s < g.e and g.s < p.e")
def span_overlap_join(spark, d):
    from ..operators.joins import overlapping

    met = overlapping(spans(spark, d, True), spans(spark, d, False), ["doc_id"])
    return met.select(F.col("a.doc_id").alias("doc_id"), F.col("a.start").alias("p_start"), F.col("b.start").alias("g_start"), F.col("a.label").alias("p_label"), F.col("b.label").alias("g_label"))


@query("span_scores", f"""
with {SPANS}, met as (select p.doc_id, p.s as ps, p.e as pe, p.label as l, g.s as gs, g.e as ge from pred p join gold g on p.doc_id = g.doc_id and p.label = g.label and p.s < g.e and g.s < p.e),
n as (select (select count(*) from pred) as np, (select count(*) from gold) as ng, (select count(*) from met where ps = gs and pe = ge) as x,
  (select count(*) from (select distinct doc_id, ps, l from met)) as hp, (select count(*) from (select distinct doc_id, gs, l from met)) as hg),
k as (select 'strict' as kind, np, ng, x / greatest(np, 1) as p, x / greatest(ng, 1) as r from n union all select 'relaxed', np, ng, hp / greatest(np, 1), hg / greatest(ng, 1) from n)
select kind, np as predicted, ng as gold, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from k
""")  # fmt: skip
def span_scores(spark, d):
    return E.span_scores(spans(spark, d, True), spans(spark, d, False))


@query("span_errors", f"""
with {SPANS}, m as (select g.doc_id, g.s, g.label, max(case when p.label is null then 0 when p.label <> g.label then 1 when p.s <> g.s then 2 else 3 end) as level
  from gold g left join pred p on p.doc_id = g.doc_id and p.s < g.e and g.s < p.e group by all)
select ['missed', 'wrong_type', 'boundary', 'correct'][level + 1] as kind, count(*) as n from m group by 1
union all select 'spurious', count(*) from pred p where not exists (select 1 from gold g where p.doc_id = g.doc_id and p.s < g.e and g.s < p.e) having count(*) > 0
""")  # fmt: skip
def span_errors(spark, d):
    return E.span_errors(spans(spark, d, True), spans(spark, d, False))


@query("bio_round_trip", f"with {SPANS} select doc_id, s as start, e as stop, label from gold")
def bio_round_trip(spark, d):
    """Spans to BIO tags over characters, and back."""
    cells = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("pos"))
    cells = cells.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    back = bio_decode(E.to_bio(cells, spans(spark, d, False)), ["doc_id"], "pos", "tag")
    return back.select("doc_id", F.col("first").alias("start"), (F.col("last") + 1).alias("stop"), "label")


@query("gazetteer_tags", """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents where lang = 'en'),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
hits as (select doc_id, i, case when w[i] = 'of' and w[i + 1] = 'the' then 2 when w[i] = 'the' then 1 end as n from p where w[i] in ('of', 'the')),
free as (select h.doc_id, h.i, h.n from hits h where n is not null and not (n = 1 and exists (select 1 from hits b where b.doc_id = h.doc_id and b.i = h.i - 1 and b.n = 2)))
select doc_id, case n when 2 then 'PAIR' else 'ARTICLE' end as label, count(*) as found from free group by all
""")  # fmt: skip
def gazetteer_tags(spark, d):
    from ..functions.text import tokens

    lexicon = spark.createDataFrame([("of the", "PAIR"), ("the", "ARTICLE")], "phrase string, label string")
    toks = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.posexplode(tokens(F.col("text"), "[a-z]+")).alias("pos", "token"))
    return E.gazetteer(toks, small(lexicon), longest=2).groupBy("doc_id", "label").agg(F.count("*").alias("found"))


def tagged_notes(spark, d):
    """Notes as words with the tags that rule entities spell: made once and stored, since they are fitted and tagged."""
    said = notes(spark, d)
    if said.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        said = said.repartition(spark.sparkContext.defaultParallelism)  # few rows of a table make much work here
    rows = said.select("o_orderkey", E.offset_tokens("text").alias("t"), E.rule_entities("text").alias("e"))
    inside = lambda t, e: (t["start"] >= e["start"]) & (t["end"] <= e["end"])
    entity = lambda t: F.get(F.filter("e", lambda e: inside(t, e)), F.lit(0))
    gold = F.transform("t", lambda t: F.when(entity(t).isNull(), "O").otherwise(F.concat(F.when(entity(t)["start"] == t["start"], "B-").otherwise("I-"), entity(t)["label"])))
    at = shared_folder(spark, "notes")
    rows.select("o_orderkey", F.transform("t", lambda t: t["text"]).alias("words"), gold.alias("gold"), "e").write.parquet(at)
    return spark.read.parquet(at)


def by_tag(done):
    """Tokens of tagged rows by gold tag: how many, how many right, and the mean probability of what was said."""
    both = done.select(F.explode(F.arrays_zip("gold", "pred", "p")).alias("x"))
    right = (F.col("x.gold") == F.col("x.pred")).cast("double")
    return both.groupBy(F.col("x.gold").alias("tag")).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("x.p"), 4).alias("mean_p"))


@query("sequence_tagger")
def sequence_tagger(spark, d):
    """A conditional random field fitted on all notes with rule entities, and its token accuracy over them by tag."""
    from ..operators import tagging

    rows = tagged_notes(spark, d)
    field = tagging.fit(rows, "words", "gold", steps=15)
    return by_tag(tagging.tag(field, rows, "words", ("gold",)))


@query("tagger_gazetteers")
def tagger_gazetteers(spark, d):
    """Entities found in notes that are held out, by what a gazetteer of the others' entities told in training: none, all, or by folds."""
    from ..operators import tagging
    from ..session import digest_int

    rows = tagged_notes(spark, d)
    held = digest_int(F.col("o_orderkey").cast("string")) % 5 == 0
    train, rest = rows.where(~held), rows.where(held)
    at, out = shared_folder(spark, "lexicon"), None
    tagging.phrases(train.select(F.explode("e").alias("e")).select("e.text", "e.label")).write.parquet(at)
    lexicon = spark.read.parquet(at)
    plain, full = (tagging.listed(rest, "o_orderkey", "words", lexicon, mode, longest=8) for mode in ("none", "full"))
    for mode in ("none", "full", "crossfit"):
        field = tagging.fit(tagging.listed(train, "o_orderkey", "words", lexicon, mode, longest=8), "words", "gold", None if mode == "none" else "spans", steps=8)
        done = tagging.tag(field, plain if mode == "none" else full, "words", ("o_orderkey", "gold"), None if mode == "none" else "spans")
        tags = done.select("o_orderkey", F.posexplode(F.arrays_zip("gold", "pred")).alias("pos", "x")).select("o_orderkey", "pos", "x.gold", "x.pred")
        part = E.sequence_scores(tags, ["o_orderkey"]).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("merged_spans", f"""
with {SPANS} select doc_id, s as start, e as stop, label from gold union all select doc_id, s, e, label from pred p where not exists (select 1 from gold g where g.doc_id = p.doc_id and g.s < p.e and p.s < g.e)
""")  # fmt: skip
def merged_spans(spark, d):
    """All spans of one source, and those of another that overlap none of them."""
    lists = lambda df, name: df.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "label")).alias(name))
    rows = lists(spans(spark, d, False), "first").join(lists(spans(spark, d, True), "second"), "doc_id", "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    merged = rows.select("doc_id", F.explode(E.merge(F.col("first"), F.coalesce("second", none))).alias("s"))
    return merged.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "s.label")


def _masked(text: str) -> str:
    from ..functions.text import MASKS

    for pattern, name in MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


@query("masked_notes", f"with {NOTES} select o_orderkey, {_masked("lower(text || ' Mail a' || o_orderkey || '@example.org, see https://example.org/' || o_orderkey || ' by 2031-01-09, 3.5 kg')")} as masked from notes")
def masked_notes(spark, d):
    """Every mask in turn: addresses, links, dates of two kinds, amounts, percents, telephone and other numbers."""
    key = F.col("o_orderkey").cast("string")
    said = F.concat("text", F.lit(" Mail a"), key, F.lit("@example.org, see https://example.org/"), key, F.lit(" by 2031-01-09, 3.5 kg"))
    return notes(spark, d).select("o_orderkey", mask(said).alias("masked"))
