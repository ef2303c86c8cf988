"""Document parsing: labelled fields, programme recognition, carried context, year and semester notations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsing as P
from ..registry import query
from ..session import small, table


def sheets(spark, d):
    """A labelled sheet for each part."""
    p = table(spark, d, "part")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    return p.select("p_partkey", F.concat_ws("\n", line("Course", F.col("p_name")), line("Course Type", F.col("p_type")), line("Semester", (F.col("p_size") % 8 + 1).cast("string")), line("Credits", (F.col("p_size") % 4 + 1).cast("string")), F.lit("Objective: to know more"), line("Course", F.lit("a second name"))).alias("text"))


@query("labelled_fields", "select p_partkey, p_name as course, p_type as course_type, p_size % 8 + 1 as semester, p_size % 4 + 1 as credits, 'labelled' as provenance, 1.0 as parse_confidence from part")
def labelled_fields(spark, d):
    out = P.parse(sheets(spark, d), "p_partkey", "text", {"course": "Course", "course_type": "Course Type", "semester": "Semester", "credits": "Credits"})
    return out.withColumns({"semester": F.col("semester").cast("int"), "credits": F.col("credits").cast("int")})


@query("nation_mentions", """
with t as (select s_suppkey, unnest(regexp_extract_all(lower('ships to ' || n_name || ', then NATION_1; not nation_1x, and ' || n_name || '.'), '[a-z0-9_]+')) as w from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, count(*) as mentions, string_agg(w, '|' order by w) as names from t where w in (select lower(n_name) from nation) group by 1
""")  # fmt: skip
def nation_mentions(spark, d):
    """All places of nations' names, not inside other words."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    t = table(spark, d, "supplier").join(small(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    t = t.select("s_suppkey", F.concat(F.lit("ships to "), "n_name", F.lit(", then NATION_1; not nation_1x, and "), "n_name", F.lit(".")).alias("text"))
    found = P.mentions(t, "s_suppkey", "text", names).groupBy("s_suppkey")
    return found.agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


@query("name_places", """
with names as (select distinct regexp_extract(lower(text), '[a-z0-9]+ [a-z0-9]+') as name from benchmark),
pieces as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')) as p, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), 1) as i from documents),
placed as (select doc_id, i, p, sum(length(p)) over (partition by doc_id order by i) - length(p) as start from pieces),
pairs as (select doc_id, start, p || lead(p, 1) over w || lead(p, 2) over w as name from placed window w as (partition by doc_id order by i))
select doc_id, name, cast(start as int) as start from pairs join names using (name) where name <> ''
""")  # fmt: skip
def name_places(spark, d):
    """Every place in documents of the first two words of each benchmark item."""
    from ..operators.names import places

    names = table(spark, d, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z0-9]+ [a-z0-9]+", 0).alias("name"))
    return places(table(spark, d, "documents"), "doc_id", "text", names)


SAID = ["n_name", "'number ' || n_nationkey || ' or so'", "'by way of ' || n_name || ' to ' || (n_nationkey % 7)", "'a nation'"]


@query("name_match", f"""
with said as (select s_suppkey, replace(lower(case s_suppkey % 4 {' '.join(f"when {i} then {x}" for i, x in enumerate(SAID))} end), '_', ' ') as t from supplier join nation on s_nationkey = n_nationkey),
n as (select replace(lower(n_name), '_', ' ') as name from nation),
met as (select s_suppkey, name, contains(' ' || t || ' ', ' ' || name || ' ') as exact, len(list_intersect(string_split(name, ' '), string_split(t, ' '))) as shared, contains(' ' || t || ' ', ' ' || string_split(name, ' ')[2] || ' ') as strong from said, n),
ranked as (select *, row_number() over (partition by s_suppkey order by exact desc, case when exact then length(name) end desc, shared desc, length(name), name) as r from met where exact or strong and shared >= 1),
lists as (select s_suppkey, list(name order by r) as x, bool_or(exact) as e from ranked where r <= 5 group by 1)
select s_suppkey, x[1] as best, case when e then 'exact' when x is null then 'none' else 'partial' end as kind, coalesce(x[2:], []) as alternatives from said left join lists using (s_suppkey)
""")  # fmt: skip
def name_match(spark, d):
    """The nation that a text means, exactly or in part, and what else it may mean."""
    from ..operators.names import match

    t = table(spark, d, "supplier").join(small(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    said = F.element_at(F.array(*map(F.expr, SAID)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return match(t.select("s_suppkey", said.alias("text")), "s_suppkey", "text", table(spark, d, "nation"), "n_name", weak=("nation",))


@query("carried_context", """
with x as (select conv_id, turn, role, text, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows unbounded preceding) as asked from conversations)
select conv_id, asked, count(*) as turns, cast(sum(length(text)) as bigint) as chars from x group by all
""")  # fmt: skip
def carried_context(spark, d):
    rows = table(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("turn")))
    out = P.sections(rows, ["conv_id"], ["turn"], "head").groupBy("conv_id", F.col("head").alias("asked"))
    return out.agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("year_notations", "select n_nationkey, case n_nationkey % 5 when 0 then -1 when 1 then 1 when 2 then 2 when 3 then 3 else null end as year from nation")
def year_notations(spark, d):
    from ..functions.text import year_of

    said = F.element_at(F.array(*map(F.lit, ("in the final year", "First year student", "2nd year", "Year 3", "no notion"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", year_of(said).alias("year"))


#: Each form with the numbers that it names.
SEMESTERS = {
    "taught in semester 2 of the plan": [2], "semesters 3 to 6, twice a week": [3, 4, 5, 6], "Sems. V & VII by turns": [5, 7], "the tenth semester alone": [10], "Sem - 8": [8],
    "runs in semester ix or x": [9, 10], "Year / Sem: I / II": [2], "seminars on 4 days": [], "1st, 2nd and 3rd semesters": [1, 2, 3], "no term is named": [], "semesters 2–4 and 7": [2, 3, 4, 7],
}
_FORMS = ", ".join(f"'{x}'" for x in SEMESTERS)
_NAMED = ", ".join(map(str, SEMESTERS.values()))


@query("semester_notations", f"select n_nationkey, [{_FORMS}][n_nationkey % {len(SEMESTERS)} + 1] as said, [{_NAMED}][n_nationkey % {len(SEMESTERS)} + 1] as semesters from nation")
def semester_notations(spark, d):
    from ..functions.python_text import semester_list

    said = F.element_at(F.array(*map(F.lit, SEMESTERS)), (F.col("n_nationkey") % len(SEMESTERS) + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", said.alias("said"), semester_list(said).alias("semesters"))
