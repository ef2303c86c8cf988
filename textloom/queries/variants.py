"""Variants, perturbations and splits over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as V
from ..registry import query
from ..session import table


@query("group_split", """
with g as (select conv_id, min(role) as role from conversations group by 1),
k as (select *, row_number() over (partition by role order by md5(conv_id || '|7'), conv_id) as k, count(*) over (partition by role) as n from g)
select conv_id, role, case when n < 3 then 'train' when (k - 1) / n < 0.7 then 'train' when (k - 1) / n < 0.85 then 'validation' else 'test' end as split from k
""")  # fmt: skip
def group_split(spark, d):
    return V.group_split(table(spark, d, "conversations"), "conv_id", "role")


@query("split_leaks", "select 0 as leaking_groups, count(distinct conv_id) as groups from conversations")
def split_leaks(spark, d):
    rows = table(spark, d, "conversations").join(V.group_split(table(spark, d, "conversations"), "conv_id", "role").select("conv_id", "split"), "conv_id")
    by = rows.groupBy("conv_id").agg(F.count_distinct("split").alias("n"))
    return by.agg(F.sum((F.col("n") > 1).cast("int")).cast("int").alias("leaking_groups"), F.count("*").alias("groups"))


@query("variants_casual", "select conv_id, turn, v from (select conv_id, turn, text, regexp_replace(lower(text), '[.!?]+$', '') as v from conversations) where v <> text")
def variants_casual(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", V.casual(F.col("text")).alias("v")).where("v is not null")


@query("perturb_half", """
with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as w from conversations)
select conv_id, turn, array_to_string(w[1 : greatest(cast(ceil(len(w) / 2) as int), 1)], ' ') as half from w
""")  # fmt: skip
def perturb_half(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", V.first_half(F.col("text")).alias("half"))


@query("variant_expansion")
def variant_expansion(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return V.expand(rows, "id", "text")


@query("robustness")
def robustness(spark, d):
    """How often a routing label stays the same under each perturbation."""
    from ..operators.routing import route
    from .classify import RULES

    rows = table(spark, d, "conversations").select("text", route(F.col("text"), RULES)["label"].alias("label"))
    made = F.array(*[F.struct(F.lit(k).alias("perturbation"), f(F.col("text")).alias("t")) for k, f in V.PERTURBATIONS.items()])
    long = rows.select("label", F.explode(made).alias("x")).select("label", "x.*").withColumn("now", route(F.col("t"), RULES)["label"])
    return long.groupBy("perturbation").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("now")).cast("double")), 6).alias("consistency"))
