"""Window-shaped queries, ordered reports and event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..registry import query
from ..session import table


@query("sequential_ids", """
select o_orderkey, 'G' || lpad(cast(row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as varchar), 6, '0') as group_id, o_orderpriority from orders
""")  # fmt: skip
def sequential_ids(spark, d):
    rows = S.running(table(spark, d, "orders"), ["o_orderpriority"], F.date_trunc("month", "o_orderdate"), ["o_orderdate", "o_orderkey"], {"nth": None})
    return rows.select("o_orderkey", F.concat(F.lit("G"), F.lpad(F.col("nth").cast("string"), 6, "0")).alias("group_id"), "o_orderpriority")


@query("previous_end_overlap", """
with s as (select user_id, event_id, epoch(ts) as start, epoch(ts) + 3600 * (1 + event_id % 5) as stop from events)
select user_id, event_id from (select *, lag(stop) over (partition by user_id order by start, event_id) as before from s) where before > start
""")  # fmt: skip
def previous_end_overlap(spark, d):
    s = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("start", F.col("us") / 1e6)
    s = s.withColumn("stop", F.col("start") + 3600 * (1 + F.col("event_id") % 5))
    return S.overlaps_previous(s, ["user_id"], "start", "stop", ["event_id"]).select("user_id", "event_id")


@query("forward_fill", """
select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as asked_at from conversations
""")  # fmt: skip
def forward_fill(spark, d):
    rows = table(spark, d, "conversations").withColumn("u", F.when(F.col("role") == "user", F.col("turn")))
    return S.forward_fill(rows, ["conv_id"], ["turn"], {"u": "asked_at"}).select("conv_id", "turn", "role", "asked_at")


@query("gap_check", """
select l_orderkey, count(*) as lines, min(l_linenumber) as first, max(l_linenumber) as last, list_sort(list(l_linenumber)) <> range(1, count(*) + 1)::int[] as has_gap from lineitem group by 1
""")  # fmt: skip
def gap_check(spark, d):
    return S.gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("running_budget", """
with w as (select conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
c as (select *, sum(n) over (partition by conv_id order by turn rows unbounded preceding) as upto from w)
select conv_id, turn, cast(upto as bigint) as upto from c where k = 1 or upto <= 120
""")  # fmt: skip
def running_budget(spark, d):
    from ..functions.text import tokens

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.size(tokens(F.col("text"))).alias("n"))
    return S.budget(rows, ["conv_id"], ["turn"], "n", 120).select("conv_id", "turn", "upto")


@query("winner_margin", """
with s as (select p_brand, p_partkey, p_retailprice as score from part),
r as (select *, lead(score) over w as second, row_number() over w as k from s window w as (partition by p_brand order by score desc, p_partkey))
select p_brand, p_partkey, score, second, round(score - second, 4) as margin from r where k = 1
""")  # fmt: skip
def winner_margin(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("score"))
    return S.winner(rows, ["p_brand"], "score", ["p_partkey"])


@query("best_per_group_then_overall", """
with r as (select p_size, p_partkey, p_retailprice, row_number() over (partition by p_size order by p_retailprice desc, p_partkey) as k from part),
o as (select *, row_number() over (order by p_retailprice desc, p_partkey) as overall from r where k = 1)
select p_size, p_partkey, p_retailprice, overall from o
""")  # fmt: skip
def best_per_group_then_overall(spark, d):
    best = table(spark, d, "part").groupBy("p_size").agg(F.max(F.struct("p_retailprice", -F.col("p_partkey"))).alias("b"))
    best = best.select("p_size", (-F.col("b.col2")).alias("p_partkey"), F.col("b.p_retailprice").alias("p_retailprice"))
    # one row for each size is left, so a single window is small
    return best.withColumn("overall", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long"))


@query("top_three_per_group", """
select p_type, p_partkey, p_retailprice, rank from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rank from part) where rank <= 3
""")  # fmt: skip
def top_three_per_group(spark, d):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_type", "p_partkey", "p_retailprice", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query("custom_category_order", """
select o_orderpriority, n, list_position(['5-LOW', '1-URGENT', '3-MEDIUM', '2-HIGH'], o_orderpriority) as place from (select o_orderpriority, count(*) as n from orders group by 1)
""")  # fmt: skip
def custom_category_order(spark, d):
    order = F.array(*map(F.lit, ("5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH")))
    by = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = F.array_position(order, F.col("o_orderpriority"))
    return by.withColumn("place", F.when(place > 0, place.cast("int")))


@query("hash_sample", """
select conv_id, turn from (select conv_id, turn, row_number() over (order by md5(conv_id || '|' || turn || '|7'), conv_id, turn) as k from conversations) where k <= 50
""")  # fmt: skip
def hash_sample(spark, d):
    return S.sample(table(spark, d, "conversations").select("conv_id", "turn"), 50, 7, ["conv_id", "turn"])


SESSION = """
with g as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) // 1000000 as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k
"""


@query("sessions_6h", SESSION)
def sessions_6h(spark, d):
    by = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("tumbling_counts", """
select epoch_us(time_bucket(interval 1 hour, ts)) // 1000000 as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all
""")  # fmt: skip
def tumbling_counts(spark, d):
    by = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query("sliding_counts", """
with b as (select event_type, value, epoch_us(time_bucket(interval 1 hour, ts)) // 1000000 as h from events)
select h - o * 3600 as start, event_type, count(*) as n, round(sum(value), 4) as total from b cross join (select unnest([0, 1]) as o) group by all
""")  # fmt: skip
def sliding_counts(spark, d):
    by = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query("line_grouping", """
with recursive o as (select conv_id, turn, 10.0 * turn + (turn % 3) * 8 as top, 10.0 * turn + (turn % 3) * 8 + 9 as bottom, row_number() over (partition by conv_id order by 10.0 * turn + (turn % 3) * 8, turn) as k from conversations),
walk as (select conv_id, k, turn, cast(bottom as double) as low, 1 as line from o where k = 1
  union all select o.conv_id, o.k, o.turn, case when o.top < w.low then greatest(w.low, o.bottom) else o.bottom end, case when o.top < w.low then w.line else w.line + 1 end from walk w join o on o.conv_id = w.conv_id and o.k = w.k + 1)
select conv_id, cast(max(line) as bigint) as lines from walk group by conv_id
""")  # fmt: skip
def line_grouping(spark, d):
    boxes = table(spark, d, "conversations").select("conv_id", "turn", (10.0 * F.col("turn") + (F.col("turn") % 3) * 8).cast("double").alias("top"))
    boxes = boxes.withColumn("bottom", F.col("top") + 9)
    return S.lines(boxes, ["conv_id"], "top", "bottom", ["turn"]).groupBy("conv_id").agg(F.max("line").cast("long").alias("lines"))
