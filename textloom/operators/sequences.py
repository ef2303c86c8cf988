"""Operators over ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, about, that a task orders where a group's rows have to meet: its memory stays the same when the table grows.
PER_TASK = 500_000


def dealt(df: DataFrame, by: list[str], per_task: int = PER_TASK) -> DataFrame:
    """Groups dealt over tasks of so many rows; a number of partitions that is asked for is not made smaller by adaptive execution."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task)), *by)


def overlaps_previous(spans: DataFrame, by: list[str], start: str, end: str, then: list[str]) -> DataFrame:
    """Spans that begin before the span before them has ended."""
    w = Window.partitionBy(*by).orderBy(start, *then)
    return spans.withColumn("_b", F.lag(end).over(w)).where(F.col("_b") > F.col(start)).drop("_b")


def forward_fill(df: DataFrame, by: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """Each named column's last value so far that isn't null."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({out: F.last(c, ignorenulls=True).over(w) for c, out in cols.items()})


def gaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Whether the numbers of a group are other than 1..n. Sums and extremes tell it; no list is gathered."""
    n, x = F.count("*"), F.col(number)
    out = df.groupBy(*by).agg(n.alias("lines"), F.min(x).alias("first"), F.max(x).alias("last"), F.count_distinct(x).alias("_d"))
    return out.withColumn("has_gap", ~((F.col("first") == 1) & (F.col("last") == F.col("lines")) & (F.col("_d") == F.col("lines")))).drop("_d")


def budget(df: DataFrame, by: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """Rows in order until the sum of costs would pass ``most``; the first row stays in any case."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return df.withColumns({"upto": upto, "_k": F.row_number().over(w)}).where((F.col("_k") == 1) | (F.col("upto") <= most)).drop("_k")


def winner(df: DataFrame, by: list[str], score: str, then: list[str]) -> DataFrame:
    """The best row of each group with the second score and the margin."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *then)
    out = df.withColumns({"second": F.lead(score).over(w), "_k": F.row_number().over(w)}).where("_k = 1").drop("_k")
    return out.withColumn("margin", F.round(F.col(score) - F.col("second"), 4))


def sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """Exactly n rows, the same for the same seed: those with the least digests."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))), *keys).limit(n)


def lines(boxes: DataFrame, by: list[str], top: str, bottom: str, then: list[str]) -> DataFrame:
    """Boxes in lines: a box that begins above the lowest edge of the line so far belongs to it.

    The lowest edge starts anew with each line, but every box before the line ended above the line's first box. So the lowest edge of
    all boxes so far decides the same, and a running maximum is enough.
    """
    w = Window.partitionBy(*by).orderBy(top, *then)
    low = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(low.isNull() | (F.col(top) >= low), 1).otherwise(0)
    return boxes.withColumn("_f", fresh).withColumn("line", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def bio_decode(tags: DataFrame, by: list[str], pos: str, tag: str, p: str | None = None, per_task: int = PER_TASK) -> DataFrame:
    """Runs of B-/I- tags as spans (label, first, last); an I- after another label begins a span. Gaps and islands by a window.

    With ``p`` the confidence is the mean of the tokens' probabilities in four digits, null where one is missing.
    """
    more = [F.when(F.count(p) == F.count("*"), F.round(F.avg(p), 4)).alias("confidence")] if p else []
    return bio_sides(tags, by, pos, {"": tag}, [p] if p else [], more, per_task).drop("side")


def bio_sides(tags: DataFrame, by: list[str], pos: str, sides: dict[str, str], cols: list[str] = (), more: list[Column] = (), per_task: int = PER_TASK) -> DataFrame:
    """``bio_decode`` of several columns of tags, named in ``sides``: side, label, first, last and ``more``. Rows are dealt and ordered once for all."""
    w = Window.partitionBy(*by).orderBy(pos)
    rows = dealt(tags.select(*dict.fromkeys([*by, pos, *sides.values(), *cols])), by, per_task)
    label = {s: F.regexp_extract(t, "^[BI]-(.+)$", 1) for s, t in sides.items()}
    before = {s: F.regexp_extract(F.coalesce(F.lag(t).over(w), F.lit("O")), "^[BI]-(.+)$", 1) for s, t in sides.items()}
    rows = rows.withColumns({f"_f{s}": F.when(F.col(t).startswith("B-") | (label[s] != before[s]), 1).otherwise(0) for s, t in sides.items()})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    told = [F.struct(F.lit(s).alias("side"), F.sum(f"_f{s}").over(upto).alias("_k"), label[s].alias("label")) for s in sides]
    rows = rows.select(*by, pos, *cols, F.array(*told).alias("_s")).select(*by, pos, *cols, F.explode("_s").alias("_s")).select(*by, pos, *cols, "_s.*").where("label <> ''")
    return rows.groupBy(*by, "side", "_k", "label").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), *more).drop("_k")


def running(df: DataFrame, by: list[str], bucket: Column, order: list, sums: dict[str, str | None]) -> DataFrame:
    """Adds running sums over ``order`` within ``by``: of a column, or of rows where that is None.

    ``bucket`` ascends with ``order`` and cuts a group into parts. A window sees one part alone, and what the parts before hold is added
    from their totals, a row each, so a group may be as large as the table.
    """
    df = df.withColumn("_b", bucket)
    value = lambda c: F.lit(1).cast("long") if c is None else F.col(c)
    total = df.groupBy(*by, "_b").agg(*[F.sum(value(c)).alias(f"_t_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_b"]
    total = total.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_t_{out}") for out in sums])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.join(total, same)
    return rows.withColumns({out: F.col(f"_t_{out}") + F.sum(value(c)).over(own) for out, c in sums.items()}).drop("_b", *[f"_k{i}" for i in range(len(keys))], *[f"_t_{out}" for out in sums])
