"""Evaluation as aggregations: class metrics, calibration, risk and coverage, intervals, paired tests, sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import digest_int, shared_folder, small
from .sequences import running


def confusion(df: DataFrame, labels: list, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.groupBy(gold).pivot(pred, labels).count().na.fill(0)


def per_class(df: DataFrame, gold: str = "gold", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 of every label that is gold or predicted; 0/0 is 0.

    Each row gives two partial counts, so there is one shuffle by label and no join.
    """
    part = lambda c, x, y, z: F.struct(F.col(c).alias("label"), x.alias("tp"), y.alias("fp"), z.alias("fn"))
    hit, one, no = (F.col(gold) == F.col(pred)).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = df.select(*by, F.explode(F.array(part(gold, hit, no, one - hit), part(pred, no, one - hit, no))).alias("x")).select(*by, "x.*")
    s = rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("support", F.col("tp") + F.col("fn"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return s.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro(df: DataFrame, gold: str = "gold", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and the unweighted mean of F1 over all labels, gold or predicted."""
    s = per_class(df, gold, pred, by)
    return s.groupBy(*by).agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def calibration_error(df: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error: bins closed on the left, the last one closed on both sides."""
    edge = F.least(F.floor(F.round(F.col(conf) * bins, 9)), F.lit(bins - 1))
    b = df.groupBy(edge.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"))


def risk_coverage(df: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """Accuracy at each distinct confidence, from the highest down; equal confidences come together.

    Rows fall together by confidence first, and windows see one of 4096 ranges of it.
    """
    by = df.groupBy(conf).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("hits"))
    total = df.count() or 1
    out = running(by, [], -F.floor(F.col(conf) * 4096), [F.desc(conf)], {"covered": "n", "right": "hits"})
    return out.select(F.col(conf).alias("threshold"), F.round(F.col("covered") / total, 6).alias("coverage"), F.round(F.col("right") / F.col("covered"), 6).alias("accuracy"))


def abstention_threshold(curve: DataFrame, least: float = 0.9) -> DataFrame:
    """The lowest threshold from which accuracy is ``least`` or more."""
    return curve.where(F.col("accuracy") >= least).agg(F.min("threshold").alias("threshold"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact McNemar test of two systems' correctness: discordant pairs and the two-sided binomial p."""
    n10 = F.sum((F.col(a) & ~F.col(b)).cast("long"))
    n01 = F.sum((~F.col(a) & F.col(b)).cast("long"))
    s = df.agg(F.coalesce(n10, F.lit(0)).alias("only_a"), F.coalesce(n01, F.lit(0)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log binomials as running sums keep the tail in range for large n
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, lambda acc, i: F.when(i > k, acc).otherwise(F.struct((acc["term"] + F.log((n - i + 1) / i)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((n - i + 1) / i))).alias("sum"))))
    return s.withColumn("p", F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail["sum"]), 9)))


def bootstrap(df: DataFrame, value: str, key: str, rounds: int = 200) -> DataFrame:
    """A 95% interval of a mean by a Poisson bootstrap: in each round a row counts as often as its digest says.

    Every row decides for itself, so rounds are partial sums and rows never move.
    """
    # cumulative probabilities of a Poisson variable with mean 1, times 2^32
    cuts = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373]
    u = digest_int(F.col(key).cast("string"), F.col("round").cast("string"))
    times = sum((u >= c).cast("long") for c in cuts)
    rows = df.select(key, value).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("times", times)
    means = rows.groupBy("round").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    p = lambda q: F.round(F.percentile("m", q), 6)
    return means.agg(p(0.025).alias("low"), p(0.975).alias("high"), F.count("*").alias("rounds"))


def sweep(df: DataFrame, thresholds: list[float], score: str = "score", gold: str = "gold") -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold`` for each threshold, in one pass over the rows."""
    col = lambda t, c: F.sum((c & (F.col(score) >= t)).cast("long"))
    aggs = [F.struct(F.lit(t).alias("threshold"), col(t, F.col(gold) == 1).alias("tp"), col(t, F.col(gold) != 1).alias("fp")) for t in thresholds]
    s = df.agg(F.sum((F.col(gold) == 1).cast("long")).alias("positives"), F.array(*aggs).alias("x")).select("positives", F.explode("x").alias("x")).select("positives", "x.*")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("positives")))
    return s.withColumn("f1", ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))).drop("positives")


def best(metrics: DataFrame, metric: str, setting: str) -> DataFrame:
    """The setting with the highest metric; of equal ones the lowest."""
    return metrics.agg(F.max_by(F.struct(setting, metric), F.struct(F.col(metric), -F.col(setting))).alias("b")).select("b.*")


def slices(df: DataFrame, by: Column, name: str, correct: str = "correct") -> DataFrame:
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.round(1 - F.avg(F.col(correct).cast("double")), 6).alias("error_rate"))


def confused_pairs(df: DataFrame, k: int, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.where(F.col(gold) != F.col(pred)).groupBy(gold, pred).agg(F.count("*").alias("n")).orderBy(F.desc("n"), gold, pred).limit(k)


def quantiles(df: DataFrame, value: str, by: tuple[str, ...] = (), ps: tuple[float, ...] = (0.5, 0.95), bins: int = 1024) -> DataFrame:
    """(by, n, mean, q): exact interpolated quantiles in an array, by histograms that get finer each round.

    A quantile lies between two ranks. Each round counts, for every rank that is looked for, the values of its interval in ``bins`` parts, with
    the least and greatest of each; the part that holds the rank is the next interval, until it has one value. Tasks count before the
    shuffle, so a group of any size is a row for each part and task. There are about as many rounds as digits to base ``bins`` in a
    group's range over the distance of neighbours. Null values count in n alone; values are finite. Groups are
    few or many: their intervals are broadcast while they are few.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "quantiles")
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *([] if by else [F.lit(0).alias("_k0")]), F.col(value).cast("double").alias("v"))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.count("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    at = [F.lit(p) * (F.col("m") - 1) for p in ps]
    sought = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    state = groups.where("m > 0").select(*keys, "lo", "hi", F.lit(0).cast("long").alias("before"), F.explode(sought).alias("rank"))
    state.write.parquet(f"{folder}/state-0")
    k, same = 0, lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys])
    while (state := spark.read.parquet(f"{folder}/state-{k}")).where("lo < hi").limit(1).count():
        wide = small(state.where("lo < hi")).alias("s")
        met = rows.alias("r").join(wide, same("r", "s") & F.col("r.v").between(F.col("s.lo"), F.col("s.hi")))
        share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
        part = F.when(F.col("v") >= F.col("hi"), bins - 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = met.select(*[f"s.{c}" for c in keys], "rank", "before", part.alias("part"), "v").groupBy(*keys, "rank", "before", "part").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("part"))
        found = counts.withColumn("upto", F.col("before") + upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        done = state.where("lo = hi").select(*keys, "lo", "hi", "before", "rank")
        k += 1
        done.unionByName(found.select(*keys, "lo", "hi", (F.col("upto") - F.col("c")).alias("before"), "rank")).write.parquet(f"{folder}/state-{k}")
    lists = state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    out = groups.alias("g").join(lists.alias("l"), same("g", "l"), "left")
    between = lambda x: F.col("at")[F.floor(x)] + (x - F.floor(x)) * (F.col("at")[F.ceil(x)] - F.col("at")[F.floor(x)])
    return out.select(*[F.col(f"g.{k}").alias(c) for c, k in zip(by, keys)], "n", "mean", F.when(F.col("m") > 0, F.array(*map(between, at))).alias("q"))


def latency(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median and 95th percentile, interpolated."""
    q = quantiles(df, value, by)
    return q.select(*by, "n", F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))
