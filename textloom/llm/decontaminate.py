"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations alone.

A window of a document has as many words as the benchmark item that it is held against. Fingerprints of windows and items meet in a
multi-index: the 64 bits fall into ``BLOCKS`` blocks, and of up to ``RADIUS`` differing bits some block holds at most
``RADIUS // BLOCKS``; items are listed under every value of a block within that many bits, so no pair within the radius is missed.
Pairs that meet are verified by the exact similarity of their five-word shingles, each weighing as often as it occurs.

Which windows need a fingerprint follows from the similarity itself. To reach it, a window of m shingles must share at least
``need(m)`` places with the item, and moving a window right to its first shared place loses none. So windows begin at shared places
only, and only where enough of them lie within reach; every other window is further off than the threshold.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small
from .common import Workspace, table
from .native import with_grams, words

SHINGLE = 5
SIMILAR = 0.8
#: Two shingle multisets that are similar by 0.8 differ in 10 of 64 bits on the average; in over 19 about once in two thousand times.
RADIUS = 19
BLOCKS = (13, 13, 13, 13, 12)


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``sh``: hashes of five-word shingles of the lower-cased words, in order."""
    return with_grams(df, words(F.lower(text)), SHINGLE, "sh")


def _bits(hashes: Column, n: Column, width: int) -> Column:
    """Bits that over half of the hashes set. Counters of ``width`` bits lie side by side in longs, so a pass over the hashes counts several bits."""
    one, mask = sum(1 << k for k in range(0, 64, width)), (1 << width) - 1
    lane = lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(one)))
    lanes = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lane)

    def bits(at: Column) -> Column:
        count = lambda j: F.call_function("shiftrightunsigned", F.get(at, j % width), j - j % width).bitwiseAND(F.lit(mask))
        bit = lambda j: F.when(2 * count(j) > n, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, j: a.bitwiseOR(bit(j)))

    # the list of lanes is bound by a lambda: named at each bit, it would be 64 copies of its expression in the plan
    return F.get(F.transform(F.array(lanes), bits), F.lit(0))


def fingerprint(hashes: Column, n: Column) -> Column:
    """SimHash of ``n`` hashes: a bit is set where over half of them set it. Over 65535 hashes take wider counters."""
    return F.when(n < 1 << 16, _bits(hashes, n, 16)).otherwise(_bits(hashes, n, 32))


def block_keys(fp: Column) -> list[Column]:
    out, at = [], 0
    for n in BLOCKS:
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)))
        at += n
    return out


def near_values(width: int, bits: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(width), k)]


def need(m: Column, size: Column) -> Column:
    """Places that a window of ``size`` shingles shares at least with an item of m shingles that it is similar to."""
    return F.ceil(F.lit(SIMILAR) / (1 + SIMILAR) * (m + size) - 1e-9)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity: shingles shared, over all shingles, each as often as it occurs."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    slow = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(slow)
    return shared / (F.size(a) + F.size(b) - shared)


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, sh, m, item_fp. Items of fewer than five words have no shingle and meet nothing."""
    out = with_shingles(benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), F.col("text")).drop("text").where(F.size("sh") > 0)
    out = out.withColumn("m", F.size("sh"))
    return out.withColumn("item_fp", fingerprint(F.col("sh"), F.col("m"))).distinct()


def _found(ws: Workspace, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``contaminated``, and th, the hash of the text that the row stands for."""
    known = ws.save(items(benchmark, item_col), "items")
    listed = ws.save(known.select("item", "m", F.explode("sh").alias("h")).distinct(), "listed")
    # rows meet by a key that is never null, as identifiers may be
    own = docs.select(F.xxhash64(id_col, text_col).alias("d"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # shingles leave the scan one by one; an outer generator infers no filter, which would be pushed below the steps that make them and repeat them all
    places = with_shingles(own.select("d", "text"), F.col("text")).select("d", F.size("sh").alias("n"), F.posexplode_outer("sh").alias("pos", "h"))
    hit = places.join(small(listed), "h").select("d", "n", "item", "m", "pos").distinct()
    size = F.least("m", "n")
    hit = hit.withColumn("size", size).withColumn("need", need(F.col("m"), F.col("size"))).where("n >= need")
    row = Window.partitionBy("d", "item").orderBy("pos")
    hit = ws.save(hit.withColumn("nth", F.row_number().over(row)), "hits")
    # the place with which a window that begins here has enough of them
    last = hit.select("d", "item", (F.col("nth") - F.col("need") + 1).alias("nth"), F.col("pos").alias("reach"))
    begin = hit.join(last, ["d", "item", "nth"]).where("reach - pos < size")
    begin = ws.save(begin.select("d", "m", "size", F.least("pos", F.col("n") - F.col("size")).alias("start")).distinct(), "begin")

    # texts with a window to look at are few, and are read again
    own = with_shingles(own.join(small(begin.select("d").distinct()), "d", "left_semi"), F.col("text")).drop("text")
    own = ws.save(own, "touched").distinct()
    shown = own.join(begin, "d").select("d", "doc", "th", "m", "start", F.slice("sh", F.col("start") + 1, F.col("size")).alias("win"))
    shown = ws.save(shown.withColumn("fp", fingerprint(F.col("win"), F.size("win"))), "windows")
    asked = shown.select("m", "fp", F.posexplode(F.array(*block_keys(F.col("fp")))).alias("block", "value")).distinct()
    index = None
    for k, (width, key) in enumerate(zip(BLOCKS, block_keys(F.col("item_fp")))):
        masks = F.expr(f"array({','.join(f'{x}L' for x in near_values(width, RADIUS // len(BLOCKS)))})")
        part = known.select("item", "m", "item_fp", F.lit(k).alias("block"), key.alias("key"), F.explode(masks).alias("mask"))
        part = part.select("item", "m", "item_fp", "block", F.col("key").bitwiseXOR(F.col("mask")).alias("value"))
        index = part if index is None else index.unionByName(part)
    # by a shuffle: a broadcast of the index would be some 1800 rows for each item in the driver
    near = asked.join(index.hint("merge"), ["m", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("m", "fp", "item").distinct()
    sure = shown.join(near, ["m", "fp"]).join(known.select("item", "m", "sh"), ["item", "m"])
    sure = sure.withColumn("similarity", similarity(F.col("win"), F.col("sh"))).where(F.col("similarity") >= SIMILAR - 1e-12)
    best = sure.groupBy("d", "doc", "th", "item").agg(F.max(F.struct("similarity", -F.col("start"), F.size("win").alias("size"))).alias("best"))
    return best.select("th", F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), (-F.col("best.col2")).alias("start"), (F.col("best.size") + SHINGLE - 1).alias("n_words"), F.round("best.similarity", 6).alias("similarity"))


def contaminated(ws: Workspace, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The best window of each document for each item that it is similar to by ``SIMILAR`` or more.

    doc_id, item_id, start (word at which the window begins, from 0), n_words, similarity. A document shorter than the item is one
    window as a whole. Null and empty texts, and those of fewer than five words, meet nothing. Rows that repeat identifier and text
    are reported once; of equal windows the first is. A null identifier is reported as null, for each text. Extra columns are ignored.
    """
    return _found(ws, docs, benchmark, id_col, text_col, item_col).drop("th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` that all ``documents`` contain."""
    with Workspace(spark, "op5") as ws:
        return ws.result(contaminated(ws, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; rows that repeat an identifier go together, those without one by their text."""
    with Workspace(spark, "decontaminate-stage") as ws:
        found = _found(ws, docs, table(spark, sf_dir, "benchmark"))
        gone = found.select(F.col("doc_id").alias("__gone"), F.when(F.col("doc_id").isNull(), F.col("th")).alias("__text")).distinct()
        gone = ws.result(gone, "gone")
        own = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"]))
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & own.eqNullSafe(gone["__text"]), "left_anti")


#: The same rows without fingerprints: every window that begins at a shared place, by the similarity itself.
SQL = f"""
with d as (select doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from (select distinct doc_id, text from documents)),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark),
ds as (select doc_id, hash(text) as th, len(w) - 4 as n, pos, array_to_string(w[pos + 1 : pos + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as pos from d where len(w) >= 5)),
bs as (select item_id, len(w) - 4 as m, array_to_string(w[pos + 1 : pos + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as pos from b where len(w) >= 5)),
bc as (select item_id, m, g, count(*) as c from bs group by all),
hit as (select doc_id, th, n, item_id, m, least(m, n) as size, pos from ds join bc using (g)),
enough as (select doc_id, th, item_id from hit group by doc_id, th, item_id having count(*) >= min(ceil({SIMILAR} / {1 + SIMILAR} * (m + size) - 1e-9))),
starts as (select distinct doc_id, th, item_id, m, size, least(pos, n - size) as start from hit join enough using (doc_id, th, item_id)),
win as (select doc_id, th, item_id, m, size, start, ds.g, count(*) as c from starts join ds using (doc_id, th) where pos between start and start + size - 1 group by all),
shared as (select doc_id, th, item_id, win.m as m, size, start, sum(least(win.c, bc.c)) as o from win join bc using (item_id, g) group by all),
sim as (select *, o / (size + m - o) as s from shared),
best as (select *, row_number() over (partition by doc_id, th, item_id order by s desc, start) as k from sim where s >= {SIMILAR} - 1e-12)
select doc_id, item_id, cast(start as int) as start, cast(size + 4 as int) as n_words, round(s, 6) as similarity from best where k = 1
"""
