"""Quality rules with distribution divergence, in DataFrame operations alone.

One pass over the texts counts character classes and common words. The language references are the sums of these counts over all
documents of a language; a document's verdict is its Jensen-Shannon distance to the nearest reference. Texts under a minimum length
have no distribution to speak of and pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table
from .native import with_grams, words

# Frequent function words of English, German, Spanish and French, in one alphabetical list
COMMON = (
    "a au avec be by como con das dans de del der des die du ein eine el en es est et for from ist it la las le les los mit nicht of on "
    "para por pour que qui se sich sur that the this to un und une von was with y zu"
).split()
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
#: Guards: shorter texts are not held against references.
GUARD_CHARS, GUARD_WORDS = 400, 60
#: Largest distances (square roots of divergences in bits, 0 to 1) to the nearest reference.
FAR_CLASSES, FAR_WORDS = 0.24, 0.285
#: A language with a smaller share of all words has no reference, so there are a hundred at most; its documents have nothing to be held
#: against and pass the method, as short ones do.
SHARE = 0.01
CLASSES = ("lower", "upper", "digit", "symbol", "punctuation", "beyond_ascii", "space")


def _without(text: Column, what: str) -> Column:
    return F.length(F.regexp_replace(text, what, ""))


def _with_covered(df: DataFrame, name: str) -> DataFrame:
    """Turns ``windows`` (a hash for each window of eight words) into ``name``: words in windows that occur twice or more.

    Texts whose windows all differ skip the steps. The others sort (hash, place), keep places whose hash a neighbour has, and add up
    what each place covers before the next.
    """
    keep = [F.col(c) for c in df.columns if c != "windows"]
    some = lambda x: F.when(F.col("dups"), x)
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    n = F.size("windows")
    df = df.withColumn("dups", F.size(F.array_distinct("windows")) < n)
    df = df.select(*keep, "dups", some(F.array_sort(F.zip_with("windows", F.sequence(F.lit(0), n - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("at"))
    m = F.size("at")
    df = df.select(*keep, "dups", "at", some(F.concat(F.array(none), F.slice("at", 1, m - 1))).alias("before"), some(F.concat(F.slice("at", F.lit(2), m - 1), F.array(none))).alias("after"))
    same = F.zip_with("at", "before", lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), (x["h"] == y["h"]).alias("same")))
    twice = F.zip_with(same, "after", lambda x, y: F.when(x["same"] | (x["h"] == y["h"]), x["i"]))
    df = df.select(*keep, "dups", some(F.array_sort(F.filter(twice, lambda i: i.isNotNull()))).alias("places"))
    gaps = F.zip_with("places", F.slice("places", F.lit(2), F.greatest(F.size("places") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.select(*keep, F.coalesce(some(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0).cast("long")).alias(name))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes (as CLASSES), common (as COMMON)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text")).withColumn("words", words(F.col("text")))
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = with_grams(out, F.col("words"), WINDOW, "windows")
    sorted_common = F.array_sort(F.concat(F.filter(F.transform("words", F.lower), lambda w: w.isin(COMMON)), F.array(*map(F.lit, sorted(COMMON)))))
    out = out.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").alias("chars"),
        _without(F.col("text"), r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        _without(F.col("text"), r"[#*$%&|<>]+").alias("no_symbol"),
        _without(F.col("text"), "[a-z]+").alias("no_lower"),
        _without(F.col("text"), "[A-Z]+").alias("no_upper"),
        _without(F.col("text"), "[0-9]+").alias("no_digit"),
        _without(F.col("text"), r"[^\x00-\x7F]+").alias("no_beyond"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "windows",
        sorted_common.alias("sorted"),
    )
    chars = F.col("chars")
    n = {"lower": chars - F.col("no_lower"), "upper": chars - F.col("no_upper"), "digit": chars - F.col("no_digit"), "symbol": chars - F.col("no_symbol"), "beyond_ascii": chars - F.col("no_beyond"), "space": chars - F.col("word_chars")}
    n["punctuation"] = chars - reduce(lambda a, b: a + b, n.values())
    # every common word stands in the sorted list once more than in the text, so its runs are the words in alphabetical order
    starts = F.filter(F.sequence(F.lit(1), F.size("sorted")), lambda i: (i == 1) | (F.col("sorted")[i - 1] != F.col("sorted")[F.greatest(i - 2, F.lit(0))]))
    runs = F.zip_with("starts", F.concat(F.slice("starts", 2, len(COMMON) - 1), F.array(F.size("sorted") + 1)), lambda a, b: b - a - 1)
    return _with_covered(out, "n_repeat_words").withColumn("starts", starts).select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        n["symbol"].cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.array(*[n[c].cast("long") for c in CLASSES]).alias("classes"),
        F.transform(runs, lambda x: x.cast("long")).alias("common"),
    )


def references(own: DataFrame) -> list[tuple[str | None, list[int], list[int]]]:
    """Name, class and word counts (with one for all other words at the end) of each language that has ``SHARE`` of all words."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(COMMON))]
    by = own.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums)
    total = by.agg(F.sum("n")).first()[0] or 0
    out = []
    for r in by.where(F.col("n") > SHARE * total).orderBy("lang").collect():
        w = [r[f"w{i}"] for i in range(len(COMMON))]
        out.append((r["lang"], [r[f"c{i}"] for i in range(len(CLASSES))], [*w, r["n"] - sum(w)]))
    return out


def distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a histogram to a reference: 0 for equal shares, 1 where nothing is shared."""
    whole = float(sum(reference)) or 1.0

    def part(c: Column, q: Column) -> Column:
        p = c / total
        return F.when(c > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(counts, F.array(*[F.lit(x / whole) for x in reference]), part)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(own: DataFrame, known: list[tuple[str | None, list[int], list[int]]]) -> DataFrame:
    """Adds base_failed, class_distance, word_distance (to the nearest reference, in 6 digits) and kept to ``features``."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    one = F.lit(1).cast("long")
    own = own.withColumns({"chars": F.greatest(total("classes"), one), "others": F.col("n_words") - total("common"), "total": F.greatest(F.col("n_words"), one)})
    own = own.withColumn("worded", F.concat("common", F.array("others")))
    nearest = lambda xs: F.round(F.array_min(F.array(*xs)), 6) if xs else F.lit(0.0)
    out = own.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        "class_distance": nearest([distance(F.col("classes"), F.col("chars"), c) for _, c, _ in known]),
        "word_distance": nearest([distance(F.col("worded"), F.col("total"), w) for _, _, w in known]),
    })
    short = (F.col("word_chars") < GUARD_CHARS) | (F.col("n_words") < GUARD_WORDS)
    alone = ~reduce(lambda a, b: a | b, (F.col("lang").eqNullSafe(F.lit(lang)) for lang, _, _ in known), F.lit(False))
    kept = ~F.col("base_failed") & (short | alone | ((F.col("class_distance") <= FAR_CLASSES) & (F.col("word_distance") <= FAR_WORDS)))
    return out.withColumn("kept", kept).drop("chars", "others", "total", "worded")


def rate(ws: Workspace, docs: DataFrame, **columns: str) -> DataFrame:
    """Counts, distances and verdict of every whole text.

    A null or empty text has no words and fails; a null language is a language of its own. Repeated rows are judged alike, extra
    columns are ignored, an empty table gives an empty one.
    """
    own = ws.save(features(docs, **columns), "features")
    return judge(own, references(own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all ``documents``."""
    with Workspace(spark, "op9") as ws:
        out = rate(ws, table(spark, sf_dir, "documents"))
        return ws.result(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"))


_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(COMMON)) + "]"

#: The same rows: windows as texts rather than hashes, histograms as rows rather than arrays.
SQL = f"""
with base as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
w as (select r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from base),
eights as (select r, i, array_to_string(w[i : i + 7], ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from eights) where n > 1),
covered as (select r, sum(least(8, coalesce(gap, 8))) as n from (select r, lead(i) over (partition by r order by i) - i as gap from twice) group by r),
lines as (select r, count(*) - count(distinct l) as n from (select r, unnest(string_split(t, chr(10))) as l from base) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by r),
n as (
  select r, doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) as chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as symbol, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) as lower_n,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as upper_n, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as digit_n,
    length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) as beyond_n
  from w
),
classes as (
  select r, lang, unnest(['lower', 'upper', 'digit', 'symbol', 'beyond', 'space', 'rest']) as k,
    unnest([lower_n, upper_n, digit_n, symbol, beyond_n, chars - word_chars, word_chars - lower_n - upper_n - digit_n - symbol - beyond_n]) as c from n
),
found as (select r, x as k, count(*) as c from (select r, unnest(w) as y from w) join (select unnest({_LIST}) as x) on lower(y) = x group by all),
worded as (
  select r, lang, k, coalesce(c, 0) as c from n cross join (select unnest({_LIST}) as k) left join found using (r, k)
  union all select n.r, lang, '~', n_words - coalesce(s, 0) from n left join (select r, sum(c) as s from found group by r) f on f.r = n.r
),
refs as (select lang as ref from n group by lang having sum(n_words) > {SHARE} * (select sum(n_words) from n)),
ref_class as (select lang as ref, k, sum(c) / sum(sum(c)) over (partition by lang) as q from classes where lang in (select ref from refs) group by lang, k),
ref_word as (select lang as ref, k, sum(c) / sum(sum(c)) over (partition by lang) as q from worded where lang in (select ref from refs) group by lang, k),
paired as (
  select 'class' as kind, r, ref, c / greatest(sum(c) over (partition by r, ref), 1) as p, q from classes join ref_class using (k)
  union all select 'word', r, ref, c / greatest(sum(c) over (partition by r, ref), 1), q from worded join ref_word using (k)
),
far as (
  select kind, r, ref, sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2, 0)) as d from paired group by all
),
near as (select r, round(min(d) filter (kind = 'class'), 6) as class_distance, round(min(d) filter (kind = 'word'), 6) as word_distance from far group by r),
judged as (
  select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(symbol as bigint) as n_symbols, cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(v.n, 0) as bigint) as n_repeat_words,
    n_words < {MIN_WORDS} or 100 * coalesce(v.n, 0) > {MAX_REPEATED} * n_words as base_failed, class_distance, word_distance, lang not in (select ref from refs) as alone
  from n join near using (r) left join lines l on l.r = n.r left join covered v on v.r = n.r
)
select * exclude (alone), not base_failed and (alone or word_chars < {GUARD_CHARS} or n_words < {GUARD_WORDS} or (class_distance <= {FAR_CLASSES} and word_distance <= {FAR_WORDS})) as kept from judged
"""
