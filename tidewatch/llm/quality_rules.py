r"""Operator 10: quality rules with adaptive thresholds, in DataFrame functions only.

`quality_counts` counts words, symbols, repeated lines and repeated passages of every whole text inside its
row. `rates` turns them into four whole-number rates. `sketches` builds a quantile sketch of each rate for
each language and source: counts by log-linear bins (exact below 128, then 64 bins to each power of two),
which merge by addition, so that Spark combines them before it shuffles and a hot source costs no more rows
than bins. `fences` reads thresholds from each sketch. The high fence lies beyond the 90th percentile by five times the
distance between it and the third quartile, that of word length has a low counterpart. A rate that is 0 in nine of ten
documents has no spread there; its fence is the median of its values above 0, so that at most half of the exceptions, a
twentieth of the documents, go. A group of fewer than `least` documents, or with fewer than `least_tail` such exceptions,
takes the fence from the merged sketch of its language, and that of all documents when the language is as small; without
any such sketch nothing is judged. No threshold is a constant. `apply_rules` joins the fences to the documents (a broadcast
behind a size check) and gives the verdict.

Null and empty texts have no words and fail the base rule. Null lang or source counts as ''. Equal rows get
equal verdicts; an empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WINDOW = 8
#: letters x 100 a word, per 1000 word characters, per 1000 lines, per 1000 words; only the first has a low fence
RATES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate")
#: groups whose fences may be broadcast
BROADCAST_ROWS = 500_000


def quality_counts(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`df` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [c for c in df.columns if c != text_col and c not in names]
    t = df.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    t = t.select(
        *kept,
        F.array_remove(F.split("_t", "[\\x20\\x09-\\x0D]+"), "").alias("_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    count = F.size("_words")
    window = F.transform(F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))
    t = t.select(
        *kept, "word_chars", "n_symbols", count.cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(count >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    # only a text in which a window repeats goes on to locate the repeats
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    t = t.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"])
    starts = F.transform("_sorted", lambda x, k: F.when(F.coalesce(same(x, k), F.lit(False)), x["i"]))
    t = t.withColumn("_starts", F.array_sort(F.filter(starts, lambda i: i.isNotNull())))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_starts", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return t.select(*kept, *names[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rates() -> dict[str, Column]:
    """The rates that have thresholds, as whole numbers of the counts; 0 where there is nothing to divide by."""
    part = lambda top, factor, below: F.coalesce(F.expr(f"({top} * {factor}) div nullif({below}, 0)"), F.lit(0)).cast("long")
    return {"word_length": part("word_chars", 100, "n_words"), "symbol_rate": part("n_symbols", 1000, "word_chars"), "dup_line_rate": part("n_dup_lines", 1000, "n_lines"), "repeat_rate": part("n_repeat_words", 1000, "n_words")}


def sketches(df: DataFrame) -> DataFrame:
    """Mergeable sketches: lang, source, rate, v (lower end of the bin), n. Rows that fail the base rule stay out."""
    long = df.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), F.col(n).alias("x")) for n in RATES))).alias("r")).select("lang", "source", "r.rate", "r.x")
    v = F.expr("if(x < 128, x, shiftleft(shiftright(x, length(bin(x)) - 7), length(bin(x)) - 7))")
    return long.groupBy("lang", "source", "rate", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, level: list[str], least: int, least_tail: int) -> DataFrame:
    """`level` and the low and high fence of each rate, null where the group's merged sketch is too small for one."""
    merged = sketch.groupBy(*level, "rate", "v").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*level, "rate")
    run = merged.withColumn("_cum", F.sum("n").over(group.orderBy("v"))).withColumn("_all", F.sum("n").over(group))
    run = run.withColumn("_zero", F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("n"))).over(group), F.lit(0)))
    percentile = lambda k: F.min(F.when(F.col("_cum") * 100 >= F.col("_all") * k, F.col("v")))
    middle = F.min(F.when((F.col("v") > 0) & ((F.col("_cum") - F.col("_zero")) * 2 >= F.col("_all") - F.col("_zero")), F.col("v")))
    found = run.groupBy(*level, "rate").agg(
        F.max("_all").alias("docs"), (F.max("_all") - F.max("_zero")).alias("tail"), percentile(10).alias("p10"), percentile(25).alias("p25"), percentile(75).alias("p75"), percentile(90).alias("p90"), middle.alias("middle")
    )
    top = lambda c: F.expr(f"if({c} < 128, {c}, {c} + shiftleft(1L, length(bin({c})) - 7) - 1)")
    high = F.when(F.col("p90") > 0, top("p90") + 5 * (top("p90") - F.col("p75"))).when(F.col("tail") >= least_tail, top("middle"))
    low = F.when(F.col("rate") == RATES[0], F.col("p10") - 5 * (top("p25") - F.col("p10"))).otherwise(F.lit(0))
    enough = (F.col("docs") >= least) & high.isNotNull()
    found = found.select(*level, "rate", F.when(enough, low).alias("low"), F.when(enough, high).alias("high"))
    return found.groupBy(*level).agg(*(F.max(F.when(F.col("rate") == n, F.col(side))).alias(f"{n}_{side}") for n in RATES for side in ("low", "high")))


def apply_rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, least: int = 100, least_tail: int = 20) -> DataFrame:
    """One row per row of `df`: its counts, base_failed and kept."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    counted = quality_counts(rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = materialize(counted.select("*", *(c.alias(n) for n, c in rates().items()), failed.alias("base_failed")), "quality-counts")
    sketch = materialize(sketches(counted), "quality-sketches")
    names = [f"{n}_{side}" for n in RATES for side in ("low", "high")]
    of = lambda level, prefix, rows: fences(rows, level, least, least_tail).select(*level, *(F.col(n).alias(f"{prefix}_{n}") for n in names))
    everything = of(["_one"], "a", sketch.withColumn("_one", F.lit(1))).drop("_one")
    chosen = of(["lang", "source"], "s", sketch).join(of(["lang"], "l", sketch), "lang").crossJoin(everything)  # one row holds the fences of all documents
    chosen = materialize(chosen.select("lang", "source", *(F.coalesce(f"s_{n}", f"l_{n}", f"a_{n}").alias(n) for n in names)), "fences")
    inside = F.lit(True)
    for n in RATES:
        inside = inside & F.coalesce(F.col(n).between(F.col(f"{n}_low"), F.col(f"{n}_high")), F.lit(True))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(inside)
    few = chosen.count() <= BROADCAST_ROWS  # beyond that, Spark sorts and merges
    return counted.join(F.broadcast(chosen) if few else chosen, ["lang", "source"], "left").withColumn("kept", kept).select(*counted.columns, "kept")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every whole text of `documents`."""
    found = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (
  select doc_id, lang, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
win as (
  select doc_id, i, array_to_string(ws[i : i + 7], chr(1)) g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w)),
dup as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1),
rep as (
  select doc_id, sum(n) n from (select doc_id, least(8, coalesce(i - lag(i) over (partition by doc_id order by i), 8)) n from dup) group by doc_id),
c as (
  select w.doc_id, lang, source, len(ws)::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
    len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
  from w left join rep using (doc_id)),
m as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
    coalesce(word_chars * 100 // nullif(n_words, 0), 0) r1, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) r2,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) r3, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) r4 from c),
l as (
  select lang, source, rate, case when x < 128 then x else (x >> (length(bin(x)) - 7)::bigint) << (length(bin(x)) - 7)::bigint end v
  from (select lang, source, unnest([1, 2, 3, 4]) rate, unnest([r1, r2, r3, r4]) x from m where not base_failed)),
lv as (
  select lang || chr(1) || source k, rate, v, 1 lvl from l union all select lang, rate, v, 2 from l union all select '', rate, v, 3 from l),
bins as (
  select lvl, k, rate, v, count(*) n, v + case when v < 128 then 0 else (1::bigint << (length(bin(v)) - 7)::bigint) - 1 end top from lv group by lvl, k, rate, v),
cum as (
  select *, sum(n) over (partition by lvl, k, rate order by v) cum, sum(n) over (partition by lvl, k, rate) a,
    coalesce(sum(n) filter (v = 0) over (partition by lvl, k, rate), 0) z from bins),
q as (
  select lvl, k, rate, max(a) docs, max(a) - max(z) tail, min(v) filter (cum * 100 >= a * 10) p10, min(top) filter (cum * 100 >= a * 25) t25,
    min(v) filter (cum * 100 >= a * 75) p75, min(v) filter (cum * 100 >= a * 90) p90, min(top) filter (cum * 100 >= a * 90) t90,
    min(top) filter (v > 0 and (cum - z) * 2 >= a - z) mid from cum group by lvl, k, rate),
f as (
  select lvl, k, rate, lo, hi from (
    select *, case when rate = 1 then p10 - 5 * (t25 - p10) else 0 end lo, case when p90 > 0 then t90 + 5 * (t90 - p75) when tail >= 20 then mid end hi from q)
  where docs >= 100 and hi is not null),
g as (
  select lang, source, r.rate rate, coalesce(s.lo, l.lo, e.lo) lo, coalesce(s.hi, l.hi, e.hi) hi
  from (select distinct lang, source from m) cross join (select unnest([1, 2, 3, 4]) rate) r
  left join f s on s.lvl = 1 and s.k = lang || chr(1) || source and s.rate = r.rate
  left join f l on l.lvl = 2 and l.k = lang and l.rate = r.rate left join f e on e.lvl = 3 and e.rate = r.rate),
p as (
  select lang, source, max(lo) filter (rate = 1) l1, max(hi) filter (rate = 1) h1, max(hi) filter (rate = 2) h2, max(hi) filter (rate = 3) h3,
    max(hi) filter (rate = 4) h4 from g group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(r1 between l1 and h1, true) and coalesce(r2 <= h2, true) and coalesce(r3 <= h3, true) and coalesce(r4 <= h4, true) kept
from m join p using (lang, source)
"""
