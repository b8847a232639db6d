"""Operator 12: grouping of spelling variants by asymmetric q-chunks.

Words are maximal runs of Latin letters, lower-cased (A-Z only), of LEAST or more code points and seen MIN_COUNT times or more.
Two words are near if exactly one inserted, deleted or replaced code point tells them apart. A word's form is its near
word of largest count (ties: the smallest in code-point order), if that is FACTOR times its own count or more, and its root is where
forms lead. `thinned` gives the runs of the query: a run whose crc32 with its document's id is divisible by 31 lacks
one code point, so that variants are there to be found.

1. `counts`: tasks count words of whole texts and give out partial counts, which Spark adds up.
2. Every word is once the shorter of a pair (of equal length: either) and contributes two disjoint chunks, its halves. One edit touches one
   of them at most, so the other one is whole in the longer word: the front half in place, the back half shifted by the
   difference of lengths, 0 or 1. The longer word contributes the grams at these places for either length that the
   shorter one can have. Words meet by (length, place, chunk) and are verified.
3. A chunk that many words share brings too many pairs. Such words are dealt anew: what lies outside the chunk is, for either word, again a
   word and one edit, so it is cut in two chunks again, down to a single code point. What then meets in one
   place differs in one or two letters only, so its size is bounded by the alphabet. No pair is lost, none is guessed.
4. Pairs give each word its near words' number and best, and forms are followed to the last by doubling.

Null text has no words; rows without id are hashed with an empty id; repeated rows count again. An empty table gives an
empty result. Very long words are words. Columns other than id and text do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import sorted_runs
from .storage import materialize
from .words import arrow_schema, bounded, columns_of

LEAST, MIN_COUNT, FACTOR, THINNED = 7, 2, 10, 31
#: pairs that a chunk's words are compared in before they are cut further, and rows of a chunk that a task holds
MOST_PAIRS, MOST_ROWS = 1000, 10_000
#: words, and characters in them, that a task counts before it gives its counts out
HELD_WORDS, HELD_CHARS = 200_000, 4 << 20


def thinned(doc_id: int | None, text: str, least: int = LEAST) -> Counter:
    """Words of a text whose A-Z are lower-cased, with their counts, shorter ones left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(m[0] for m in re.finditer(f"[a-zÀ-ÿ]{{{least},}}", text)).items():
        h = zlib.crc32(run.encode(), start)
        if h % THINNED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words with at least `min_count` occurrences in all texts."""
    schema = "word string, n long"
    arrow = arrow_schema(schema)

    def give(found):
        return columns_of(arrow, {"word": list(found), "n": list(found.values())})

    def task(batches):
        import pyarrow as pa

        found, chars = Counter(), 0
        for batch in bounded(batches):
            texts = batch.column(1).cast(pa.large_binary() if str(batch.column(1).type).startswith("large") else pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if text.is_valid:
                    words = thinned(doc_id, text.as_buffer().to_pybytes().lower().decode("utf-8", "replace"), least)
                    chars += sum(map(len, words))  # those known already count too, so that this is a bound
                    found.update(words)
            if len(found) > HELD_WORDS or chars > HELD_CHARS:
                chars = sum(map(len, found))
                if len(found) > HELD_WORDS or chars > HELD_CHARS:
                    yield give(found)
                    found, chars = Counter(), 0
        yield give(found)

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(task, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(x: str, y: str, same: int = 0) -> bool:
    """Whether exactly one code point is replaced, or inserted into x, to give y, which is as long or longer by one; both begin with `same` equal ones."""
    for i in range(same, len(x)):
        if x[i] != y[i]:
            return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]
    return len(y) == len(x) + 1


_ROW = "key long, word string, chunk boolean, size int, lo int, tail int"


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: with its open part's front half settled, and with its back half."""
    half = F.floor((F.col("size") - F.col("lo") - F.col("tail")) / 2).cast("int")
    open_ = F.col("size") - F.col("lo") - F.col("tail")
    places = F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("tail").alias("tail")), F.struct(F.col("lo").alias("lo"), (F.col("tail") + open_ - half).alias("tail")))
    cut = rows.select("word", "chunk", "size", F.explode(places).alias("_p")).select("word", "chunk", "size", "_p.lo", "_p.tail")
    key = F.xxhash64("size", "lo", "tail", F.expr("left(word, lo)"), F.expr("right(word, tail)"))  # equal keys of different chunks meet for nothing
    return cut.select(key.alias("key"), "word", "chunk", "size", "lo", "tail")


def _met(rows: DataFrame, most_pairs: int) -> DataFrame:
    """word and near (as long or longer) of the pairs that meet; of chunks with too many pairs, their rows, near null."""
    schema = "word string, near string, chunk boolean, size int, lo int, tail int"
    arrow = arrow_schema(schema)

    def task(batches):
        import pyarrow as pa

        def again(table):
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in (table.column("word"), pa.chunked_array([pa.nulls(table.num_rows, arrow.field("near").type)]), *(table.column(c) for c in ("chunk", "size", "lo", "tail")))], schema=arrow)

        for table, starts in sorted_runs(batches, MOST_ROWS):
            table = table.set_column(1, "word", table.column("word").cast(arrow.field("word").type))
            if starts is None:
                size, lo, tail = (table.column(c)[0].as_py() for c in ("size", "lo", "tail"))
                if size - lo - tail <= 1:
                    raise ValueError(f"more than {MOST_ROWS} words differ in one place")
                yield again(table)
                continue
            chunk = np.asarray(table.column("chunk").combine_chunks().to_numpy(zero_copy_only=False), bool)
            ends = np.append(starts[1:], len(chunk))
            of = np.concatenate(([0], np.cumsum(chunk)))
            short = of[ends] - of[starts]
            long = ends - starts - short
            open_ = (table.column("size").to_numpy() - table.column("lo").to_numpy() - table.column("tail").to_numpy())[starts]
            large = (short * long > most_pairs) & (open_ > 1)
            words, near = [], []
            for k in np.flatnonzero((short > 0) & (long > 0) & ~large).tolist():
                i, n = int(starts[k]), int(ends[k] - starts[k])
                run, side = table.column("word").slice(i, n).to_pylist(), chunk[i : i + n].tolist()
                lo = table.column("lo")[i].as_py()
                longer = [y for y, s in zip(run, side, strict=True) if not s]
                for x in (x for x, s in zip(run, side, strict=True) if s):
                    for y in longer:
                        if (len(y) > len(x) or y > x) and len(y) - len(x) in (0, 1) and x[:lo] == y[:lo] and one_edit(x, y, lo):
                            words.append(x)
                            near.append(y)
            if words:
                none = [None] * len(words)
                yield columns_of(arrow, {"word": words, "near": near, "chunk": none, "size": none, "lo": none, "tail": none})
            for k in np.flatnonzero(large).tolist():
                yield again(table.slice(int(starts[k]), int(ends[k] - starts[k])))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(task, schema)


def near_words(words: DataFrame, *, least: int = LEAST, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word and near: every two of the distinct words `word`, of `least` or more code points, that one edit tells apart, once."""
    size = F.length("word")
    roles = F.array(F.struct(F.lit(True).alias("chunk"), size.alias("size")), F.struct(F.lit(False).alias("chunk"), size.alias("size")), F.struct(F.lit(False).alias("chunk"), (size - 1).alias("size")))
    rows = words.select("word", F.explode(roles).alias("_r")).select("word", "_r.chunk", "_r.size", F.lit(0).alias("lo"), F.lit(0).alias("tail")).where(F.col("size") >= least)
    pairs = None
    while True:
        found = materialize(_met(_cut(rows), most_pairs), "near-words")
        new = found.where("near is not null").select("word", "near")
        pairs = new if pairs is None else pairs.unionByName(new)
        rows = found.where("near is null").select("word", "chunk", "size", "lo", "tail")
        if not rows.limit(1).count():
            return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words with a form: where forms, which never lead in a circle, end."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = materialize(found.join(further, "root", "left"), "roots")
        if not stepped.where("_next is not null").limit(1).count():
            return found
        found = stepped.select("word", F.coalesce("_next", "root").alias("root"))


def variants(words: DataFrame, *, least: int = LEAST, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n) of `least` or more code points."""
    pairs = materialize(near_words(words.select("word"), least=least), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    ranked = both.join(words.select(F.col("word").alias("near"), (-F.col("n")).alias("_n")), "near")
    best = ranked.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("_n", "near")).alias("_best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("_best._n"))
    found = found.withColumn("_is", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False)))
    found = found.select("word", F.when(F.col("_is"), F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("form_n")).alias("form_n"))
    found = materialize(found, "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    words = materialize(counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return variants(words)
