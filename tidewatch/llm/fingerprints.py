"""Operator 7: document fingerprints as homomorphic multiset hashes, in DataFrame functions only.

A fingerprint is a wide vector, the sum of vectors hashed from the paragraphs (lines with more than white
space) of a text, taken lane by lane modulo 2^32. So the order of paragraphs does not matter, and
`add` and `subtract` insert or delete paragraphs without the rest of the text. Two kinds of lanes:

* EXACT lanes hold halves of 64-bit hashes of the whole paragraph. Equal multisets have equal sums.
* LIKENESS lanes hold one hash bit for each run of words of the paragraph; the last of them holds the number of runs.
  A run ends where the hash of its last word says so, every CUT words on average, so an inserted, changed or deleted
  word touches the runs beside it only. With the bits read as -1 and 1, the scalar product of two sums
  estimates the number of runs in common, and `likeness` is its cosine.

Every run becomes a row, and the sums are combined before the shuffle, so a long text is no long row of
vectors. Null text counts as empty and has the fingerprint of no paragraphs. Equal texts have equal
fingerprints; repeated rows are fingerprinted each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

EXACT, BITS, CUT = 8, 64, 6
LANES = EXACT + BITS + 1
#: rows of 16 bytes that may be broadcast
BROADCAST_ROWS = 500_000


def _sums(units: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """Sums of the vectors of `units` (keys, number of the version, whole paragraph or null, run or null) by keys, an array<bigint> of LANES for each version."""
    low, high = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)
    exact = [F.when(F.col("_whole").isNotNull(), side(F.xxhash64(F.lit(k), "_whole"))) for k in range(EXACT // 2) for side in (low, high)]
    # two bits to each sum, 32 places apart: a text would need 2^31 runs to carry from one to the other
    pair = [F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(0x100000001)) for k in range(BITS // 2)]
    parts = [*exact, *pair, F.when(F.col("_run").isNotNull(), F.lit(1).cast("long"))]
    hashed = units.withColumn("_h", F.when(F.col("_run").isNotNull(), F.xxhash64(F.lit(-1), "_run")))
    summed = hashed.groupBy(*keys).agg(*(F.sum(x if len(versions) == 1 else F.when(F.col("_version") == v, x)).alias(f"_s{v}_{i}") for v in range(len(versions)) for i, x in enumerate(parts)))

    def lanes(v: int) -> Column:
        of = lambda i: F.coalesce(F.col(f"_s{v}_{i}"), F.lit(0))
        return F.array(*(low(of(i)) for i in range(EXACT)), *(side(of(EXACT + k)) for k in range(BITS // 2) for side in (low, high)), of(EXACT + BITS // 2))

    return summed.select(*keys, *(lanes(v).alias(name) for v, name in enumerate(versions)))


def fingerprint(df: DataFrame, *, keys: list[str], texts: dict[str, str] | None = None) -> DataFrame:
    """keys and an array<bigint> of lanes for each text column of `texts` (lanes column -> text column; `lanes` of `text`
    if not given), one row for each distinct key; rows of one key are one text, their paragraphs added.

    All versions of a key are summed in one aggregate, so that they cross one shuffle as one row.
    """
    texts = texts or {"lanes": "text"}
    lines = lambda c: F.filter(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    versions = F.explode(F.array(*(F.struct(F.lit(v).alias("_version"), lines(c).alias("_lines")) for v, c in enumerate(texts.values())))).alias("_v")
    paragraphs = df.select(*keys, versions).select(*keys, "_v._version", F.explode_outer("_v._lines").alias("_whole"))
    words = F.regexp_extract_all("_whole", F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    ended = F.transform(words, lambda w: F.concat(w, F.when(F.pmod(F.xxhash64(w), F.lit(CUT)) == 0, "\n").otherwise(" ")))  # a paragraph holds no \n
    runs = F.split(F.regexp_replace(F.array_join(ended, ""), "[\\x20\\n]$", ""), "\n")
    units = paragraphs.select(*keys, "_version", "_whole", F.posexplode_outer(runs).alias("_at", "_run"))
    units = units.select(*keys, "_version", F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col("_whole")).alias("_whole"), "_run")
    return _sums(units, keys, list(texts))


def _modulo(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: F.pmod(x, F.lit(1 << 32)))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _modulo(F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of `a` without the paragraphs of `b`."""
    return _modulo(F.zip_with(a, b, lambda x, y: x - y))


def text_of(lanes: Column) -> Column:
    """Lanes as a string of hexadecimal digits, eight to a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the signed bit sums; 1 for equal fingerprints, two empty ones included."""
    signed = lambda v: F.transform(F.slice(v, EXACT + 1, BITS), lambda x: (2 * x - F.get(v, LANES - 1)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0).cast("double"), lambda s, p: s + p)
    x, y = signed(a), signed(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def next_ids(ids: DataFrame, *, id_col: str = "doc_id", bits: tuple[int, ...] = (12, 12, 16)) -> DataFrame:
    """Each distinct id and the next greater one (after the last: the first), with no window over all ids.

    Ids are ranked inside blocks of 2^12 consecutive values; the next block's first id follows the last of a
    block, and blocks are handled likewise, level by level. The top level has at most 2^24 blocks.
    """
    level = ids.select(F.col(id_col).cast("long").alias("_b")).where("_b is not null").distinct().withColumn("_first", F.col("_b"))
    levels, shift = [], 0
    for step in bits:
        levels.append((level, shift, step))
        shift += step
        level = level.groupBy(F.shiftright("_b", step).alias("_b")).agg(F.min("_first").alias("_first"))
    top = level.withColumn("_next", F.coalesce(F.lead("_first").over(Window.orderBy("_b")), F.min("_first").over(Window.partitionBy())))
    for below, _, step in reversed(levels):
        block = F.shiftright("_b", step)
        inside = below.withColumn("_block", block).withColumn("_in", F.lead("_first").over(Window.partitionBy("_block").orderBy("_b")))
        last = top.select(F.col("_b").alias("_block"), F.col("_next").alias("_beyond"))
        top = inside.join(last, "_block").select("_b", "_first", F.coalesce("_in", "_beyond").alias("_next"))
    return top.select(F.col("_first").alias(id_col), F.col("_next").alias("next_id"))


def edit_with_next(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bits: int = 8) -> DataFrame:
    """id, copy, next_id, text, edited: a text whose last quarter gives way to as much of the next document's beginning.

    The next document is that of the next greater id (after the last: the first); where rows share an id, it is
    the least of their texts. A row without id has no next document but its own text, and its `copy` is a number of its own; else `copy` numbers the rows of one
    id from 1 by their texts. Rows meet their successor inside blocks of 2^8 consecutive ids, and the first row
    of each block is also sent to the block before it, so whole texts are shuffled once, or twice if the first ids
    of blocks are too many to broadcast.
    """
    all_docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = all_docs.where("id is not null")
    nameless = all_docs.where("id is null").select("id", F.monotonically_increasing_id().alias("copy"), F.col("id").alias("next_id"), "text", F.col("text").alias("_more"))
    successor = next_ids(docs, id_col="id")
    block = lambda c: F.shiftright(c, block_bits)
    far = successor.where((block("id") != block("next_id")) | (F.col("next_id") <= F.col("id"))).select(F.col("next_id").alias("id"), block("id").alias("_block"))
    far = materialize(far, "first-of-blocks")
    few = far.count() <= BROADCAST_ROWS  # beyond that, Spark sorts and merges
    sent = docs.join(F.broadcast(far) if few else far, "id").select("_block", F.lit(1 << block_bits).alias("_order"), "id", "text")
    own = docs.select(block("id").alias("_block"), F.col("id").bitwiseAND(F.lit((1 << block_bits) - 1)).cast("int").alias("_order"), "id", "text")
    beyond = Window.partitionBy("_block").orderBy(F.desc("_order")).rangeBetween(Window.unboundedPreceding, -1)
    copies = Window.partitionBy("_block", "_order").orderBy("text")
    seen = own.unionByName(sent).withColumn("_next", F.min(F.struct("_order", "id", "text")).over(beyond)).withColumn("copy", F.row_number().over(copies))
    quarter = "cast(floor(length(text) / 4) as int)"
    rows = seen.where(F.col("_order") < 1 << block_bits).select("id", F.col("copy").cast("long").alias("copy"), F.coalesce("_next.id", "id").alias("next_id"), "text", F.coalesce("_next.text", "text").alias("_more"))
    rows = rows.unionByName(nameless)
    return rows.select("id", "copy", "next_id", "text", F.expr(f"concat(left(text, length(text) - {quarter}), left(_more, {quarter}))").alias("edited"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of `documents` and of its edited text, and how alike they and the next one's are."""
    rows = edit_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    keys = ["id", "copy", "next_id", "n_chars", "edited_sha256"]
    rows = rows.select("id", "copy", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", F.col("edited").alias("_edited"))
    lanes = fingerprint(rows, keys=keys, texts={"own": "text", "edited": "_edited"})
    lanes = materialize(lanes, "fingerprints")
    following = lanes.where("copy = 1").select(F.col("id").alias("next_id"), F.col("own").alias("next"))
    found = lanes.join(following, "next_id", "left")
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.coalesce("next", "own")).alias("near_next"),
    )
