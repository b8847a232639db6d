"""Operator 9: packing documents into sequences of fixed length by cutting-stock column generation.

1. `token_pieces` tokenizes every whole text inside Arrow batches and cuts a document at multiples of the
   sequence length. A task keeps the ids of the words it has met, so a word is tokenized once per task; batches are
   bounded by bytes, so that very long texts are read a few at a time.
2. Short pieces are strung together into bundles, so that rounding lengths up to classes costs little.
3. The histogram of item lengths, by classes of 16 tokens, goes to the driver: at most 256 numbers whatever
   the input. `cutting_stock` solves the linear program over patterns by column generation: the duals of the
   restricted program price a knapsack over the capacity, whose best pattern enters the basis. The patterns
   are rounded down, and what is left is packed first-fit by class.
4. Items are ranked within their class (rank in a chunk of documents plus the chunk's offset), and the rank
   gives the pattern, the sequence and the place in it. No class is gathered in one task.

Null and empty texts make one piece that holds the end id. Repeated rows are packed like any others. An
empty table gives an empty result. A sequence never holds more than the sequence length.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .words import WordIndex, arrow_schema, bounded, columns_of, texts_of

#: Texts of these characters only are cut at white space before tokenizing, which changes no id.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ–—‘-”…€]*")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def _splitter(path: str):
    """What cuts a normalized word of PLAIN characters into the pieces that the tokenizer's model reads one by one; None
    if the tokenizer does not lower-case, drop white space, split by a pattern and read bytes in this order."""
    import regex

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    steps = [x.get("type") for x in (given.get("normalizer") or {}).get("normalizers", [])]
    cuts = (given.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or not cuts[0].get("invert") or cuts[1].get("use_regex"):
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"]).findall


@lru_cache(maxsize=2)
def _index(path: str) -> WordIndex:
    return WordIndex(300_000, owner="packing")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level tokenizers write for each byte: itself, or the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in own)}


def _ids_of_words(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers; words hold no white space. Pieces are read once."""
    tokenize, split, letters = _tokenizer(path).model.tokenize, _splitter(path), _byte_letters()
    known: dict[str, bytes] = {}

    def ids(piece: str) -> bytes:
        found = known.get(piece)
        if found is None:
            coded = [t.id for t in tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters))]
            found = known[piece] = struct.pack(f"<{len(coded)}I", *coded)
        return found

    return [ids(w) if w.isalpha() else b"".join(map(ids, split(w))) for w in words]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, equal to those of the tokenizer on the whole text."""
    index = _index(path)
    index.reset_if_over()
    apart = _splitter(path) is not None
    docs: list = []
    for text in texts:
        if apart and PLAIN.fullmatch(text):
            docs.append(index.number(unicodedata.normalize("NFC", text).lower().split()))
        else:
            docs.append(np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes())
    index.values += _ids_of_words(path, index.unseen())
    value = index.values.__getitem__
    return [d if isinstance(d, bytes) else b"".join(map(value, d.tolist())) for d in docs]


def token_pieces(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` ids: id column, start, length, ids_crc32, doc_tokens; `ids` binary if asked for."""
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    end = end_id.to_bytes(4, "little")
    arrow = arrow_schema(schema)

    def task(batches):
        for batch in bounded(batches):
            keys = batch.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in (id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * keep_ids))}
            texts = texts_of(batch.column(1))
            for key, ids in zip(keys, encode_texts(texts, tokenizer_path), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[start * 4 : (start + size) * 4]
                    row = (key, start, len(part) // 4, zlib.crc32(part), n, *([part] * keep_ids))
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            yield columns_of(arrow, out)

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(task, schema)


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and for each the last item taken (-1: what the capacity below has)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if k:
            gains = best[c - sizes[:k]] + values[:k]
            top = int(gains.argmax())
            if gains[top] > best[c] + 1e-12:
                best[c], choice[c] = gains[top], top
    return best, choice


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 2e-4, rounds: int = 400) -> list[tuple[dict[int, int], int]]:
    """Patterns `{class size: copies}` with how often to use each, which together hold the demand exactly.

    Column generation. The duals are smoothed towards those of the best bound so far (at first an item's share
    of the capacity), a knapsack prices one column for each class at once, and the simplex pivots over all
    columns known until none improves. It ends when the dual bound is within `gap` of the program's value.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    costs = np.ones(m)
    inverse = np.diag(1 / basis.diagonal())
    use = inverse @ need
    pool, known = np.hstack([-np.eye(m), basis]), set()
    pool_costs = np.concatenate((np.zeros(m), np.ones(m)))  # a surplus costs nothing, a pattern one sequence
    center, bound, trust = sizes / capacity, 0.0, 0.7
    for _ in range(rounds):
        for _ in range(20 * m):
            duals = costs @ inverse
            gains = duals @ pool - pool_costs
            enter = int(gains.argmax())
            if gains[enter] <= 1e-9:
                break
            step = inverse @ pool[:, enter]
            ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                break
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
            basis[:, out], costs[out] = pool[:, enter], pool_costs[enter]
            use = np.maximum(use - step * ratio[out], 0)
            use[out] = max(ratio[out], 0)
        inverse = np.linalg.inv(basis)
        use, duals = np.maximum(inverse @ need, 0), np.maximum(costs @ inverse, 0)
        values = trust * center + (1 - trust) * duals
        best, choice = _knapsack(sizes, values, capacity)
        reached = values @ need / max(best[capacity], 1)
        if reached > bound:
            bound, center = reached, values
        if costs @ use - bound <= gap * bound:
            break
        fresh = []
        for first in range(m):
            column, c = np.zeros(m), capacity - int(sizes[first])
            column[first] = 1
            while c > 0:
                if choice[c] < 0:
                    c -= 1
                else:
                    column[choice[c]] += 1
                    c -= int(sizes[choice[c]])
            if duals @ column > 1 + 1e-9 and (key := column.tobytes()) not in known:
                known.add(key)
                fresh.append(column)
        if fresh:
            pool = np.hstack([pool, np.array(fresh).T])
            pool_costs = np.concatenate((pool_costs, np.ones(len(fresh))))
        elif trust < 1e-3:
            break
        else:
            trust *= 0.5
    basis = np.where(costs > 0, basis, 0)
    use = np.where(costs > 0, use, 0)
    left = need.astype(np.int64)
    patterns: list[tuple[dict[int, int], int]] = []
    for p in np.argsort(-use, kind="stable").tolist():
        copies = np.rint(basis[:, p]).astype(np.int64)
        inside = copies > 0
        if not inside.any():
            continue
        times = min(int(use[p] + 1e-9), int((left[inside] // copies[inside]).min()))
        if times:
            left -= copies * times
            patterns.append(({int(sizes[i]): int(copies[i]) for i in np.flatnonzero(inside)}, times))
    while left.any():  # what rounding left: the fullest pattern that the rest still fills, as often as it does
        room, copies = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            copies[i] = min(int(left[i]), room // int(sizes[i]))
            room -= int(copies[i] * sizes[i])
        inside = copies > 0
        times = int((left[inside] // copies[inside]).min())
        left -= copies * times
        patterns.append(({int(sizes[i]): int(copies[i]) for i in np.flatnonzero(inside)}, times))
    return patterns


def pack(pieces: DataFrame, *, id_col: str = "doc_id", size: int = 4096, unit: int = 16, short: int = 256, bundle: int = 1024) -> DataFrame:
    """`pieces` with sequence_id and offset. `pieces` has the id column, start, length and is read three times."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    chunks = max(16, min(65_536, pieces.count() // 4096))
    order = [F.col(c) for c in (id_col, "start", *sorted(c for c in pieces.columns if c not in (id_col, "start")))]
    p = pieces.withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int")).withColumn("_short", F.col("length") < short)
    run = Window.partitionBy("_chunk").orderBy("_short", *order)
    p = p.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_short"), F.col("length"))).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.withColumn("_item", F.when(F.col("_short"), -1 - F.floor(F.col("_before") / bundle)).otherwise(F.row_number().over(run)).cast("long"))
    item = Window.partitionBy("_chunk", "_item")
    p = p.withColumn("_class", F.ceil(F.sum("length").over(item) / unit).cast("int")).withColumn("_head", F.row_number().over(item.orderBy(*order)) == 1)
    counts = p.where("_head").groupBy("_class", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "class-counts")
    demand = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}

    slots, first, sequence = [], dict.fromkeys(demand, 0), 0
    for copies, times in cutting_stock(demand, size // unit):
        for cls, per in copies.items():
            slots.append((cls, first[cls], first[cls] + per * times, per, sequence))
            first[cls] += per * times
        sequence += times
    table = spark.createDataFrame(slots, "_class int, _from long, _to long, _per long, _base long")

    offsets = counts.select("_class", "_chunk", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_chunk")) - F.col("_n")).alias("_offset"))
    ranked = p.withColumn("_rank", F.dense_rank().over(Window.partitionBy("_chunk", "_class").orderBy("_item")) - 1)
    ranked = ranked.join(offsets, ["_class", "_chunk"]).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    placed = ranked.join(F.broadcast(table), ["_class"]).where("_rank >= _from and _rank < _to")  # the table is bounded by the classes, not by the input
    placed = placed.withColumn("sequence_id", F.expr("_base + (_rank - _from) div _per"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank", *order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents`, packed into sequences of 4096 tokens."""
    import public_tokenizers as P

    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json")))
