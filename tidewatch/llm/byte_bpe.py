"""Operator 1: byte-level BPE encoding and decoding by merge replay.

Spark deals out the documents; each task takes an Arrow batch of texts as its corpus. The distinct words
that the task has not met yet are laid end to end as bytes. An inverted index from merge rank to the
positions of its token pairs is built over that array, and the merges are applied in rank order from a heap.
Each merge touches the merged positions and their two neighbours only. Nothing is shuffled, and the state of
a task is the word index of bounded size.

Results equal those of a rank-based BPE library: a word that is itself a token is taken whole, otherwise the
pair of lowest rank merges first and, within a word, the leftmost of equal ranks. New pairs can have a lower
rank than the merge that made them, so a word does one merge at a time and the rest go back to the heap.

Null text counts as empty: no ids, empty bytes. Repeated rows give repeated results; an empty table gives an
empty one. Only the columns named by the caller are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordIndex, arrow_schema, bounded, columns_of, texts_of

SPACED = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (= id) from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many distinct words at once with an inverted index from pair to word positions."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each token pair, -1 where it does not merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        todo = []
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif w:
                todo.append(i)
        for k in range(0, len(todo), 100_000):
            part = todo[k : k + 100_000]
            for i, ids in zip(part, self._replay([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        starts = np.cumsum(lengths) - lengths
        following = np.arange(1, n + 1, dtype=np.int32)
        following[starts + lengths - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[starts] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, -1, np.int32)
        has = np.flatnonzero(following >= 0).astype(np.int32)
        rank_at[has] = self._rank(symbol[has], symbol[has + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray) -> None:
            """Enter pairs that start at these positions under their ranks."""
            ranks = rank_at[positions]
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        post(has)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[(rank_at[at] == rank) & alive[at]]
            if not len(at):
                continue
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            rest, at = at[~first], at[first]
            gone = following[at]
            after = following[gone]
            symbol[at] = rank
            alive[gone] = False
            rank_at[gone] = -1
            following[at] = after
            right = after >= 0
            before[after[right]] = at[right]
            rank_at[at] = -1
            rank_at[at[right]] = self._rank(symbol[at[right]], symbol[after[right]])
            prior = before[at]
            left = prior[prior >= 0]
            rank_at[left] = self._rank(symbol[left], symbol[at[prior >= 0]])
            post(np.concatenate((at, left)))
            if len(rest):
                post(rest)

        ids = symbol[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(maxsize=4)
def _replay_of(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


@lru_cache(maxsize=2)
def _index_of(path: str, pattern: str) -> WordIndex:
    return WordIndex(owner="byte_bpe")


@lru_cache(maxsize=4)
def _tokens_of(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _cut(text: str, find) -> list:
    """Parts of a text that can be encoded apart: a part stands for itself after a space, the first (in a tuple) without.

    A cut before a space that follows white space could move a border between words; such a text is one part.
    """
    if SPACED.search(text):
        return [(text,)]
    first, *rest = text.split(" ")
    return [(first,), *rest]


def encoding(ranks_path: str, pattern: str, arrow):
    """Function of an iterator of batches (id, text) to batches (id, n_tokens, ids)."""

    def task(batches):
        import regex

        find = regex.compile(pattern).findall
        replay, index = _replay_of(ranks_path), _index_of(ranks_path, pattern)
        for batch in bounded(batches):
            index.reset_if_over()
            docs = [index.number(_cut(t, find)) for t in texts_of(batch.column(1))]
            parts = [find(x[0] if isinstance(x, tuple) else f" {x}") for x in index.unseen()]
            words = list(dict.fromkeys(w for part in parts for w in part))
            coded = dict(zip(words, replay.encode([w.encode() for w in words]), strict=True)).__getitem__
            index.values += [b"".join(map(coded, part)) for part in parts]
            value = index.values.__getitem__
            ids = [b"".join(map(value, d.tolist())) for d in docs]
            yield columns_of(arrow, {arrow.names[0]: batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    return task


def decoding(ranks_path: str, arrow, ids_col: str):
    """Function of an iterator of batches to the same batches with the last column of `arrow`: the bytes of the ids."""

    def task(batches):
        token = _tokens_of(ranks_path).__getitem__
        for batch in batches:
            decoded = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield columns_of(arrow, {n: batch.column(batch.schema.get_field_index(n)) for n in arrow.names[:-1]} | {arrow.names[-1]: decoded})

    return task


def encode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row per row of `df`: the id column, `n_tokens` long and `ids` binary (little-endian uint32).

    `pattern` cuts a text into words; each match is encoded separately, without special tokens.
    """
    schema = f"`{id_col}` {id_type}, n_tokens long, ids binary"
    return df.select(F.col(id_col).cast(id_type).alias(id_col), F.col(text_col).alias("text")).mapInArrow(encoding(ranks_path, pattern, arrow_schema(schema)), schema)


def decode(df: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with `out_col` binary: the bytes that its ids stand for. Null ids decode to empty bytes."""
    kept = [c for c in df.columns if c != out_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes) + f", `{out_col}` binary"
    return df.select(*kept).mapInArrow(decoding(ranks_path, arrow_schema(schema), ids_col), schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, encoded and decoded; digests of both."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    encoded, decoded, digests = map(arrow_schema, ("doc_id long, n_tokens long, ids binary", "doc_id long, n_tokens long, ids binary, decoded binary", schema))
    encode_task, decode_task = encoding(path, P.PATTERN, encoded), decoding(path, decoded, "ids")

    def task(batches):
        sha = lambda column: [hashlib.sha256(x.as_buffer()).hexdigest() for x in column]
        for batch in decode_task(encode_task(batches)):  # one Python worker a task, and neither ids nor bytes cross to the JVM
            yield columns_of(digests, {"doc_id": batch.column(0), "n_tokens": batch.column(1), "ids_sha256": sha(batch.column(2)), "decoded_sha256": sha(batch.column(3))})

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema)
