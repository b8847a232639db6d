"""Helpers shared by the operators that look words up inside Python tasks."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import count
from weakref import WeakSet

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: a part of a text between white space that is longer is read in pieces
PART, OVERLAP = 32, 3
_RUN = re.compile(r"[^\W_]+")


class WordIndex:
    """Numbers the distinct words a task has met, so that a text is held as an int32 array.

    `values[i]` is what the caller has computed for word i. An index serves all tasks of a worker process.
    `reset_if_over` empties it between batches once it holds more than `limit` words or `most_chars` characters;
    that bounds memory and changes no result.
    """

    _live: WeakSet = WeakSet()

    def __init__(self, limit: int = 250_000, owner: str = "", most_chars: int = 8 << 20):
        """Indexes of one owner are used together; where another owner's tasks begin, they are emptied."""
        self.limit, self.owner, self.most_chars = limit, owner, most_chars
        self.clear()
        WordIndex._live.add(self)

    def clear(self) -> None:
        self.ids: defaultdict[str, int] = defaultdict(count().__next__)
        self.values: list = []
        self.chars = 0

    def reset_if_over(self) -> None:
        for other in list(WordIndex._live):
            if other.owner != self.owner and other.ids:
                other.clear()
        if len(self.ids) > self.limit or self.chars > self.most_chars:
            self.clear()

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def unseen(self) -> list[str]:
        """Words numbered since values were last extended, in order of their numbers."""
        fresh = len(self.ids) - len(self.values)
        if not fresh:
            return []
        words = list(self.ids)
        words = words[len(words) - fresh :]
        self.chars += sum(len(w) if isinstance(w, str) else len(w[0]) for w in words)
        return words


def arrow_schema(schema: str):
    """Arrow's form of a Spark DDL string. Made where the session is, on the driver; tasks get the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def columns_of(schema, arrays: dict):
    """A record batch of these columns, by name, in an Arrow schema."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], type=f.type) for f in schema], schema=schema)


def texts_of(column) -> list[str]:
    """Texts of an Arrow column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def bounded(batches, column: int = 1, most: int = 4 << 20, rows: int = 2000):
    """The same rows in batches of at most `rows` rows, and of at most `most` bytes in `column` unless one row has more.

    What Arrow's pool keeps of earlier batches goes back to the system: a worker process serves the tasks of many stages
    and would else hold the most that any of them took.
    """
    import pyarrow as pa

    pool = pa.default_memory_pool()
    pool.release_unused()
    for batch in batches:
        texts = batch.column(column)
        kind = np.int64 if str(texts.type).startswith("large") else np.int32
        ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1), len(texts))
            yield batch.slice(at, to - at)
            at = to
        del batch, texts
        pool.release_unused()


def sent_once(df, keep: tuple[str, ...], text_col: str):
    """The columns `keep` and the text, which is not sent twice if it is one of them; and the place of the text."""
    if text_col in keep:
        return df.select(*keep), keep.index(text_col)
    return df.select(*keep, df[text_col].alias("_text")), len(keep)


def parts(text: str) -> list[str]:
    """Lower-case parts between white space. A part of more than PART characters is cut at what is neither letter nor
    digit, and runs that are still longer into pieces of PART characters that overlap by OVERLAP: every character
    counts, and no entry of an index is long."""
    found = text.lower().split()
    if not found or max(map(len, found)) <= PART:
        return found
    out = []
    for part in found:
        if len(part) <= PART:
            out.append(part)
        else:
            for run in _RUN.findall(part):
                out += [run] if len(run) <= PART else [run[i : i + PART] for i in range(0, len(run) - OVERLAP, PART - OVERLAP)]
    return out


@lru_cache(maxsize=2)
def _table(letters_only: bool) -> np.ndarray:
    test = str.isalpha if letters_only else str.isalnum
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Letters:
    """Words of many parts, laid end to end as code points with a 0 before, between and after them.

    `letters_only`: a part is cut into its runs of letters; else it is one word, of its letters and digits.
    `owner` is the part of each word, `begin` and `length` its place.
    """

    def __init__(self, words: list[str], letters_only: bool):
        codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        border = codes == 10
        good = _table(letters_only)[codes]
        part = np.cumsum(border) - 1
        if letters_only:
            keep = good.copy()
            keep[1:] |= good[:-1]  # one border after each run
            keep[0] = True
        else:
            keep = good | border
        self.codes = np.where(good, codes, 0)[keep]
        inside = self.codes != 0
        first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.begin, self.length = first, last - first + 1
        self.owner = part[keep][first] if len(first) else np.zeros(0, np.int64)
        self.inside = inside

    def word_hashes(self) -> np.ndarray:
        """A hash of each word."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(self.inside)
        place = at - np.repeat(self.begin, self.length)
        top = int(self.length.max())
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(top, MULTIPLIER, np.uint64))), dtype=np.uint64)
        terms = self.codes[at].astype(np.uint64) * powers[place]
        starts = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        return mix(np.add.reduceat(terms, starts) + self.length.astype(np.uint64))

    def gram_hashes(self, n: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of `n` code points within a word and the 0 on either side of it, at the `wanted` places only if given."""
        size = len(self.codes) - n + 1
        if size <= 0 or not len(self.begin):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.inside
        if n == 1:
            good = inside.copy()
        elif n == 2:
            good = inside[:-1] | inside[1:]
        else:
            good = inside[1 : 1 + size].copy()
            for k in range(2, n - 1):
                good &= inside[k : k + size]
        at = np.flatnonzero(good if wanted is None else good & wanted[:size])
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * MULTIPLIER + self.codes[at + k]
        return at, mix(h)

    def word_at(self, places: np.ndarray) -> np.ndarray:
        """Number of the word that a window beginning at each place belongs to."""
        if not hasattr(self, "_word"):
            marks = np.zeros(len(self.codes) + 1, np.int32)
            marks[self.begin] = 1
            self._word = np.cumsum(marks, dtype=np.int32) - 1
        return self._word[places + 1]


def hash_share(key, rows: int, n: int, seed: int):
    """Condition that keeps about `rows` of `n` rows by a hash of their key."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit((1 << 60) - 1)) < F.lit(share_of(rows, n))


def share_of(rows: int, n: int) -> int:
    """rows / n as a part of 2^60, all of it where n is not larger."""
    return 1 << 60 if n <= rows else (rows << 60) // n
