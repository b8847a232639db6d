"""Operator 5: language identification, words first, then backing off to character n-grams.

`train` counts words and their character n-grams by language over a bounded sample of labelled rows (`sample_rows`;
Spark counts, one row per task and entry before the shuffle). The model holds all of them, by 64-bit hash, so its
size is bounded by the sample. A text's words are scored by their log frequency in each language. A word that no
language knows is read from left to right by the longest n-gram known at each place, from four characters down to
one. A task scores each distinct word once, in arrays, and keeps the scores in an index.

Words are runs of letters. A run of more than 32 letters is read in pieces of 32 that overlap by three. The
prediction depends on the text alone. Null texts and texts without a letter get `und` with score 0. A text of
unknown letters gets the language that was most frequent in the sample, with a low score. Ties go to the language
that comes first in the alphabet. Repeated rows get equal results; an empty table an empty one. An empty sample
gives a model without languages, and every text gets `und`. Batches are bounded by bytes, so that very long texts
are read a few at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Letters, WordIndex, arrow_schema, bounded, columns_of, hash_share, parts, sent_once, texts_of

LONGEST = 4


class LanguageModel:
    """Log frequencies of words and n-grams by language; plain arrays, so that it can be broadcast."""

    def __init__(self, languages: list[str], documents: list[int], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: length of the n-gram (0: a word) -> hashes in ascending order, and counts of each by language."""
        self.languages = languages
        self.prior = np.log(np.array(documents, float) / max(1, sum(documents))) if languages else np.zeros(0)
        # hash -> row of `table`: log frequencies less their mean over the languages; those of n-grams by n, as the
        # n-grams that a word is read by overlap in all but one of their characters
        table, self.keys, self.first = [np.zeros((1, len(languages)))], [], []
        for n in range(LONGEST + 1):
            keys, c = counts.get(n, (np.zeros(0, np.uint64), np.zeros((0, len(languages)))))
            self.first.append(sum(map(len, table)))
            self.keys.append(keys)
            if len(keys):
                log = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(c)))
                table.append((log - log.mean(axis=1, keepdims=True)) / max(n, 1))
        self.table = np.vstack(table).astype(np.float32)

    def rows_of(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash among the entries of length n, 0 where it is unknown."""
        keys = self.keys[n]
        if not len(keys) or not len(hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at + self.first[n], 0)

    def score_parts(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log score of the words of each part for each language, and how many words it has."""
        letters = Letters(given, letters_only=True)
        rows = self.rows_of(0, letters.word_hashes())
        score = self.table[rows].astype(np.float64)
        unknown = rows == 0
        if unknown.any():
            word = letters.word_at(np.arange(len(letters.codes)))
            wanted = (word >= 0) & unknown[word]
            found = np.zeros(len(word), np.int64)
            for n in range(LONGEST, 0, -1):
                at, hashes = letters.gram_hashes(n, wanted)
                rows = self.rows_of(n, hashes)
                found[at] = rows
                wanted[at[rows > 0]] = False
            at = np.flatnonzero(found)
            for k in range(len(self.languages)):
                score[:, k] += np.bincount(word[at], self.table[found[at], k], len(score))
        words = np.bincount(letters.owner, minlength=len(given))
        return np.stack([np.bincount(letters.owner, score[:, k], len(given)) for k in range(len(self.languages))], axis=1) if self.languages else np.zeros((len(given), 0)), words

    def decide(self, score: np.ndarray, words: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence (0 to 1) of texts, from their summed scores and numbers of words."""
        if not self.languages:
            return ["und"] * len(words), np.zeros(len(words))
        tempered = self.prior + score / np.sqrt(np.maximum(words, 1))[:, None]
        p = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = (self.prior + score).argmax(axis=1)
        named = [self.languages[b] if n else "und" for b, n in zip(best, words, strict=True)]
        return named, np.where(words > 0, p[np.arange(len(best)), best], 0.0)


class PartScores:
    """Scores of the distinct parts met so far, and sums of them over texts."""

    def __init__(self, model: LanguageModel, index: WordIndex):
        self.model, self.index = model, index
        self.clear()

    def clear(self) -> None:
        self.scored = np.zeros((0, len(self.model.languages)), np.float32)
        self.words = np.zeros(0, np.int32)

    def extend(self, fresh: list[str]) -> None:
        """Scores of parts that follow those known."""
        for i in range(0, len(fresh), 20_000):
            scored, words = self.model.score_parts(fresh[i : i + 20_000])
            self.scored = np.vstack([self.scored, scored.astype(np.float32)])
            self.words = np.concatenate([self.words, words.astype(np.int32)])

    def decide(self, docs: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        score = np.array([self.scored[d].sum(axis=0, dtype=np.float64) for d in docs]).reshape(len(docs), len(self.model.languages))
        return self.model.decide(score, np.array([self.words[d].sum() for d in docs], np.int64))

    def of_texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text."""
        self.index.reset_if_over()
        if not self.index.values:
            self.clear()
        docs = [self.index.number(parts(t)) for t in texts]
        fresh = self.index.unseen()
        self.extend(fresh)
        self.index.values += [None] * len(fresh)
        return self.decide(docs)


def sample(df: DataFrame, rows: int, key_col: str, seed: int = 5) -> DataFrame:
    """About `rows` rows of `df` (all if it has fewer), chosen by a hash of the key."""
    n = df.count()
    return df if n <= rows else df.where(hash_share(key_col, rows, n, seed))


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = 12_000) -> LanguageModel:
    """A model from rows with a language; `sample_rows` bounds the rows read."""
    import pyarrow as pa

    rows = df.select(F.col(key_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    rows = sample(rows, sample_rows, "key").select("lang", "text")
    schema = "lang string, entry long, n int, count long"
    arrow = arrow_schema(schema)

    def task(batches):
        for batch in bounded(batches):
            by_lang: dict[str, Counter] = {}
            documents: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                by_lang.setdefault(lang, Counter()).update(parts(text))
                documents[lang] += 1
            for lang, counts in by_lang.items():
                entries, lengths, numbers = [np.zeros(1, np.int64)], [np.array([-1])], [np.array([documents[lang]])]
                letters, times = Letters(list(counts), letters_only=True), np.fromiter(counts.values(), np.int64, len(counts))
                if len(letters.begin):
                    times = times[letters.owner]
                    found = {0: (letters.word_hashes(), times)}
                    for n in range(1, LONGEST + 1):
                        at, hashes = letters.gram_hashes(n)
                        found[n] = hashes, times[letters.word_at(at)]
                    for n, (hashes, weight) in found.items():
                        keys, inverse = np.unique(hashes, return_inverse=True)
                        entries.append(keys.view(np.int64))
                        lengths.append(np.full(len(keys), n))
                        numbers.append(np.bincount(inverse, weight, len(keys)).astype(np.int64))
                entry = np.concatenate(entries)
                yield columns_of(arrow, {"lang": pa.array([lang] * len(entry)), "entry": entry, "n": np.concatenate(lengths).astype(np.int32), "count": np.concatenate(numbers)})

    counted = rows.mapInArrow(task, schema).groupBy("lang", "n", "entry").agg(F.sum("count").alias("count")).toArrow()  # as many rows as the bounded sample has entries
    lang, n, entry, number = (counted.column(c).to_numpy() for c in ("lang", "n", "entry", "count"))
    documents = {x: int(c) for x, c in zip(lang[n == -1], number[n == -1], strict=True)}
    languages = sorted(documents)
    at = np.searchsorted(np.array(languages, object), lang) if languages else np.zeros(0, np.int64)
    counts = {}
    for k in range(LONGEST + 1):
        keys, inverse = np.unique(entry[n == k].astype(np.int64).view(np.uint64), return_inverse=True)
        c = np.zeros((len(keys), len(languages)))
        c[inverse, at[n == k]] = number[n == k]
        counts[k] = keys, c
    return LanguageModel(languages, [documents[x] for x in languages], counts)


def predict(df: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep`, the language string and its score double under `names`, one row per row of `df`."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + f", `{names[0]}` string, `{names[1]}` double"
    arrow = arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the entries of the sample
    given, at = sent_once(df, keep, text_col)

    def task(batches):
        held = vars(sent.value)  # the tasks of a worker share the model and the index
        if "held" not in held:
            held["held"] = PartScores(sent.value, WordIndex(100_000, "language_id"))
        for batch in bounded(batches, at):
            named, score = held["held"].of_texts(texts_of(batch.column(at)))
            yield columns_of(arrow, dict(zip(arrow.names, [*batch.columns[: len(keep)], named, score], strict=True)))

    return given.mapInArrow(task, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`, learned from rows whose crc32(doc_id) mod 3 is not 1."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
