"""Operator 4: toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of the vectors to which the word and all its character 4-grams hash. Filters of
widths 1, 2 and 3 slide over the words, each keeps its maximum over the text, and a logistic layer reads the
maxima. `train` fits it on a bounded sample of labelled rows (`per_class`, `sample_chars`): embeddings start from the
log odds of their features in the sample, then Adagrad steps on mini-batches adjust embeddings, filters and weights.
All labelled rows outside the sample, a fifth of them by hash at least, calibrate it: Spark scores them and counts
them by language (as `language_id` tells it from the text), label and log odds, and for each language the threshold
that best separates the classes there is mapped to `cut`; scores are stretched on either side of it. `score` sends
the model, whose size does not depend on the input, to the tasks, which embed each distinct word once.

A score depends on the text alone. Null, empty and wordless texts have no maxima and get the score of the
bare bias, below the cut. A part of more than 32 characters is read in pieces (`words.parts`). Repeated rows get equal
results; an empty table an empty one. Where a key repeats in the labels, the row is toxic if one of them says so;
where it repeats among the documents, the least of its texts is learned from. Without labelled rows of both classes,
every text gets score 0. Batches are bounded by bytes, and a very long text goes through the filters in stretches.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language_id
from .storage import materialize
from .words import Letters, WordIndex, arrow_schema, bounded, columns_of, parts, sent_once, share_of, texts_of

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
#: (width, place in the filter) of each group of FILTERS columns in the product with all filters
PLACES = [(w, j) for w in WIDTHS for j in range(w)]
#: labelled keys that may be broadcast
BROADCAST_ROWS = 2_000_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words and of their 4-grams (a border counts as a character), word after word, and where each
    word's begin. A part without a letter or digit has bucket BUCKETS only."""
    letters = Letters(words, letters_only=False)
    at, grams = letters.gram_hashes(4)
    of = letters.owner[letters.word_at(at)] if len(at) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(1 + np.bincount(of, minlength=len(words)))))
    flat = np.empty(starts[-1], np.int32)
    whole = np.full(len(words), BUCKETS, np.int32)
    whole[letters.owner] = (letters.word_hashes() % np.uint64(BUCKETS)).astype(np.int32)
    first = np.zeros(len(flat), bool)
    first[starts[:-1]] = True
    flat[first] = whole
    flat[~first] = (grams % np.uint64(BUCKETS)).astype(np.int32)
    return flat, starts


class Network:
    """Embeddings, filters and logistic layer. Row BUCKETS of the embeddings is zero."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[:, 0] = np.abs(f[:, 0]) + 0.3
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.weight = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.offset = np.float32(-2)
        self.embed[BUCKETS] = 0

    def words(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Embeddings of words from their features."""
        out = np.empty((len(starts) - 1, DIM), np.float32)
        for i in range(0, len(out), 20_000):
            ends = starts[i : i + 20_001]
            out[i : i + 20_000] = np.add.reduceat(self.embed[flat[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
        return np.tanh(out / 4) * 4

    def maxima(self, docs: list[np.ndarray], embedded: np.ndarray, where: bool = False, counted: list[int] | None = None):
        """Maximum of each filter over each text (0 where none is positive), and the place of each if asked for.

        Only the first `counted` places of each text count as such, all if not given. Texts are laid end to end with
        word 0 between, whose embedding is 0, as many as a filter can reach over. One product gives what every
        filter has at each of its places for every word.
        """
        gap = max(WIDTHS) - 1
        lengths = np.array([len(d) for d in docs])
        starts = np.concatenate(([0], np.cumsum(lengths + gap)))[:-1]
        total = int(lengths.sum() + gap * len(docs))
        x = np.zeros(total + gap, np.int32)
        real = np.zeros(total, bool)
        for s, d, n in zip(starts.tolist(), docs, counted or lengths.tolist(), strict=True):
            x[s : s + len(d)] = d
            real[s : s + n] = True
        between = np.flatnonzero(~real)
        each = embedded.take(x, axis=0) @ np.hstack([self.filters[w][j] for w, j in PLACES])
        out, places = [], []
        for k, w in enumerate(WIDTHS):
            at = PLACES.index((w, 0)) * FILTERS
            y = each[:total, at : at + FILTERS].copy()
            for j in range(1, w):
                y += each[j : j + total, at + j * FILTERS : at + (j + 1) * FILTERS]
            y += self.bias[k * FILTERS : (k + 1) * FILTERS]
            y[between] = 0
            out.append(np.maximum(np.maximum.reduceat(y, starts, axis=0), 0))
            if where:
                np.maximum(y, 0, out=y)
                places.append(np.array([y[s : s + n].argmax(axis=0) if n else np.zeros(FILTERS, int) for s, n in zip(starts, lengths, strict=True)]))
        return np.hstack(out), (np.hstack(places) if where else None)

    def logits(self, docs: list[np.ndarray], embedded: np.ndarray, budget: int = 10_000) -> np.ndarray:
        """Log odds of each text of word numbers from 1, worked out for about `budget` words at a time; longer texts in stretches that overlap."""
        top = np.zeros((len(docs), len(self.weight)), np.float32)
        part, of, counted, size = [], [], [], 0

        def flush():
            if part:
                np.maximum.at(top, np.array(of), self.maxima(part, embedded, counted=counted)[0])

        for k, d in enumerate(docs):
            for at in range(0, max(len(d), 1), budget):
                piece = d[at : at + budget + max(WIDTHS) - 1]
                if part and size + len(piece) > budget:
                    flush()
                    part, of, counted, size = [], [], [], 0
                part.append(piece)
                counted.append(min(budget, len(d) - at))
                of.append(k)
                size += len(piece)
        flush()
        return top @ self.weight + self.offset

    def fit(self, docs: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = 2, batch: int = 32, rate: float = 0.05, seed: int = 4) -> None:
        """Adagrad on the logistic loss; only the words at the maxima receive gradient."""
        seen = np.zeros((2, BUCKETS + 1))
        for d, y in zip(docs, labels.tolist(), strict=True):
            seen[y, np.unique(np.concatenate([flat[starts[w] : starts[w + 1]] for w in np.unique(d)]))] += 1
        n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        odds = np.clip(np.log((seen[1] + 0.5) / n1) - np.log((seen[0] + 0.5) / n0), -2, 5) / 4
        self.embed[:, 0] = np.where(seen.sum(axis=0) >= 3, odds, self.embed[:, 0])
        self.embed[BUCKETS] = 0
        rng = np.random.default_rng(seed)
        dense = [self.bias, self.weight, *self.filters.values()]
        squares = [np.full_like(p, 1e-3) for p in dense]
        embed_square, offset_square = np.full(BUCKETS + 1, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                used, inverse = np.unique(np.concatenate([docs[i] for i in chosen]), return_inverse=True)
                part = np.split(inverse, np.cumsum([len(docs[i]) for i in chosen])[:-1])
                counts = starts[used + 1] - starts[used]
                ends = np.cumsum(counts)
                feats = flat[np.arange(ends[-1]) + np.repeat(starts[used] - ends + counts, counts)]
                squashed = np.tanh(np.add.reduceat(self.embed[feats], ends - counts, axis=0) / 4)
                embedded = squashed * 4
                top, places = self.maxima([d + 1 for d in part], np.vstack([np.zeros((1, DIM), np.float32), embedded]), where=True)
                p = 1 / (1 + np.exp(-(top @ self.weight + self.offset)))
                error = (p - labels[chosen]).astype(np.float32) / len(chosen)
                to_top = error[:, None] * self.weight * (top > 0)
                grads = [to_top.sum(axis=0), top.T @ error]
                to_words = np.zeros_like(embedded)
                for k, w in enumerate(WIDTHS):
                    grad = np.zeros_like(self.filters[w])
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    for i, d in enumerate(part):
                        for j in range(w):
                            at_word = places[i, cols] + j
                            inside = np.flatnonzero((at_word < len(d)) & (to_top[i, cols] != 0))
                            if len(inside):
                                ids = d[at_word[inside]]
                                g = to_top[i, cols][inside]
                                grad[j][:, inside] += (embedded[ids] * g[:, None]).T
                                np.add.at(to_words, ids, self.filters[w][j][:, inside].T * g[:, None])
                    grads.append(grad)
                for p_, g, s in zip(dense, grads, squares, strict=True):
                    s += g * g
                    p_ -= rate * g / np.sqrt(s)
                offset_square += float(error.sum()) ** 2
                self.offset -= np.float32(rate * error.sum() / np.sqrt(offset_square))
                touched = np.flatnonzero(np.abs(to_words).sum(axis=1))
                if len(touched):
                    back = np.zeros_like(to_words)
                    back[touched] = to_words[touched] * (1 - squashed[touched] ** 2)
                    of = np.repeat(np.arange(len(used)), counts)
                    inside = np.isin(of, touched)
                    step = np.zeros((BUCKETS + 1, DIM), np.float32)
                    np.add.at(step, feats[inside], back[of[inside]])
                    rows = np.unique(feats[inside])
                    embed_square[rows] += (step[rows] ** 2).sum(axis=1)
                    self.embed[rows] -= rate * step[rows] / np.sqrt(embed_square[rows])[:, None]
                    self.embed[BUCKETS] = 0


class Model:
    """Network, language model and the threshold of each language; None as network scores 0."""

    def __init__(self, network: Network | None, languages, cut: float):
        self.network, self.languages, self.cut, self.thresholds = network, languages, cut, {}
        self.default = cut

    def raw(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and log odds of each text before calibration."""
        if "held" not in vars(self):
            index = WordIndex(100_000, "toxicity")
            self.held = index, language_id.PartScores(self.languages, index), [None]
        index, languages, embedded = self.held
        index.reset_if_over()
        if not index.values:
            languages.clear()
            embedded[:] = [np.zeros((1, DIM), np.float32)]
        docs = [index.number(parts(t)) for t in texts]
        fresh = index.unseen()
        languages.extend(fresh)
        for i in range(0, len(fresh), 20_000):
            embedded[:] = [np.vstack([*embedded, self.network.words(*features(fresh[i : i + 20_000]))])]
        index.values += [None] * len(fresh)
        return languages.decide(docs)[0], self.network.logits([d + 1 for d in docs], embedded[0]).astype(float)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(texts))
        named, logits = self.raw(texts)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        t = np.array([self.thresholds.get(x, self.default) for x in named])
        return np.where(p < t, self.cut * p / t, self.cut + (1 - self.cut) * (p - t) / (1 - t))

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "held"}


#: bins of log odds to one, and the log odds between which a threshold lies
BINS, MOST = 8, 4.0


def best_threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Where a cut between bins of log odds makes fewest errors; the middle of the longest run of such places."""
    places = np.arange(int(-MOST * BINS), int(MOST * BINS) + 1)
    wrong = np.array([toxic[bins < p].sum() + clean[bins >= p].sum() for p in places])
    least = np.concatenate(([False], wrong <= wrong.min() * (1 + 1e-9), [False])).astype(int)
    begins, ends = np.flatnonzero(np.diff(least) == 1), np.flatnonzero(np.diff(least) == -1) - 1
    longest = int((ends - begins).argmax())
    return float(1 / (1 + np.exp(-(places[begins[longest]] + places[ends[longest]]) / 2 / BINS)))


def thresholds(counts: list[tuple[str, int, int, int]], cut: float, prior: int = 200) -> tuple[float, dict[str, float]]:
    """The common threshold and that of each language, from rows (language, label, bin, count).

    A language's counts have those of all languages added, scaled to `prior` rows: the fewer labelled rows it has, the
    nearer its threshold lies to the common one, and there is no number at which it gets one of its own.
    """
    table = np.array([(y, b, n) for _, y, b, n in counts], np.int64).reshape(-1, 3)
    named = np.array([x for x, *_ in counts], object)
    if len(set(table[:, 0])) < 2:
        return cut, {}
    scaled = table[:, 2] * (prior / table[:, 2].sum())

    def of(n: np.ndarray) -> float:
        return best_threshold(table[:, 1], n * (table[:, 0] == 1), n * (table[:, 0] == 0))

    return of(table[:, 2]), {lang: of(table[:, 2] * (named == lang) + scaled) for lang in sorted(set(named))}


def train(docs: DataFrame, labels: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: tuple[int, int] = (3000, 2000), sample_chars: int = 40_000_000, cut: float = 0.3) -> Model:
    """A model from labelled documents.

    `per_class` (rows of label 0 and of label 1) and `sample_chars` (their characters) bound the sample that the
    network and the language model are fitted on. All other labelled rows calibrate the thresholds.
    """
    given = labels.select(F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and key is not null").groupBy("key").agg(F.max("y").alias("y"))
    given = given.withColumn("at", F.xxhash64(F.lit(4), "key").bitwiseAND(F.lit((1 << 60) - 1))).withColumn("back", F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(5)) == 0)
    given = materialize(given, "labels")
    counts = {r["y"]: r["n"] for r in given.where("not back").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, None, cut)
    share = F.when(F.col("y") == 1, F.lit(share_of(per_class[1], counts[1]))).otherwise(F.lit(share_of(per_class[0], counts[0])))
    chosen = ~F.col("back") & (F.col("at") < share)
    texts = docs.select(F.col(key_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = texts.join(F.broadcast(given.where(chosen)), "key").groupBy("key", "y", "at").agg(F.min(F.struct("text", "lang")).alias("_"))  # bounded by per_class
    sample = materialize(sample.select("key", "y", "at", "_.text", "_.lang"), "toxicity-sample")
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > sample_chars:
        sample = sample.where(F.xxhash64(F.lit(6), "key").bitwiseAND(F.lit((1 << 60) - 1)) < F.lit(share_of(sample_chars, chars)))
    rows = sample.collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["key"]).encode()), str(r["key"])))
    index = WordIndex()
    words = [index.number(parts(r["text"])) for r in rows]
    flat, starts = features(index.unseen())
    y = np.array([r["y"] for r in rows], np.int64)
    fitted = [i for i in range(len(rows)) if len(words[i])]
    if len(np.unique(y[fitted])) < 2:
        return Model(None, None, cut)
    network = Network()
    network.fit([words[i] for i in fitted], flat, starts, y[fitted])
    del words, rows, index, flat
    model = Model(network, language_id.train(sample, key_col="key"), cut)
    others = given.where(~chosen)
    few = others.count() <= BROADCAST_ROWS  # beyond that, Spark sorts and merges
    rest = texts.join(F.broadcast(others.select("key", "y")) if few else others.select("key", "y"), "key").select("y", "text")
    model.default, model.thresholds = thresholds([tuple(r) for r in _counted(rest, model).collect()], cut)  # languages x labels x bins
    return model


def _counted(rows: DataFrame, model: Model) -> DataFrame:
    """lang, y, bin, n of rows (y, text): how many have these log odds."""
    schema = "lang string, y int, bin int, n long"
    arrow = arrow_schema(schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in bounded(batches):
            named, logits = sent.value.raw(texts_of(batch.column(1)))
            bins = np.floor(np.clip(logits, -2 * MOST, 2 * MOST) * BINS).astype(int)
            yield columns_of(arrow, {"lang": named, "y": batch.column(0), "bin": bins, "n": np.ones(len(bins), np.int64)})

    return rows.mapInArrow(task, schema).groupBy("lang", "y", "bin").agg(F.sum("n").alias("n"))


def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """`keep` and a score double under `name` (0 to 1; toxic from the model's cut on), one row per row of `df`."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + f", `{name}` double"
    arrow = arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the sample
    given, at = sent_once(df, keep, text_col)

    def task(batches):
        for batch in bounded(batches, at):
            found = sent.value.score(texts_of(batch.column(at)))
            yield columns_of(arrow, dict(zip(arrow.names, [*batch.columns[: len(keep)], found], strict=True)))

    return given.mapInArrow(task, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learned from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out.alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = train(docs.where(~F.col("held_out")), labels)
    return score(docs, model, keep=("doc_id", "held_out")).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
