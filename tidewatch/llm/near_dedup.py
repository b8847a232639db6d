"""Operator 2: near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (a text of fewer words is one shingle); words are cut at white space,
lower-cased, and lose what is neither letter nor digit. A shingle's weight in a text is
(1 + ln tf) * (1 + ln((N + 1) / (df + 1)) / ln(N + 1)), with df counted over all distinct texts. Two texts are
near duplicates if the weighted Jaccard similarity of their shingles is 0.8 or more; classes are the connected
components, named by the least doc_id in them.

1. `texts`: tasks hash the shingles of whole texts and send them, packed into arrays, to buckets of hashes.
   Copies that meet in a task are one text there. Beyond DIRECT buckets rows are dealt in two steps, so that a row still
   holds hundreds of postings. A bucket counts in how many distinct texts each shingle
   lies and sends the shingles found in more than one, packed again, to groups of texts. The others can match nothing.
2. A text less than 0.8 of whose weight lies in shared shingles cannot have a partner: it is dropped from the
   search, by proof. Of the rest, all shingles of df 1 are replaced by one element of their total weight,
   which leaves every weighted Jaccard similarity as it is.
3. `signatures` samples each of them BANDS x ROWS times; texts that agree in a band are candidates.
4. `links`: in each band bucket, texts are paired with one of them, not with each other. Pairs whose samples
   agree in far too few places are dropped (a similarity of 0.8 would be more than four standard deviations
   off), the others are verified by their exact weighted Jaccard similarity. In a second round the texts of a
   bucket that are not yet in one class are paired with another of them, chosen at random.
5. `apart` takes the buckets that still hold more than one class and compares every pair of texts of different
   classes in them, in cells of bounded size, so all candidates are in one class or refuted.
6. `components` joins links into classes by minimum labels.

Tables grow in proportion to the input or slower. A bucket of many texts that are all different takes a time that grows with its square. A shingle
that a third of all texts share is one entry for each text in one bucket's arrays. Null and wordless texts have
no shingles and form classes of their own; equal word sequences are one text; repeated rows fall in one class, and
every row of an id has a row in the result. Rows without id are not searched and have no class (null). 1 + ln tf
is rounded to 16 bits. Batches are bounded by bytes.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .words import MULTIPLIER as _MULTIPLIER
from .words import WordIndex, arrow_schema, bounded, columns_of, mix, texts_of

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 20, 5
#: postings to a bucket, and postings that a task holds before it sends them
BUCKET, FLUSH = 2_000_000, 1_500_000
_NOT_ALNUM = re.compile(r"[\W_]+")
#: texts of a bucket that shares its cell with others, texts of such a cell, and texts to a block of larger buckets
FEW, CELL, BLOCK = 32, 20_000, 1024
_INDEX = WordIndex(100_000, "near_dedup")


def _word_hash(part: str) -> int:
    word = _NOT_ALNUM.sub("", part)
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") | 1 if word else 0


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's shingles, in order, from the hashes of its words."""
    n = min(WORDS, len(words))
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * _MULTIPLIER + words[k : k + len(h)]
    return mix(h)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text; parts without a letter or digit are none."""
    _INDEX.reset_if_over()
    docs = [_INDEX.number(t.lower().split()) for t in texts]
    _INDEX.values += map(_word_hash, _INDEX.unseen())
    of = np.array(_INDEX.values, np.uint64)
    return [w[w != 0] for w in (of[d] for d in docs)]


def inverse_df(df, n: float):
    return 1 + np.log((n + 1) / (df + 1.0)) / math.log(n + 1)


_POSTINGS = "bucket long, keys binary, low binary, high binary, at binary, shares binary, ids binary, units binary, totals binary"
_SHARED = "texts long, ids binary, units binary, totals binary, owners binary, counts binary, hashes binary, weights binary, shares binary"
_TEXTS = "doc_id long, unit long, alone double, hashes binary, weights binary"


#: unit of a document without words
WORDLESS = -(1 << 63)
#: numbers up to which rows are dealt at once; more take a second step, each of the square root of the number
DIRECT = 8192


def levels(number: int) -> tuple[int, int]:
    """How many ways rows are dealt in the first and in the second step, so that there are at least `number` ways."""
    if number <= DIRECT:
        return number, 1
    first = math.isqrt(number - 1) + 1
    return first, -(-number // first)


def _cut(groups: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(group, places) of each group that has any, in order."""
    if not len(groups):
        return []
    order = np.argsort(groups, kind="stable")
    found, starts = np.unique(groups[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, starts[1:]), strict=True))


def _posting_rows(arrow, bucket: np.ndarray, unit: np.ndarray, rest: np.ndarray, share: np.ndarray):
    """A batch with a row for each bucket that has postings (key of the text, rest of the hash, 1 + ln tf)."""
    out = {n: [] for n in arrow.names}
    for b, part in _cut(bucket):
        keys, place = np.unique(unit[part], return_inverse=True)
        r = rest[part]
        for n, v in zip(arrow.names, (b, keys.astype("<i8").tobytes(), r.astype("<u4").tobytes(), (r >> np.uint64(32)).astype("<u2").tobytes(), place.astype("<i4").tobytes(), share[part].tobytes(), None, None, None), strict=True):
            out[n].append(v)
    return columns_of(arrow, out)


def _read(table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist() if x is not None]


def _joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _postings(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rests and shares of the postings of some rows."""
    unit = _joined([k[a] for k, a in zip(_read(table, "keys", "<i8"), _read(table, "at", "<i4"), strict=True)], "<i8")
    rest = _joined(_read(table, "low", "<u4"), "<u4").astype(np.uint64) | _joined(_read(table, "high", "<u2"), "<u2").astype(np.uint64) << np.uint64(32)
    return unit, rest, _joined(_read(table, "shares", "<f2"), "<f2")


def _packed(df: DataFrame, buckets: int) -> DataFrame:
    """Rows for buckets: either postings (keys of texts, hashes, place of the text in keys, 1 + ln tf) or documents (ids, keys, sums of 1 + ln tf)."""
    arrow = arrow_schema(_POSTINGS)
    first, second = levels(buckets)

    def task(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def rows():
            hashes = np.concatenate([h for h, _ in held.values()])
            unit = np.repeat(np.array(list(held), np.int64), [len(h) for h, _ in held.values()])
            share = np.concatenate([t for _, t in held.values()])
            return _posting_rows(arrow, (hashes % np.uint64(first)).astype(np.int64), unit, hashes // np.uint64(first) & np.uint64((1 << 48) - 1), share)

        for k, batch in enumerate(bounded(batches)):
            ids, units, totals = batch.column(0).to_pylist(), [], []
            for words in word_hashes(texts_of(batch.column(1))):
                unit, total = WORDLESS, 0.0
                if len(words):
                    unit = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
                    h, tf = np.unique(shingles(words), return_counts=True)
                    share = (1 + np.log(tf)).astype("<f2")
                    total = float(share.sum(dtype=float))
                    if unit not in held:
                        held[unit] = (h, share)
                        size += len(h)
                units.append(unit)
                totals.append(total)
            if ids:
                yield columns_of(arrow, {n: [None] for n in arrow.names} | {"bucket": [(k * 31 + ids[0]) % first], "ids": [np.array(ids, "<i8").tobytes()], "units": [np.array(units, "<i8").tobytes()], "totals": [np.array(totals, "<f8").tobytes()]})
            if size > FLUSH:
                yield rows()
                held, size = {}, 0
        if held:
            yield rows()

    def deal(batches):
        """Postings of first-step buckets to those of the second step."""
        import pyarrow as pa

        held, size = [], 0

        def rows():
            bucket, unit, rest, share = (np.concatenate(x) for x in zip(*held, strict=True))
            return _posting_rows(arrow, bucket, unit, rest, share)

        for batch in batches:
            documents = batch.filter(batch.column(batch.schema.get_field_index("ids")).is_valid())
            if documents.num_rows:
                yield columns_of(arrow, {n: documents.column(i) for i, n in enumerate(arrow.names)} | {"bucket": [b * second for b in documents.column(0).to_pylist()]})
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                unit, rest, share = _postings(one)
                if len(unit):
                    held.append((one.column(0)[0].as_py() * second + (rest % np.uint64(second)).astype(np.int64), unit, rest // np.uint64(second), share))
                    size += len(unit)
                if size > FLUSH:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    packed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _POSTINGS)
    return packed if second == 1 else packed.repartition("bucket").mapInArrow(deal, _POSTINGS)


def texts(df: DataFrame, documents: int, characters: int) -> DataFrame:
    """Two kinds of rows: (doc_id, unit) for each document with words, where unit is the key of its text, and
    (unit, alone, hashes, weights) for each text that can have a partner: its shared shingles in ascending order
    of their hashes, and the total weight of the others."""
    buckets = max(8, characters // 6 // BUCKET)
    first, second = levels(max(8, buckets // 2))
    n = float(documents)
    shared_schema, texts_schema = arrow_schema(_SHARED), arrow_schema(_TEXTS)

    def shared_rows(add, group_of, ids, units, totals, unit, hashes, weight, share):
        """Documents and shared shingles, a row for each group of texts that has any."""
        for g, at in _cut(group_of(units)):
            add(texts=g, ids=ids[at], units=units[at], totals=totals[at])
        for g, at in _cut(group_of(unit)):
            at = at[np.argsort(unit[at], kind="stable")]
            owners, counts = np.unique(unit[at], return_counts=True)
            add(texts=g, owners=owners.astype("<i8"), counts=counts.astype("<i4"), hashes=hashes[at].astype("<u8"), weights=weight[at], shares=share[at])

    def collector():
        out: dict[str, list] = {c: [] for c in shared_schema.names}

        def add(**values):
            for c in out:
                v = values.get(c)
                out[c].append(v.tobytes() if isinstance(v, np.ndarray) else v)

        return out, add

    def bucket(table):
        """Postings of a bucket of hashes to its shared shingles, for groups of texts."""
        import pyarrow as pa

        out, add = collector()
        ids, units, totals = _joined(_read(table, "ids", "<i8"), "<i8"), _joined(_read(table, "units", "<i8"), "<i8"), _joined(_read(table, "totals", "<f8"), "<f8")
        unit, rest, share = _postings(table)
        order = np.argsort(rest, kind="stable")
        rest, unit, share = rest[order], unit[order], share[order]
        same = rest[1:] == rest[:-1]
        kept = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(rest) else np.zeros(0, bool)  # others stand alone
        rest, unit, share = rest[kept], unit[kept], share[kept]
        order = np.lexsort((unit, rest))
        rest, unit, share = rest[order], unit[order], share[order]
        fresh = np.ones(len(rest), bool)
        fresh[1:] = (rest[1:] != rest[:-1]) | (unit[1:] != unit[:-1])  # a text that came from two tasks counts once
        rest, unit, share = rest[fresh], unit[fresh], share[fresh]
        _, inverse, count = np.unique(rest, return_inverse=True, return_counts=True)
        df_ = count[inverse]
        rest, unit, share, df_ = rest[df_ > 1], unit[df_ > 1], share[df_ > 1].astype("<f4"), df_[df_ > 1]
        weight = (share * inverse_df(df_, n)).astype("<f4")
        hashes = mix(rest * _MULTIPLIER + np.uint64(table.column("bucket")[0].as_py()))
        shared_rows(add, lambda u: (u.view(np.uint64) % np.uint64(first)).astype(np.int64), ids, units, totals, unit, hashes, weight, share)
        return pa.table({c.name: pa.array(out[c.name], c.type) for c in shared_schema})

    def deal(batches):
        """Rows of first-step groups of texts to those of the second step."""
        import pyarrow as pa

        out, add = collector()
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                g = one.column("texts")[0].as_py()
                of = lambda u, g=g: g * second + (u.view(np.uint64) // np.uint64(first) % np.uint64(second)).astype(np.int64)
                get = lambda c, kind, one=one: _joined(_read(one, c, kind), kind)
                owner = np.repeat(get("owners", "<i8"), get("counts", "<i4"))
                shared_rows(add, of, get("ids", "<i8"), get("units", "<i8"), get("totals", "<f8"), owner, get("hashes", "<u8"), get("weights", "<f4"), get("shares", "<f4"))
                held += len(owner)
            if held > FLUSH:
                yield columns_of(shared_schema, out)
                out, add = collector()
                held = 0
        yield columns_of(shared_schema, out)

    single = float(inverse_df(1, n))

    def assemble(table):
        """All that buckets have found of a group of texts to its texts that can have a partner."""
        import pyarrow as pa

        ids, units, totals = _joined(_read(table, "ids", "<i8"), "<i8"), _joined(_read(table, "units", "<i8"), "<i8"), _joined(_read(table, "totals", "<f8"), "<f8")
        documents_part = pa.table({"doc_id": pa.array(ids), "unit": pa.array(units)} | {c.name: pa.nulls(len(ids), c.type) for c in list(texts_schema)[2:]}).cast(texts_schema)
        owners = _read(table, "owners", "<i8")
        if not owners:
            return documents_part
        owner = np.concatenate([np.repeat(o, c) for o, c in zip(owners, _read(table, "counts", "<i4"), strict=True)])
        hashes, weights, shares = (np.concatenate(_read(table, c, k)) for c, k in (("hashes", "<u8"), ("weights", "<f4"), ("shares", "<f4")))
        order = np.lexsort((hashes, owner))
        owner, hashes, weights, shares = owner[order], hashes[order], weights[order], shares[order]
        text, starts = np.unique(owner, return_index=True)
        place = np.argsort(units, kind="stable")
        total = totals[place][np.searchsorted(units[place], text)]
        weight = np.add.reduceat(weights.astype(float), starts)
        left = total - np.add.reduceat(shares.astype(float), starts)
        alone = np.where(left > 1e-3, left * single, 0.0)
        ends = np.append(starts[1:], len(owner))
        able = np.flatnonzero(weight >= (SIMILAR - 1e-6) * (weight + alone))
        rows = {
            "doc_id": pa.nulls(len(able), pa.int64()), "unit": pa.array(text[able]), "alone": pa.array(alone[able]),
            "hashes": pa.array([hashes[starts[i] : ends[i]].tobytes() for i in able], pa.binary()), "weights": pa.array([weights[starts[i] : ends[i]].tobytes() for i in able], pa.binary()),
        }
        return pa.concat_tables([documents_part, pa.table(rows).cast(texts_schema)])

    shared = _packed(df, buckets).groupBy("bucket").applyInArrow(bucket, _SHARED)
    shared = shared if second == 1 else shared.repartition("texts").mapInArrow(deal, _SHARED)
    return shared.groupBy("texts").applyInArrow(assemble, _TEXTS)


def sample(hashes: np.ndarray, weights: np.ndarray, count: int, seed: int = 2) -> np.ndarray:
    """`count` improved consistent weighted samples of a weighted set, each as a 64-bit hash of the element and its level."""
    log_w = np.log(weights.astype(np.float32))
    out, level = np.empty(count, np.uint64), np.empty(count, np.uint64)
    scale = np.float32(2.0**-32)
    half = np.uint64(0xFFFFFFFF)
    salts = mix((np.arange(count, dtype=np.uint64) + np.uint64(1 + (seed << 20))) * _MULTIPLIER)
    uniform = lambda x: (x.astype(np.float32) + np.float32(0.5)) * scale
    block = max(1, 20_000 // len(hashes))
    for i in range(0, count, block):
        a = mix(hashes ^ salts[i : i + block, None])
        b, c = mix(a + _MULTIPLIER), mix(a ^ _MULTIPLIER)
        r = -np.log(uniform(a >> np.uint64(32)) * uniform(a & half))
        log_c = np.log(-np.log(uniform(b >> np.uint64(32)) * uniform(b & half)))
        beta = uniform(c >> np.uint64(32))
        t = np.floor(log_w / r + beta)
        best = (log_c - r * (t - beta + 1)).argmin(axis=1)
        out[i : i + block] = hashes[best]
        level[i : i + block] = t[np.arange(len(best)), best].astype(np.int64).astype(np.uint64)
    return mix(out ^ mix(level ^ salts))


def signatures(vectors: DataFrame) -> DataFrame:
    """unit, samples binary (32 bits each) and bands array<long>."""
    schema = "unit long, samples binary, bands array<bigint>"
    arrow = arrow_schema(schema)

    def task(batches):
        for batch in bounded(batches, 2, rows=1000):
            out = {"unit": batch.column(0), "samples": [], "bands": []}
            for unit, alone, h, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, weights = np.frombuffer(h, "<u8"), np.frombuffer(w, "<f4")
                if alone > 0:  # in no other text
                    hashes, weights = np.append(hashes, mix(np.array([unit & 0xFFFFFFFFFFFFFFFF], np.uint64))), np.append(weights, np.float32(alone))
                s = sample(hashes, weights, BANDS * ROWS)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    band = mix(band * _MULTIPLIER + s[k::ROWS])
                out["samples"].append((s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                out["bands"].append(band.astype(np.int64).tolist())
            yield columns_of(arrow, out)

    return vectors.mapInArrow(task, schema)


def _least_agreement() -> float:
    """Samples in which two texts of similarity SIMILAR agree at least, but for one pair in some hundred thousand."""
    count = BANDS * ROWS
    return SIMILAR * count - 4.5 * math.sqrt(SIMILAR * (1 - SIMILAR) * count)


def _similar(alone_a: float, x: np.ndarray, v: np.ndarray, alone_b: float, y: np.ndarray, w: np.ndarray) -> bool:
    """Whether the weighted Jaccard similarity of two texts is SIMILAR or more."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(v[i], w[j]).sum(dtype=float))
    return both >= (SIMILAR - 1e-9) * (alone_a + alone_b + float(v.sum(dtype=float)) + float(w.sum(dtype=float)) - both)


def links(pairs: DataFrame, signed: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is SIMILAR or more."""
    samples = lambda c: signed.select(F.col("unit").alias(c), F.col("samples").alias(f"s{c}"))
    least = _least_agreement()
    arrow = arrow_schema("a long, b long")

    def likely(batches):
        for batch in batches:
            a, b, sa, sb = (c.to_pylist() for c in batch.columns)
            agree = [int((np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")).sum()) for x, y in zip(sa, sb, strict=True)]
            keep = [i for i, n in enumerate(agree) if n >= least]
            yield columns_of(arrow, {"a": [a[i] for i in keep], "b": [b[i] for i in keep]})

    def similar(batches):
        for batch in bounded(batches, 3, rows=1000):
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            keep = []
            for a, b, alone_a, ha, wa, alone_b, hb, wb in rows:
                if _similar(alone_a, np.frombuffer(ha, "<u8"), np.frombuffer(wa, "<f4"), alone_b, np.frombuffer(hb, "<u8"), np.frombuffer(wb, "<f4")):
                    keep.append((a, b))
            yield columns_of(arrow, {"a": [k[0] for k in keep], "b": [k[1] for k in keep]})

    found = pairs.join(samples("a"), "a").join(samples("b"), "b").select("a", "b", "sa", "sb").mapInArrow(likely, "a long, b long")
    vector = lambda c: vectors.select(F.col("unit").alias(c), F.col("alone").alias(f"alone_{c}"), F.col("hashes").alias(f"h{c}"), F.col("weights").alias(f"w{c}"))
    return found.join(vector("b"), "b").join(vector("a"), "a").select("a", "b", "alone_a", "ha", "wa", "alone_b", "hb", "wb").mapInArrow(similar, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and the least node connected with it, of nodes with an edge (a, b). Each round takes the least label among
    neighbours and then that label's own label, so that long chains shorten by half."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = materialize(stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if not stepped.where("old != label").limit(1).count():
            return stepped.select("node", "label")
        labels = stepped.select("node", "label")


def _likely_pairs(table, least: float):
    """(place, places of the texts that it may be similar to) within each band of a cell, texts of one class left out."""
    band, label, side = (table.column(c).to_numpy() for c in ("band", "label", "side"))
    codes = np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint8).reshape(len(band), -1)
    for _, rows in _cut(band):
        for n, k in enumerate(rows):
            if side[k] == 1:
                continue
            against = rows[n + 1 :] if side[k] == 2 else rows[side[rows] == 1]
            against = against[label[against] != label[k]]
            agree = (codes[against] == codes[k]).sum(axis=1)
            found = np.flatnonzero(agree >= least)
            if len(found):
                yield k, against[found[np.argsort(-agree[found], kind="stable")]]


def apart(bands: DataFrame, label: DataFrame, signed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Links (a, b) between texts of different classes in a common bucket, enough of them to join all classes that any pair joins.

    Texts outside the largest class of a bucket are compared with all of other classes, those in it not with each
    other. Buckets of up to FEW texts go to cells of many buckets. In a larger one both kinds are dealt to blocks by their
    hashes, and each pair of blocks is a cell of its own. A cell first compares the last byte of each sample, which
    can only add to the agreement, and names the texts that have a likely partner; to these their vectors are
    sent, and the cell verifies pairs of classes that it has not joined yet. So no table holds pairs that are merely likely.
    """
    named = bands.join(label, bands.unit == label.node, "left").select("band", "unit", F.coalesce("label", "unit").alias("label"))
    named = materialize(named, "named")
    classes = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    most = classes.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).where("classes > 1")
    open_ = materialize(most.select("band", "n", F.col("most.label").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("mains")), "open")
    member = named.join(open_, "band")

    packs = max(8, (open_.where(F.col("n") <= FEW).agg(F.sum("n")).first()[0] or 0) // CELL)
    small = member.where(F.col("n") <= FEW).select(F.pmod(F.xxhash64("band"), F.lit(packs)).alias("cell"), "band", F.lit(2).alias("side"), "unit", "label")
    salt, column = F.xxhash64(F.lit(3), "unit", "band"), F.col("_x")
    large = member.where(F.col("n") > FEW).withColumn("_main", F.col("label") == F.col("main"))
    large = large.withColumn("_own", F.when(F.col("_main"), F.col("others") + F.pmod(salt, F.col("mains"))).otherwise(F.pmod(salt, F.col("others"))).cast("int"))
    facing = F.when(F.col("_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    side = F.when(column == F.col("_own"), 2).when(F.col("_own") < column, 0).otherwise(1)
    large = large.withColumn("_x", F.explode(facing)).select(F.xxhash64("band", F.least(column, "_own"), F.greatest(column, "_own")).alias("cell"), "band", side.alias("side"), "unit", "label")

    least, shape = _least_agreement(), "cell long, band long, side int, unit long, label long"
    arrow, rows, links_ = arrow_schema(f"{shape}, samples binary"), arrow_schema(shape), arrow_schema("a long, b long")

    def thin(batches):
        import pyarrow as pa

        for batch in batches:
            short = pa.array([x[::4] for x in batch.column(5).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], short], schema=arrow)

    def likely(table):
        import pyarrow as pa

        found = {int(i) for k, others in _likely_pairs(table, least) for i in (k, *others)}
        return table.take(pa.array(sorted(found), pa.int64())).select(rows.names)

    def verified(table):
        import pyarrow as pa

        unit, label, alone = (table.column(c).to_numpy() for c in ("unit", "label", "alone"))
        hashes, weights = _read(table, "hashes", "<u8"), _read(table, "weights", "<f4")
        into = {x: x for x in label.tolist()}

        def root(x):
            while into[x] != x:
                into[x] = into[into[x]]
                x = into[x]
            return x

        out = []
        for k, others in _likely_pairs(table, least):
            for i in others.tolist():
                x, y = root(int(label[k])), root(int(label[i]))
                if x != y and _similar(alone[k], hashes[k], weights[k], alone[i], hashes[i], weights[i]):
                    into[x] = y
                    out.append((min(unit[k], unit[i]), max(unit[k], unit[i])))
        return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}).cast(links_)

    cells = small.unionByName(large).join(signed.select("unit", "samples"), "unit").select(*rows.names, "samples").mapInArrow(thin, f"{shape}, samples binary")
    involved = materialize(cells.groupBy("cell").applyInArrow(likely, shape), "involved")
    whole = involved.join(signed.select("unit", "samples"), "unit").select(*rows.names, "samples").mapInArrow(thin, f"{shape}, samples binary").join(vectors, "unit")
    return whole.select(*rows.names, "samples", "alone", "hashes", "weights").groupBy("cell").applyInArrow(verified, "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id and class_id, one row per row of `df`; class_id is the least doc_id of the class."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    found = materialize(texts(docs.where("doc_id is not null"), max(2, size["n"]), size["chars"]), "texts")
    wordless = found.where(f"doc_id is not null and unit = {WORDLESS}").select("doc_id", F.col("doc_id").alias("class_id"))
    of_doc = found.where(f"doc_id is not null and unit != {WORDLESS}").select("doc_id", "unit")
    units = materialize(of_doc.groupBy("unit").agg(F.min("doc_id").alias("least")), "units")
    vector = found.where("hashes is not null").select("unit", "alone", "hashes", "weights")
    signed = materialize(signatures(vector), "signatures")
    bands = signed.select("unit", F.explode("bands").alias("band"))
    edges, label = None, None
    for k in range(rounds):
        if label is None:
            bucket = bands.withColumn("label", F.col("unit"))
            order = F.struct("unit")
        else:
            bucket = bands.join(label, bands.unit == label.node, "left").select("band", "unit", F.coalesce("label", "unit").alias("label"))
            order = F.struct(F.xxhash64(F.lit(k), "unit", "band"), "unit")
            bucket = bucket.groupBy("band", "label").agg(F.min_by("unit", order).alias("unit"))  # one text for each class
        head = bucket.groupBy("band").agg(F.min_by("unit", order).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
        pairs = bucket.join(head, "band").where("a != unit").select(F.least("a", "unit").alias("a"), F.greatest("a", "unit").alias("b")).distinct()
        new = materialize(links(pairs, signed, vector), "links")
        edges = new if edges is None else edges.unionByName(new)
        label = components(edges)
    new = materialize(apart(bands, label, signed, vector), "links")
    if new.limit(1).count():
        label = components(edges.unionByName(new))
    of_unit = units.join(label, units.unit == label.node, "left").select("unit", "least", F.coalesce("label", "unit").alias("label"))
    names = of_unit.groupBy("label").agg(F.min("least").alias("class_id"))
    by_unit = of_unit.join(names, "label").select("unit", "class_id")
    by_doc = of_doc.join(by_unit, "unit").select("doc_id", "class_id")
    nameless = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return by_doc.unionByName(wordless).unionByName(nameless)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
