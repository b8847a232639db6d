"""Operator 11: near-duplicate documents by SimHash and an embedding of segment bit counts.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; its shingles are SHINGLE consecutive words joined by
spaces, repeats included (fewer words: all of them; none: fingerprint zero). Bit k of its fingerprint is 1 if bit k is
set in over half of the shingles' 64-bit hashes (XXH64, seed 42). Fingerprints link at DISTANCE or fewer differing bits.

1. Equal fingerprints are one from here on, so that copies cost nothing.
2. A fingerprint is cut into 32 segments of two bits and maps to the vector of their bit counts (0, 1 or 2, packed
   into a long again). A bit that differs changes one count by one, so the Manhattan distance of two
   vectors never exceeds the number of differing bits: vectors of a link lie at most two steps apart.
3. Grid range-join: two lattice points at most two steps apart have a point at most one step from either, so a
   fingerprint goes to its own cell and to those one step away, 49 on average, and every link meets in a cell.
4. A task reads the cells one after another, compares their fingerprints exactly, and gives out each one's
   link to the least of those it is connected with in the cell. Fingerprints of one vector are compared in their own cell only, so a
   family of near copies is not compared again in all cells around. A cell of more than MOST fingerprints is not
   compared: its fingerprints are dealt anew by the vector of another choice of segments, within the cell. What is still
   in cells too large after the last choice is looked up instead, each fingerprint with every one or two of its bits turned, in
   time linear in the cell.
5. The links' connected components are named by the least doc_id.

Null text counts as empty. Rows without id have a fingerprint and link like others, but give no component its name: a component
of such rows only has the name null. Rows with one id are judged each; an empty table gives an empty result. Columns
other than the id and the text do not matter. A long text is read in blocks, so only its bytes are held whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import components
from .runs import sorted_runs
from .storage import materialize
from .words import arrow_schema, bounded, columns_of, mix

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: fingerprints of a cell that are compared with each other; looking them up is faster beyond
MOST = 50_000
#: the bits that lie side by side in a choice of segments are these steps apart (modulo 64)
CHOICES = (1, 5, 11)
_EVEN = np.uint64(0x5555555555555555)
_SPACE = b" \t\n\r\x0b\x0c"


def _blocks(text: bytes, size: int = 1 << 20):
    """Words of a text in lists; each list but the first begins with the last words of the one before, so that no shingle is lost."""
    carried, at = [], 0
    while at < len(text) or not at:
        to = min(at + size, len(text))
        while to < len(text) and text[to] not in _SPACE:
            to += 1
        words = carried + text[at:to].lower().split()
        at = max(to, 1)
        if at >= len(text) or len(words) >= SHINGLE:
            yield words
            words = words[1 - SHINGLE :]
        carried = words


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    import xxhash

    digest, total, counts = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    for words in _blocks(text):
        if not words or (total and len(words) < SHINGLE):
            continue
        joined = b" ".join(words)
        if len(words) < SHINGLE:
            hashes = [digest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and code (the fingerprint as a signed long), one row per row of `df`."""
    schema = "doc_id long, code long"
    arrow = arrow_schema(schema)

    def task(batches):
        import pyarrow as pa

        for batch in bounded(batches):
            texts = batch.column(1).cast(pa.large_binary() if str(batch.column(1).type).startswith("large") else pa.binary())
            codes = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts), np.uint64, len(texts))
            yield columns_of(arrow, {"doc_id": batch.column(0), "code": codes.view(np.int64)})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, schema)


def bit_counts(codes: np.ndarray, step: int = 1) -> np.ndarray:
    """Counts of the 32 segments of two bits, packed into 64 bits; the bits of a segment lie `step` apart."""
    if step != 1:
        bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        codes = np.ascontiguousarray(np.packbits(bits[:, np.arange(64) * step % 64], axis=1, bitorder="little")).view("<u8").ravel()
    return codes - ((codes >> np.uint64(1)) & _EVEN)


def _cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each point and the lattice points at most one step from it."""
    lane = np.uint64(1) << (np.uint64(2) * np.arange(32, dtype=np.uint64))
    low, high = (points[:, None] & lane) != 0, (points[:, None] & (lane << np.uint64(1))) != 0
    place, k = np.nonzero(~high)  # a count below 2
    up = points[place] + lane[k]
    place_, k_ = np.nonzero(low | high)
    down = points[place_] - lane[k_]
    return np.concatenate((np.arange(len(points)), place, place_)), np.concatenate((points, up, down))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place connected with each of n places by the edges (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(codes: np.ndarray, points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least place connected with each of distinct `codes` that meet in a cell. `own`: this is the cell of the code's own
    point. Two codes of one point elsewhere are not compared here."""
    order = np.lexsort((points, ~own))
    codes, points, own = codes[order], points[order], own[order]
    starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (~own[1:] & (points[1:] != points[:-1]))])
    label = np.arange(len(codes))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
        first = i if own[i] else j
        rest = codes[first:]
        step = max(1, (1 << 20) // max(1, len(rest)))
        for k in range(i, j if len(rest) else i, step):
            x, y = np.nonzero(np.bitwise_count(codes[k : min(k + step, j), None] ^ rest[None, :]) <= DISTANCE)
            x, y = x + k, y + first
            apart = label[x] != label[y]
            if apart.any():
                label = _roots(len(codes), np.concatenate((x[apart], np.arange(len(codes)))), np.concatenate((y[apart], label)))
    out = np.empty_like(label)
    out[order] = order[label]
    return out


def _looked_up(codes: np.ndarray) -> np.ndarray:
    """The least place connected with each of sorted distinct codes, by looking up each one with one or two of its bits turned."""
    label = np.arange(len(codes))
    masks = [sum(1 << k for k in bits) for n in range(1, DISTANCE + 1) for bits in combinations(range(64), n)]
    a, b, held = [], [], 0
    for k, mask in enumerate(masks):
        turned = codes ^ np.uint64(mask)
        place = np.minimum(np.searchsorted(codes, turned), len(codes) - 1)
        found = np.flatnonzero((codes[place] == turned) & (place > np.arange(len(codes))))
        a.append(found)
        b.append(place[found])
        held += len(found)
        if held > 1 << 22 or k == len(masks) - 1:  # fold what was found so far
            a, b = [np.concatenate([*a, label]), np.zeros(0, np.int64)], [np.concatenate([*b, np.arange(len(codes))]), np.zeros(0, np.int64)]
            label = _roots(len(codes), a[0], b[0])
            a, b, held = [], [], 0
    return label


def _met(rows: DataFrame, step: int, last: bool, most: int) -> DataFrame:
    """cell, a, b: links of fingerprints that meet in a cell, as (member, least connected with it); of cells too large, cell and member, b null.

    `rows` are cell, code: fingerprints and the cell of the choice before, null at first.
    """
    schema = "cell long, a long, b long"
    dealt_ = "cell long, code long, own boolean"
    dealt, found = arrow_schema(dealt_), arrow_schema(schema)

    def deal(batches):
        for batch in batches:
            codes = np.asarray(batch.column(1)).view(np.uint64)
            for i in range(0, len(codes), 2000):
                part = codes[i : i + 2000]
                place, cells = _cells(bit_counts(part, step))
                if batch.column(0).null_count == 0:
                    within = np.asarray(batch.column(0)).view(np.uint64)[i : i + 2000]
                    cells = mix(cells ^ mix(within)[place])
                yield columns_of(dealt, {"cell": cells.view(np.int64), "code": part[place].view(np.int64), "own": np.arange(len(place)) < len(part)})

    def task(batches):
        for table, starts in sorted_runs(batches, None if last else most):
            cells, codes = table.column(0).to_numpy(), table.column(1).to_numpy()
            if starts is None:
                yield columns_of(found, {"cell": cells, "a": codes, "b": [None] * len(codes)})
                continue
            ends = np.append(starts[1:], len(codes))
            own, points = np.asarray(table.column(2).combine_chunks().to_numpy(zero_copy_only=False), bool), bit_counts(codes.view(np.uint64), step)
            met = np.add.reduceat(own, starts, dtype=np.int64) > 0
            met |= np.maximum.reduceat(points, starts) != np.minimum.reduceat(points, starts)  # else all meet in their own cell
            linked = []
            for k in np.flatnonzero(met & (ends - starts > 1)).tolist():
                i, j = int(starts[k]), int(ends[k])
                if j - i > most and not last:
                    yield columns_of(found, {"cell": cells[i:j], "a": codes[i:j], "b": [None] * (j - i)})
                    continue
                members, at = np.unique(codes[i:j].view(np.uint64), return_index=True)
                root = _compared(members, points[i:j][at], own[i:j][at]) if j - i <= most else _looked_up(members)
                those = np.flatnonzero(root != np.arange(len(root)))
                linked.append((members[those].view(np.int64), members[root[those]].view(np.int64)))
            if linked:
                a, b = (np.concatenate(x) for x in zip(*linked, strict=True))
                yield columns_of(found, {"cell": [None] * len(a), "a": a, "b": b})

    return rows.select("cell", "code").mapInArrow(deal, dealt_).repartition("cell").sortWithinPartitions("cell").mapInArrow(task, schema)


def links(codes: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: pairs of fingerprints of one component, enough of them to join all fingerprints (`code`) that any link joins."""
    rows, edges = codes.select(F.lit(None).cast("long").alias("cell"), "code"), None
    for k, step in enumerate(CHOICES):
        found = materialize(_met(rows, step, k == len(CHOICES) - 1, most), "links")
        new = found.where("b is not null").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        rows = found.where("b is null").select("cell", F.col("a").alias("code"))
        if not rows.limit(1).count():
            break
    return edges.distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row per row of `df`."""
    found = materialize(fingerprints(df, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = materialize(found.groupBy("code").agg(F.min("doc_id").alias("least")), "nodes")
    label = components(links(nodes.select("code")))
    named = nodes.join(label, nodes.code == label.node, "left").select("code", "least", F.coalesce("label", "code").alias("label"))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_code = named.join(component, "label").select("code", "component_id")
    return found.join(by_code, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component of documents linked with it."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
