import os
import random
import re

import numpy as np
import pytest

from tidewatch.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(codes):
    """Least id of each row's component, by comparing all pairs."""
    label = list(range(len(codes)))
    moved = True
    near = [[j for j, y in enumerate(codes) if (x ^ y).bit_count() <= 2] for x in codes]
    while moved:
        new = [min(label[j] for j in near[i]) for i in range(len(codes))]
        moved, label = new != label, new
    return label


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    codes = [plain_fingerprint(r.text) for r in docs]
    label = plain_components(codes)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, SF).collect()}
    assert found == {r.doc_id: (f"{c:016x}", docs[k].doc_id) for r, c, k in zip(docs, codes, label, strict=True)}


def test_spark_hashes_alike(spark):
    df = spark.createDataFrame([("ärger über zwei",)], "x string")
    assert int(df.selectExpr("hex(xxhash64(x)) h").first().h, 16) == simhash.fingerprint("ÄRGER Über zwei".replace("Ä", "ä").replace("Ü", "ü").encode())


def test_blocks_lose_no_shingle():
    text = " ".join(random.Random(1).choices("aa b ccc \t x\ny".split(), k=500)).encode()
    whole = text.lower().split()
    for size in (1, 3, 7, 50, 10_000):
        found = []
        for k, words in enumerate(simhash._blocks(text, size)):
            found += [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        assert found == [tuple(whole[i : i + 3]) for i in range(len(whole) - 2)]
    assert list(simhash._blocks(b"")) == [[]]
    assert [w for w in simhash._blocks(b" a  b ", 1) if w][-1] == [b"a", b"b"]


@pytest.mark.parametrize("text", ["", "  \n", "One", "one TWO", "one two three", "Ünï ç 文字 x", "a " * 5000])
def test_fingerprints_of_odd_texts(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_counts_never_exceed_differing_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    for step in simhash.CHOICES:
        lanes = lambda v: (v[:, None] >> (np.uint64(2) * np.arange(32, dtype=np.uint64))) & np.uint64(3)
        a, b = (lanes(simhash.bit_counts(v, step)).astype(int) for v in (x, y))
        assert a.max() <= 2 and (np.abs(a - b).sum(axis=1) <= np.bitwise_count(x ^ y)).all()
        assert (a.sum(axis=1) == np.bitwise_count(x)).all()


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_large_cells_are_dealt_anew(spark, most):
    """A family around one fingerprint fills its cells; every choice of segments and the look-up must keep all links."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(3)]
    codes = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(120)}
    codes |= {base[0] ^ (1 << k) for k in range(40)}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"), most).collect()
    root = {c: c for c in signed}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in edges:
        root[find(a)] = find(b)
    label = plain_components(codes)
    mine = [find(c) for c in signed]
    assert len(set(zip(label, mine, strict=True))) == len(set(label)) == len(set(mine)) > 1


def test_odd_rows(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 6), (2, None, 1), (3, "", 1), (None, "a b c d", 1), (None, "q r s t u v", 1), (7, "A B C D", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, code long")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert found == sorted([(1, 1), (1, 1), (2, 2), (3, 2), (None, 1), (None, None), (7, 1)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
