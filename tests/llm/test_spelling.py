import os
import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import spelling

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_near(words):
    """Near words by taking every code point out of every word and putting a mark in its place."""
    words = set(words)
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= by[w[:i], w[i + 1 :]]
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    return {w: v - {w} for w, v in near.items()}


def plain_variants(n):
    near = plain_near(n)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_query_against_plain_counting(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = spelling.op12_spelling(spark, SF)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = list(map(tuple, found.collect()))
    assert len(found) == len(set(found)) and set(found) == plain_variants(plain_words(rows))
    assert any(r[1] for r in found)


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_crowded_chunks_are_cut_further(spark, most):
    rng = random.Random(4)
    words = {"".join(rng.choices("ab", k=rng.randint(7, 10))) for _ in range(500)} | {"internation" + "".join(rng.choices("xyzé", k=rng.randint(0, 3))) for _ in range(60)}
    found = spelling.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), most_pairs=most).collect()
    near = plain_near(words)
    assert len({tuple(r) for r in found}) == len(found)
    assert {frozenset(r) for r in found} == {frozenset((a, b)) for a in near for b in near[a]}


def test_a_chunk_of_more_rows_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_ROWS", 50)
    rng = random.Random(9)
    words = {"prefixprefix" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(400)} | {"prefixprefixaaaaa" + c for c in "abcdefghij"}
    found = spelling.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(3), most_pairs=100).collect()
    near = plain_near(words)
    assert {frozenset(r) for r in found} == {frozenset((a, b)) for a in near for b in near[a]}


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abcd") and spelling.one_edit("bcd", "abcd") and spelling.one_edit("aab", "aaab")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "abdd")


def test_forms_lead_to_the_last(spark):
    words = [("station", 1000), ("stations", 100), ("stationss", 10), ("stationsss", 2), ("statioms", 10), ("elephant", 5), ("statian", 1000), ("stattion", 100)]
    found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert found == {w: (f, r, k, m) for w, f, r, _, k, m in plain_variants(dict(words))}
    assert found["stationss"][:2] == ("stations", "station") and found["elephant"] == (None, "elephant", 0, None)
    assert found["stations"][0] == "station"


def test_odd_rows(spark):
    rows = [(1, "Größere Änderung", 1), (1, "Größere Änderung", 2), (None, "station station", 1), (2, None, 1), (3, "", 1), (4, "x" * 100_000 + " " + "x" * 100_000, 3), (5, "kilom×tre kilom×tre short", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    found = {r.word: r.n for r in spelling.counts(df).collect()}
    assert found == plain_words([r[:2] for r in rows]) and len(found) >= 3
    assert spelling.variants(spelling.counts(df)).count() == len(found)
    assert spelling.variants(spelling.counts(df.limit(0))).collect() == []


def test_counts_given_out_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abc", k=7)) for _ in range(30))) for i in range(300)]
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    assert {r.word: r.n for r in spelling.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == plain_words(rows)
