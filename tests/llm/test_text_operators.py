"""Operators on texts against plain versions on small tables: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

import hashlib
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, chat_format, fingerprints, html_extract, language_id, near_dedup, packing, quality_rules, sharding, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, ids string, bucket int"
HARD = ["", None, " ", "a", "\n\n \t", "Hello  world\n\n  x 's don't", "é É ﬁ ² Σς 中文 😀😀", "ab" * 3000, "the cat " * 4000, "x\x1cy\x85z\xa0w", "the cat sat", "the cat sat"]


def docs(spark, texts=None):
    """Texts as documents; two more columns have names that the operators use inside."""
    rows = [(i, t, "en", "s", "clash", 7) for i, t in enumerate(HARD if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe_equals_the_library_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs(spark), RANKS, P.PATTERN)
    for r in byte_bpe.decode(encoded, RANKS).collect():
        expected = library.encode_ordinary(HARD[r["doc_id"]] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == expected and r["n_tokens"] == len(expected)
        assert bytes(r["decoded"]).decode() == (HARD[r["doc_id"]] or "")
    assert byte_bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_merges_run_one_at_a_time_in_a_word():
    """A merge can make a pair of lower rank than its own, which must come before the word's next pair of that rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 300, b"ab": 301}
    assert np.frombuffer(byte_bpe.MergeReplay(ranks).encode([b"ababx"])[0], "<u4").tolist() == [300, ord("b"), ord("x")]


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    pieces = packing.token_pieces(docs(spark), WORDS, size=512, keep_ids=True)
    found = packing.pack(pieces, size=512, unit=8, short=32, bundle=64).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for i, text in enumerate(HARD):
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for r in parts for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()]
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 2] and parts[0]["doc_tokens"] == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack(packing.token_pieces(docs(spark, []), WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cutting_stock_meets_demand_near_its_bound(seed):
    rng = np.random.default_rng(seed)
    demand = {k: int(500 * np.exp(-k / 12) * rng.random()) for k in range(1, 65)}
    held, used = Counter(), 0
    for copies, times in packing.cutting_stock(demand, 64):
        assert sum(k * n for k, n in copies.items()) <= 64
        for k, n in copies.items():
            held[k] += n * times
        used += times
    assert held == Counter({k: n for k, n in demand.items() if n})
    assert used <= 1.02 * sum(k * n for k, n in demand.items()) / 64 + 3


def brute_quality(t):
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [*HARD, "a b c d e f g h a b c d e f g h i", "x\ny\nx\n\n\nx ", "one two three four five six seven eight nine\n" * 5, "# $%& é|<>"]
    for r in quality_rules.apply_rules(docs(spark, texts)).collect():
        n, chars, symbols, dup, repeat = brute_quality(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), texts[r["doc_id"]]
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(docs(spark, [])).count() == 0


def test_quality_thresholds_adapt(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(200)] + [" ".join(word() + "###" for _ in range(60))]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs(spark, texts)).collect()}
    assert sum(kept[i] for i in range(200)) >= 198 and not kept[200]


def test_fingerprints_add_up_and_ignore_order(spark):
    df = docs(spark, ["a b c\nd e f", "d e f\na b c", "a b c", "d e f", "", None, "   \n"])
    f = {r["doc_id"]: r["lanes"] for r in fingerprints.fingerprint(df, keys=["doc_id"]).collect()}
    assert f[0] == f[1] != f[2] and f[4] == f[5] == f[6]
    row = spark.createDataFrame([(f[0], f[2], f[3])], "a array<bigint>, b array<bigint>, c array<bigint>")
    got = row.select(fingerprints.add(F.col("b"), F.col("c")), fingerprints.subtract(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("a")), fingerprints.likeness(F.col("b"), F.col("c"))).first()
    assert got[0] == f[0] and got[1] == f[3] and got[2] == 1 and 0 <= got[3] < 0.5


def test_edited_texts(spark):
    rows = [(3, "abcdefgh"), (-5, "x"), (100000, "0123456789"), (7, None), (7, "éé😀zwölf"), (2**62, "last one"), (3, "abcdefgh")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, copy int")
    found = sorted((r["id"], r["text"], r["edited"]) for r in fingerprints.edit_with_next(df).collect())
    least = {}
    for i, t in rows:
        least[i] = min(least.get(i, t or ""), t or "")
    ids = sorted(least)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))

    def edit(i, t):
        q = len(t) // 4
        return t[: len(t) - q] + least[following[i]][:q]

    assert found == sorted((i, t or "", edit(i, t or "")) for i, t in rows)
    assert fingerprints.edit_with_next(df.where("false")).count() == 0


def test_rows_without_id_keep_their_fingerprints(spark):
    rows = [(None, "first text of its own"), (5, "five five five five"), (None, "first text of its own"), (None, None), (9, "nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    edited = sorted((r["id"] is None, r["text"], r["edited"]) for r in fingerprints.edit_with_next(df).collect())
    own = lambda t: t[: len(t) - len(t) // 4] + t[: len(t) // 4]
    assert edited == sorted([(True, t or "", own(t or "")) for i, t in rows if i is None] + [(False, "five five five five", "five five five " + "nine"), (False, "nine", "ninf")])
    got = fingerprints.fingerprint(fingerprints.edit_with_next(df), keys=["id", "copy"], texts={"own": "text"}).collect()
    assert len(got) == 5 and len({tuple(r["own"]) for r in got if r["id"] is None}) == 2


def test_next_ids_across_blocks(spark):
    ids = sorted({int(x) for x in np.random.default_rng(1).integers(-(2**50), 2**50, 300)} | set(range(4090, 4100)))
    found = {r["doc_id"]: r["next_id"] for r in fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    assert found == dict(zip(ids, [*ids[1:], ids[0]], strict=True))


CHAT = [(1, 0, "user", "hi"), (1, 1, "assistant", "### user:\n</turn>\n\\h \\"), (2, 1, "assistant", None), (2, 0, None, "x\\### Assistant: </turn> ok"), (3, 0, "a:\n#b", ""), (3, 0, "a:\n#b", "")]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*r, "clash") for r in CHAT], "conv_id long, turn long, role string, text string, at string")
    template = chat_format.FencedTemplate()
    for r in chat_format.digests(df).collect():
        turns = sorted(((t, ro or "", x or "") for c, t, ro, x in CHAT if c == r["conv_id"]))
        assert r["n_turns"] == len(turns) and r["rewrites"] == 0
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {}
    for r in chat_format.format_turns(df).orderBy("conv_id", "at").collect():
        assert len(whole.get(r["conv_id"], "")) == r["begins"]
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["added"]
    assert [t.text for t in template.read(whole[1])] == ["hi", "### user:\n</turn>\n\\h \\"]
    assert chat_format.digests(df.where("false")).count() == 0


def test_chat_spans_of_other_templates():
    turns = [chat_format.Turn("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(100)]
    plain = lambda ts: "<s>" + "".join(f"[{t.role}]{t.text}" for t in ts)
    spans = list(chat_format.locate(turns, chat_format.FencedTemplate()))
    assert [s.added for s in spans] == [chat_format.FencedTemplate()([t]) for t in turns] and not any(s.rewrote for s in spans)
    assert [s.added for s in chat_format.locate(turns[:5], plain)][1:] == [f"[{t.role}]{t.text}" for t in turns[1:5]]
    last_only = lambda ts: "".join(f"[{t.text if i == len(ts) - 1 else '...'}]" for i, t in enumerate(ts))
    assert [s.rewrote for s in chat_format.locate(turns[:4], last_only)] == [False, True, True, True]


def test_chat_renders_whole_prefixes_of_long_conversations():
    turns = [chat_format.Turn("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(100)]
    plain = lambda ts: "<s>" + "".join(f"[{t.role}]{t.text}" for t in ts)
    spans = list(chat_format.locate(turns, plain))
    assert "".join(s.added for s in spans) == plain(turns) and not any(s.rewrote for s in spans)
    late = lambda ts: "".join(f"[{'...' if i == 3 and len(ts) > 60 else t.text}]" for i, t in enumerate(ts))
    assert [i for i, s in enumerate(chat_format.locate(turns, late)) if s.rewrote] == [60]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; b</h1><p>one <b>two\n three<p>four<div class='ad'>buy</div></article><footer>f</footer>"
    rows = [(1, "http://h.example/1", page, "x"), (2, None, None, "x"), (3, "http://h.example/1", page, "x"), (4, "u", "", "x"), (5, "http://h.example/5", "a < b &lt; c", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert found == {1: "A & b\n\none two three\n\nfour", 2: "", 3: "A & b\n\none two three\n\nfour", 4: "", 5: "a < b < c"}
    assert html_extract.extract(df.where("false")).count() == 0


def test_site_style_tree_cuts_what_a_host_repeats(spark):
    page = lambda i, top: f"<body><div class=top>{top}</div><div class=text><p>Story {i} of its own</p><p>More {i * 7}</p></div></body>"
    rows = [(i, f"http://Site.example/{i}", page(i, "Welcome to our site")) for i in range(40)] + [(100, "http://other.example/", page(100, "Hello"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for names in (True, False):
        found = {r["page_id"]: (r["text"], r["cut_by_tree"], r["cut_by_name"]) for r in html_extract.extract(df, names=names).collect()}
        assert found[3] == ("Story 3 of its own\n\nMore 21", 19, 0)
    assert html_extract.extract(df.where("page_id = 100")).first()["text"].startswith("Hello")


def test_style_tree_cuts_inside_articles_and_keeps_copies_as_one(spark):
    page = lambda i: f"<article><p>Text {i} and {i * 3}</p><p class=s>Send this to a friend</p></article>"
    rows = [(i, "http://h.example/x", page(i % 200)) for i in range(400)]
    found = [r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert found == [f"Text {i % 200} and {i % 200 * 3}" for i in range(400)]


def test_names_of_layouts_drop_nothing():
    kept = ['<div class="wrap no-sidebar"><p>Real text</p></div>', '<div class="content has-banner"><p>Real text</p></div>', '<article class="single related-topic"><p>Real text</p></article>',
            '<form id="aspnet-form"><div><p>Real text</p></div></form>', '<main><p>Long enough words</p><div class="share-price">Real text</div></main>']
    for page in kept:
        assert "Real text" in html_extract.main_text(page)[0], page
    for name in ("share-buttons", "post-share", "related-posts", "sidebar-left", "comment-list", "ad", "top-banner", "social-icons-2"):
        text, _, by_name = html_extract.main_text(f'<div><p>The article itself</p><div class="{name}">Not this</div></div>')
        assert text == "The article itself" and by_name == 8, name
    nested = '<form class="page-form"><nav>Home About</nav><p>Long text of the page that counts</p><div class="comments">Nice one</div></form>'
    assert html_extract.main_text(nested)[0] == "Long text of the page that counts"


def test_a_page_thousands_of_levels_deep(spark):
    deep = "<div>" * 3000 + "<p>At the bottom</p>" + "</div>" * 3000
    df = spark.createDataFrame([(1, "http://a.example/", deep), (2, "http://a.example/", "<p>Flat</p>")], "page_id long, url string, html string")
    began = time.time()
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {1: "At the bottom", 2: "Flat"}
    assert time.time() - began < 60


def test_noise_of_many_hosts_goes_by_a_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/p", f"<div class=top>Same line</div><p>Own text {i} {'x' * (i % 7)}</p>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted(map(tuple, html_extract.extract(df, names=False).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_extract.extract(df, names=False).collect())) == few and all("Same" not in r[2] for r in few)


def test_style_tree_against_a_plain_one(spark):
    rng = np.random.default_rng(2)
    pages = []
    for i in range(60):
        items = "".join(f"<li>{rng.choice(['a', 'b', 'c'])}</li>" for _ in range(rng.integers(1, 4)))
        pages.append(f"<body><ul>{items}</ul><p>Own {i}</p><div class=n>Note | {i % 5}</div></body>")
    pages += pages[:10]
    df = spark.createDataFrame([(i, "http://h.example/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    found = {r["node"]: r for r in html_extract.style_tree(df, prior_pages=8).where("host = 'h.example'").collect()}

    styles, texts = {}, {}
    for x in dict.fromkeys(pages):
        of_page, of_text = {}, {}
        for node, text, *_ in html_extract.blocks(x, styles=of_page):
            of_text.setdefault(html_extract.child_of(node, "#"), Counter()).update(t for t in re.split(r"\s*\|\s*", text) if t)
        for node, children in of_page.items():
            styles.setdefault(node, []).append(tuple(children))
        for node, counts in of_text.items():
            texts.setdefault(node, []).append(counts)

    def entropy(counts):
        p = np.array(counts, float) / sum(counts)
        return float(-(p * np.log(p)).sum())

    def importance(node):
        if node in texts:
            m = len(texts[node])
            each = [entropy([c[t] for c in texts[node] if c[t]]) for t in set().union(*texts[node])]
            return (m * (1 - np.mean(each) / np.log(m)) + 8 * 0.9) / (m + 8)
        m, kinds = len(styles[node]), Counter(styles[node])
        own, power = entropy(list(kinds.values())) / np.log(m), 0.9 ** len(kinds)
        inside = sum(k / m * np.mean([importance(html_extract.child_of(node, c)) for c in style]) for style, k in kinds.items())
        return (1 - power) * own + power * inside

    assert set(found) == set(styles) | set(texts)
    for node in found:
        assert abs(found[node]["composite"] - importance(node)) < 1e-6, node


def test_shards_fit(spark):
    texts = [f"{i} " * (1 + i % 90) for i in range(400)] + [None, "", "big " * 4000] + ["same"] * 5
    df = docs(spark, texts)
    same = df.where("text = 'same'").withColumn("doc_id", F.lit(1000).cast("long"))
    df = df.where("text is null or text != 'same'").unionByName(same).unionByName(*[same])
    limit = 2000
    found = sharding.shards(df, limit=limit).collect()
    assert len(found) == 413
    size, members = Counter(), Counter()
    for r in found:
        size[r["shard"]] += r["bytes"]
        members[r["shard"]] += 1
    for r in found:
        assert r["shard_bytes"] == size[r["shard"]] and (size[r["shard"]] <= limit) != r["oversize"]
        assert not r["oversize"] or members[r["shard"]] == 1
    names = sorted({r["shard"].split("+")[0] for r in found})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a directory: no shard's bits begin another's
    assert sharding.shards(df.where("false")).count() == 0


def test_equal_rows_are_cut_by_running_total(spark):
    df = spark.createDataFrame([(1, "y" * 300)] * 20, "doc_id long, text string")
    found = sharding.shards(df, limit=1000).collect()
    assert len(found) == 20 and all(r["shard_bytes"] <= 1000 for r in found)


def test_language(spark):
    en, de = "the house and the garden of this town were old and quiet", "das haus und der garten dieser stadt waren alt und ruhig"
    train = docs(spark, [en, de] * 10).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = language_id.train(train)
    test = docs(spark, ["the garden", "der garten", "gardening houses", "ruhiger häuser", None, "", "123 !?", "中文"])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(test, model).collect()}
    assert [found[i][0] for i in range(8)][:7] == ["en", "de", "en", "de", "und", "und", "und"] and found[7][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {r["lang_pred"] for r in language_id.predict(test, language_id.train(train.where("false"))).collect()} == {"und"}
    assert language_id.predict(test.where("false"), model).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(400)]
    say = lambda bad: " ".join(np.insert(rng.choice(vocabulary, 40).astype(object), 20, bad + str(rng.choice(["s", "er", "ing"]))))
    texts = [say("zlotk") if i % 3 == 0 else say("fine") for i in range(300)]
    df = docs(spark, texts)
    labels = df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).where("doc_id < 250")
    model = toxicity.train(df, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    wrong = sum((found[i] >= 0.3) != (i % 3 == 0) for i in range(250, 300))
    assert wrong <= 3 and all(0 <= s <= 1 for s in found.values())
    odd = [r["score"] for r in toxicity.score(docs(spark), model).collect()]
    assert len(odd) == len(HARD) and odd[0] < 0.3 and odd[1] == odd[0]
    assert {r["score"] for r in toxicity.score(df.limit(3), toxicity.train(df, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(df.where("false"), model).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    texts = []
    for n in (12, 60, 200, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for k in (0, 1, max(1, n // 50), n // 8):
                copy = list(base)
                for at in rng.integers(0, n, k):
                    copy[at] = word()
                texts.append(" ".join(copy).upper() if k == 1 else " ".join(copy) + ".")
    texts += [None, "", "...", "one two", "one two", "One, two!", "a b c d e f " * 30]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}

    words = [near_dedup.word_hashes([t or ""])[0] for t in texts]
    sets = [dict(zip(*(x.tolist() for x in np.unique(near_dedup.shingles(w), return_counts=True)), strict=True)) if len(w) else {} for w in words]
    distinct = {w.tobytes(): s for w, s in zip(words, sets, strict=True) if len(w)}
    df = Counter(h for s in distinct.values() for h in s)
    weights = [{h: (1 + np.log(c)) * float(near_dedup.inverse_df(df[h], len(texts))) for h, c in s.items()} for s in sets]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if weights[i] and weights[j]:
                low = sum(min(v, weights[j].get(h, 0)) for h, v in weights[i].items())
                if low >= 0.8 * (sum(weights[i].values()) + sum(weights[j].values()) - low):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    assert found == {i: root(i) for i in range(len(texts))}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("few", "block"), [(1000, 2048), (4, 16)])
def test_texts_of_a_family_meet_in_every_bucket(spark, monkeypatch, few, block):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(150):
        words = [f"w{i}" for i in range(120)]
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            words[at] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join(words))
    df = docs(spark, texts)
    found = near_dedup.texts(df, len(texts), sum(map(len, texts))).persist()
    vectors = {r["unit"]: r for r in found.where("hashes is not null").collect()}
    bands = {r["unit"]: set(r["bands"]) for r in near_dedup.signatures(found.where("hashes is not null").select("unit", "alone", "hashes", "weights")).collect()}
    sets = {u: dict(zip(np.frombuffer(r["hashes"], "<u8").tolist(), np.frombuffer(r["weights"], "<f4").tolist(), strict=True)) for u, r in vectors.items()}
    total = {u: sum(x.values()) + vectors[u]["alone"] for u, x in sets.items()}
    unit = {r["doc_id"]: r["unit"] for r in found.where("doc_id is not null").collect()}
    label = {u: min(d for d, v in unit.items() if v == u) for u in unit.values()}
    for u in sets:
        for v in sets:
            if bands[u] & bands[v]:
                low = sum(min(w, sets[v].get(h, 0)) for h, w in sets[u].items())
                if low >= 0.8 * (total[u] + total[v] - low):
                    a, b = sorted((label[u], label[v]))
                    label = {k: a if x == b else x for k, x in label.items()}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {d: label[u] for d, u in unit.items()}


def test_weighted_samples_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.random(300).astype(np.float32) + 0.5
    v = np.where(rng.random(300) < 0.8, w, w / 3).astype(np.float32)
    expected = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    agree = (near_dedup.sample(h, w, 600) == near_dedup.sample(h, v, 600)).mean()
    assert abs(agree - expected) < 0.06
    both = near_dedup.sample(np.array([1, 2], np.uint64), np.array([3.0, 1.0], np.float32), 800)
    single = near_dedup.sample(np.array([1], np.uint64), np.array([3.0], np.float32), 800)
    assert abs((both == single).mean() - 0.75) < 0.06


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100 and len(found) == 43


def test_parts_and_batches_are_bounded():
    import pyarrow as pa

    from tidewatch.llm import words

    long = "x" * 70 + "," + "y" * 40
    assert words.parts(f"A {long} b") == ["a", "x" * 32, "x" * 32, "x" * 12, "y" * 32, "y" * 11, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["ab" * 600, "c", None, "d" * 3000, "", "e", "f"])], ["i", "t"])
    found = list(words.bounded([batch], 1, most=1500, rows=3))
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(7))
    assert all(b.num_rows <= 3 and (b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 1500) for b in found)


def test_all_grams_of_a_word_count():
    a, b = "q" * 20 + "abcdefghij", "q" * 20 + "abcdefghik"
    flat, starts = toxicity.features([a, b, "..."])
    assert set(flat[starts[0] : starts[1]]) != set(flat[starts[1] : starts[2]]) and starts[1] == 1 + len(a) - 1
    assert flat[starts[2] :].tolist() == [toxicity.BUCKETS]


def test_long_texts_go_through_the_filters_in_stretches():
    network = toxicity.Network()
    rng = np.random.default_rng(0)
    embedded = np.vstack([np.zeros((1, toxicity.DIM)), rng.normal(size=(50, toxicity.DIM))]).astype(np.float32)
    docs = [rng.integers(1, 51, n).astype(np.int32) for n in (0, 1, 7, 300, 40)]
    assert np.allclose(network.logits(docs, embedded, budget=10), network.logits(docs, embedded), atol=1e-5)


def test_samples_at_any_size():
    from tidewatch.llm.words import share_of

    assert share_of(10, 5) == 1 << 60 and abs(share_of(3000, 10**13) / 2**60 * 10**13 - 3000) < 1


def test_language_needs_letters(spark):
    model = language_id.train(docs(spark, ["the house and the garden", "a town"] * 5))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs(spark, ["\u00bd \u00b2", "\u2167 \u2460", "12", "a\u00bd", "x" * 500]), model).collect()}
    assert found == {0: "und", 1: "und", 2: "und", 3: "en", 4: "en"}


def test_rows_go_two_steps_beyond_the_direct_limit(spark, monkeypatch):
    texts = [" ".join(f"w{i}_{k % 3}" for i in range(40)) for k in range(6)] + ["", None]
    df = docs(spark, texts).unionByName(docs(spark, ["alone"]).withColumn("doc_id", F.lit(None).cast("long")))
    expected = sorted(map(str, near_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(near_dedup, "DIRECT", 4)
    assert sorted(map(str, near_dedup.near_duplicates(df).collect())) == expected and len(expected) == 9
    assert all(a * b >= n and a * b < n + 2 * a for n in (5, 10_000, 8_000_000) for a, b in [near_dedup.levels(n)])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="tables are not here")
def test_queries_hold_their_contracts(spark):
    import tiktoken

    from tidewatch.llm import registry

    found = {name: query(spark, SF).toPandas() for name, query in registry.queries().items()}
    table = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    text = table["text"].map(lambda t: t or "")
    for name, rows in found.items():
        if name not in ("op6_html_extract", "op8_chat_format", "op9_packing", "op12_spelling", "op13_whitening"):  # rows of other things
            assert sorted(rows["doc_id"]) == sorted(table.index), name
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for r in found["op1_byte_bpe"].itertuples():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    classes = found["op2_near_dedup"].set_index("doc_id")["class_id"]
    assert all(classes[c] == c and c <= d for d, c in classes.items())
    assert found["op3_sharding"].groupby("shard")["bytes"].sum().max() <= 16 << 20
    for name, mod, rest in (("op4_toxicity", 4, 2), ("op5_language_id", 3, 1)):
        rows = found[name]
        assert rows["score"].between(0, 1).all() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows.itertuples())
    assert ((found["op4_toxicity"]["score"] >= 0.3) == (found["op4_toxicity"]["predicted"] == 1)).all()
    for r in found["op5_language_id"].itertuples():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id]))
    assert (found["op6_html_extract"]["text"].str.len() == found["op6_html_extract"]["n_chars"]).all()
    order = sorted(table.index)
    following = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in found["op7_fingerprints"].itertuples():
        own, other = text[r.doc_id], text[following[r.doc_id]]
        quarter = len(own) // 4
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[: len(own) - quarter] + other[:quarter]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1 or own != other)
    assert -7 in set(found["op8_chat_format"]["conv_id"])
    pieces = found["op9_packing"]
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096
    for r in found["op10_quality_rules"].itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text[r.doc_id])


def test_fingerprints_stay_alike_when_a_word_is_put_in_front(spark):
    """One paragraph of distinct words, a word more at its start, middle and end; runs of words are cut by their words alone."""
    words = [f"w{i * 7919 % 1000}" for i in range(300)]
    rows = {1: words, 2: ["new", *words], 3: [*words[:150], "new", *words[150:]], 4: [*words, "new"], 5: [f"v{i}" for i in range(300)]}
    df = spark.createDataFrame([(k, " \t".join(v)) for k, v in rows.items()] + [(6, "a"), (7, "\n \n"), (8, None), (9, "x  " * 50)], "doc_id long, text string")
    f = fingerprints.fingerprint(df, keys=["doc_id"])
    lanes = {r["doc_id"]: r["lanes"] for r in f.collect()}
    ends = {w for w, h in spark.createDataFrame([(w,) for v in rows.values() for w in v], "w string").distinct().selectExpr("w", "pmod(xxhash64(w), 6) h").collect() if h == 0}
    assert lanes[1][-1] == sum(w in ends for w in words[:-1]) + 1
    assert lanes[6][-1] == 1 and lanes[7] == lanes[8] and lanes[9][-1] in (1, 50)
    first = f.where("doc_id = 1").select(F.col("lanes").alias("first"))
    near = {r["doc_id"]: r["near"] for r in f.join(first).select("doc_id", fingerprints.likeness(F.col("first"), F.col("lanes")).alias("near")).collect()}
    assert near[1] == 1.0 and min(near[2], near[3], near[4]) > 0.9 and near[5] < 0.5


def test_workers_give_memory_back_and_get_texts_once(spark):
    code = """
import os
import re
import subprocess
import sys
import pyarrow as pa
from tidewatch.llm.words import bounded

def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def given(rows):
    yield pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(["x" * 2000] * rows)], names=["id", "text"]).take(pa.array(range(rows)))

assert sum(b.num_rows for b in bounded(given(1))) == 1
before, rows = mb(), 0
for _ in range(4):
    rows += sum(b.num_rows for b in bounded(given(10_000)))
assert rows == 40_000
print(mb() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ":".join(sys.path)})
    assert float(done.stdout) < 45
    df = spark.createDataFrame([(1, "the quiet garden", "en"), (2, None, None)], "doc_id long, text string, lang string")
    model = language_id.LanguageModel(["en"], [1], {})
    named = language_id.predict(df, model, keep=("text", "doc_id"), names=("_a", "_b"))
    scored = toxicity.score(df, toxicity.Model(None, None, 0.3), keep=("text", "doc_id"))
    for found in (named, scored):
        assert "_text" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(found.select("doc_id", "text").collect()) == sorted(df.select("doc_id", "text").collect())
    assert {r["doc_id"]: r["_a"] for r in named.collect()} == {1: "en", 2: "und"}
