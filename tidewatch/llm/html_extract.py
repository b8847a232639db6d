"""Operator 6: main text of web pages with a site style tree.

The pages of a host are merged into a style tree, all their branches, those inside articles too; the pages of all hosts
are merged into one more. An element node is a path of element names with their classes; a style node is one of the
sequences of children that it has on different pages; its own text is a leaf under it. `style_tree` computes

* presentation importance of an element: the entropy of its style nodes over its pages, relative to that of as many
  styles as pages,
* content importance of a leaf: one less the mean entropy, over its pages, of its different texts (a text that every page
  shows says nothing about any of them, one found on a single page says most); texts are cut at the marks that menus and
  footers put between their parts,
* composite importance, bottom up: an element's own importance and the mean of its children's, weighted by how often its
  styles occur; the more styles it has, the more its own counts (weight 1 - 0.9^styles).

Importances count for m pages and a prior for `prior_pages` (1 inside an article by element or role, 0.9 elsewhere), so
that a few pages decide nothing. A branch is noise if it and all branches in it have a composite importance below
`least_importance` in the host's tree or in that of all hosts. `extract` cuts these branches from every page and reads
the blocks that are left. Entropy cannot tell an advert or a reader's comment that is new on each page from an article, so
of these blocks it drops those inside elements that by name, role or class are no part of an article (unless one holds most of the
page's text; names of whole layouts, as "no-sidebar", say nothing), and where
a page has an article or main element it takes the text from there. `cut_by_tree` and `cut_by_name` tell how many
characters went either way; `names=False` leaves the tree alone to decide.

A task sums the statistics of its pages by host, node and text before they are shuffled, so that a host with a third
of all pages sends no more rows than it has different texts. Pages that are exact copies count as one. The noise of a
host, with its nodes that are noise in the tree of all hosts, comes to its pages by a broadcast behind a size check; beyond it by a join that deals a host's pages to 32 salts.

Null and empty pages give an empty text, a null url the host ''. Repeated rows give repeated results; an
empty table an empty one. Markup that breaks off is closed at the end; a tag that is none is text. Batches are
bounded by bytes.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .words import arrow_schema, bounded, columns_of, texts_of

# fixed values: element names of HTML
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE_GAP = frozenset("br td th option img input".split())
REMOVED = frozenset("nav footer aside form button select input dialog menu head svg canvas object audio video map datalist search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
#: parts of class names that say menu, advert or comment, wherever they stand
NO_PART = re.compile(r"ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer\w*|cookie\w*|consent|gdpr|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w+|signup|login|comment\w*|disqus\w*|pagination|pager|toolbar", re.I)
#: parts that say so alone, or with nothing but a part of a page after them ("share-buttons", but not "share-price")
NO_PART_ALONE = re.compile(r"promo\w*|widget\w*|notice\w*|alert\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|respond|reply|replies|skip", re.I)
PART_OF_PAGE = re.compile(r"\d+|area|articles?|bar|block|bottom|box|btns?|buttons?|container|content|form|group|icons?|inner|items?|left|links?|list|main|module|outer|panel|posts?|right|row|section|stories|text|title|to|tools?|top|widget|wrap|wrapper", re.I)
#: of elements outside the article only
NO_PART_OUTSIDE = re.compile(r"header|masthead|topbar|side|copyright|legal", re.I)
#: first parts that speak of a whole layout
LAYOUT = frozenset("no has have with without is hide hidden show not".split())


@lru_cache(maxsize=50_000)
def says_no_part(style: str, outside: bool) -> bool:
    """Whether the classes and id of an element name it as no part of an article."""
    for token in style.split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        if not parts or parts[0].lower() in LAYOUT and len(parts) > 1:
            continue
        for k, part in enumerate(parts):
            if NO_PART.fullmatch(part) or outside and NO_PART_OUTSIDE.fullmatch(part):
                return True
            if NO_PART_ALONE.fullmatch(part) and all(PART_OF_PAGE.fullmatch(x) for x in parts[k + 1 :]):
                return True
    return False


NO_PART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


#: between the parts of menus and footers
SEPARATOR = re.compile(r"\s*[|\u00b7\u2022\u00bb\u203a\u00a9]+\s*")
#: host of the tree of all hosts, leaf of a node's own text, node above all elements
ALL, TEXT, ROOT = "*", "#", 0
#: branches of hosts' noise that may be broadcast, salts beyond that
BROADCAST_ROWS, SALTS = 500_000, 32
GAMMA = 0.9


@lru_cache(maxsize=200_000)
def child_of(node: int, name: str) -> int:
    """The node under `node` by the element name and classes `name`: a hash of the path, so that a deep page has no long paths."""
    return _hash(f"{node}/{name}") or 1


def blocks(page: str, cut: frozenset[int] = frozenset(), styles: dict[int, list[str]] | None = None) -> Iterator[tuple[int, str, bool, tuple[int, ...], bool]]:
    """(node, text, in a branch that is cut, numbers of the elements around it that are no part of an article, inside article or main)
    of each block. `styles` receives the children of each node."""
    stack: list[tuple[str, int, bool, tuple[int, ...], bool]] = []  # element, node, cut, no part, main
    away, gone, main, article_seen, named_so = False, (), False, False, 0
    parts: list[str] = []
    node, at, end = ROOT, 0, len(page)

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text and styles is not None:
            styles.setdefault(node, []).append(TEXT)
        return (node, text, away or child_of(node, TEXT) in cut, gone, main) if text else None

    def close(k: int) -> None:
        nonlocal away, gone, main, node
        del stack[k:]
        _, node, away, gone, main = stack[-1] if stack else ("", ROOT, False, (), False)

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # end tag
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCKS and (found := flush()):
                        yield found
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break
            continue
        if name in RAW:
            ends = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = ends.end() if ends else end
            continue
        if name in VOID:
            if name == "hr" and (found := flush()):
                yield found
            elif name in INLINE_GAP:
                parts.append(" ")
            continue
        block = name in BLOCKS
        if block and (found := flush()):
            yield found
        if block or name in CLOSES:  # a block ends an open paragraph, a list item the one before, and so on
            ended = CLOSES.get(name, frozenset()) | ({"p"} if block else frozenset())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    close(k)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] != "p":
                    break
        attributes = _attributes(m[3] or m[6] or "")
        style = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        role = attributes.get("role", "").lower()
        content = name in ("article", "main") or role == "main" or attributes.get("itemprop") == "articleBody"
        if content and gone and not article_seen and not says_no_part(style, False):
            close(0)  # an unclosed advert or menu does not swallow the article
        if block:
            named = name + (f".{'.'.join(attributes['class'].split())}" if attributes.get("class", "").strip() else "")
            if styles is not None:
                styles.setdefault(node, []).append(named)
            node = child_of(node, named)
            away = away or node in cut
        article_seen |= content
        bare = not main and name == "header"
        if name in REMOVED or bare or role in NO_PART_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or (style != " " and name not in ("body", "html") and says_no_part(style, not main and not content)):
            named_so += 1
            gone = (*gone, named_so)
        main = main or content
        if block or gone or stack or name == "html":
            stack.append((name, node, away, gone, main))
        if not block and name in INLINE_GAP:
            parts.append(" ")
    if found := flush():
        yield found


def main_text(page: str, cut: frozenset[int] = frozenset(), names: bool = True) -> tuple[str, int, int]:
    """Main text of a page, and how many characters of other blocks the tree cut and names then dropped.

    An element whose name says that it is no part of an article, but which holds more than half of the page's text that the tree leaves, is one.
    """
    found = list(blocks(page, cut))
    by_tree, by_name, kept = sum(len(text) for _, text, away, _, _ in found if away), 0, []
    sizes: Counter = Counter()
    for _, text, away, gone, _ in found:
        if not away:
            sizes.update(dict.fromkeys((None, *gone), len(text)))
    for _, text, away, gone, main in found:
        if away:
            continue
        if names and any(2 * sizes[k] <= sizes[None] for k in gone):
            by_name += len(text)
        else:
            kept.append((main, text))
    if names and any(main for main, _ in kept):
        by_name += sum(len(text) for main, text in kept if not main)
        kept = [x for x in kept if x[0]]
    return "\n\n".join(text for _, text in kept), by_tree, by_name


def host_of(url):
    """Host of a URL column in lower case, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


@lru_cache(maxsize=100_000)
def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _page_statistics(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Sums by host, node, kind (0: the node itself, 1: a style, 2: a text, 3: a child) and feature over the pages of a task."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    copies = materialize(rows.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    few = copies.count() <= BROADCAST_ROWS  # beyond that, Spark sorts and merges
    rows = rows.join(F.broadcast(copies) if few else copies, ["host", "page"], "left").select("host", F.coalesce("copies", F.lit(1)).alias("copies"), "html")
    schema = "host string, node long, main int, kind int, feature long, n double, log double, child long, share double"
    arrow = arrow_schema(schema)

    def task(batches):
        held: dict[tuple, list[float]] = {}

        def add(key: tuple, n: float, log: float = 0.0, share: float = 0.0) -> None:
            found = held.get(key)
            if found is None:
                held[key] = [n, log, share]
            else:
                found[0] += n
                found[1] += log
                found[2] += share

        def out():
            columns = {c: [k[i] for k in held] for i, c in enumerate(("host", "node", "main", "kind", "feature", "child"))}
            columns |= {c: [v[i] for v in held.values()] for i, c in enumerate(("n", "log", "share"))}
            batch = columns_of(arrow, columns)
            held.clear()
            return batch

        for batch in bounded(batches, 2):
            for host, copies, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weight, styles, inside = 1.0 / copies, {}, {}
                texts: dict[str, Counter] = {}
                for node, text, _, _, main in blocks(page, styles=styles):
                    inside[node] = max(inside.get(node, 0), int(main))
                    texts.setdefault(node, Counter()).update(x for x in SEPARATOR.split(text) if x)
                for node, children in styles.items():
                    add((host, node, 0, 0, 0, 0), weight)
                    add((host, node, 0, 1, _hash(" ".join(children)), 0), weight)
                    for child, k in Counter(children).items():
                        add((host, node, 0, 3, 0, child_of(node, child)), 0.0, 0.0, weight * k / len(children))
                for node, found in texts.items():
                    leaf = child_of(node, TEXT)
                    add((host, leaf, inside[node], 0, 0, 0), weight)
                    for text, k in found.items():
                        add((host, leaf, inside[node], 2, _hash(text), 0), weight * k, weight * k * math.log(k))
            if len(held) > 200_000:
                yield out()
        if held:
            yield out()

    keys = ["host", "node", "kind", "feature", "child"]
    sums = [F.max("main").alias("main"), *(F.sum(c).alias(c) for c in ("n", "log", "share"))]
    own = materialize(rows.mapInArrow(task, schema).groupBy(*keys).agg(*sums), "statistics")
    every = own.withColumn("host", F.lit(ALL)).groupBy(*keys).agg(*sums)
    return own.unionByName(every)


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", prior_pages: int = 32) -> DataFrame:
    """host, node, parent, leaf, pages, own (presentation or content) importance, composite and best (highest composite in
    the branch) of every node of every host's tree, and of the tree of all hosts (host '*').

    Composites are sums over the branch of own importances times the weights on the way down, so they are computed by doubling: in round
    k, a node takes what those 2^k levels below it have gathered, and then looks twice as far up. A tree as deep as 3000 takes 12 rounds.
    """
    seen = materialize(_page_statistics(pages, url_col, html_col), "node-statistics")
    pages_of = seen.where("kind = 0").select("host", "node", "main", F.col("n").alias("pages"))
    # a feature's entropy over pages is log n - (sum of c log c) / n for counts c; a style's share of the pages is n / pages
    text = seen.where("kind = 2").groupBy("host", "node").agg(F.avg(F.log("n") - F.col("log") / F.col("n")).alias("text"))
    style = seen.where("kind = 1").groupBy("host", "node").agg(F.sum(F.col("n") * F.log("n")).alias("style"), F.count(F.lit(1)).alias("styles"))
    m = F.log(F.greatest("pages", F.lit(2.0)))
    entropy = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("text").isNotNull(), F.col("text") / m).otherwise((F.log("pages") - F.col("style") / F.col("pages")) / m)))
    own = F.when(F.col("pages") <= 1, F.lit(1.0)).when(F.col("text").isNotNull(), 1 - entropy).otherwise(entropy)
    nodes = pages_of.join(text, ["host", "node"], "left").join(style, ["host", "node"], "left").withColumn("own", own)
    prior = F.when(F.col("main") == 1, F.lit(1.0)).otherwise(F.lit(0.9))
    nodes = nodes.withColumn("leaf", F.col("styles").isNull()).withColumn("own", F.when(F.col("leaf"), (F.col("pages") * F.col("own") + prior_pages * prior) / (F.col("pages") + prior_pages)).otherwise(F.col("own")))
    nodes = nodes.select("host", "node", "leaf", "pages", "own", F.pow(F.lit(GAMMA), F.coalesce(F.col("styles"), F.lit(0)).cast("double")).alias("_power"))
    shares = seen.where("kind = 3").select("host", F.col("node").alias("parent"), F.col("child").alias("node"), "share")
    shares = shares.join(nodes.select("host", "node"), ["host", "node"])
    total = shares.groupBy("host", "parent").agg(F.sum("share").alias("_total"))
    held = nodes.join(total.withColumnRenamed("parent", "node"), ["host", "node"], "left")
    inner = F.col("_total").isNotNull() & ~F.col("leaf")
    nodes = held.select("host", "node", "leaf", "pages", "own", F.when(inner, (1 - F.col("_power")) * F.col("own")).otherwise(F.col("own")).alias("sum"), F.when(inner, F.col("_power") / F.col("_total")).alias("_per"))
    nodes = materialize(nodes, "nodes")
    up = shares.join(nodes.select("host", F.col("node").alias("parent"), "_per"), ["host", "parent"]).select("host", "node", F.col("parent").alias("above"), (F.col("share") * F.col("_per")).alias("w"))
    steps = [materialize(up, "above")]  # of each node, the one 2^k levels above it and the weight on the way
    tops = steps[0].select("host", "node", F.col("above").alias("parent"))
    value = nodes.select("host", "node", "sum")
    while True:
        up = steps[-1]
        gained = value.join(up, ["host", "node"]).groupBy("host", F.col("above").alias("node")).agg(F.sum(F.col("w") * F.col("sum")).alias("_more"))
        value = materialize(value.join(gained, ["host", "node"], "left").select("host", "node", (F.col("sum") + F.coalesce("_more", F.lit(0.0))).alias("sum")), "composites")
        further = up.select("host", F.col("node").alias("above"), F.col("above").alias("_to"), F.col("w").alias("_w"))
        further = materialize(up.join(further, ["host", "above"]).select("host", "node", F.col("_to").alias("above"), (F.col("w") * F.col("_w")).alias("w")), "above")
        if not further.limit(1).count():
            break
        steps.append(further)
    best = value.withColumn("best", F.col("sum"))
    for up in steps:
        most = best.join(up, ["host", "node"]).groupBy("host", F.col("above").alias("node")).agg(F.max("best").alias("_most"))
        best = materialize(best.join(most, ["host", "node"], "left").select("host", "node", "sum", F.greatest("best", "_most").alias("best")), "best")
    return nodes.select("host", "node", "leaf", "pages", "own").join(best, ["host", "node"]).join(tops, ["host", "node"], "left").select("host", "node", "parent", "leaf", "pages", "own", F.col("sum").alias("composite"), "best")


def noise(tree: DataFrame, least_importance: float) -> DataFrame:
    """host, node of the branches that are noise and lie in no other such branch, by the host's tree or, of the host's nodes, by that of all hosts."""
    low = tree.where((F.col("best") < least_importance) & (F.col("node") != ROOT)).select("host", "node", "parent")
    above = tree.where(F.col("best") >= least_importance).select("host", F.col("node").alias("parent"))
    low = materialize(low.join(above, ["host", "parent"], "left_semi").select("host", "node"), "low")
    everywhere = tree.where(F.col("host") != ALL).select("host", "node").join(low.where(F.col("host") == ALL).select("node"), "node", "left_semi")
    return low.where(F.col("host") != ALL).unionByName(everywhere.select("host", "node")).distinct()


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = 0.8, prior_pages: int = 32, names: bool = True) -> DataFrame:
    """id, url, text string, cut_by_tree and cut_by_name long of each page."""
    low = noise(style_tree(pages, url_col=url_col, html_col=html_col, prior_pages=prior_pages), least_importance)
    low = materialize(low.groupBy("host").agg(F.collect_set("node").alias("_cut")), "noise")  # branches of one tree, not pages
    kept = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    low = low.withColumnRenamed("host", "_host")
    if (low.agg(F.sum(F.size("_cut"))).first()[0] or 0) <= BROADCAST_ROWS:
        joined = kept.join(F.broadcast(low), "_host", "left")
    else:
        salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = kept.withColumn("_salt", F.pmod(F.xxhash64("_html", id_col), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    joined = joined.select(id_col, url_col, "_html", "_cut")
    schema = ", ".join(f"`{n}` {t}" for n, t in joined.select(id_col, url_col).dtypes) + ", text string, cut_by_tree long, cut_by_name long"
    arrow = arrow_schema(schema)

    def task(batches):
        for batch in bounded(batches, 2):
            found = [main_text(page, frozenset(cut or ()), names) for page, cut in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            texts, by_tree, by_name = zip(*found, strict=True)
            yield columns_of(arrow, dict(zip(arrow.names, [batch.column(0), batch.column(1), texts, by_tree, by_name], strict=True)))

    return joined.mapInArrow(task, schema)


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page of `pages`."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "cut_by_tree", "cut_by_name")
