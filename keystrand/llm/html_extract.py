"""Main text of web pages by a site style tree.

Pages of a host are merged: a style-tree node is a path of block elements with
their classes and ids; its presentations are the sequences of its child elements, its contents
the text blocks that lie directly in it.  Over the m pages that have a node, the
entropy of what it presents and holds, to the base m, is its importance: what repeats from page to page
(menus, adverts, notices) scores low, article text, which doesn't, scores high.  The composite importance of a branch
is ``DECAY`` times the mean importance of all contents in it, weighted by their blocks, and for
the rest the importance of its top's presentations.  A branch is cut from every page if its
composite importance and those of all branches inside it are under ``LEAST_IMPORTANCE``.

Every host has a tree, and all hosts together have one; a branch is cut if either finds it unimportant.
As few pages say little, a host's composite importance is shrunk
towards that of the same path on all hosts, which counts as ``PRIOR_PAGES`` pages.  Text in an article
or main element is judged by all hosts alone, and by a lower bound: a host may well carry one
article many times.  Pages of one host with equal html are one page of its tree.

What an element declares itself to be goes before the tree (``by_name``): menus, headers,
footers, forms, adverts, notices and comments by their tag, role, class or id, and whatever lies outside the article or main
element where a page has one.  The README gives figures of the tree without names.  A page of which the
tree would leave nothing is left as the names leave it.

The trees are counts, aggregated by Spark before they are shuffled, so a host with
a third of all pages is no special case.  Only the nodes to cut go back
to the pages: broadcast when their measured size is under ``BROADCAST_BYTES``, otherwise in a
join by host of two tables, whose hot hosts Spark splits.

Edge cases: null or empty html gives an empty text; null urls share the host "";
broken markup, unclosed elements and cut-off pages are read as far as they go, and elements
deeper than ``DEPTH`` belong to the branch of the one at that depth;
repeated pages each give their text; other columns come back as they were, whatever
their names (but ``text``, which is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import bounded_batches, discard, map_batches, materialize, table

#: Branches of lower composite importance are cut; in an article or main element, of lower than a quarter of it.
LEAST_IMPORTANCE = 0.75
#: Share of the contents of a branch in its composite importance.
DECAY = 0.9
#: How many pages of a host the tree of all hosts counts for.
PRIOR_PAGES = 8
#: Levels of the tree.
DEPTH = 32
BROADCAST_BYTES = 16 << 20

#: Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe math noembed noframes noscript script style svg template textarea title".split())
NOISE_TAGS = frozenset("aside button dialog footer form head menu nav select".split())
#: What an open element of this name is ended by, and what such an end doesn't reach beyond.
ENDED_BY = {
    "p": (BLOCKS - {"body", "head", "html"}, frozenset({"td", "th", "li", "div", "article", "section", "blockquote"})),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th", "tr"}), frozenset({"table"})),
    "th": (frozenset({"td", "th", "tr"}), frozenset({"table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_NOISE_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|foot(?:er)?|sidebar|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|pagination|pager|toolbar|widget|skip)(?:$|[-_ 0-9])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)(?:>|$)|</?[A-Za-z][^<>]*+(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Roles of elements that are no main text.
_NOISE_ROLES = frozenset("navigation banner contentinfo search complementary form dialog alert".split())
_DIGITS = re.compile(r"[0-9]+")


@functools.lru_cache(1 << 16)
def node_id(parent: int, key: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def text_id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Open(NamedTuple):
    """An open element: its branch of the tree (node ids from the top), and what it lies in."""

    tag: str
    branch: tuple[int, ...]
    main: bool
    noise: bool
    #: An inline element of noise or a hidden one: its text is no part of the block around it.
    dropped: bool
    #: Keys of the child elements seen so far, repeats in a row once.
    children: list[str]


class Page:
    """Text blocks of a page in order: (branch, lies in article or main, noise by name, text); and the presentations of its nodes."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[int, ...], bool, bool, str]] = []
        self.shown: set[tuple[tuple[int, ...], bool, tuple[str, ...]]] = set()
        self.stack = [Open("", (), False, False, False, [])]
        self.parts: list[str] = []
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                self.add(source[at:])
                break
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.add(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            if m[1]:
                self.close(tag)
            else:
                self.open(tag, m[3])
                if tag in RAW and not m[3].endswith("/"):
                    stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                    at = stop.end() if stop else end
        self.leave(1)

    def add(self, text: str) -> None:
        if not self.stack[-1].dropped:
            self.parts.append(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                top = self.stack[-1]
                self.blocks.append((top.branch, top.main, top.noise, text))
            self.parts.clear()

    def leave(self, k: int) -> None:
        """Close the elements from the k-th on."""
        if any(x.tag in BLOCKS for x in self.stack[k:]) or k == 1:
            self.flush()
        for x in self.stack[k:]:
            if x.tag in BLOCKS and x.branch and x.children:
                self.shown.add((x.branch, x.main, tuple(x.children)))
        del self.stack[k:]

    def open(self, tag: str, attributes: str) -> None:
        if tag in RAW:
            return
        if tag == "br":
            self.add("\n")
        names: list[str] = []
        roles: list[str] = []
        hidden = False
        if attributes and _TELLING.search(attributes):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id") and value.strip():
                    names.append(value.strip())
                elif name == "role":
                    roles += value.lower().split()
                hidden = hidden or (name == "style" and bool(_HIDDEN.search(value))) or (name == "hidden" and value.lower() != "until-found")
        named = tag in NOISE_TAGS or any(r in _NOISE_ROLES for r in roles)
        if tag not in ("html", "body", "article", "main"):
            named = named or any(_NOISE_NAME.search(n) for n in names)
        elif tag == "article":
            named = named or any("comment" in n.lower() for n in names)
        if tag not in BLOCKS:
            if tag not in VOID:
                top = self.stack[-1]
                self.stack.append(top._replace(tag=tag, dropped=top.dropped or hidden or named))
            return
        self.flush()
        for name, (enders, limits) in ENDED_BY.items():
            if tag in enders:
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag == name:
                        self.leave(k)
                        break
                    if self.stack[k].tag in limits:
                        break
        if tag in VOID:
            return
        top = self.stack[-1]
        key = tag + ("." + _DIGITS.sub("0", " ".join(names)) if names else "")
        if not top.children or top.children[-1] != key:
            top.children.append(key)
        main = top.main or tag in ("article", "main") or "main" in roles or "article" in roles
        noise = top.noise or top.dropped or named or (tag == "header" and not main)
        branch = top.branch if len(top.branch) >= DEPTH else (*top.branch, node_id(top.branch[-1] if top.branch else 0, key))
        self.stack.append(Open(tag, branch, main, noise, hidden, []))

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.leave(k)
                return
            # an inline end tag doesn't end the block around it
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                return
        if tag in BLOCKS:
            self.flush()


def main_text(source: str | None, low: set[int], by_name: bool = True) -> str:
    """The page's text without noise and without the branches cut, which are the nodes ``low``."""
    if not source:
        return ""
    blocks = Page(source).blocks
    if by_name:
        has_main = any(main and not noise for _, main, noise, _ in blocks)
        blocks = [b for b in blocks if not b[2] and (b[1] or not has_main)]
    kept = [text for branch, _, _, text in blocks if low.isdisjoint(branch)]
    return "\n".join(kept or [text for *_, text in blocks])


HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


NODE, PRESENTATION, CONTENT = 0, 1, 2


def style_tree(pages: DataFrame) -> DataFrame:
    """From pages (host, html) the trees of all hosts: host, node, branch, in_main, kind, value, n.

    A row of kind NODE counts the pages that have the node, one of PRESENTATION or
    CONTENT those that show one sequence of children there, or hold one text.
    """

    def contents(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                seen = set()
                if source:
                    page = Page(source)
                    for branch, main, _, text in page.blocks:
                        if branch:
                            seen |= {(branch[:k], main and k == len(branch), NODE, 0) for k in range(1, len(branch))}
                            seen |= {(branch, main, NODE, 0), (branch, main, CONTENT, text_id(text))}
                    for branch, main, children in page.shown:
                        seen |= {(branch, main, NODE, 0), (branch, main, PRESENTATION, text_id(" ".join(children)))}
                name = text_id(source or "")
                for branch, main, kind, value in seen:
                    for column, cell in zip(out, (host, branch[-1], branch if kind == NODE else None, main, kind, value, name), strict=True):
                        column.append(cell)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "node", "branch", "in_main", "kind", "value", "page"])

    bounded_batches(pages.sparkSession)
    rows = pages.mapInArrow(contents, "host string, node bigint, branch array<bigint>, in_main boolean, kind int, value bigint, page bigint")
    # equal pages of a host once
    by = ["host", "node", "branch", "in_main", "kind", "value"]
    return rows.groupBy(*by, "page").agg(F.lit(1)).groupBy(*by).agg(F.count("*").alias("n"))


def composite_importance(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Per node (keys): pages (m), importance of its branch, and the greatest importance of a branch inside it or its own (most)."""
    n = F.col("n").cast("double")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    sums = tree.groupBy(*keys, "node").agg(
        F.max("in_main").alias("in_main"), F.first("branch", ignorenulls=True).alias("branch"), F.sum(F.when(F.col("kind") == NODE, F.col("n"))).alias("m"),
        of(PRESENTATION, n).alias("shown"), of(PRESENTATION, n * F.log(n)).alias("shown_logs"), of(CONTENT, n).alias("blocks"), of(CONTENT, n * F.log(n)).alias("logs"),
    )
    # entropy of a random one of N things with counts n: -sum (n/N) log (n/N) = log N - sum n log n / N
    entropy = lambda total, logs: F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log(total) - F.col(logs) / F.col(total)) / F.log(F.col("m").cast("double")))).otherwise(1.0)
    own = sums.select(*keys, "node", "branch", "in_main", "m", F.when(F.col("shown") > 0, entropy("shown", "shown_logs")).alias("presented"), F.coalesce("blocks", F.lit(0.0)).alias("blocks"), entropy("blocks", "logs").alias("held"))
    above = lambda df: df.withColumn("top", F.explode("branch"))
    inside = above(own.filter("blocks > 0")).groupBy(*keys, F.col("top").alias("node")).agg((F.sum(F.col("held") * F.col("blocks")) / F.sum("blocks")).alias("inside"))
    importance = F.when(F.col("presented").isNull(), F.col("inside")).otherwise(DECAY * F.coalesce("inside", F.lit(1.0)) + (1 - DECAY) * F.col("presented"))
    found = own.join(inside, [*keys, "node"], "left").select(*keys, "node", "branch", "in_main", "m", F.coalesce(importance, F.lit(1.0)).alias("importance"))
    most = above(found).groupBy(*keys, F.col("top").alias("node")).agg(F.max("importance").alias("most"))
    return found.join(most, [*keys, "node"]).drop("branch")


def low_branches(tree: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """Per host: the nodes (low) whose branches are cut."""
    pooled = tree.groupBy("node", "branch", "in_main", "kind", "value").agg(F.sum("n").alias("n"))
    everywhere = composite_importance(pooled, []).select("node", F.col("most").alias("all"), "in_main")
    own = composite_importance(tree, ["host"]).select("host", "node", "m", "most")
    shrunk = (F.col("m") * F.col("most") + PRIOR_PAGES * F.col("all")) / (F.col("m") + PRIOR_PAGES)
    score = F.when(F.col("in_main"), 4 * F.col("all")).otherwise(F.least("all", shrunk))
    return own.join(everywhere, "node").filter(score < least).groupBy("host").agg(F.collect_set("node").alias("low"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", by_name: bool = True) -> DataFrame:
    """All columns of ``pages`` plus text (a column of that name is replaced)."""
    given = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "text"]).alias("row")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), HOST, 1)), F.lit("")).alias("host")
    rows = pages.select(given, host, F.col(f"`{html_col}`").cast("string").alias("html"))
    tree = materialize(style_tree(rows.select("host", "html")), "style-tree")
    low = materialize(low_branches(tree), "low-branches")
    discard(tree)
    held = low.agg(F.sum(F.length("host") + 8 * F.size("low"))).first()[0] or 0
    joined = rows.join(F.broadcast(low) if held <= BROADCAST_BYTES else low, "host", "left")

    def make():
        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            return {"text": [main_text(s, set(cut or ()), by_name) for s, cut in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]}

        return fn

    return map_batches(joined, [T.StructField("text", T.StringType())], make, drop=("host", "low", "html")).select("row.*", "text")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
