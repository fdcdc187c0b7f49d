"""Main text of web pages with site template removal.

A page is parsed into a tree, in one pass over its characters. Every element's subtree
is hashed (names, class and id, texts), and Spark counts for each host on how many
pages a hash occurs; a hash on many pages of its host is the site's template and its
subtrees are deleted. What is counted is distinct main contents, so an article that a
host shows at many addresses doesn't make itself a template. A template is on
MIN_PAGES pages and MIN_SHARE of its host's, or, on small hosts, on FEW_PAGES and
FEW_SHARE.

What templates can't see is what varies from page to page. There HTML itself says
which elements are no content (head, script, nav, aside, footer, form ...), and a few
class, id and role words mark parts that hold another text on every page: adverts
that are drawn anew, readers' comments, related articles, what is hidden. In an
explicit main element (article, main) paragraphs, headings, lists and tables are the
article's own however often they recur on the site (a quoted passage or an edited copy
recurs as well): there only containers are deleted as templates.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import by_host, checkpointed, internal, table

#: A subtree is a template with at least so many distinct pages, and such a share of its host's.
MIN_PAGES, MIN_SHARE = 10, 0.02
#: On a small host with so many, and such a share.
FEW_PAGES, FEW_SHARE = 3, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROP = frozenset("head script style noscript template textarea title iframe nav aside form footer button select input option svg canvas object audio video dialog menu math map label datalist xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre search section summary table tbody thead tfoot caption tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption b i u s em strong a span code kbd q cite sub sup small mark abbr time br hr img wbr del ins font tt var samp dfn bdi bdo big strike".split())
#: Words of class, id or role of parts that hold another text on every page, so that
#: no count finds them: adverts, readers' comments, related articles, trails, notices.
DROP_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments respond replies disqus related recommended recommendations breadcrumb breadcrumbs pager pagination cookie consent notice newsletter sidebar contentinfo complementary navigation search alert".split())
#: Of a main element only these do, and the words of a page's head only outside one.
ASIDE_WORDS = frozenset("comment comments related recommended sponsored ad advert promo".split())
HEAD_WORDS = frozenset("header masthead topbar banner".split())
MAIN_WORDS = frozenset("article articlebody post story".split())
#: Start tags before which an open paragraph ends.
_ENDS_P = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption"}
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: What bounds an open paragraph and an inline element's end tag.
_WALLS = BLOCK | {"td", "th", "button"}
#: A tag with its attributes. No part gives back what it took, and the tail takes what
#: a quote without an end leaves, so that every character is read a few times at most.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[\"'][^>]*+(?:>|\Z)|\Z)", re.DOTALL)
_HUGE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "attributes", "kids", "hash")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.kids, self.hash = tag, attributes, [], 0

    def words(self) -> set[str]:
        a = self.attributes
        if not a:
            return set()
        return {w.lower() for name in ("class", "id", "role", "itemprop") if a.get(name) for w in _WORDS.findall(a[name])}


def decoded(text: str) -> str:
    """The text without character references; those to no character become U+FFFD."""

    def bounded(found: re.Match) -> str:
        digits = found.group()[2:].rstrip(";")
        base = 16 if digits[0] in "xX" else 10
        digits = digits.lstrip("xX0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{int(digits, base)};"

    if "&" not in text:
        return text
    return unescape(_HUGE.sub(bounded, text) if "&#" in text else text)


@functools.lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE)


class Stack:
    """The open elements, with their places by name and those of walls."""

    def __init__(self, root: Node):
        self.open = [root]
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in _WALLS:
            self.walls.append(len(self.open))
        self.open.append(node)

    def last(self, names: tuple[str, ...] | list[str]) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((own[-1] for name in names if (own := self.places.get(name))), default=0)

    def wall(self) -> int:
        return self.walls[-1] if self.walls else 0

    def close(self, at: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.open) > at:
            node = self.open.pop()
            self.places[node.tag].pop()
            if self.walls and self.walls[-1] == len(self.open):
                self.walls.pop()


def attributes_of(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {name.lower(): decoded(a or b or c) for name, a, b, c in reversed(_ATTRIBUTE.findall(text))}


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all elements, parents before children, in time linear in the page.

    Unclosed comments and tags end with the page; of an attribute whose quote has no
    end, the tag ends at the next ">"; "<" before anything but a name is text.
    """
    root = Node("#root", {})
    nodes, stack = [root], Stack(root)
    at, end, text_from = 0, len(page), 0

    def text_to(place: int) -> None:
        if place > text_from:
            stack.open[-1].kids.append(decoded(page[text_from:place]))

    while (at := page.find("<", at)) >= 0:
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            text_to(at)
            if page.startswith("<!--", at):
                close, size = page.find("-->", at + 4), 3
            elif page.startswith("<![CDATA[", at):
                close, size = page.find("]]>", at + 9), 3
                stack.open[-1].kids.append(page[at + 9 : close if close >= 0 else end])
            else:
                close, size = page.find(">", at), 1
            at = text_from = close + size if close >= 0 else end
            continue
        token = _TAG.match(page, at)
        if token is None:
            at += 1
            continue
        text_to(at)
        at = text_from = token.end()
        closing, name, text = token.group(1), token.group(2).lower(), token.group(3)
        if closing:
            if name == "br":
                stack.open[-1].kids.append(Node("br", {}))
                nodes.append(stack.open[-1].kids[-1])
            else:
                place = stack.last((name,))
                # An end tag of an inline element doesn't end the block around it.
                if place and (name in BLOCK or place >= stack.wall()):
                    stack.close(place)
            continue
        if name in _ENDS_P and (wall := stack.wall()) and stack.open[wall].tag == "p":
            stack.close(wall)
        if name in _CLOSES:
            closed, within = _CLOSES[name]
            floor = stack.last(within)
            while (place := stack.last(closed.split())) > floor:
                stack.close(place)
        node = Node(name, attributes_of(text))
        stack.open[-1].kids.append(node)
        nodes.append(node)
        if name in RAW:
            close = _raw_end(name).search(page, at)
            body = page[at : close.start() if close else end]
            node.kids.append(decoded(body) if name in ("title", "textarea") else body)
            at = text_from = close.end() if close else end
        elif name not in VOID and (name in BLOCK or not text.endswith("/")):
            stack.push(node)  # "<div/>" opens a div: only void elements close themselves
    text_to(end)
    return root, nodes


def hashed(nodes: list[Node]) -> None:
    """Hash every element's subtree: children come after their parents."""
    for node in reversed(nodes):
        marks = node.attributes
        parts = [node.tag, marks.get("class", ""), marks.get("id", "")] if marks else [node.tag]
        for kid in node.kids:
            if type(kid) is str:
                if text := " ".join(kid.split()):
                    parts.append(text)
            else:
                parts.append(f"\0{kid.hash}")
        node.hash = xxhash.xxh64_intdigest("\1".join(parts)) - (1 << 63)


def dropped(node: Node, within: bool) -> bool:
    """Is the element, by its name, class, id or role, none of the article?"""
    if node.tag in DROP or (node.tag == "header" and not within):
        return True
    a = node.attributes
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body", "#root"):
        return False
    found = node.words()
    if node.tag in ("article", "main"):
        return bool(found & ASIDE_WORDS)
    return bool(found & DROP_WORDS) or (not within and bool(found & HEAD_WORDS))


def contents(root: Node) -> tuple[list[Node], bool]:
    """The main elements in page order, and whether the page names them as such."""
    kinds = (
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or n.attributes.get("role") == "main" or n.attributes.get("itemprop", "").lower() == "articlebody",
        lambda n: n.tag in ("div", "section", "td") and bool(n.words() & MAIN_WORDS),
    )
    for kind in kinds:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if kind(node) and not dropped(node, False):
                found.append(node)
            elif not dropped(node, False):
                stack += [k for k in reversed(node.kids) if type(k) is not str]
        if found:
            return found, True
    return [root], False


def text_of_page(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the main text, one a line."""
    root, nodes = parse(page)
    hashed(nodes)
    mains, named = contents(root)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                blocks.append(text)
            run.clear()

    for main in mains:
        close()
        stack: list = [main]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif type(item) is str:
                run.append(item)
            elif item is main or not (dropped(item, named) or (item.hash in templates and not (named and item.tag in PROSE))):
                if item.tag in ("br", "td", "th", "wbr"):
                    run.append("" if item.tag == "wbr" else " ")
                if item.tag in BLOCK:
                    close()
                    stack.append(None)
                stack += reversed(item.kids)
    close()
    return "\n".join(blocks)


def subtrees(page: str) -> tuple[int, list[int]]:
    """A hash of the page's main content, and the distinct hashes that may be templates."""
    root, nodes = parse(page)
    hashed(nodes)
    mains, named = contents(root)
    identity = xxhash.xxh64_intdigest(repr([m.hash for m in mains])) - (1 << 63)
    inside: set[int] = set()  # ids of prose elements within a named main element
    if named:
        for main in mains:
            stack = [main]
            while stack:
                node = stack.pop()
                if node is main or node.tag in PROSE:
                    inside.add(id(node))
                stack += [k for k in node.kids if type(k) is not str]
    return identity, sorted({n.hash for n in nodes if id(n) not in inside and n.tag not in ("#root", "html", "body", "br", "hr", "wbr")})


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; "-" for none."""
    host = F.regexp_extract(F.lower(url.cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host.isNull() | (host == ""), F.lit("-")).otherwise(host)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, few_pages: int = FEW_PAGES, few_share: float = FEW_SHARE) -> tuple[DataFrame, DataFrame]:
    """(host, h) of the template subtrees, and (host, n) of the hosts' distinct contents.

    A host has no more of them than the mean number of elements of its pages divided
    by the share, whatever its number of pages.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [subtrees(page) for page in frame["html"]]
            yield pd.DataFrame({"host": frame["host"], "content": [i for i, _ in found], "hashes": [h for _, h in found]})

    rows = pages.select(host_of(pages["url"]).alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    found = rows.mapInPandas(run, "host string, content long, hashes array<long>")
    # The page itself goes along as a hash that no element has: it counts the pages.
    each = found.select("host", "content", F.explode(F.array_append("hashes", F.lit(None).cast("long"))).alias("h")).distinct()
    counted = each.groupBy("host", "h").agg(F.count("*").alias("n"))
    counted = checkpointed(counted.where(F.col("h").isNull() | (F.col("n") >= min(min_pages, few_pages))))
    totals = counted.where("h IS NULL").select("host", F.col("n").alias("pages"))
    many = (F.col("n") >= min_pages) & (F.col("n") >= F.col("pages") * F.lit(min_share))
    few = (F.col("n") >= few_pages) & (F.col("n") >= F.col("pages") * F.lit(few_share))
    templates = counted.where("h IS NOT NULL").join(totals, "host").where(many | few).select("host", "h")
    return templates, totals.withColumnRenamed("pages", "n")


def with_text(pages: DataFrame, out: str = "text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The pages with their main text as a further column, in place of one of that name.

    A null or empty page has an empty text. Pages without a host are one site. A page
    without an article or main element is taken as a whole, without its templates.
    A very long or malformed page takes time in proportion to its length. Repeated
    rows are equal pages, which count once. An empty table stays empty. Columns other
    than url and html stay as they are.
    """
    found, hosts = site_templates(pages, min_pages, min_share)
    found = checkpointed(found)
    host, known = internal(pages, "__host"), internal(pages, "__templates")
    sites = found.groupBy(F.col("host").alias(host)).agg(F.sort_array(F.collect_list("h")).alias(known))
    located = pages.withColumn(host, host_of(pages["url"]))
    located = by_host(located, sites, hosts.withColumnRenamed("host", host), host, 8 * found.count())

    @F.pandas_udf("string")
    def extracted(html: pd.Series, hashes: pd.Series) -> pd.Series:
        last, own = None, frozenset()
        result = []
        for page, hashes_ in zip(html, hashes, strict=True):
            key = None if hashes_ is None else np.asarray(hashes_, dtype=np.int64).tobytes()
            if key != last:
                last, own = key, frozenset() if hashes_ is None else frozenset(np.frombuffer(key, np.int64).tolist())
            result.append(text_of_page(page, own))
        return pd.Series(result, dtype=object)

    text = extracted(F.coalesce(F.col("html").cast("string"), F.lit("")), F.col(known))
    return located.withColumn(out, text).drop(host, known)


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_page_text": op8_page_text}
ORACLES: dict[str, str] = {}
