"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: its nodes are paths of elements (tag, class and id words), and
at each node the styles (sequences of child elements) and contents (text blocks) that pages have there are
counted. A node's presentation matters as far as its styles vary over pages, its content as far as its
blocks stand in few pages: both are entropies to the base of the number of pages. Branches of low importance
are removed from each page of the host. Pages that are copies of one another count once.

Entropies need several pages. What tags and class names say by themselves (menus, forms, adverts, reader
comments and so on) is removed from any page. An article or main element goes before the text around it
unless the tree finds more outside, and is kept if its whole is of low importance, so that an article which
many pages repeat is still one; branches of low importance go from within other ones.

The tree is a table keyed by host and path. Pages meet their host's list of branches in one join, which
Spark broadcasts if the table is small and splits by AQE if a host is large.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from pulsegrid.llm.common import text_batches, with_columns_from_batches, written

#: Distinct pages that a node needs, the importance below which it goes, and the weight of its content.
MIN_PAGES, LOW, CONTENT = 12, 0.4, 0.9

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Class names that tell a state of an element or what it has elsewhere, not what it is.
_STATE = re.compile(r"(?<![\w-])(?:has|with|without|no|is)[-_][\w-]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "xmp", "noembed", "noframes")}
#: Elements that are never main text.
NOISE_TAGS = frozenset("head nav footer aside form menu dialog button select textarea datalist fieldset object canvas audio video map".split())
#: Elements whose noise depends on where they stand: not inside an article.
OUTER_NOISE_TAGS = frozenset(["header"])
MAIN_TAGS = frozenset(["article", "main"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words in class names and ids.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar aside footer ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments"
    " respond reply replies disqus discussion related recommended share sharing social breadcrumb breadcrumbs pagination pager widget widgets toolbar"
    " copyright disclaimer masthead skip search searchbox".split()
)
OUTER_NOISE_WORDS = frozenset("header banner top bottom".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Elements that keep a closing of theirs from reaching further out.
WALLS = frozenset("ul ol dl table tbody thead tfoot tr td th article main section div body blockquote".split())


class Node:
    """An open element: its path as a code, whether it or one around it is noise, and whether it stands in a main element."""

    __slots__ = ("children", "main", "noise", "path", "tag")

    def __init__(self, tag: str, path: int, noise: bool, main: bool):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


def blocks(page: str) -> Iterator[tuple[list[Node], str | None]]:
    """``(open elements, text)`` of each block of text in page order; text None as an element closes."""
    stack = [Node("", 0, False, False)]
    text: list[str] = []
    at, n = 0, len(page)

    def flush():
        whole = " ".join(html_lib.unescape("".join(text)).split()) if text else ""
        text.clear()
        return whole

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:-3])
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if tag in ("br", "hr", "wbr"):
            text.append(" " if tag == "br" else "")
            if tag == "hr" and (whole := flush()):
                yield stack, whole
            continue
        if not closing and tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            end = RAW[tag].search(page, at)
            # what is never closed takes the rest of the page with it only where it can hold no elements
            at = end.end() if end else n if tag in ("script", "style", "textarea", "title", "xmp") else at
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            # class names of inline elements count for noise, so these open a node as well if they have any
            if not closing and attributes and _noise_words(attributes, True):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        if whole := flush():
            yield stack, whole
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        yield stack, None
                        stack.pop()
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        shut = CLOSES.get(tag, set()) | {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in shut:
                while len(stack) > k:
                    yield stack, None
                    stack.pop()
                break
            if stack[k].tag in WALLS and not (tag in ("td", "th") and stack[k].tag in ("td", "th")):
                break
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag != "html":
                yield stack, None
                stack.pop()
        up = stack[-1]
        names = _names(attributes)
        inside = up.main or tag in MAIN_TAGS
        words = set(_words(names))
        noise = (
            tag in NOISE_TAGS
            or (tag in OUTER_NOISE_TAGS and not up.main)
            or (tag not in MAIN_TAGS and tag != "body" and bool(words & NOISE_WORDS) and not words & MAIN_WORDS - {"post", "entry", "story", "article"})
            or (not up.main and tag not in MAIN_TAGS and bool(words & OUTER_NOISE_WORDS) and not words & MAIN_WORDS)
            or names.get("role", "").lower() in NOISE_ROLES
            or "hidden" in names
            or names.get("aria-hidden") == "true"
        ) and tag not in ("html", "body")
        label = ".".join([tag, *sorted(w for w in words if w.isalpha())])
        up.children.append(tag)
        stack.append(Node(tag, path_code(f"{up.path}/{label}"), noise or up.noise, inside))
    if whole := flush():
        yield stack, whole
    while len(stack) > 1:
        yield stack, None
        stack.pop()


def _names(attributes: str) -> dict[str, str]:
    if "=" not in attributes and "hidden" not in attributes:
        return {}
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)}


def _words(names: dict[str, str]) -> list[str]:
    return [w.lower() for k in ("class", "id") if k in names for w in _PART.findall(_STATE.sub(" ", names[k]))]


def _noise_words(attributes: str, inline: bool) -> bool:
    return bool(set(_words(_names(attributes))) & NOISE_WORDS)


def main_text(page: str | None, tree: Mapping[int, float] = MappingProxyType({}), low: float = LOW) -> str:
    """The main text of a page; ``tree``: importance by code of the paths that the host's tree judges.

    Null, empty and markup-only pages have an empty one. Branches of low importance go, in article and main
    elements as well, unless the whole element is of low importance (an article that many pages repeat). Where
    article or main elements have text, it is the text in them; text outside stays with it if the tree judges
    it and finds more there, by characters times importance."""
    if not page:
        return ""
    every, main, outside = [], [], []
    weight = {True: 0.0, False: 0.0}
    for stack, text in blocks(page):
        if text is None or stack[-1].noise:
            continue
        inside = stack[-1].main
        of = [tree.get(x.path) for x in stack[1:]] if tree else []
        judged = of
        if inside and of:
            # below its outermost element, if that one is not low itself
            first = next(k for k, x in enumerate(stack[1:]) if x.main)
            judged = of[first + 1 :] if of[first] is None or of[first] >= low else []
        if any(x is not None and x < low for x in judged):
            continue
        known = [x for x in of if x is not None]
        (main if inside else outside).append(text)
        if inside or known:
            weight[inside] += len(text) * (known[-1] if known else 1.0)
            every.append(text)
    if main:
        return " ".join(every if weight[False] > weight[True] else main)
    return " ".join(outside)


_codes: dict[str, int] = {}


def path_code(path: str) -> int:
    got = _codes.get(path)
    if got is None:
        if len(_codes) > 100_000:
            _codes.clear()
        got = _codes[path] = text_code(path)
    return got


def text_code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def observations(page: str) -> set[tuple[int, int, int]]:
    """(path, kind, feature): 0 that the page has the path, 1 a style of it, 2 a block of text below it."""
    out = set()
    for stack, text in blocks(page):
        if text is None:
            path = stack[-1].path
            out.add((path, 0, 0))
            out.add((path, 1, path_code(" ".join(stack[-1].children))))
        else:
            feature = text_code(text)
            for x in stack[1:]:
                if x.tag not in ("html", "body"):
                    out.add((x.path, 2, feature))
    return out


def host_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per host and path: pages (distinct), presentation, content and importance."""
    text_batches(pages.sparkSession)

    def observe(batches):
        for batch in batches:
            host, page, rows = [], [], []
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p:
                    seen = list(observations(p))
                    code = text_code(p)
                    host += [h] * len(seen)
                    page += [code] * len(seen)
                    rows += seen
            of = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(of[:, 0]), pa.array(of[:, 1]), pa.array(of[:, 2])],
                names=["host", "page", "path", "kind", "feature"],
            )

    seen = pages.select(host_of(url).alias("host"), F.col(html)).mapInArrow(observe, "host string, page long, path long, kind long, feature long")
    # Copies of a page count once. Counts of one feature, then their entropies by node: partial aggregates both.
    counts = seen.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    spread = F.col("n") * F.log(F.col("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    node = counts.groupBy("host", "path").agg(
        F.coalesce(of(0, F.col("n")), F.lit(0)).alias("pages"),
        of(1, spread).alias("styles"),
        of(2, spread).alias("blocks"),
        of(2, F.col("n")).alias("n_blocks"),
    )
    base = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    presentation = F.when(F.col("pages") > 1, 1 - F.coalesce(F.col("styles"), F.lit(0.0)) / (F.col("pages") * base)).otherwise(1.0)
    content = F.when((F.col("pages") > 1) & (F.col("n_blocks") > 0), 1 - F.col("blocks") / (F.col("n_blocks") * base)).otherwise(1.0)
    return node.select(
        "host", "path", "pages", presentation.alias("presentation"), content.alias("content"), ((1 - CONTENT) * presentation + CONTENT * content).alias("importance")
    )


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    A null or empty html, or one without text, gives an empty text; a null or odd url puts the page with
    the other pages without a host; repeated rows each get their text; very long pages are read whole; an
    empty table gives no rows; columns of these names are replaced."""
    tree = style_tree(pages, url, html)
    branches = tree.where(F.col("pages") >= min_pages)
    # A host's list is as long as its templates have elements, not its pages.
    lists = written(branches.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("__tree")), "branches")
    joined = pages.withColumn("__host", host_of(url)).join(lists, F.col("__host") == lists["host"], "left").drop(lists["host"])

    def make(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            trees = [{b["path"]: b["importance"] for b in x or ()} for x in column("__tree")]
            text = [main_text(p, x, low) for p, x in zip(column(html), trees, strict=True)]
            yield batch, [pa.array(text, pa.string()), [len(t) for t in text]]

    out = with_columns_from_batches(joined, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return out.drop("__host", "__tree")


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
