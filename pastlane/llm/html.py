"""Main text of web pages by paths that the pages of a host agree on (operator 4).

Each page is read once for its containers: elements that hold blocks of text. A container's
worth is the text in it, less links, less what menus, notices and adverts hold. Its path is
the tags and classes from the root, generalised (digits become N, ids are dropped), so the
same template gives the same path on all pages of a host. Pages vote for their best paths
in Spark, hosts take the path with most votes, and each page is extracted again from
the elements on its host's path; a page that has none of them uses its own best.

Headers, footers, menus, sidebars, forms, notices, adverts, reader comments, scripts and
styles are left out wherever they stand. A word of a class, id or role says so only of an element that does not
hold the page's article (see ``_decide``), and of none if nothing else is left; inside an article only a name that has nothing else
to say ("share-buttons", not "share-price-table"). A null or empty page has an empty text, an empty table no rows. A row
without url votes with the other rows without one. Repeated rows vote and are extracted each; of paths with as many votes the deepest,
then the last by its letters, wins. Long pages are read from end to end. Input columns keep their names and values: the text goes to a
column of a free name, ``into`` or that with lines after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastlane.llm.components import free_name
from pastlane.session import fresh_dir

# Tags by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title".split())
MUTE = set("svg math select object canvas".split())  # their text is left out
BROKEN_OUT = {"svg", "math", "select"}  # a block ends them, if nothing of KEEPS_IN is between
KEEPS_IN = {"foreignobject", "desc", "annotation-xml", "object", "canvas"}
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table
tbody td tfoot th thead tr ul""".split())
CONTAINER = set("html body main article section div td center blockquote form nav aside header footer".split())
LEFT_OUT = set("head nav footer aside form menu dialog search button label".split())
ENDS_P = BLOCK - {"html", "body", "head"}
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# Words in classes, ids and roles of what is not the article.
NOT_ARTICLE = set("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social
related recommended recommendations comment comments commentlist disqus replies respond widget toolbar pagination pager
skip complementary contentinfo toc tags form search""".split())
HEADER = {"header", "banner"}
# Words beside them in names of the same things.
BESIDE = set("""area bar block body box btn button buttons card center col column container content count feed float form frame group
head heading holder icon icons inline inner item items label left link links list main meta module more new option options outer
panel part popular post posts pull rail region right row section side site slot small sticky story stories tab text thread title
top unit bottom view wrap wrapper zone""".split())

DEEPEST = 48  # containers below this depth count as the one at it
CANDIDATES = 5  # paths a page may vote for
VOTE = 1000  # votes of a page for its best path

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/!?])[^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_END_OF = {tag: re.compile(rf"(?i)</{tag}\b[^>]*>") for tag in RAW}


class Element:
    __slots__ = ("tag", "path", "depth", "out", "article", "link", "holder", "mute", "mark")

    def __init__(self, tag, path, depth, out, article, link, holder, mute=False, mark=None):
        self.tag, self.path, self.depth = tag, path, depth
        self.out = out  # in something left out
        self.article = article  # in an article or main element
        self.link = link
        self.holder = holder  # its path if it is a container, else that of the container around it
        self.mute = mute  # in an element whose text is left out
        self.mark = mark  # the innermost element around it, or itself, that words mark as not the article


class Mark:
    """An element whose class, id or role says that it is not the article."""

    __slots__ = ("around", "kind", "whole", "text", "holds", "out")

    def __init__(self, around, kind, whole):
        self.around = around  # the mark around it
        self.kind = kind  # tag and classes
        self.whole = whole  # one of the words stands alone and is no part of a longer name
        self.text, self.holds, self.out = 0, False, True


class Open:
    """The open elements; the places of each tag and of blocks are kept, so that no search goes through them."""

    def __init__(self, root: Element):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of some tags, or 0."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=0)

    def cut(self, k: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tags: Iterable[str], stop: Iterable[str]) -> None:
        k = self.last(tags)
        if k and k > self.last(stop):
            self.cut(k)

    def end(self, tag: str) -> None:
        k = self.last((tag,))
        # An inline end tag does not close the block around it.
        if k and (tag in BLOCK or not self.blocks or k > self.blocks[-1]):
            self.cut(k)


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...], bool, int]]:
    """(text, paths of the containers around it, left out, characters in links) of each block in page order."""
    found: list = []
    if not html:
        return found
    marks: list[Mark] = []
    articles: list[Element] = []  # articles and main elements
    root = Element("", (), 0, False, False, False, ("",))
    opened, parts, links = Open(root), [], 0
    stack = opened.stack
    state = [root]  # of the block that is open

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            at = state[0]
            found.append((text, at.holder, at.out, min(links, len(text)), at.mark))
        parts.clear()
        links = 0

    position, size = 0, len(html)
    while position < size:
        match = _TOKEN.match(html, position)
        position = match.end()
        tag = match[2]
        if tag is None:
            token = match[0]
            if (token[0] != "<" or token == "<") and not stack[-1].mute:
                if not parts:
                    state[0] = stack[-1]
                parts.append(token)
                if stack[-1].link:
                    links += len(token)
            continue
        tag = tag.lower()
        if match[1]:
            if tag in BLOCK:
                flush()
            opened.end(tag)
            continue
        if tag in RAW:
            end = _END_OF[tag].search(html, position)
            position = end.end() if end else size
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            opened.close(BROKEN_OUT, KEEPS_IN)
            if tag in ENDS_P:
                opened.close(("p",), CONTAINER)
            if tag in ENDS_ITSELF:
                opened.close(ENDS_ITSELF[tag], SCOPE.get(tag, ()))
        elif tag == "br" or tag in MUTE:
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack[:4]):
            continue
        if not match[3].endswith("/") or tag in BLOCK:
            element = _element(stack[-1], tag, match[3])
            opened.push(element)
            if element.mark is not stack[-2].mark:
                marks.append(element.mark)
            if tag in ("article", "main") and not element.out:
                articles.append(element)
    flush()
    _decide(found, marks, articles)
    return [(text, holder, out or mark is not None and mark.out, links) for text, holder, out, links, mark in found]


def _around(mark: Mark | None) -> Iterator[Mark]:
    while mark is not None:
        yield mark
        mark = mark.around


def _decide(found: list, marks: list[Mark], articles: list[Element]) -> None:
    """Which marked elements, in page order, are left out.

    Not those around the first article or main element, nor these themselves and articles of the same
    classes; an article in an element that a whole word marks ("comments") counts if most of the text is there.
    Without any, not those that hold more than half of the text, if the word is but a part of a name
    ("has-sidebar"). When nothing would be left, none is left out.
    """
    total = 0
    for text, _, out, _, mark in found:
        if not out:
            total += len(text)
            if mark is not None:
                mark.text += len(text)
    for mark in reversed(marks):
        if mark.around is not None:
            mark.around.text += mark.text
    anchors: dict[str, Element] = {}
    for element in articles:
        if element.tag == "main" or element.tag not in anchors and all(
                not mark.whole or 2 * mark.text > total for mark in _around(element.mark)):
            anchors.setdefault(element.tag, element)
    for element in anchors.values():
        mark = element.mark
        while mark is not None and not mark.holds:
            mark.holds, mark = True, mark.around
    kinds = {mark.kind for mark in marks if mark.holds and mark.kind[0] == "article"}
    for mark in marks:
        own = not mark.holds and mark.kind not in kinds and (bool(anchors) or mark.whole or 2 * mark.text <= total)
        mark.out = own or mark.around is not None and mark.around.out
    if total and all(out or mark is not None and mark.out for _, _, out, _, mark in found):
        for mark in marks:
            mark.out = False


def _says_only(name: str, not_it: set[str]) -> bool:
    """Whether a name has a word of what is not the article, and no other but such as stand beside them."""
    words = set(_WORDS.findall(name))
    return not words.isdisjoint(not_it) and words <= not_it | BESIDE


def _element(parent: Element, tag: str, attributes: str) -> Element:
    article = parent.article or tag in ("article", "main")
    out = parent.out or tag in LEFT_OUT or tag == "header" and not parent.article
    classes, marked, whole = "", False, False
    if attributes and tag in BLOCK or "hidden" in attributes or "none" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                out = True
            elif name in ("class", "id", "role") and tag not in ("html", "body"):
                not_it = (NOT_ARTICLE - HEADER if parent.article else NOT_ARTICLE) | (set() if article else HEADER)
                if parent.article:
                    marks = any(_says_only(token, not_it) for token in value.lower().split())
                else:
                    marks = not not_it.isdisjoint(x.lower() for x in _WORDS.findall(value))
                if marks:
                    marked = True
                    whole = whole or not not_it.isdisjoint(value.lower().split())
                if name == "class":
                    classes = "".join("." + re.sub(r"\d+", "N", x) for x in sorted(set(value.split()))[:8])
    path, holder = parent.path, parent.holder
    if tag in CONTAINER and parent.depth < DEEPEST:
        step = (path[-1] if path else "") + ">" + tag + classes
        path = (*path, step)
        holder = path
    return Element(tag, path, min(parent.depth + 1, DEEPEST) if path is not parent.path else parent.depth,
                   out, article, parent.link or tag == "a", holder, parent.mute or tag in MUTE,
                   Mark(parent.mark, (tag, classes), whole) if marked else parent.mark)


def best_paths(found: list) -> list[tuple[str, int, int]]:
    """(path, votes, depth) of a page's best containers, the best first."""
    worth: dict[str, list] = {}
    for text, holder, out, links in found:
        value = -0.1 * len(text) if out else len(text) - 4 * links - (15 if len(text) < 30 else 0)
        for depth, path in enumerate(holder):
            entry = worth.setdefault(path, [0.0, depth])
            entry[0] += value
    ranked = sorted(((v, d, p) for p, (v, d) in worth.items() if v > 0), key=lambda x: (-x[0], -x[1], x[2]))
    return [(p, int(VOTE * v / ranked[0][0]), d) for v, d, p in ranked[:CANDIDATES]]


def main_text(html: str | None, path: str | None) -> str:
    """The blocks of a page on a path; without any, those on the page's own best path."""
    found = blocks(html)
    inside = [text for text, holder, out, _ in found if not out and path in holder] if path is not None else []
    if not inside:
        own = best_paths(found)
        inside = [text for text, holder, out, _ in found if not out and (not own or own[0][0] in holder)]
    return "\n\n".join(inside)


def page_votes(html: Column) -> Column:
    """An array of the paths that a page votes for."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("votes", pa.int64()), ("depth", pa.int32())]))
    names = ("path", "votes", "depth")

    @F.arrow_udf("array<struct<path: string, votes: bigint, depth: int>>")
    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([[dict(zip(names, x, strict=True)) for x in best_paths(blocks(page.as_py()))]
                            for page in column], kind)

    return votes(html)


def page_text(html: Column, path: Column) -> Column:
    """The main text of a page on a path."""

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, paths in batches:
            yield pa.array([main_text(a.as_py(), b.as_py()) for a, b in zip(pages, paths, strict=True)], pa.string())

    return text(html, path)


def host_of(url):
    """The host of a url, in lower case; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host's pages, of equals the deepest."""
    votes = pages.select(host_of(F.col(url)).alias("host"), F.explode(page_votes(F.col(html))).alias("vote"))
    sums = votes.groupBy("host", F.col("vote.path").alias("path")).agg(
        F.sum("vote.votes").alias("votes"), F.max("vote.depth").alias("depth"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "depth", "path")).alias("path"))


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each.

    The hosts' paths are written first: Spark then knows their size, broadcasts them if they
    are below its threshold, and else joins by host with skewed hosts split.
    """
    folder = fresh_dir(pages.sparkSession, "host-paths")
    host_paths(pages, url, html).select(F.col("host").alias("__host"), F.col("path").alias("__path")).write.parquet(folder)
    winners = pages.sparkSession.read.parquet(folder)
    kept = pages.select(F.struct(*[F.col(f"`{name}`") for name in pages.columns]).alias("page"), host_of(F.col(url)).alias("__host"))
    joined = kept.join(winners, "__host", "left")
    made = page_text(F.col("page")[html], F.col("__path")).alias(free_name(pages, into))
    return joined.select("page.*", made)
