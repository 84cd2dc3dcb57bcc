"""HTML extraction: containers are scored page by page, hosts vote on container paths, pages are extracted again.

Plan
 1. Every page is parsed and its containers are scored: text of blocks directly below counts whole, text two levels
    below counts half, links count against it. The best container's generalised path (tags and classes, digits
    dropped) is the page's vote, weighted by its text.
 2. Spark sums the votes by host and path in a partial and a final aggregation, so a host with very many pages is
    no hot group, and keeps the path with the most pages.
 3. The winning path joins every page of its host (broadcast while the table is known to be small, otherwise with
    the host salted over the page), and the page is extracted from the elements at that path, or from its own best
    container where it has none.

A path of over LONGEST_PATH characters is a hash, which only voting needs. Parsing is linear in the page, whatever is
nested, unclosed or repeated in it, and drops no text for being deep.

Results: one row per input row. A null or empty page, or one without text, has an empty string. Repeated rows vote
repeatedly and give repeated rows. Ties between paths go to more text, then to the path that sorts first. A null or hostless
URL votes with all others of the kind. A table without rows gives none.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_table
from .common import map_rows, raw_texts

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: For a page with a quote that is never closed: a tag ends at the next >.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = frozenset("article body center dd details div main section td blockquote table tbody tr html li ul ol dl figure".split())
SKIP = frozenset("nav footer aside form button select option label fieldset dialog menu head object audio video canvas map datalist".split())
#: Words in class, id and role that mark what is not the article.
BOILER = frozenset(
    "ad ads adbox adslot advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended recommendations related remark reply replies respond share sharing shoutbox sidebar sidebars sidecol signup skip skyscraper social sponsor sponsored "
    "subscribe subscription tagcloud teaser toolbar toc topbar widget widgets contentinfo complementary search alert disclaimer paywall".split()
)
_NAME = re.compile(r"[^a-z]+")
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: End tags that do not reach beyond the table cell they stand in.
INSIDE_CELLS = frozenset(("p", "div", "li", "b", "i", "span"))
LONGEST_PATH = 200


class Element:
    """box is the nearest container, the element itself if it is one; own and link are its characters of text, path its
    generalised path."""

    __slots__ = ("tag", "path", "box", "outer", "skip", "own", "link", "first", "last")

    def __init__(self, tag: str, path: str, parent: Element | None, skip: bool, first: int):
        self.tag, self.path, self.skip, self.first = tag, path, skip, first
        self.box = self if parent is None or tag in CONTAINER else parent.box
        self.outer = parent.box if parent is not None else None
        self.own = self.link = 0
        self.last = None


def _longer(path: str, step: str) -> str:
    """The path with one more step; beyond LONGEST_PATH characters, and from there on, a hash of path and step."""
    out = f"{path}/{step}"
    return out if len(out) <= LONGEST_PATH and path[:1] != "#" else "#" + blake2b(out.encode("utf-8", "replace"), digest_size=8).hexdigest()


def _marks(attrs: str) -> tuple[str, bool]:
    """The generalised classes of a tag and whether its attributes mark it as boilerplate or hidden."""
    classes, boiler = [], False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [x for x in _NAME.split(word) if x]
                if name == "class" and parts:
                    classes.append("-".join(parts))
                boiler |= any(x in BOILER for x in parts)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            boiler = True
    return ".".join(sorted(set(classes))), boiler


class Page:
    """Blocks of text in page order and the containers that span them.

    Time and memory are in proportion to the page, whatever is nested or left open: open elements are a stack with the
    depths of each tag, and what was not found to the end of the page is not looked for again.
    """

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.elements: list[Element] = []
        self._texts: list[str] = []
        self._stack: list[Element] = []
        #: Depths of the open elements by tag, and of those that are blocks.
        self._open: dict[str, list[int]] = {}
        self._block_depths: list[int] = []
        self._parse(html)

    def _flush(self) -> None:
        if self._texts:
            text = _SPACE.sub(" ", unescape("".join(self._texts))).strip()
            self._texts = []
            if text:
                self.blocks.append(text)
                # A block's text counts whole for its nearest container and half for the one around that.
                box = self._stack[-1].box
                box.own += 2 * len(text)
                if box.outer is not None:
                    box.outer.own += len(text)

    def _push(self, e: Element) -> None:
        if e.tag in CONTAINER or not self._stack:
            self.elements.append(e)
        self._open.setdefault(e.tag, []).append(len(self._stack))
        if e.tag in BLOCK:
            self._block_depths.append(len(self._stack))
        self._stack.append(e)

    def _close(self, depth: int, block: bool) -> None:
        """Closes the element at depth and all within."""
        if block:
            self._flush()
        while len(self._stack) > depth:
            e = self._stack.pop()
            e.last = len(self.blocks)
            self._open[e.tag].pop()
            if e.tag in BLOCK:
                self._block_depths.pop()

    def _depth(self, tags) -> int:
        """Of the innermost open element with one of the tags; -1 if there is none."""
        return max((d[-1] for t in tags if (d := self._open.get(t))), default=-1)

    def _tokens(self, html: str):
        """(text before, closing mark, tag, attributes, end) of every tag; the last has no tag. Comments are left out."""
        at = low = 0
        tag, no_comment_end = _TAG, False
        while (lt := html.find("<", at)) >= 0:
            if m := tag.match(html, lt):
                yield html[low:lt], m[1], m[2].lower(), m[3], m.end()
                at = low = max(m.end(), self._at)
                continue
            after = html[lt + 1 : lt + 2]
            if after in ("!", "?"):
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    end = end + 3 if end >= 0 else len(html)
                else:
                    end = html.find(">", lt) + 1
                if not end:
                    break
                if lt > low:
                    yield html[low:lt], "", "", "", end
                at = low = end
                continue
            if _NAMED.match(html, lt):
                if tag is _PLAIN_TAG:
                    break
                # A quote that is never closed: from here on quotes do not hide the end of a tag.
                tag = _PLAIN_TAG
                continue
            at = lt + 1
        yield html[low:], "", "", "", len(html)

    def _parse(self, html: str) -> None:
        self._at = 0
        self._push(Element("html", "", None, False, 0))
        stack, link, unclosed = self._stack, 0, set()
        for text, closing, tag, attrs, end in self._tokens(html):
            top = stack[-1]
            if text and not top.skip:
                self._texts.append(text)
                if link:
                    top.box.link += len(text)
            if not tag:
                continue
            if closing:
                if tag == "a":
                    link = max(0, link - 1)
                depth = self._depth((tag,))
                if tag in INSIDE_CELLS and depth < self._depth(("td", "th", "table")):
                    depth = -1
                if depth > 0:
                    self._close(depth, tag in BLOCK)
                elif tag in BLOCK and tag != "html":
                    self._flush()
                continue
            if tag in RAW and not attrs.endswith("/"):
                found = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, end)
                if found is None:
                    unclosed.add(tag)
                self._at = found.end() if found else (len(html) if tag in ("script", "style") else end)
                continue
            if tag == "br" or tag == "wbr":
                if not top.skip:
                    self._texts.append(" " if tag == "br" else "")
                continue
            if tag in BLOCK:
                self._flush()
                if tag in STOPS:
                    depth = self._depth(CLOSES[tag] | STOPS[tag])
                    if depth > 0 and stack[depth].tag in CLOSES[tag]:
                        self._close(depth, True)
                elif stack[depth := self._block_depths[-1]].tag == "p":
                    # A block inside a paragraph, also another paragraph, ends the paragraph.
                    self._close(depth, True)
                top = stack[-1]
            if tag in VOID or attrs.endswith("/"):
                continue
            if tag == "a":
                link += 1
            if tag in ("html", "body") and len(stack) == 1 and top.tag == tag:
                continue
            classes, boiler = _marks(attrs) if attrs else ("", False)
            if tag in ("body", "html"):
                boiler = False
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            skip = top.skip or tag in SKIP or (boiler and not heading) or (tag == "header" and self._depth(("article", "main")) < 0)
            self._push(Element(tag, _longer(top.path, f"{tag}.{classes}" if classes else tag) if tag in CONTAINER else top.path, top, skip, len(self.blocks)))
        self._flush()
        self._close(0, False)

    def best(self) -> Element:
        weight = {"article": 2.0, "main": 1.6}
        return max(self.elements, key=lambda e: (0 if e.skip else (e.own - 2 * e.link) * weight.get(e.tag, 1.0), -e.first))

    def text(self, path: str | None) -> str:
        """The text of all elements at path, outermost first; of the best container where there is none."""
        spans, end = [], 0
        for e in self.elements:
            if e.path == path and not e.skip and e.first >= end and e.last > e.first:
                spans.append((e.first, e.last))
                end = e.last
        if not spans:
            e = self.best()
            spans = [(e.first, e.last)]
        return "\n".join("\n".join(self.blocks[a:b]) for a, b in spans)


def vote(html: str) -> tuple[str, int]:
    """The path of the page's best container and the length of its text."""
    page = Page(html)
    e = page.best()
    return e.path, sum(map(len, page.blocks[e.first : e.last]))


def host_of(url):
    """Column: what stands between :// and the next /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars, path) per row; path is the host's winning path."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def votes(batch: pa.RecordBatch) -> dict:
        got = [vote(t.decode("utf-8", "replace")) for t in raw_texts(batch.column(1))]
        return {"host": batch.column(0), "path": [g[0] for g in got], "size": pa.array([g[1] for g in got], pa.int64())}

    cast = map_rows(pages.select(host_of(F.col("url")).alias("host"), "html"), votes, "host string, path string, size long")
    tally = cast.where("size > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # max_by over a struct: most pages, then most text, then the smaller path (min_by on the text keeps it exact).
    best = tally.groupBy("host").agg(F.max(F.struct("n", "size")).alias("top"))
    winners = shared_table(tally.join(best, "host").where("n = top.n and size = top.size").groupBy("host").agg(F.min("path").alias("path")))
    with_host = pages.withColumn("host", host_of(F.col("url")))
    if winners.count() <= broadcast_rows:
        joined = with_host.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(salts)))))
        joined = with_host.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def again(batch: pa.RecordBatch) -> dict:
        text = [Page(t.decode("utf-8", "replace")).text(p) if t else "" for t, p in zip(raw_texts(batch.column(2)), batch.column(3).to_pylist())]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": pa.array(map(len, text), pa.int64()), "path": batch.column(3)}

    return map_rows(joined.select("page_id", "url", "html", "path"), again, "page_id long, url string, text string, n_chars long, path string")
