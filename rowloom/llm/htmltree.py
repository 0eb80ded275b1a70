"""Main text of web pages with a style tree per site.

The pages of a host are merged into one tree: a node stands for all elements
with the same path of tags and classes. From the merged tree comes how
important a branch is: the entropy, over the host's different pages, of what
its leaves say and of the child sequences (presentations) its inner nodes
show. Branches that say the same on page after page are dropped, and so are
branches that markup names as navigation, advertising, forms, comments and the
like. This holds inside and outside of article and main elements; standing in
one weighs for a branch but decides nothing alone. All paragraphs of one path
are one leaf, so a sentence that many articles share stays among others.

Cases: null pages give empty text; unclosed tags close with their parents;
hosts with few different pages are judged by markup alone; repeated rows count
once in a host's tree and each get their text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import materialize

#: Pages of a host needed to judge a branch, and the importance under which it goes.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.3
#: Weight of a node's own entropy against that of its children, per child.
DECAY = 0.9
#: How many times the importance of a branch counts in an article or main element.
MAIN_WEIGHT = 2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>""", re.S
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED_TAGS = {
    "head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "noscript", "iframe", "svg", "canvas", "object", "template",
    "dialog", "menu", "audio", "video", "map", "math", *RAW,
}
#: Words of classes, ids and roles that name what is not the article.
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "contentinfo", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr", "login", "masthead",
    "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "promoted", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "topbar", "widget", "respond",
}
MAIN = {"article", "main"}
#: Opening one of these closes an open paragraph.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details", "menu",
}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


class Page:
    """Blocks of text with the path of elements that each stands in."""

    def __init__(self, source: str):
        #: (tag, path, dropped by markup, inside an article or main element)
        self.stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        self.blocks: list[tuple[str, str, bool]] = []
        self.shapes: dict[str, list[str]] = {}
        self.words: list[str] = []
        at = 0
        while m := _TOKEN.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self._text(m[1])
            elif m[3]:
                tag = m[3].lower()
                if m[2]:
                    self._close(tag)
                else:
                    self._open(tag, m[4])
                    if tag in RAW:
                        end = re.compile(rf"</{tag}\b", re.I).search(source, at)
                        at = end.start() if end else len(source)
        self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            self.words.append(raw)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.words)).split())
        self.words = []
        if text:
            _, path, dropped, _ = next(x for x in reversed(self.stack) if x[0] not in INLINE)
            inline_dropped = dropped or self.stack[-1][2]
            self.blocks.append((text, path, inline_dropped))

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P:
            self._pop_through("p", MAIN | {"body", "td", "th", "li", "div", "section", "blockquote", "button"})
        elif tag in CLOSES_SAME:
            self._pop_through(tag, CLOSES_SAME[tag])
        _, path, dropped, main = self.stack[-1]
        names: list[str] = []
        hidden = False
        if attributes:
            for name, *values in _ATTR.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if name.lower() in ("class", "id", "role"):
                    names += [w for part in value.split() for w in _NAME.findall(part)]
                hidden |= name.lower() == "hidden" or name.lower() == "style" and "display:none" in value.replace(" ", "")
        own = tag + "".join("." + n for n in names)
        off = tag in DROPPED_TAGS or hidden or (tag not in ("html", "body", "article", "main") and not DROPPED_NAMES.isdisjoint(names))
        off |= tag == "header" and not main
        self.shapes.setdefault(path, []).append(own)
        if off and tag in INLINE:
            self._flush()
        if tag not in VOID:
            self.stack.append((tag, f"{path}/{own}", dropped or off, main or tag in MAIN))

    def _pop_through(self, tag: str, stop: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE or self.stack[-1][2]:
            self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return


def host_of(url: str | None) -> str:
    """Host of an address, lower case, without port and user."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].split(":")[0].lower() if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def tree_rows(pages: DataFrame) -> DataFrame:
    """Nodes of every page: (host, page, path, parent, leaf, value): what a leaf says, or the children an inner node shows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for url, source in zip(batch["url"].to_pylist(), batch["html"]):
                source = source.as_py() or ""
                page, host, own = Page(source), host_of(url), _hash(source)
                said: dict[str, list[str]] = {}
                for text, path, dropped in page.blocks:
                    if not dropped:
                        said.setdefault(path, []).append(text)
                for path, texts in said.items():
                    out.append((host, own, path, True, _hash("\n".join(texts))))
                for path, children in page.shapes.items():
                    if path:
                        out.append((host, own, path, False, _hash(" ".join(children))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64())],
                                             ["host", "page", "path", "leaf", "value"])

    return pages.select("url", "html").mapInArrow(work, "host string, page bigint, path string, leaf boolean, value bigint")


def dull_branches(pages: DataFrame) -> DataFrame:
    """Per host the paths (as hashes) of branches of low importance."""
    rows = tree_rows(pages).groupBy("host", "page", "path", "leaf").agg(F.min("value").alias("value"))
    counts = rows.groupBy("host", "path", "leaf", "value").agg(F.count("*").alias("n"))
    share = F.col("n") * F.log2(F.col("n").cast("double"))
    nodes = counts.groupBy("host", "path", "leaf").agg(F.sum("n").alias("m"), F.sum(share).alias("s"))
    entropy = F.coalesce(F.try_divide(F.log2("m") - F.try_divide("s", "m"), F.log2("m")), F.lit(1.0))
    nodes = nodes.withColumn("entropy", entropy).where(F.col("m") >= LEAST_PAGES)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, dull = [], []
            for host, listed in zip(batch["host"].to_pylist(), batch["nodes"].to_pylist()):
                hosts.append(host)
                dull.append(low_importance({(n["path"], n["leaf"]): n["entropy"] for n in listed}))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(dull, pa.list_(pa.int64()))], ["host", "dull"])

    listed = nodes.groupBy("host").agg(F.collect_list(F.struct("path", "leaf", "entropy")).alias("nodes"))
    return listed.mapInArrow(weigh, "host string, dull array<bigint>")


def low_importance(entropies: dict[tuple[str, bool], float]) -> list[int]:
    """Hashes of the paths whose composite importance is low.

    A leaf's importance is the entropy of what it says. An inner node's is its
    presentations' entropy, weighted the less the more children it has, and
    for the rest the mean importance of its children and its own text.
    """
    children: dict[str, set[str]] = {}
    for path, _ in entropies:
        while path:
            parent = path.rpartition("/")[0]
            children.setdefault(parent, set()).add(path)
            path = parent
    memo: dict[str, float] = {}
    for path in sorted({p for c in children.values() for p in c}, key=lambda p: -p.count("/")):
        below = [memo[c] for c in children.get(path, ())]
        if (path, True) in entropies:
            below.append(entropies[path, True])
        keep = DECAY ** len(below)
        own = entropies.get((path, False))
        memo[path] = (1 - keep) * own + keep * float(np.mean(below)) if below and own is not None and own < 1 else float(np.mean(below)) if below else 1.0
    return sorted(_hash(p) for p, x in memo.items() if x * _weight(p) < LEAST_IMPORTANCE and _only_text(p, entropies))


def _weight(path: str) -> int:
    return MAIN_WEIGHT if any(part.partition(".")[0] in MAIN for part in path.split("/")) else 1


def _only_text(path: str, entropies: dict[tuple[str, bool], float]) -> bool:
    """Whether some leaf stands in this branch and none in it says much."""
    inside = [e * _weight(p) for (p, leaf), e in entropies.items() if leaf and (p == path or p.startswith(path + "/"))]
    return bool(inside) and max(inside) < LEAST_IMPORTANCE


def main_text(source: str | None, dull: set[int]) -> str:
    page = Page(source or "")

    def kept(path: str, dropped: bool) -> bool:
        if dropped or not dull:
            return not dropped
        parts = path.split("/")
        return not any(_hash("/".join(parts[:i])) in dull for i in range(2, len(parts) + 1))

    return "\n".join(text for text, path, dropped in page.blocks if kept(path, dropped))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every page."""
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    dull = materialize(dull_branches(plain))
    kind = plain.schema["id"].dataType.simpleString()
    # The host as in host_of: what stands between // and the next / ? or #, without user and port.
    named = F.lower(F.split_part(F.element_at(F.split(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1), "@"), -1), F.lit(":"), F.lit(1)))
    joined = plain.withColumn("host", F.coalesce(named, F.lit(""))).join(dull, "host", "left").select("id", "url", "html", "dull")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), set(d or ())) for h, d in zip(batch["html"], batch["dull"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(texts, pa.string())], ["id", "url", "text"])

    out = joined.mapInArrow(work, f"id {kind}, url string, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
