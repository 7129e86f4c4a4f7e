"""Main text of web pages: site templates are found by counting element subtrees per host, then removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, pick

#: A subtree belongs to the site if it is on so many of a host's distinct pages.
LEAST_PAGES = 5
#: Up to so many templates are broadcast; beyond it, they are joined by shuffle, those of one key in so many parts.
BROADCAST_ROWS = 200_000
SALTS = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements whose content is no text of the page, those without content, and those that end a line of text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Set aside after the templates went.
DROP = {"nav", "header", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video", "fieldset"}
#: But these can be around it: they stay, as elements with such a word do, if they have the larger part of what the counts left,
#: and so many characters.
MAY_HOLD = {"header", "form", "dialog", "fieldset"}
LEAST_MAIN = 200
#: Class, id and role words of the same kinds.
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "complementary", "contentinfo", "cookie", "cookies",
    "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "comment", "comments",
    "disqus", "replies", "related", "widget", "search", "login",
}
#: Words of place and form behind them.
PLAIN_WORDS = {"area", "bar", "block", "bottom", "box", "container", "form", "inner", "item", "items", "left", "links", "list", "panel", "right", "section", "slot", "top", "unit", "wrap", "wrapper"}
#: A start tag on the left closes an open element on the right.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLANK = re.compile(r"\s+")


def _mark(name: str, attributes: str) -> int:
    """2 for what is never text of the page, 1 for what may be set aside, or 0."""
    if name in DROP:
        return 1 if name in MAY_HOLD else 2
    if name in ("html", "body", "article", "main") or not attributes or "=" not in attributes:
        return 0
    return int(any(_sets_aside(w) for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()))


def _sets_aside(name: str) -> bool:
    """Whether a class, id or role like site-header says so: by its last word, others being no more than its place or form."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    while words and words[-1] in PLAIN_WORDS:
        words.pop()
    return bool(words) and words[-1] in DROP_WORDS


class Page:
    """Text pieces in page order, and the tree of elements that they lie in.

    Element 0 is the page. An element's parent has the smaller number.
    """

    def __init__(self, html: str | None):
        self.out: list[tuple[str | None, int]] = []  # text or None for a break, innermost element
        self.parent, self.names, self.marks, self.hashes = [0], [""], [0], [None]
        html = html or ""
        stack: list[int] = []
        log: list[list[bytes]] = [[]]  # what open subtrees are hashed from
        holds = [False]  # whether they have text
        out, names = self.out, self.names
        now = at = 0
        end = len(html)

        def close(to: int) -> None:
            nonlocal now
            while len(stack) > to:
                e = stack.pop()
                now = self.parent[e]
                inner, some = blake2b(b"%s\0%s" % (names[e].encode("utf-8", "surrogatepass"), b"".join(log.pop())), digest_size=8).digest(), holds.pop()
                log[-1] += (b"\0", inner)
                holds[-1] |= some
                if some:
                    self.hashes[e] = int.from_bytes(inner, "little", signed=True)
                if names[e] in BLOCK:
                    out.append((None, now))

        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                text = html[at:stop]
                log[-1].append(_BLANK.sub(" ", text).encode("utf-8", "surrogatepass"))
                holds[-1] |= not text.isspace()
                out.append((text, now))
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    text = m[0][9:].removesuffix("]]>").replace("&", "&amp;")
                    log[-1].append(_BLANK.sub(" ", text).encode("utf-8", "surrogatepass"))
                    holds[-1] |= bool(text.strip())
                    out.append((text, now))
                continue
            name = m[2].lower()
            if not m[0].endswith(">"):  # cut off in a tag
                break
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if names[stack[i]] == name:
                        close(i)
                        break
                else:
                    if name in BLOCK:
                        out.append((None, now))
                continue
            if name in RAW:
                ends = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = ends.end() if ends else end
                continue
            if name in VOID:
                if name in BLOCK:
                    out.append((None, now))
                continue
            if name in BLOCK:
                # a block ends an open paragraph, with whatever is open inside it
                for i in range(len(stack) - 1, -1, -1):
                    if names[stack[i]] == "p":
                        close(i)
                        break
                    if names[stack[i]] in BLOCK:
                        break
            if name in _CLOSES and stack and names[stack[-1]] in _CLOSES[name]:
                close(len(stack) - 1)
            self.parent.append(now)
            names.append(name)
            self.marks.append(_mark(name, m[3]))
            self.hashes.append(None)
            now = len(names) - 1
            stack.append(now)
            log.append([])
            holds.append(False)
            if name in BLOCK:
                out.append((None, now))
        close(0)
        self.candidates = {h for h in self.hashes if h is not None}

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        """The page without subtrees that are templates, and then without what tags and class words set aside.

        An inline element that is a template goes with all else on its line, so that no sentence loses a word.
        """
        gone, loose = [False] * len(self.parent), [False] * len(self.parent)
        for e in range(1, len(gone)):
            known = self.hashes[e] in templates
            gone[e] = gone[self.parent[e]] or (known and self.names[e] in BLOCK)
            loose[e] = loose[self.parent[e]] or known
        left, line = [], []
        for text, e in [*self.out, (None, 0)]:
            if text is not None:
                if not gone[e]:
                    line.append((text, e))
                continue
            # signs between templates go with them
            if not any(loose[e] for _, e in line) or any(not loose[e] and any(map(str.isalnum, unescape(text))) for text, e in line):
                left += line
            line = []
            left.append((None, e))
        size = [0] * len(gone)
        for text, e in left:
            if text is not None:
                size[e] += len(text.strip())
        for e in range(len(gone) - 1, 0, -1):
            size[self.parent[e]] += size[e]
        for e in range(1, len(gone)):
            mark = self.marks[e]
            # the larger part of a page, if it is more than a few lines, is no aside whatever its name
            gone[e] = gone[self.parent[e]] or mark == 2 or (mark == 1 and (size[e] < LEAST_MAIN or 2 * size[e] <= size[0]))
        blocks, now = [], []
        for text, e in left:
            if text is None:
                line = _BLANK.sub(" ", unescape("".join(now))).strip() if now else ""
                if line:
                    blocks.append(line)
                now = []
            elif not gone[e]:
                now.append(text)
        return "\n".join(blocks)


def host_of(url) -> F.Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty if null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for host, html in zip(b["host"], b["html"], strict=True):
            page = Page(html)
            body = int.from_bytes(blake2b(page.text().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            rows += [(host, h, body) for h in page.candidates]
        yield pd.DataFrame(rows, columns=["host", "subtree", "body"]).astype({"subtree": "int64", "body": "int64"})


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, subtree) of the templates. Copies of a page count once, so that a copied article is no template."""
    seen = pages.mapInPandas(_subtrees, "host string, subtree long, body long")
    # a host that holds a third of all pages is dealt by page as well, counted, and only then gathered
    seen = seen.distinct().groupBy("host", "subtree", F.pmod("body", F.lit(64)).alias("salt")).agg(F.count("*").alias("n"))
    return seen.groupBy("host", "subtree").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_pages).select("host", "subtree")


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(host, key, h) for host, key, html in zip(b["host"], b["key"], b["html"], strict=True) for h in Page(html).candidates]
        yield pd.DataFrame(rows, columns=["host", "key", "subtree"]).astype({"subtree": "int64"})


def _on_page(src: DataFrame, known: DataFrame) -> DataFrame:
    """(host, key, subtrees) of pages (host, key, html) with templates: a list is no longer than its page."""
    # a subtree of all pages of a hot host meets its template in SALTS places; copies of a page are one before that
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = src.mapInPandas(_places, "host string, key string, subtree long").distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return places.join(dealt, ["host", "subtree", "salt"]).groupBy("host", "key").agg(F.collect_set("subtree").alias("subtrees"))


def _texts(b: pd.DataFrame, known) -> pd.DataFrame:
    text = [Page(html).text(gone) for html, gone in zip(b["html"], known, strict=True)]
    return pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}).astype({"page_id": "Int64"})


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html has an empty text; no rows give no rows. Pages whose url is null or has no host form one site without name.
    Repeated rows are extracted alike. How many templates a host has does not matter: few are broadcast,
    many are joined by (host, subtree), and each page gets those that stand on it.
    """
    src = pick(pages, page_id="long", url="string", html="string").withColumn("host", host_of(F.col("url")))
    known = cut(templates(src.select("host", "html"), least_pages))
    out = "page_id long, url string, text string, n_chars long"
    if known.count() <= BROADCAST_ROWS:
        of_host: dict[str, set[int]] = {}
        for host, subtree in known.collect():
            of_host.setdefault(host, set()).add(subtree)
        held = pages.sparkSession.sparkContext.broadcast(of_host)
        return src.mapInPandas(lambda batches: (_texts(b, [held.value.get(host, ()) for host in b["host"]]) for b in batches), out)
    src = src.withColumn("key", F.md5("html"))
    both = src.join(_on_page(src.select("host", "key", "html"), known), ["host", "key"], "left").select("page_id", "url", "html", "subtrees")
    return both.mapInPandas(lambda batches: (_texts(b, [() if x is None else {int(h) for h in x} for x in b["subtrees"]]) for b in batches), out)
