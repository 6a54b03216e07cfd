"""HTML extraction: boosted trees over DOM nodes, and a decoding in which what stands below a dropped node is dropped."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm import boosting
from parity.llm._base import lean, read, ship

_TOKEN = re.compile(r"""<!--(?:.*?(?:-->|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_STOP = re.compile(r"[.!?;:,]")

#: Elements whose content is never text of the page. Without an end tag, script and style reach to the end of the page; the others are passed over.
RAW = frozenset("script style template textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line: they make no node, and text goes on through them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
#: What an opening tag closes if it is the innermost open element of these.
CLOSES = {x: frozenset(("p",)) for x in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",)), "body": frozenset(("head", "title")),
}

TAGS = ("#text", "p", "h1", "h2", "h3", "div", "section", "article", "main", "body", "html", "head", "title", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "tr", "blockquote", "pre", "figure", "button", "dl", "dd", "dt")
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
#: Groups of attribute words. The first LOST of them speak of what isn't the article.
WORDS = (
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc", "header masthead topbar banner branding logo hero", "footer foot copyright colophon legal bottom",
    "sidebar aside rail widget widgets secondary related recommended trending popular more", "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted adslot dfp",
    "cookie cookies consent gdpr notice alert popup modal overlay privacy message", "form newsletter subscribe signup login search register contact",
    "comment comments disqus reply replies respond discussion reader readers reviews thread", "share sharing social follow tools toolbar meta byline tags author", "hidden skip print screen",
    "article content main post entry story body text page prose", "headline title lead paragraph intro articlebody",
)
LOST = 10
_GROUP_AT = {w: k for k, ws in enumerate(WORDS) for w in ws.split()}
N_NUMERIC = 15


class Page:
    """Nodes in page order. A text that shares its element with other blocks is a node of its own (#text)."""

    __slots__ = ("tags", "parents", "groups", "texts", "links", "size")

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.groups: list[tuple[int, ...]] = [()]
        self.texts: list[list[str]] = [[]]
        self.links: list[int] = [0]
        self.size = len(source)
        stack, at, in_link = [0], 0, 0
        is_open: dict[str, int] = {}  # open elements by name, so that an end tag without one isn't sought in the stack
        run: list[str] = []

        def close() -> None:
            nonlocal run
            if run:
                text = "".join(run)
                run = []
                if text.strip():
                    self._add("#text", stack[-1], ())
                    self.texts[-1].append(text)
                    self.links[-1] = in_link_chars[0]
            in_link_chars[0] = 0

        in_link_chars = [0]
        lower = None
        while True:
            m = _TOKEN.search(source, at)
            between = source[at : m.start() if m else None]
            if between:
                run.append(between)
                if in_link:
                    in_link_chars[0] += len(between)
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    in_link = 0
                elif name in INLINE:
                    pass
                elif name == "br":
                    run.append(" ")
                elif is_open.get(name):
                    close()
                    while True:  # each element is taken off once
                        last = self.tags[stack.pop()]
                        is_open[last] -= 1
                        if last == name:
                            break
                continue
            if name in RAW:
                lower = lower or source.lower()
                if len(lower) != len(source):  # some characters change length in lower case
                    end = re.compile("</" + name, re.I).search(source, at)
                    end = end.start() if end else -1
                else:
                    end = lower.find("</" + name, at)
                if end < 0 and name not in ("script", "style"):
                    continue
                if end < 0:
                    break
                at = source.find(">", end) + 1 or len(source)
                continue
            if name == "a":
                in_link = 1
                continue
            if name in INLINE:
                continue
            if name in VOID:
                if name == "hr":
                    close()
                else:
                    run.append(" ")
                continue
            close()
            closes = CLOSES.get(name)
            while closes and self.tags[stack[-1]] in closes:
                is_open[self.tags[stack.pop()]] -= 1
            self._add(name, stack[-1], self._words(m[3]))
            if not (name == "svg" and m[0].endswith("/>")):
                stack.append(len(self.tags) - 1)
                is_open[name] = is_open.get(name, 0) + 1
        close()

    def _add(self, tag: str, parent: int, groups: tuple[int, ...]) -> None:
        self.tags.append(tag)
        self.parents.append(parent)
        self.groups.append(groups)
        self.texts.append([])
        self.links.append(0)

    @staticmethod
    def _words(attrs: str) -> tuple[int, ...]:
        if "=" not in attrs:
            return ()
        found = set()
        for a in _ATTR.finditer(attrs):
            for w in _WORD.findall(a[1] or a[2] or a[3] or ""):
                if (k := _GROUP_AT.get(w.lower())) is not None:
                    found.add(k)
        return tuple(found)

    def features(self) -> np.ndarray:
        """One row a node: numbers of its subtree, place and siblings; its tag; attribute words of its own and above it."""
        n = len(self.tags)
        tags, parents = self.tags, self.parents
        own = [len(t[0]) if t else 0 for t in self.texts]
        chars, links, nodes, paragraphs, stops = own[:], self.links[:], [1] * n, [0] * n, [0] * n
        for i, t in enumerate(self.texts):
            if t:
                stops[i] = len(_STOP.findall(t[0]))
        before, depth, index, children, same = [0] * n, [0] * n, [0] * n, [0] * n, {}
        seen = 0
        for i in range(n):
            before[i] = seen
            seen += own[i]
            if i:
                p = parents[i]
                depth[i] = depth[p] + 1
                index[i] = children[p]
                children[p] += 1
                same[p, tags[i]] = same.get((p, tags[i]), 0) + 1
        for i in range(n - 1, 0, -1):
            p = parents[i]
            chars[p] += chars[i]
            links[p] += links[i]
            nodes[p] += nodes[i]
            stops[p] += stops[i]
            paragraphs[p] += paragraphs[i] + (tags[i] == "p")
        out = np.zeros((n, N_NUMERIC + len(TAGS) + 2 * len(WORDS)))
        total = max(1, seen)
        above: list[frozenset] = [frozenset()] * n
        tag_above: list[int] = [0] * n  # 1 nav, header, footer, aside, form; 2 head
        for i in range(1, n):
            p = parents[i]
            above[i] = above[p].union(self.groups[p]) if self.groups[p] else above[p]
            t = tags[p]
            tag_above[i] = max(tag_above[p], 1 if t in ("nav", "header", "footer", "aside", "form", "button") else 2 if t in ("head", "title") else 0)
            c = chars[i] or 1
            out[i, :N_NUMERIC] = (
                depth[i], chars[i], links[i] / c, chars[i] / nodes[i], own[i], min(paragraphs[i], 30), min(index[i], 15), min(children[p] - index[i], 15), min(children[p], 30), same[p, tags[i]] / children[p],
                stops[i] / c, before[i] / total, chars[i] / total, links[p] / (chars[p] or 1), tag_above[i],
            )
            k = _TAG_AT.get(tags[i])
            if k is not None:
                out[i, N_NUMERIC + k] = 1
            for g in self.groups[i]:
                out[i, N_NUMERIC + len(TAGS) + g] = 1
            for g in above[i]:
                out[i, N_NUMERIC + len(TAGS) + len(WORDS) + g] = 1
        return out

    def decode(self, log_odds: np.ndarray) -> np.ndarray:
        """Of all choices in which nothing is kept below a dropped node, the likeliest: bottom up, then top down."""
        n = len(self.tags)
        keep = -np.logaddexp(0, -log_odds)
        drop = -np.logaddexp(0, log_odds)
        keep[0] = 0.0
        drop[0] = -np.inf
        keep, drop = keep.tolist(), drop.tolist()
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
        kept = np.ones(n, bool)
        for i in range(1, n):
            kept[i] = kept[self.parents[i]] and keep[i] >= drop[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks = (" ".join(html.unescape(t[0]).split()) for t, k in zip(self.texts, kept) if t and k)
        return "\n".join(b for b in blocks if b)


# Pages to learn from: made here by a fixed seed, in many layouts, each element marked with what it should be.

_SYLLABLES = "an be con de er fo ga hi in ka lo mi no or pa que re so ti un va wi xe ya zu".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *x):
        return x[self.r.integers(len(x))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        out = ["".join(self.pick(*_SYLLABLES) for _ in range(self.r.integers(1, 5))) for _ in range(n)]
        for k in range(n):
            if self.chance(0.12):
                out[k] += self.pick(".", ",", ".", "?", ";")
        return " ".join(out).capitalize() + self.pick(".", ".", "", "!")

    def tag(self, name: str, inner: str, keep: int, attr: str = "", end: bool = True) -> str:
        return f"<{name}{attr} data-keep={keep}>{inner}" + (f"</{name}>" if end else "")

    def attr(self, *words: str) -> str:
        if not words or self.chance(0.12):
            return ""
        w = self.pick(*words)
        w = self.pick(w, f"{w}-{self.r.integers(9)}", f"site-{w}", f"{w} box", f"c{self.r.integers(99)} {w}")
        return self.pick(f' class="{w}"', f' id="{w}"', f" class='{w}'", f' id={w.split()[0]}')

    def links(self, n: int) -> str:
        return "".join(f'<li data-keep=0><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def lost(self) -> str:
        """Something that isn't the article."""
        r, t = self.r, self.tag
        n = int(r.integers(3, 9))
        p = lambda a=4, b=30: t("p", self.words(a, b), 0)
        return self.pick(
            lambda: t("nav", t("ul", self.links(n), 0), 0, self.pick("", self.attr("menu", "main-nav", "breadcrumbs"))),
            lambda: t("div", t("ul", self.links(n), 0), 0, self.attr("menu", "navigation", "navbar", "pagination")),
            lambda: t("header", self.pick("", t("h1", self.words(1, 4), 0), t("div", self.words(1, 4), 0, self.attr("logo", "branding"))) + self.pick("", t("nav", t("ul", self.links(n), 0), 0)), 0, self.pick("", self.attr("header", "masthead"))),
            lambda: t("footer", self.pick(f"&copy; {self.words(3, 14)}", p(), t("ul", self.links(n), 0), t("div", self.words(3, 20), 0)), 0, self.pick("", self.attr("footer", "site-footer"))),
            lambda: t("div", self.pick(f"&copy; {self.words(3, 14)}", p(), t("ul", self.links(n), 0)), 0, self.attr("footer", "copyright", "bottom")),
            lambda: t("aside", t("h3", self.words(1, 4), 0) + self.pick(t("ul", self.links(n), 0), p(10, 50), p() + p()), 0, self.pick("", self.attr("sidebar", "related"))),
            lambda: t("div", t("h3", self.words(1, 4), 0) + self.pick(t("ul", self.links(n), 0), p(10, 50)), 0, self.attr("sidebar", "widget", "related", "trending", "right-rail")),
            lambda: t("div", self.pick(self.words(3, 25), p(3, 25), f'<a href="/x">{self.words(3, 12)}</a>'), 0, self.attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad")),
            lambda: t(self.pick("div", "section"), self.pick(self.words(5, 30), p(5, 30)) + self.pick("", t("button", self.words(1, 2), 0)), 0, self.attr("cookie-notice", "consent", "notice", "gdpr", "popup", "alert")),
            lambda: t("form", self.pick(self.words(1, 6), p(2, 12), t("div", f"<label>{self.words(1, 3)}</label><input>", 0)) + self.pick("", t("button", self.words(1, 2), 0)), 0, self.pick("", self.attr("newsletter", "login", "search"))),
            lambda: t("div", t("h3", self.words(1, 3), 0) + t("form", self.words(1, 6) + "<input>", 0), 0, self.attr("newsletter", "subscribe", "signup")),
            lambda: t("div", f'<a href="#">{self.words(1, 2)}</a> <a href="#">{self.words(1, 2)}</a>', 0, self.attr("share", "social", "follow")),
        )()

    def comments(self) -> str:
        t = self.tag
        one = lambda: t(self.pick("div", "li", "article"), self.pick("", t("div", self.words(1, 3), 0)) + self.pick(t("p", self.words(5, 60), 0), self.words(5, 60)), 0, self.attr("comment", "reply"))
        return t(self.pick("section", "div", "ul"), self.pick("", t("h3", self.words(1, 3), 0)) + "".join(one() for _ in range(self.r.integers(1, 6))), 0, self.attr("comments", "comment-list", "discussion", "reader-comments", "responses replies"))

    def article(self) -> str:
        t, r = self.tag, self.r
        out = [t("h1", self.words(1, 14), 1)] if self.chance(0.85) else []
        # some are very long, of short or of long paragraphs
        long = self.chance(0.06)
        for _ in range(int(r.integers(60, 300)) if long else int(r.integers(1, 14)) if self.chance(0.9) else 0):
            x = r.random()
            end = self.chance(0.85)
            if x < 0.68:
                out.append(t("p", self.words(1, int(self.pick(3, 20, 60, 120))), 1, end=end))
            elif x < 0.74:
                out.append(t("p", f"<b>{self.words(1, 20)}<br>", 1, end=False))
            elif x < 0.82:
                out.append(t(self.pick("h2", "h3"), self.words(1, 8), 1))
            elif x < 0.87:
                out.append(t(self.pick("ul", "ol"), "".join(t("li", self.words(1, 25), 1) for _ in range(r.integers(2, 6))), 1))
            elif x < 0.91:
                out.append(t(self.pick("blockquote", "pre"), self.words(5, 40), 1))
            elif x < 0.93:
                out.append(t("table", "".join(t("tr", "".join(t("td", self.words(1, 4), 1) for _ in range(3)), 1) for _ in range(3)), 1))
            elif x < 0.96:
                out.append(t("p", f'{self.words(2, 20)} <a href="/y">{self.words(1, 5)}</a> {self.words(1, 10)}', 1))
            else:
                out.append(self.pick(self.lost, lambda: t("div", self.words(3, 20), 0, self.attr("ad", "advert", "promo", "related")))())
        body = "".join(out)
        if self.chance(0.2):
            body = t("div", body, 1, self.attr("content", "entry-content", "article-body", "text"))
        x = r.random()
        if x < 0.55:
            return t("article", body, 1, self.pick("", self.attr("article", "post", "story")))
        if x < 0.7:
            return t("main", body, 1, self.pick("", self.attr("content", "main")))
        if x < 0.95:
            return t(self.pick("div", "section"), body, 1, self.attr("article", "content", "post", "main-content", "entry", "story-body"))
        return body

    def page(self) -> str:
        t = self.tag
        head = t("head", f'<meta charset="utf-8">{t("title", self.words(1, 12), 0)}<style>p{{margin:0}}</style><script>var t="</p>";</script>', 0)
        top = "".join(self.lost() for _ in range(self.r.integers(0, 4)))
        bottom = (self.comments() if self.chance(0.4) else "") + "".join(self.lost() for _ in range(self.r.integers(0, 4)))
        main = self.article()
        if self.chance(0.15):
            main += self.comments()
        if self.chance(0.3):
            main = t(self.pick("div", "main", "section"), main + (self.lost() if self.chance(0.4) else ""), 1, self.attr("page", "wrapper", "main", "container"))
        return f"<!DOCTYPE html><html data-keep=1>{head if self.chance(0.95) else ''}" + t("body", top + "<!-- x -->" + main + bottom, 1, end=self.chance(0.8))


_MARK = re.compile(r"data-keep=(\d)")


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A made page, and what each of its nodes should be; a text is as its element."""
    marks = iter(_MARK.findall(source))
    page = Page(_MARK.sub("", source))
    want = np.ones(len(page.tags), int)
    for i in range(1, len(page.tags)):
        want[i] = want[page.parents[i]] if page.tags[i] == "#text" else int(next(marks))
        want[i] &= want[page.parents[i]]
    return page, want


@lru_cache(maxsize=1)
def model(pages: int = 600, seed: int = 11) -> boosting.Trees:
    """Trees fitted to ``pages`` made pages: the bound of the sample that they are learned from."""
    maker = _Maker(seed)
    x, y = zip(*((p.features()[1:], w[1:]) for p, w in (labelled(maker.page()) for _ in range(pages))))
    return boosting.fit(np.concatenate(x), np.concatenate(y).astype(float))


def main_texts(sources: list[str], trees: boosting.Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    features = [p.features() for p in pages]
    odds = trees.log_odds(np.concatenate(features)) if features else np.zeros(0)
    out, at = [], 0
    for p in pages:
        n = len(p.tags)
        out.append(p.text(p.decode(odds[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    text holds the blocks of the article in page order, joined by line ends; within a block character references are decoded
    and white space is one space. It is empty where the html is null or empty, or no node is kept. Whole pages are read,
    nothing is shuffled. Repeated rows each get a row; an empty table gives none; other columns aren't looked at.
    """
    spark = ship(pages.sparkSession)
    sent = spark.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
