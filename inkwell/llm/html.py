"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead title tr ul".split())
#: Elements that hold no content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article. A form can be wrapped around a whole page, so it's judged by what it holds.
DROPPED = frozenset(
    "aside audio button canvas dialog footer head iframe menu nav noscript object option script search select "
    "style svg template textarea title video".split())
#: Elements that hold the main content where a page has them.
HOLDERS = frozenset(("article", "main"))
#: Words in a class, id or role that mark menus, notices, adverts, comments and the like, wherever a name begins with them.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts breadcrumb breadcrumbs comment commentlist comments cookie cookies disqus footer gdpr "
    "masthead menu nav navbar navigation newsletter pagination paywall popup promo sidebar sponsor sponsored sponsors".split())
#: Words that mark the same if they stand alone or beside words of layout.
WEAK = frozenset(
    "alert alertdialog banner complementary consent contentinfo copyright dialog disclaimer hidden login modal notice notification overlay "
    "pager promoted promotion recommended related replies respond responses search share sharing signup skip social subscribe "
    "subscription tags toolbar widget".split())
#: Words of layout, which say nothing of what an element is.
PLAIN = frozenset(
    "area bar block bottom box byline card center column container content fixed form global group header inner item items left link "
    "links list main message modal outer page panel post posts primary region right row secondary section site sticky text top unit "
    "wrap wrapper".split())
#: Words of prose. A name with one of them, as comments-on-policy, is made from a heading and says what a part is about.
PROSE = frozenset("a about and by for from in is of on or s the to with".split())
#: Elements in which a label is part of a sentence, and headings.
SENTENCES = ("p", "li", "dd", "td", "blockquote", "figcaption")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own text, outside any block within, is a box beside the paragraphs of a page that has paragraphs.
BOXES = frozenset("#page body center div section".split())
#: Elements that can be a menu.
GROUPS = frozenset("div dl ol p section table ul".split())
#: An open element on the left is closed by a start tag on the right.
CLOSES = {
    "p": BLOCKS - {"caption", "optgroup", "option", "tbody", "tfoot", "thead", "tr"} | {"td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": (BLOCKS | {"body"}) - {"title"}}
#: Elements that can be the article where there is no article or main element.
REGIONS = frozenset("#page body center div html section td".split())
#: How far up an open element is looked for.
FENCES = frozenset("article aside body button div footer form header html main nav section table ul ol dl td th template".split())

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COMMENT_END = re.compile(r"--!?>")

#: A class that begins so tells of a page's layout, not of what an element is.
LAYOUT = frozenset("has is no with without".split())
#: What an element's names or tag say of it: content, doubtful, to be judged as a form, or no content.
CONTENT, DOUBTFUL, FORM, OUT = range(4)


def marked(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """CONTENT, DOUBTFUL or OUT by an element's attributes.

    A name in a class, id or role marks an element if it begins with a word of MARKS, or has one of WEAK and else only
    words of PLAIN. One of WEAK beside other words, or of MARKS in a name with words of PROSE, leaves doubt: what such an
    element holds decides. For a holder a
    class must be one such word alone, or begin with comment, so that its other properties don't count against it.
    """
    said = CONTENT
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for part in (value or "").split():
                words = [w.lower() for w in WORD.findall(part)]
                if not words or words[0] in LAYOUT:
                    continue
                if tag in HOLDERS:
                    if len(words) == 1 and words[0] in MARKS | WEAK or words[0] == "comment":
                        return OUT
                elif words[0] in MARKS and PROSE.isdisjoint(words[1:]) or not WEAK.isdisjoint(words) and WEAK.union(MARKS, PLAIN).issuperset(words):
                    return OUT
                elif words[0] in MARKS or not WEAK.isdisjoint(words):
                    said = DOUBTFUL
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return OUT
    return said


class Lines(HTMLParser):
    """Turns parser events into lines: one for each block, with its text, its tags and the element that holds it.

    What is no content by its tag or names gives no line. Every event costs a bounded time on average, however deep
    elements are nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # (tag, element, begins a block, silent)
        self.fences: list[int] = []  # places in open of elements that start tags can end, or that stop the search
        self.held = Counter()  # open elements of each tag
        self.silent = 0
        self.parent, self.kind, self.said = [-1], ["#page"], [CONTENT]
        self.lines: list[tuple[str, int, int, int]] = []  # (text, tags, element, characters in links)
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0, self.linked))
        self.text, self.tags, self.linked = [], 0, 0

    def _leave(self, depth: int):
        if any(block for _, _, block, _ in self.open[depth:]):
            self.flush()
        for tag, _, _, silent in self.open[depth:]:
            self.held[tag] -= 1
            self.silent -= silent
        del self.open[depth:]
        while self.fences and self.fences[-1] >= depth:
            self.fences.pop()

    def _closed_by(self, tag) -> int:
        """Place of the open element that a start tag ends, or -1."""
        for i in reversed(self.fences):
            t = self.open[i][0]
            if tag in CLOSES.get(t, ()):
                return i
            if t in FENCES:
                break
        return -1

    def handle_starttag(self, tag, attrs):
        cell = tag in ("td", "th")
        while (i := self._closed_by(tag)) >= 0:
            self._leave(i)
        if tag == "br" or cell:
            self.handle_data(" ")
        inside = self.held["article"] + self.held["main"] > 0
        labels = tag == "label" and (self.held["form"] or not any(self.held[t] for t in SENTENCES))
        said = OUT if tag in DROPPED or labels or tag == "header" and not inside or tag == "form" and inside else FORM if tag == "form" else CONTENT
        if attrs and said < OUT and tag not in ("html", "body"):
            said = max(said, marked(tag, attrs))
        block = tag in BLOCKS
        if said == DOUBTFUL and not block:
            said = CONTENT
        if block:
            self.flush()
        if not self.silent:
            self.tags += said < OUT
        if tag in VOID:
            if block:
                self.flush()
            return
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.kind.append(tag)
        self.said.append(said)
        if tag in CLOSES or tag in FENCES:
            self.fences.append(len(self.open))
        self.open.append((tag, len(self.kind) - 1, block, said == OUT))
        self.held[tag] += 1
        self.silent += said == OUT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.held[tag]:
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if not self.silent:
            self.tags += 1
        self._leave(i)
        if tag in ("td", "th"):
            self.handle_data(" ")

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.held["a"]:
                self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        """A section in <![ ... > is a comment, as browsers take it; one without an end is the rest of the page."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_comment(self, i, report=1):
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    reach = max(1, int(np.ceil(2 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = lambda y: np.convolve(y, k)[reach:reach + len(x)]
    return cut(x) / cut(np.ones(len(x)))


def content_lines(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Lines of the upper of two clusters of the smoothed ratio: the threshold is the mean of the clusters' means."""
    if not len(ratio):
        return np.zeros(0, bool)
    s = np.log1p(smooth(ratio, sigma))
    level = s.mean()
    for _ in range(50):
        up = s > level
        if up.all() or not up.any():
            break
        new = (s[up].mean() + s[~up].mean()) / 2
        if abs(new - level) < 1e-9:
            break
        level = new
    return s >= level


def _subtrees(own: list[int], parent: list[int]) -> list[int]:
    """Sums over each element and all below it; an element comes after its parent."""
    total = list(own)
    for e in range(len(own) - 1, 0, -1):
        total[parent[e]] += total[e]
    return total


def _region(p: Lines, weight: list[int], paragraphs: list[int]) -> int:
    """The element that holds the content lines, by their length in each subtree.

    An article or main element with a quarter of it or more, the one with most; else the innermost element that holds
    85 % of the content in ``paragraphs``, where content lines that are a box's own text don't vote.
    """
    holders = [e for e, kind in enumerate(p.kind) if kind in HOLDERS and 4 * weight[e] >= weight[0] > 0]
    if holders:
        best = max(holders, key=lambda e: (weight[e], p.kind[e] == "article", -e))
        inner = [e for e in holders if p.kind[e] == "article" and 2 * weight[e] > weight[best]]
        return max(inner, key=lambda e: weight[e]) if inner and p.kind[best] == "main" else best
    return max((e for e in range(len(p.kind)) if paragraphs[e] >= 0.85 * paragraphs[0] > 0 and p.kind[e] in REGIONS), default=0)


def _menus(p: Lines, weight: list[int]) -> list[bool]:
    """Elements without content lines whose text is in links, in two or more: menus, where nothing else tells.

    A heading among them is a reason to stay.
    """
    n = len(p.kind)
    said, linked, links, kept = ([0] * n for _ in range(4))
    for text, _, e, chars in p.lines:
        said[e] += len(text.replace(" ", ""))
        linked[e] += chars
        links[e] += chars > 0
        kept[e] += p.kind[e] in HEADINGS
    said, linked, links, kept = (_subtrees(x, p.parent) for x in (said, linked, links, kept))
    return [p.kind[e] in GROUPS and not weight[e] and not kept[e] and links[e] > 1 and 2 * linked[e] > said[e] for e in range(n)]


def extract(html: str | None) -> str:
    """Main text of one page: its blocks, white space as one space each, joined by empty lines."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    lines, n = p.lines, len(p.kind)
    ratio = np.array([len(t) / max(1, tags) for t, tags, _, _ in lines])
    dense = content_lines(ratio)
    alone = dense & (ratio >= ratio[dense].mean() / 4) if dense.any() else dense  # not by its neighbours only

    def weigh(lit, gone):
        own = [0] * n
        for (text, _, e, _), up in zip(lines, lit.tolist()):
            if up and not gone[e]:
                own[e] += len(text)
        return _subtrees(own, p.parent)

    gone = [False] * n
    weight, proven = weigh(dense, gone), weigh(alone, gone)
    for e in range(1, n):
        empty = p.said[e] == DOUBTFUL and not proven[e] or p.said[e] == FORM and 2 * weight[e] <= weight[0]
        gone[e] = gone[p.parent[e]] or empty
    weight = weigh(dense, gone)
    paragraphs = weigh(dense, [g or kind in BOXES for g, kind in zip(gone, p.kind)])
    best, under = _region(p, weight, paragraphs if 2 * paragraphs[0] >= weight[0] else weight), [False] * n
    under[best] = True
    menu = _menus(p, weight) if p.kind[best] not in HOLDERS and weight[0] else gone
    for e in range(best + 1, n):
        under[e] = under[p.parent[e]] and not menu[e]
    return "\n\n".join(t for t, _, e, _ in lines if t and under[e] and not gone[e])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, from the whole html.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by element,
    role, class or id, are left out first. Every other block is a line with a text-to-tag ratio. Ratios are smoothed
    and split into two clusters; the lines of the upper one are content. They decide which element is the article, of
    which all blocks are kept, but for groups of links without content lines where no article or main element is given;
    whether a block with a doubtful name is content; and whether a form is a wrapper of the page (it holds more than half
    of the content). Null or empty html gives ''; a very long or deeply nested page takes
    time in proportion to its length. Repeated rows give equal results, an empty table an empty one; other columns are
    ignored. No shuffle.
    """

    def run(batches):
        for b in batches:
            text = [extract(h) for h in b.column(len(keep)).to_pylist()]
            size = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(text, pa.string()), size], [*keep, "text", "n_chars"])

    src = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:len(keep)])
    return src.mapInArrow(run, f"{kinds}, text string, n_chars long")
