"""Operator 2: main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser gives events; block elements end lines. Each line has a ratio of text outside
links to tags. Smoothed with a Gaussian along the page, the ratios are parted by a threshold into two clusters, and the
runs of the upper one are the content regions. The article is the article or main element that holds nearly all of
their text (with other articles of the page at least half as long as the longest), or else the smallest container that holds all regions; its lines are returned without those of boilerplate
elements, and without its blocks of links if it isn't an article element. An element is not boilerplate by a word of
its class, id or role (or as a form) if it wraps the page's article or main element, or far more of the text than what is left without it. A
name of several words, as "related-work", is only a doubt, which the ratio settles: what lies in regions of half the threshold or more stays. And within the article runs of lines of
links alone go if the smoothed ratio falls under the threshold in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import read_table

# HTML's elements by role.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article main section div body td html".split())
NOT_CONTENT = set("aside button canvas datalist dialog footer head iframe math menu nav noscript object optgroup option script select style svg template textarea title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
LIMITS_CLOSING = set("ol ul dl table article section div body html main td th".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html"}
# Words in class, id and role that name boilerplate.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentary commentlist consent contentinfo complementary cookie cookies copyright disclaimer discussion disqus dropdown feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications outbrain overlay pager pagination paywall popup popups promo promoted promotion recommendations recommended related replies respond search share sharing sidebar sidenav signin signup skip skyscraper social sponsor sponsored subscribe subscription taboola teaser teasers toolbar topbar widget widgets".split()
)
# Of these the ones that name reader comments, whose prose no ratio tells from an article's; and words of layout, which say nothing beside another word.
COMMENTS = set("comment comments commentary commentlist discussion disqus feedback replies respond".split())
LAYOUT = set("area article articles bar block blocks bottom box button buttons column container content data div field fixed global group header inner item items js left link links list main module outer page panel post posts primary right row secondary section site slot stories story text title top unit wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG_START = re.compile(r"<[A-Za-z/!?]")
SIGMA = 1.5
SHARE = 0.9
# Times the text left without it that an element marked by a word must hold to count as a wrapper: on pages without article text, and with it.
WRAPS, WRAPS_ARTICLE = 2, 10


class Lines(HTMLParser):
    """Collects the page's lines: text, tags, characters in links, container, whether all of it is boilerplate, and the innermost element marked by a word."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # name, in boilerplate, container, marked element
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
        self.parents: list[tuple[int, str]] = [(-1, "root")]  # containers: parent and name
        self.marked: list[int] = [-1]  # elements marked by a word: parent; the first stands for none
        self.doubtful: list[int] = []  # containers marked by a word among others that aren't boilerplate's or layout's
        self.articles: list[tuple[int, int]] = []  # unmarked main and outermost article elements: container and marked element around it
        self.lines: list[tuple[str, int, int, int, bool, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            skip, container, mark = self.stack[-1][1:] if self.stack else (False, 0, 0)
            self.lines.append((text, max(self.tags, 1), self.linked, container, skip, mark))
            self.tags = 0
        self.parts, self.linked = [], 0

    # Markup that ends at no ">" doesn't come here (see ``main_text``), and what isn't a comment, tag or doctype is read as a comment.
    def parse_comment(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find("-->", i + 2)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    parse_marked_section = parse_bogus_comment = parse_pi = lambda self, i, report=True: self.parse_html_declaration(i)

    def drop(self, depth: int) -> None:
        for name, *_ in self.stack[depth:]:
            self.links -= name == "a"
            self.open[name].pop()
        del self.stack[depth:]

    def deepest(self, names: set[str]) -> int:
        """The innermost open element of these names; -1 if there is none."""
        return max((places[-1] for n in names if (places := self.open.get(n))), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            closing = set(CLOSES.get(tag, ())) | ({"p"} if tag in ENDS_PARAGRAPH else set())
            depth = self.deepest(closing)
            if depth >= 0 and depth >= self.deepest(LIMITS_CLOSING):
                self.drop(depth)
        elif tag in ("br", "img"):
            self.parts.append(" ")
        if tag in VOID:
            return
        skip, container, mark = self.stack[-1][1:] if self.stack else (False, 0, 0)
        starts = False
        word = self.has_word(attrs)
        doubtful = not word and not skip and tag not in ("html", "body", "article", "main") and self.has_word(attrs, among_others=True)
        if not skip:
            skip = starts = tag in NOT_CONTENT or tag == "header" and not self.open.get("article") and not self.open.get("main") or tag not in ("html", "body", "article", "main") and self.hidden(attrs)
        if tag in CONTAINERS or doubtful:
            self.parents.append((container, tag))
            container = len(self.parents) - 1
        if doubtful:
            self.doubtful.append(container)
            starts = True
        if tag in ("article", "main"):
            if not word and not skip and not self.open.get("article"):
                self.articles.append((container, mark))
        elif (word or tag == "form") and not skip and tag not in ("html", "body"):  # a form that holds the page's text is a wrapper, as of a word
            self.marked.append(mark)
            mark, starts = len(self.marked) - 1, True
        self.links += tag == "a"
        if starts:
            self.flush()
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, skip, container, mark))

    @staticmethod
    def hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and re.search(r"display\s*:\s*none", value) for key, value in attrs)

    @staticmethod
    def has_word(attrs: list[tuple[str, str | None]], among_others: bool = False) -> bool:
        """Whether a name in class, id or role has a word of boilerplate: one of comments, or beside layout words only (or ``among_others``)."""
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                for name in value.split():
                    words = {w.lower() for w in _WORD.findall(name)}
                    if words & BOILERPLATE and (among_others or words & COMMENTS or words <= BOILERPLATE | LAYOUT):
                        return True
        return False

    def boilerplate(self) -> list[bool]:
        """Of each line, whether it is boilerplate: in such an element, or in one marked by a word that isn't a wrapper."""
        if len(self.marked) == 1:
            return [x[4] for x in self.lines]
        free = [0 if x[4] else max(len(x[0]) - x[2], 0) for x in self.lines]
        held, text = [0] * len(self.parents), [0] * len(self.marked)
        for x, n in zip(self.lines, free):
            held[x[3]] += n
            text[x[5]] += n
        for sums, up in ((held, [p for p, _ in self.parents]), (text, self.marked)):  # parents come before what they hold
            for c in range(len(sums) - 1, 0, -1):
                sums[up[c]] += sums[c]
        wrapper = [True] + [False] * (len(self.marked) - 1)  # the first stands for what no word marks
        largest = max((held[c] for c, _ in self.articles if self.parents[c][1] == "article"), default=0)
        for c, mark in self.articles:  # articles much smaller than the largest are teasers or comments
            if held[c] and (self.parents[c][1] == "main" or 2 * held[c] >= largest):
                while not wrapper[mark]:
                    wrapper[mark] = True
                    mark = self.marked[mark]
        inside = [False] * len(self.parents)
        for c, _ in self.articles:
            inside[c] = True
        for c in range(1, len(self.parents)):
            inside[c] |= inside[self.parents[c][0]]
        # Text directly in each marked element, and whether some of it is in an article; a wrapper's parents are wrappers too.
        direct, in_article = [0] * len(self.marked), [False] * len(self.marked)
        for x, n in zip(self.lines, free):
            direct[x[5]] += n
            in_article[x[5]] |= n > 0 and inside[x[3]]
        left = sum(n for n, w in zip(direct, wrapper) if w)
        article = any(x and w for x, w in zip(in_article, wrapper))
        for m in sorted(range(1, len(self.marked)), key=lambda m: (-text[m], m)):
            if text[m] <= (WRAPS_ARTICLE if article else WRAPS) * left:
                break
            if not wrapper[m] and wrapper[self.marked[m]]:
                wrapper[m] = True
                left += direct[m]
                article |= in_article[m]
        return [x[4] or not wrapper[x[5]] for x in self.lines]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        depth = self.deepest({tag})
        if depth >= 0:
            outer = self.stack[depth - 1][1::2] if depth else (False, 0)
            if tag in BLOCKS or self.stack[depth][1::2] != outer:
                self.flush()
            self.drop(depth)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    mass = np.convolve(np.ones(len(ratio)), kernel, "same") if len(ratio) >= len(kernel) else np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    total = np.convolve(ratio, kernel, "same") if len(ratio) >= len(kernel) else np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return total / mass


def threshold(ratio: np.ndarray) -> float:
    """Between two clusters of the ratios: the middle of their means, repeated until it stays; one cluster is all content."""
    low, high = float(ratio.min()), float(ratio.max())
    cut = (low + high) / 2
    for _ in range(50):
        upper, lower = ratio[ratio >= cut], ratio[ratio < cut]
        new = (upper.mean() + lower.mean()) / 2 if len(upper) and len(lower) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = float(new)
    return min(cut, float(ratio.mean()))


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines; empty for a null or empty page, or one without text."""
    if not html:
        return ""
    page = Lines()
    # What follows the last ">" has no whole tag: its text ends where another tag would begin.
    end = html.rfind(">") + 1
    tail = _TAG_START.search(html, end)
    page.feed(html[: tail.start()] if tail else html)
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    skip = page.boilerplate()
    size = np.array([len(x[0]) for x in lines], float)
    free = np.array([0.0 if out else max(len(x[0]) - x[2], 0) for x, out in zip(lines, skip)])
    if not free.any():
        return ""
    ratio = smoothed(free / np.array([x[1] for x in lines]))
    cut = threshold(ratio)
    content = (ratio >= cut) & (free > 0)
    if not content.any():
        content = free > 0
    # An article or main element that holds nearly all of the regions' text is taken whole; else the smallest container of all regions.
    weight = np.zeros(len(page.parents))
    for k in np.flatnonzero(content):
        weight[lines[k][3]] += size[k]
    for c in range(len(weight) - 1, 0, -1):  # parents come before what they hold
        weight[page.parents[c][0]] += weight[c]
    best = max(c for c in range(len(weight)) if weight[c] >= SHARE * weight[0])
    up, whole = best, -1
    while up >= 0:
        if page.parents[up][1] in ("article", "main"):
            whole = up
            if page.parents[up][1] == "article":
                break
        up = page.parents[up][0]
    blocks = set()
    if whole < 0:
        best = max(c for c in range(len(weight)) if weight[c] >= weight[0])
        # Containers of mostly links that hold no region, as menus without a name.
        text, linked = np.zeros(len(weight)), np.zeros(len(weight))
        for x in lines:
            text[x[3]] += len(x[0])
            linked[x[3]] += x[2]
        for c in range(len(weight) - 1, 0, -1):
            text[page.parents[c][0]] += text[c]
            linked[page.parents[c][0]] += linked[c]
        blocks = {int(c) for c in np.flatnonzero((weight == 0) & (linked > text / 2))}
    inside = {whole if whole >= 0 else best}
    if whole >= 0 and page.parents[whole][1] == "article":  # with it others of its page that aren't much smaller
        held = np.bincount([x[3] for x in lines], weights=free, minlength=len(weight))
        for c in range(len(weight) - 1, 0, -1):
            held[page.parents[c][0]] += held[c]
        largest = max([held[whole], *(held[c] for c, _ in page.articles if page.parents[c][1] == "article")])
        inside |= {c for c, _ in page.articles if page.parents[c][1] == "article" and held[c] and 2 * held[c] >= largest}
    for c in range(len(page.parents)):
        if page.parents[c][0] in inside and c not in blocks:
            inside.add(c)
    # What is marked by a word among others is kept if most of its text lies in regions of half the threshold or more, and not in links.
    place = np.array([x[3] for x in lines])
    in_links = np.array([x[2] for x in lines], float)
    total, good, linked = (np.bincount(place, weights=w, minlength=len(page.parents)) for w in (free, free * (ratio >= cut / 2), in_links))
    for c in range(len(page.parents) - 1, 0, -1):
        total[page.parents[c][0]] += total[c]
        good[page.parents[c][0]] += good[c]
        linked[page.parents[c][0]] += linked[c]
    out_of = np.zeros(len(page.parents), bool)
    out_of[np.array(page.doubtful, int)] = True
    out_of &= (2 * good < total) | (total == 0) | (linked > total)
    for c in range(1, len(page.parents)):
        out_of[c] |= out_of[page.parents[c][0]]
    doubted = out_of[place]
    # Within the article, runs of lines of links alone are told by their ratio: they go as a whole if it falls under the threshold in them. One such line is a heading or a source.
    linked_only = np.array([2 * x[2] > len(x[0]) for x in lines])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], linked_only, [0]])))
    menu = np.zeros(len(lines), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        menu[a:b] = b - a > 1 and ratio[a:b].min() < cut
    kept = np.array([x[3] in inside and not out for x, out in zip(lines, skip)]) & ~menu & ~doubted
    return "\n".join(x[0] for x, k in zip(lines, kept) if k)


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the page's main text (see ``main_text``). Rows keep their other columns; a column named ``out`` is replaced.

    Whole pages are parsed, however long, in time linear in their length; broken markup is read as a browser would: an
    unknown section is a comment, and an unfinished tag or comment at the end goes. Repeated rows give equal texts; an
    empty table gives an empty one.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index(html)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array([main_text(p) for p in pages], pa.string())], names=[*names, out])

    return df.mapInArrow(run, schema)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
