"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one per block element. A line counts with its text length, or with zero if it is mostly
links or belongs to a menu, notice, form and the like. Sums over sliding windows of lines give the distribution: text
is kept from where it surges to where it dives to zero, and so are other lines of the same container. Lines outside an
article or main element weigh less if the page has one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from trialscope.llm.common import fields, frugal, slices

#: Lines of a window, its least weight to be a surge outside a main element, and the weight of a character there if
#: the page has such an element.
WINDOW, SURGE, OUTSIDE = 3, 80, 0.25

#: Element and attribute names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th wbr option img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object select button canvas audio video".split())
NOT_TEXT = frozenset("nav footer aside menu dialog head search".split())
MAIN = frozenset("article main".split())
INNER = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr center address details summary".split())
#: Elements whose ids are slugs.
SLUGGED = frozenset("p h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar copyright disclaimer skip banner".split())

#: First parts of a class that say what is not there or only that a page has it, and names of talk.
NEGATIONS = frozenset("has have no not with without hide is".split())
TALK = frozenset("comment comments commentlist disqus respond replies".split())

#: Last parts of a name that say it is a box on a page, not the slug of a heading.
BOXES = frozenset("area bar block box boxes buttons card cards container form frame icons inner items links list module panel posts section slot stories strip unit wrap wrapper".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)")

# a quote opens a value only after an equals sign
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")

CLEAN, FORM, SOFT, TALKING, HARD = range(5)


class Line(NamedTuple):
    """A block with text: hard if an element or role around it is never text; the number of the innermost element around
    it that is a form or whose class or id is unwanted, 0 if none; whether it lies in a main element; the share of link
    characters; the number of its container; and of its outermost article, 0 if none."""

    text: str
    hard: bool
    soft: int
    main: bool
    share: float
    holder: int
    article: int


def _named(words: str, in_main: bool, tag: str, slug: bool) -> int:
    """Whether a class or id is one of NAMES: whole, or as the first or last part of a hyphenated one. In a main element a
    first part counts only in the name of a box, and in an id, which may be a heading's slug, a last part doesn't."""
    out = CLEAN
    for word in words.split():
        parts = [p for p in _PART.split(word) if p]
        if not parts or len(parts) > 1 and parts[0] in NEGATIONS:
            continue
        ends = {word, parts[0], parts[-1]}
        if in_main and len(parts) > 1:
            box = parts[-1] in BOXES or parts[-1] in NAMES
            ends = {word} | ({parts[0]} if box or not slug and parts[0] in TALK else set()) | (set() if slug else {parts[-1]})
        if ends & TALK:
            return TALKING
        if ends & NAMES or "header" in ends and not in_main and tag not in ("h1", "h2", "h3"):
            out = SOFT
    return out


def _unwanted(tag: str, attributes: str, in_main: bool, in_form: bool) -> int:
    if tag in NOT_TEXT or tag == "header" and not in_main or tag in ("label", "legend") and in_form:
        return HARD
    if tag in ("html", "body"):
        return CLEAN
    out = FORM if tag == "form" else CLEAN
    for name, value in _ATTR.findall(attributes) if attributes else ():
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES and tag not in MAIN:
            return HARD
        if name == "style" and _HIDDEN.search(value):
            return HARD
        if name == "class" and tag not in MAIN or name == "id" and tag not in MAIN and tag not in SLUGGED:
            out = max(out, _named(value, in_main, tag, name == "id"))
    return out


class _Open(NamedTuple):
    tag: str
    hard: bool
    soft: int
    main: bool
    article: bool


class Page:
    """A page's lines, in page order, and what is known of its softly unwanted elements."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.parent = [0]  # of each soft the one around it, 0 none; a soft's number is greater than its parent's
        self.talk = [False]  # whether a soft is comments and the like, or lies in such
        self.form = [False]  # whether it is a form
        self.marked = False  # whether it has a main element, comments' apart
        self.around: dict[int, int] = {}  # the soft around each outermost article
        self.lifted: set[int] = set()  # softs around a main element: wrappers, not boxes
        self._read(page)

    def _read(self, page: str) -> None:
        open_: list[_Open] = []
        count: Counter[str] = Counter()  # of open elements by tag
        holders = [0]  # the container within each open element, and 0 for the page
        soft = muted = hard = main = links = opened = articles = article = linked = 0
        parts: list[str] = []

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.lines.append(Line(text, hard > 0, soft, main > 0, linked / len(text), holders[-1], article if articles else 0))
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not muted:
                parts.append(text := unescape(text))
                if links:
                    linked += len(text.strip())

        def close() -> str:
            nonlocal hard, main, soft, muted, articles
            e = open_.pop()
            holders.pop()
            count[e.tag] -= 1
            hard, main, articles = hard - e.hard, main - e.main, articles - e.article
            muted -= e.hard and e.tag not in BLOCKS
            if e.soft:
                soft = self.parent[e.soft]
            return e.tag

        at, size, lower = 0, len(page), None
        while at < size:
            m = _TAG.search(page, at)
            if not m:
                add(page[at:])
                break
            add(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                if m[3].endswith("/") and tag in ("svg", "math"):
                    continue
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == size else page.find(f"</{tag}", at)
                at = size if end < 0 else end
                if tag in BLOCKS:
                    flush()
                continue
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
                continue
            if tag in SPACED:
                parts.append(" ")
                continue
            what = CLEAN if closing or tag in VOID else _unwanted(tag, m[3], main > 0, count["form"] > 0)
            if tag not in BLOCKS and not what and not (closing and any(e.tag == tag for e in open_[-3:])):
                continue
            if tag in BLOCKS:
                flush()
                links = 0
            else:
                parts.append(" ")
            if closing:
                if count[tag]:
                    if tag not in BLOCKS and open_[-1].soft:
                        flush()
                    while close() != tag:
                        pass
            elif tag not in VOID and not m[3].endswith("/"):
                if tag in ("p", "li") and open_ and open_[-1].tag == tag:
                    close()
                if tag not in BLOCKS and what != HARD:
                    flush()
                muted += what == HARD and tag not in BLOCKS  # within a line: it goes on behind
                opened += 1
                boxed = what in (FORM, SOFT, TALKING)
                if boxed:
                    self.talk.append(what == TALKING or self.talk[soft])
                    self.form.append(what == FORM)
                    self.parent.append(soft)
                    soft = len(self.parent) - 1
                e = _Open(tag, what == HARD, soft if boxed else 0, tag in MAIN, tag == "article")
                open_.append(e)
                count[tag] += 1
                holders.append(holders[-1] if tag in INNER else opened)
                if e.article and not articles:
                    article = opened
                    self.around[opened] = soft
                hard, main, articles = hard + e.hard, main + e.main, articles + e.article
                self.marked |= e.main and not hard and not self.talk[soft]
                if tag == "main" and not hard:
                    self.lifted.add(soft)
        flush()

    def _within(self, good: Callable[[int], bool]) -> list[bool]:
        """Of each soft, whether it and all around it are good."""
        out = [True]
        for s in range(1, len(self.parent)):
            out.append(out[self.parent[s]] and good(s))
        return out

    def _lift(self) -> list[bool]:
        """Lifts what stands around lifted softs; of each soft, whether it and all around it are lifted."""
        for s in range(len(self.parent) - 1, 0, -1):
            if s in self.lifted:
                self.lifted.add(self.parent[s])
        return self._within(self.lifted.__contains__)

    def wanted(self) -> list[bool]:
        """Which lines are neither hard nor in an unwanted element. An element around a main element is a wrapper; so
        are those around the longest article, comments apart, if the page has no other main element; and so is a form
        that holds most of the text, if the page has no main element at all."""
        clear = self._lift()
        if not any(x.main and not x.hard and clear[x.soft] for x in self.lines):
            size: Counter[int] = Counter()
            for x in self.lines:
                if x.article and not x.hard and not self.talk[x.soft] and x.soft == self.around[x.article]:
                    size[x.article] += len(x.text)
            if size:
                self.lifted.add(self.around[max(size, key=lambda k: (size[k], -k))])
            elif not self.marked:
                held = [0] * len(self.parent)
                own = self._within(lambda s: self.form[s] or s in self.lifted)
                for x in self.lines:
                    held[x.soft] += len(x.text) if not x.hard and own[x.soft] else 0
                for s in range(len(self.parent) - 1, 0, -1):
                    held[self.parent[s]] += held[s]
                self.lifted.update(s for s in range(1, len(self.parent)) if self.form[s] and own[s] and 2 * held[s] > held[0])
            clear = self._lift()
        return [not x.hard and clear[x.soft] for x in self.lines]


def _regions(weights: list[float], least: float) -> set[int]:
    """The lines of all regions from a surge to a dive."""
    out: set[int] = set()
    blocks = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    i = 0
    while i < len(weights):
        if weights[i] and blocks[i] >= least:  # surge
            while i < len(weights) and blocks[i] > 0:
                out.add(i)
                i += 1  # until the dive
        i += 1
    return {k for k in out if weights[k]}


def main_text(page: str | None) -> str:
    """The article of a page. Null, empty and text-free pages give an empty string."""
    read = Page(page or "")
    lines, wanted = read.lines, read.wanted()
    named = any(x.main and w for x, w in zip(lines, wanted, strict=True))
    inside = [len(x.text) if x.main and w else 0 for x, w in zip(lines, wanted, strict=True)]
    outside = [0 if not w or x.main or x.share > 0.5 else len(x.text) * (OUTSIDE if named else 1) for x, w in zip(lines, wanted, strict=True)]
    most = max((sum(outside[i : i + WINDOW]) for i in range(len(lines))), default=0)
    kept = _regions(outside, SURGE if named or most >= SURGE else 1)
    holders = {lines[k].holder for k in kept}
    kept |= {k for k, line in enumerate(lines) if outside[k] and line.holder in holders}
    kept |= _regions(inside, 1)
    return "\n\n".join(lines[k].text for k in sorted(kept))


@frugal
def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. No shuffle; repeated rows and null ids stay as they are,
    a null or empty page gives an empty text, an empty table no rows; other columns aren't read. A page is read in time
    proportional to its length, whole."""
    own = fields(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = dict(own.dtypes)
    return own.mapInArrow(_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
