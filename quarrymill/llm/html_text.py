"""Operator 5: main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Scripts, styles and other text
that is not shown are left out, and so are blocks in elements that name what
no rule on words can tell from an article: adverts, notices, forms, headers,
footers, sidebars and reader comments. All others are judged by their length,
the share of their text that is link text, and the share of stop words.

First pass: a block is bad if most of it is link text, good if it is long
enough and enough of its words are stop words, else undecided. Marks of the
page only move these limits: in a marked article (article, main) a stop word
will do, in a menu (nav) a small share of link text is too much. Second pass: an undecided block takes the label of its nearest decided
neighbour; a heading looks at what follows it first. The edge of an article or a menu counts as
``EDGE`` blocks. If neighbours at equal distance disagree, a block with a stop
word or in an article is good; without any decided neighbour it is bad. Only where an article
without decided blocks has fewer than ``FEW_WORDS`` different words, so that
the share of stop words says nothing, its blocks are good.

So prose outside an article stays, lists of links within one go, and an
article of many words without a stop word among them goes.

Defined results: a null or empty page has an empty text; character references
are decoded and white space inside a block is one blank; very long and deeply
nested pages are read whole, in time that grows with their length; repeated
rows are each extracted; an empty table gives no rows; other columns are not
read, and kept columns named like a result are left out.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate, groupby, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import by_place, quoted

#: Characters and share of stop words from which a block is good; in a marked article one stop word will do.
LONG, STOP_DENSITY = 70, 0.15
#: An article of fewer different words is too small for its share of stop words to say anything.
FEW_WORDS = 150
#: Share of link text above which a block is bad: anywhere, and in a menu.
LINKS, MENU_LINKS = 0.5, 0.1
#: How many blocks the edge of an article or a menu counts for.
EDGE = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and a to in is was it for on that with as by at from this be are or an not but his her they which have had were
    der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    le la les de des et un une du en que qui dans est pour pas sur au plus par avec il elle ce se sont ou
    el los las y del se por con una su para al lo como más o pero sus le ha este no es""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split()
)
RAW = frozenset("script style noscript template iframe textarea svg math title object select option canvas audio video".split())
NEVER = frozenset("head header footer aside form button dialog fieldset".split())
ARTICLE = frozenset("article main".split())
MENU = frozenset("nav menu".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# A word of a class, id or role attribute that marks what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebars?|side|footer|header|masthead|cookies?|consent|gdpr|notices?|"
    r"newsletter|subscribe|popup|modal|overlay|comments?|disqus|respond|replies|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|widget|login|signup|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
# A word that marks a menu.
MENU_NAME = re.compile(r"(?:^|[\s_-])(?:nav\w*|menus?|breadcrumbs?|navigation)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)/?>|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _kind(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it is a menu."""
    if tag in NEVER:
        return True, False
    if not attributes or tag in ("html", "body") or tag in ARTICLE:
        return False, tag in MENU
    names = [next(filter(None, m.groups()), "") for m in _NAMED.finditer(attributes)]
    left_out = any(map(NOISE.search, names)) or bool(_HIDDEN.search(attributes))
    return left_out, tag in MENU or any(map(MENU_NAME.search, names))


class Open:
    """The open elements; looking one up and closing it take no longer the more are open."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # names, whether each is left out, and whether it is a menu
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.never = self.articles = self.links = self.menus = self.headings = 0

    def push(self, tag: str, never: bool, menu: bool):
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, never, menu))
        self._count(tag, never, menu, 1)

    def _count(self, tag: str, never: bool, menu: bool, by: int):
        self.never += by * never
        self.menus += by * menu
        self.headings += by * (tag in HEADING)
        self.articles += by * (tag in ARTICLE)
        self.links += by * (tag == "a")

    def close(self, tag: str):
        """Close the innermost such element and all within it; an inline end tag does not close blocks around it."""
        at = self.places.get(tag)
        if not at or tag in INLINE and self.block_places and self.block_places[-1] > at[-1]:
            return
        k = at[-1]
        while len(self.stack) > k:
            name, never, menu = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.block_places.pop()
            self._count(name, never, menu, -1)


class Block(NamedTuple):
    text: str
    links: float  # share of link text
    article: bool = False  # in a marked article
    menu: bool = False
    heading: bool = False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that are not left out."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    unclosed: set[str] = set()
    around = Open()

    def end():
        text = " ".join(html.unescape("".join(parts)).split())
        if text and not around.never:
            share = len("".join(html.unescape("".join(linked)).split())) / len(text)
            out.append(Block(text, share, around.articles > 0, around.menus > 0, around.headings > 0))
        parts.clear()
        linked.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            parts.append(text)
            if around.links:
                linked.append(text)
        if not m:
            break
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            end()
        elif tag == "br":
            parts.append(" ")
        if closing:
            around.close(tag)
            continue
        if tag in VOID or m[0].endswith("/>") and tag in RAW:
            continue
        if tag in RAW:
            done = tag not in unclosed and re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not done:
                unclosed.add(tag)
            at = done.end() if done else size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "body":
            around.close("head")
        if tag in _CLOSES and around.stack and around.stack[-1][0] in _CLOSES[tag]:
            around.close(around.stack[-1][0])
        around.push(tag, *_kind(tag, m[3]))
    end()
    return out


def stop_density(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(found: list[Block]) -> list[bool | None]:
    """True (good), False (bad) or None (undecided) of each block."""
    labels: list[bool | None] = []
    for b in found:
        if b.links > (MENU_LINKS if b.menu else LINKS):
            labels.append(False)
        elif b.menu:
            labels.append(None)
        elif b.article:
            labels.append(True if stop_density(b.text) > 0 else None)
        else:
            labels.append(True if len(b.text) >= LONG and stop_density(b.text) >= STOP_DENSITY else None)
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Labels of all blocks, undecided ones by their nearest decided neighbour."""
    steps = (1 + EDGE * ((a.article, a.menu) != (b.article, b.menu)) for a, b in pairwise(found))
    places = [*accumulate(steps, initial=0)]

    def nearest(order):
        out, last = [None] * len(found), None
        for i in order:
            out[i] = last
            if labels[i] is not None:
                last = i
        return out

    small = [False] * len(found)
    for (article, menu), run in groupby(range(len(found)), lambda i: (found[i].article, found[i].menu)):
        at = list(run)
        if article and not menu and all(labels[i] is None for i in at):
            few = len({w for i in at for w in _WORDS.findall(found[i].text.lower())}) < FEW_WORDS
            for i in at:
                small[i] = few

    decided = []
    for i, (b, before, behind) in enumerate(zip(found, nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1)), strict=True)):
        if labels[i] is not None:
            decided.append(labels[i])
            continue
        if small[i]:
            decided.append(True)
            continue
        near = sorted((abs(places[j] - places[i]), labels[j]) for j in (before, behind) if j is not None)
        if b.heading and behind is not None and places[behind] - places[i] < EDGE:
            decided.append(labels[behind])
        elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
            decided.append(b.article or stop_density(b.text) > 0)
        else:
            decided.append(near[0][1] if near else False)
    return decided


def extract(page: str) -> str:
    found = blocks(page)
    return " ".join(b.text for b, good in zip(found, second_pass(found, first_pass(found)), strict=True) if good)


def _extract_all(keep: list[str], names: list[str]):
    def run(batches):
        for batch in batches:
            texts = [extract(p or "") for p in batch.column("__html").to_pylist()]
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=names)

    return run


def extract_pages(pages: DataFrame, keep: list[str] | None = None, column: str = "html") -> DataFrame:
    """The ``keep`` columns of every page with text and n_chars; kept columns of those names are left out."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    columns, own = by_place(pages, keep)
    rows = pages.select(*columns, F.col(quoted(column)).alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = rows.mapInArrow(_extract_all([*own.values()], schema.names), schema)
    return found.select(*(F.col(o).alias(c) for c, o in own.items()), "text", "n_chars")
