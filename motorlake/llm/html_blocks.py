"""HTML extraction: flat text blocks, classified by a decision tree over a block and its neighbours.

A page becomes a list of blocks with their words and the share of words in links. The
tree sees these of a block and of the blocks around it; where the block stands, and
what the names around it say, are further features of the same tree, none of which
decides by itself. It is trained here on the small labelled table of html_labelled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlake.llm.arrow import mapper, texts
from motorlake.llm.html_labelled import labelled_pages

#: Elements inside a line; those whose text isn't shown; those for furniture; those for content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow msub msup mfrac q ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object textarea select title head canvas audio video".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation contentinfo complementary search banner dialog menu".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id that often name furniture, and words before them that say it stands elsewhere.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer form header "
    "menu modal nav navbar navigation newsletter notice notices pagination popup promo related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
ELSEWHERE = frozenset("has no with without".split())
#: A form or a marked element that holds more than this share of a page's words, in so many blocks, is a wrapper.
WRAPPER_SHARE = 0.6
WRAPPER_BLOCKS = 3

ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
HIDES = re.compile(r"""\shidden(?=[\s=>/])|display\s*:\s*none""", re.IGNORECASE)
NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
TAG_REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")


@dataclass
class Around:
    """An element that may say something about the blocks in it: for content, for furniture, a header, or with marks (1 a word among others, 2 all words of a name)."""

    parent: Around | None
    content: bool
    furniture: bool
    form: bool
    header: bool
    marks: int
    words: int = 0
    own_words: int = 0  # without those of content elements inside
    blocks: int = 0


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool = False
    around: Around | None = None

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _tokens(page: str):
    """(kind, value): text, or the inside of a tag; comments, declarations and a tag that is cut off are left out."""
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            return
        follows = page[start + 1 : start + 2]
        if not (follows.isalpha() and follows.isascii() or follows in ("/", "!", "?") and follows):
            yield "text", page[at : start + 1]
            at = start + 1
            continue
        if start > at:
            yield "text", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        found = TAG_REST.match(page, start + 1)
        end = found.end() - 1 if found else page.find(">", start)
        if end < 0:
            return
        at = end + 1
        tag = page[start + 1 : end]
        if follows in "!?":
            continue
        yield "tag", tag
        name = NAME.match(tag)
        if name and follows != "/" and name[1].lower() in ("script", "style", "textarea", "title") and not tag.endswith("/"):
            close = re.compile(rf"</{name[1]}\b", re.IGNORECASE).search(page, at)
            at = size if close is None else close.start()


def _marks(tag: str) -> tuple[int, bool]:
    """What the class, id and role of a tag say: 2 if all words of one name are marks, 1 if one is; and whether the role is for furniture."""
    found, role = 0, False
    if "=" in tag:
        for kind, value in ATTRIBUTE.findall(tag):
            for name in value.strip("\"'").lower().split():
                parts = [x for x in re.split(r"[^a-z]+", name) if x]
                if kind.lower() == "role":
                    role = role or name in ROLES
                elif parts and parts[0] not in ELSEWHERE:
                    hits = sum(x in MARKS for x in parts)
                    found = max(found, 2 if hits == len(parts) else 1 if hits else 0)
    return found, role


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; white space in a block is one space, character references are decoded."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, Around | None]] = []  # name; in a hidden element, in a heading, and what is around, each with the element itself
    open_names: Counter[str] = Counter()  # of the stack
    links = 0

    def close(to: int) -> None:
        """Take everything off the stack from place ``to`` on."""
        open_names.subtract(x[0] for x in stack[to:])
        del stack[to:]

    def flush() -> None:
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            in_links = sum(len(p.split()) for p, link in parts if link)
            words = len(text.split())
            _, _, heading, around = stack[-1] if stack else ("", False, False, None)
            found.append(Block(text, words, min(words, in_links), heading, around))
        parts.clear()

    for kind, value in _tokens(page):
        if kind == "text":
            if not (stack and stack[-1][1]):
                parts.append((html.unescape(value), links > 0))
            continue
        name = NAME.match(value)
        if not name:
            continue
        name = name[1].lower()
        if value.startswith("/"):
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE:
                flush()
            if open_names[name] > 0:
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                close(at)
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name not in INLINE:
            flush()
            links = 0
        elif name == "a":
            links += 1
        if name in VOID or value.endswith("/"):
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # opening one closes the one before
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] not in INLINE | {"p"}:
                    break
        hides = name in HIDDEN or "hidden" in value and HIDES.search(value + ">") or "display" in value and HIDES.search(value)
        if name in INLINE and name != "a" and not hides:
            continue
        _, hidden, heading, around = stack[-1] if stack else ("", False, False, None)
        if name not in INLINE and name not in ("html", "body"):
            marks, role = _marks(value)
            if name in CONTENT or name in FURNITURE or name == "header" or role or marks:
                around = Around(around, name in CONTENT, name in FURNITURE or role, name == "form", name == "header", marks)
        stack.append((name, bool(hidden or hides), heading or name in HEADINGS, around))
        open_names[name] += 1
    flush()
    return found


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "header", "marks", "in_content", "outside", "in_other", "heading")


def _elements(page: list[Block]) -> list[Around]:
    """All elements around the page's blocks, each behind the one around it."""
    seen: set[int] = set()
    found: list[Around] = []
    for b in page:
        way, at = [], b.around
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            way.append(at)
            at = at.parent
        found += reversed(way)
    return found


def _content(page: list[Block], elements: list[Around]) -> Around | None:
    """The content element that holds most words of its own; those marked or inside marked ones only where there is no other."""
    inner: dict[int, Around | None] = {}  # the innermost content element, the element itself included
    marked: dict[int, bool] = {}
    for x in elements:
        above = id(x.parent)
        inner[id(x)] = x if x.content else inner.get(above)
        marked[id(x)] = x.marks == 2 or marked.get(above, False)
    roots: dict[int, Around] = {}
    for b in page:
        if b.around is not None:
            b.around.words += b.words
            b.around.blocks += 1
            if (x := inner[id(b.around)]) is not None:
                x.own_words += b.words
                roots.setdefault(id(x), x)
    for x in reversed(elements):
        if x.parent is not None:
            x.parent.words += x.words
            x.parent.blocks += x.blocks
    open_ = [x for x in roots.values() if not marked[id(x)]] or list(roots.values())
    return max(open_, key=lambda x: x.own_words, default=None)


#: What an element hands down to the blocks in it: furniture, header, other content, marks, inside.
Told = tuple[bool, bool, bool, int, float]


def features(page: list[Block]) -> np.ndarray:
    """A row for each block.

    in_content: inside the page's content element, or 0.5 in one around that; outside: the
    page has one, elsewhere; in_other: inside another content element; header: in a header
    outside the content element, but not a heading. furniture, header
    and marks come from the elements between the block and the content element; those
    around the content element, and wrappers of most of a page without one, say nothing.
    Each element adds to what the one around it says, so the time doesn't grow with depth.
    """
    elements = _elements(page)
    root = _content(page, elements)
    beyond = set()
    at = root
    while at is not None:
        beyond.add(id(at))
        at = at.parent
    total = sum(b.words for b in page)
    nothing: Told = (False, False, False, 0, 0.0)
    told: dict[int, Told] = {}
    for x in elements:
        furniture, header, other, marks, inside = told.get(id(x.parent), nothing)
        if x is root:
            told[id(x)] = (False, False, False, 0, 1.0)
        elif id(x) in beyond:
            told[id(x)] = (furniture, header, other, marks, max(inside, 0.5 * x.content))
        elif root is None and (x.form or x.marks and not x.furniture) and x.words > WRAPPER_SHARE * total and x.blocks >= WRAPPER_BLOCKS:
            told[id(x)] = (furniture, header, other, marks, inside)
        else:
            told[id(x)] = (furniture or x.furniture, header or x.header, other or x.content, max(marks, x.marks), inside)
    own = [(b.words, b.density) for b in page]
    around = [(0, 0.0), *own, (0, 0.0)]
    rows = []
    for i, b in enumerate(page):
        furniture, header, other, marks, inside = nothing if b.around is None else told[id(b.around)]
        rows.append((*own[i], *around[i], *around[i + 2], furniture, header and not inside and not b.heading, marks, inside, root is not None and not inside, other, b.heading))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


#: Blocks of the labelled table in a leaf of the tree at least.
LEAST = 4


@dataclass(frozen=True)
class Split:
    """A leaf has feature -1 and the class to give."""

    feature: int
    limit: float = 0.0
    below: Split | None = None
    above: Split | None = None
    keep: bool = False


def train(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = LEAST) -> Split:
    """A binary tree of splits that lower the Gini impurity most, with ``least`` blocks on either side; the first feature and limit win ties."""
    keep = bool(2 * y.sum() >= len(y))
    if depth == 0 or y.all() or not y.any():
        return Split(-1, keep=keep)
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            below = x[:, feature] <= limit
            if not least <= below.sum() <= len(y) - least:
                continue
            impurity = sum(part.sum() * share * (1 - share) for part in (below, ~below) for share in (y[part].mean(),))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(limit), below)
    if best is None:
        return Split(-1, keep=keep)
    _, feature, limit, below = best
    return Split(feature, limit, train(x[below], y[below], depth - 1, least), train(x[~below], y[~below], depth - 1, least))


def trained() -> Split:
    found = [(features(blocks(page)), np.array(keep, bool)) for page, keep in labelled_pages()]
    return train(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def kept(tree: Split, row: np.ndarray) -> bool:
    while tree.feature >= 0:
        tree = tree.below if row[tree.feature] <= tree.limit else tree.above
    return tree.keep


def main_text(page: str, tree: Split) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if kept(tree, row))


def extract(pages: DataFrame, tree: Split | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    text is the main text: kept blocks in page order, one on a line; empty for null or
    empty html and where nothing is kept. n_chars counts its code points. Whole pages are
    read, however long. Repeated rows give equal results; other columns aren't read, so
    they can't clash; an empty table gives no rows.
    """
    tree = tree or trained()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(h, tree) for h in texts(batch, "html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(mapper(step, "html"), "page_id bigint, url string, text string, n_chars bigint")
