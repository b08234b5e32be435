"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with its path of block elements from the root. Per path the length of
text outside links and the number of punctuation marks are summed and divided by the number of blocks,
smoothed over similar paths, and multiplied; blocks on paths over a share of the page's best are its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import pieces

# fixed values of the markup language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
FOREIGN = frozenset("template svg math canvas object audio video select".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an opening of the key ends an open element of the values, up to the nearest element of the third
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("table td th caption button".split())

ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

#: elements that hold no part of an article, and words in a class, id or role that say the same
APART = frozenset("nav footer aside form button dialog menu fieldset search".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted comment comments commentlist reply replies disqus discussion "
    "sidebar sidenav rail menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer footers header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "share sharing social related recommended recommendations widget widgets subscribe subscription newsletter signup login search pagination pager complementary contentinfo dialog".split()
)
#: a class such as has-sidebar tells of a state and doesn't name the element
STATES = re.compile(r"\b(?:has|no|with|without|is|not|hide|show)[-_][\w-]+")
HEADER_NAMES = frozenset("header headers masthead".split())
ARTICLE_NAMES = frozenset("article main articlebody".split())
#: weight of a path one step away, exp(-2)
NEAR = 0.1353


@dataclass
class Element:
    tag: str
    parent: int
    path: int  # of the page's tree of tag paths
    apart: bool = False  # never text of an article, or inside of what isn't
    named: bool = False  # by NAMES
    header: bool = False  # of a page or of an article without marks
    article: bool = False  # a marked article, or inside of one


@dataclass
class Block:
    element: int
    text: str
    linked: int

    @property
    def open_length(self) -> int:
        return len(self.text) - min(self.linked, len(self.text))


TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r">|=\s*[\"']")


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag; comments, declarations and the text of raw elements have no
    name. One pass: what is looked for in vain is not looked for again."""
    at, last = 0, {c: page.rfind(c) for c in ">\"'"}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            close = "-->" if page.startswith("<!--", start) else "]]>"
            end = page.find(close, start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if start > last[">"]:
            return
        found = TAG.match(page, start + 1)
        if not found:
            at = start + 1
            if page.startswith(("<!", "<?"), start):
                at = page.index(">", start) + 1
                yield start, at, "", "", ""
            continue
        end = found.end()
        while (stop := STOP.search(page, end)) and stop[0] != ">":
            quote = stop[0][-1]
            end = page.find(quote, stop.end()) + 1 if stop.end() <= last[quote] else 0
            if not end:  # a quote that never closes ends with the tag
                stop = re.compile(">").search(page, stop.end())
                break
        if not stop:
            return
        at = stop.end()
        name = found[2].lower()
        yield start, at, found[1], name, page[found.end() : at - 1]
        if name in RAW and not found[1] and page[at - 2] != "/":
            end = re.compile(f"</{name}", re.I).search(page, at)
            yield at, end.start() if end else len(page), "", "", ""
            if not end:
                return
            at = end.start()


def _attributes(given: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(given)}


class Page:
    """A page's elements, its blocks of text in order, and its tree of tag paths.

    Elements are numbered as they open; number 0 is the page. A path is a number as well, with that of its parent.
    """

    def __init__(self, page: str):
        self.elements = [Element("", -1, 0)]
        self.blocks: list[Block] = []
        self.above = [-1]  # path of the parent, by path
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [0]
        self._open: dict[str, list[int]] = {}  # places in the stack, by tag
        self._words: list[str] = []
        self._linked = [0, 0]  # links open, and characters in links of this block
        self._read(page)

    def _close(self) -> None:
        text = " ".join("".join(self._words).split())
        if text and not self.elements[self._stack[-1]].apart:
            self.blocks.append(Block(self._stack[-1], text, self._linked[1]))
        self._words.clear()
        self._linked[:] = [0, 0]

    def _last(self, tags) -> int:
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _pop(self, tags, stop) -> None:
        """Ends the innermost open element of `tags`, unless one of `stop` is open inside of it."""
        at = self._last(tags)
        if at and at >= self._last(stop):
            while len(self._stack) > at:
                self._open[self.elements[self._stack.pop()].tag].pop()

    def _push(self, tag: str, given: str) -> None:
        at = _attributes(given) if given and not given.isspace() else {}
        inside = self.elements[self._stack[-1]]
        called = " ".join(at.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
        words = set(re.findall(r"[a-z]+", STATES.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1 \2", called)))) & NAMES if called else set()
        marked = tag in ("article", "main") or at.get("role", "").lower() in ARTICLE_NAMES or at.get("itemprop", "").lower() == "articlebody"
        if tag in ("body", "html", "main") or inside.article and (tag == "header" or tag in HEADINGS):
            words = set()
        elif inside.article or tag in HEADINGS:
            words -= HEADER_NAMES
        hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I) is not None
        header = not inside.article and (tag == "header" or bool(words) and words <= HEADER_NAMES)
        label = f"{tag}.{at.get('class', '').lower()}" + "".join(f"#{w}" for w in sorted(words))
        path = self._paths.setdefault((inside.path, label), len(self.above))
        if path == len(self.above):
            self.above.append(inside.path)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.elements))
        self.elements.append(Element(tag, self._stack[-2], path, inside.apart or hidden or tag in APART, bool(words) and not header, header, marked or inside.article))

    def _say(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self._words.append(text)
            if self._linked[0]:
                self._linked[1] += len(text.strip())

    def _read(self, page: str) -> None:
        skip, depth, at = None, 0, 0
        for start, end, slash, tag, given in _tags(page):
            if skip is None:
                self._say(page[at:start])
            at = end
            if skip is not None:
                if tag == skip and not given.endswith("/"):
                    depth += -1 if slash else 1
                    skip = skip if depth else None
            elif tag in FOREIGN:
                if not slash and not given.endswith("/"):
                    skip, depth = tag, 1
            elif tag in VOID:
                if tag == "hr":
                    self._close()
                elif tag == "br":
                    self._words.append(" ")
            elif tag not in BLOCK:
                if tag == "a":
                    self._linked[0] = 0 if slash else 1
            elif slash:
                self._close()
                self._pop({tag}, frozenset() if tag not in ("p", "li", "td", "th", "tr") else SCOPE - {tag})
            else:
                self._close()
                if tag != "p" or self._open.get("p"):
                    self._pop({"p"}, SCOPE)
                if tag in ENDS:
                    self._pop(*ENDS[tag])
                if tag in HEADINGS and (top := self.elements[self._stack[-1]].tag) in HEADINGS:
                    self._stack.pop()
                    self._open[top].pop()
                self._push(tag, given)
        if skip is None:
            self._say(page[at:])
        self._close()

    def flags(self, own) -> list[bool]:
        """Per element, whether `own` holds for it or for an element around it."""
        out: list[bool] = []
        for e in self.elements:
            out.append(own(e) or e.parent >= 0 and out[e.parent])
        return out

    def outermost(self, own) -> list[int]:
        """Per element, the outermost of itself and the elements around it for which `own` holds; -1 for none."""
        out: list[int] = []
        for i, e in enumerate(self.elements):
            above = out[e.parent] if e.parent >= 0 else -1
            out.append(above if above >= 0 else i if own(e) else -1)
        return out

    def held(self, amount=None, own=None) -> list[int]:
        """Per element, the sum over itself and all elements in it: of `amount` of their blocks, or of `own`."""
        out = [0] * len(self.elements) if own is None else [int(own(i, e)) for i, e in enumerate(self.elements)]
        for b in self.blocks if amount else ():
            out[b.element] += amount(b)
        for i in range(len(out) - 1, 0, -1):
            out[self.elements[i].parent] += out[i]
        return out


def _real(block: Block) -> int:
    """Characters of a block that reads like text and not like a label or a list of links."""
    return block.open_length if 5 * block.open_length >= 2 * len(block.text) and (len(block.text) >= 80 or re.search(r"[.!?…。！？]", block.text)) else 0


def _unname(page: Page) -> None:
    """Takes the name from elements that hold the article itself.

    A named element goes however long its text is, unless nothing outside of named elements reads like text, or the
    only top heading is inside with more text than outside. Then what holds that heading, else the largest
    marked article, else the largest named element, is no part to leave out.
    """
    elements = page.elements
    gone = page.flags(lambda e: e.named or e.header or e.apart)
    named = page.flags(lambda e: e.named)
    if not any(named):
        return
    real = page.held(_real)
    clean = sum(_real(b) for b in page.blocks if not gone[b.element])

    outer = page.outermost(lambda e: e.named)
    target = -1
    if not any(e.tag == "h1" and not gone[i] for i, e in enumerate(elements)):
        header = page.flags(lambda e: e.header or e.apart)
        headings = (i for i, e in enumerate(elements) if e.tag == "h1" and named[i] and not header[i])
        target = next((i for i in headings if real[outer[i]] > clean), -1)
    if target < 0 and not clean:
        inside = [i for i, e in enumerate(elements) if named[i] and not e.apart and e.article and not elements[e.parent].article]
        target = max(inside or [i for i, e in enumerate(elements) if outer[i] == i and not e.apart], key=real.__getitem__, default=-1)
        if target >= 0 and not real[target]:
            target = -1
    while target >= 0:
        elements[target].named = False
        target = elements[target].parent


def path_scores(above: Sequence[int], sums: dict[int, list[float]], near: float = NEAR, most_linked: float = 0.6) -> dict[int, float]:
    """Score per path from its sums (text outside links, punctuation marks, text, blocks).

    Text and marks per block are each smoothed over the path itself and, with the weight `near`, its parent, its
    children and the other children of its parent; their product is the score. A path whose text lies in links
    for more than most_linked has none. above: the parent of each path.
    """
    none = [0.0, 0.0, 0.0, 0.0]
    below: dict[int, list[float]] = {}
    for p, own in sums.items():
        into = below.setdefault(above[p], [0.0] * 4)
        for i, x in enumerate(own):
            into[i] += x
    score = {}
    for p, own in sums.items():
        parent, beside, children = sums.get(above[p], none), below[above[p]], below.get(p, none)
        length, marks, _, n = (x + near * (u + b - x + c) for x, u, b, c in zip(own, parent, beside, children))
        score[p] = 0.0 if own[0] < (1 - most_linked) * own[2] else length / n * (1 + marks / n)
    return score


def _title(page: Page, first: int) -> list[int]:
    """Blocks of the header of an article without marks that starts with block `first`: of the last header before it
    that is in an element below the body which holds the article, and that holds a heading, no menu, mostly unlinked
    text, and the only top heading if there is one."""
    elements = page.elements
    gone = page.flags(lambda e: e.named or e.apart)
    around, i = set(), page.blocks[first].element
    while i >= 0 and elements[i].tag not in ("body", "html", ""):
        around.add(i)
        i = elements[i].parent
    tops = page.outermost(lambda e: e.header)
    found: dict[int, list[int]] = {}
    for k, b in enumerate(page.blocks[:first]):
        if (top := tops[b.element]) >= 0 and not gone[top] and elements[top].parent in around:
            found.setdefault(top, []).append(k)
    menus = page.held(own=lambda i, e: e.apart)
    firsts = page.held(own=lambda i, e: e.tag == "h1" and not gone[i])
    for top in sorted(found, reverse=True):
        blocks = [page.blocks[k] for k in found[top]]
        heads = any(elements[b.element].tag in HEADINGS for b in blocks)
        if heads and not menus[top] and firsts[0] == firsts[top] and 2 * sum(b.open_length for b in blocks) >= sum(len(b.text) for b in blocks):
            return found[top]
    return []


def main_text(html_text: str, share: float = 0.25, most_linked: float = 0.6) -> str:
    """Text of the article of a page: its blocks in order, one line each; empty if there is none.

    share: what a path's score must reach of the best, see `path_scores`. If the page marks an article, its paths are
    chosen. Else those over the share are, with all others in the element, below the body, that holds the best
    path's blocks, headings right before a chosen block, other blocks with a score between chosen ones, and the
    header of that element. Menus, forms, comments, adverts and the like go by element and by name, inside of an
    article as well, however long they are; see `_unname` for names on what holds the article. Time and memory
    are in proportion to the page, whatever it holds.
    """
    page = Page(html_text)
    _unname(page)
    elements, blocks = page.elements, page.blocks
    named = page.flags(lambda e: e.named)
    gone = page.flags(lambda e: e.named or e.header or e.apart)
    inside = [k for k, b in enumerate(blocks) if not gone[b.element]]
    if marked := any(elements[blocks[k].element].article for k in inside):
        inside = [k for k in inside if elements[blocks[k].element].article]
    sums: dict[int, list[float]] = {}
    path = {k: elements[blocks[k].element].path for k in inside}
    for k in inside:
        b, s = blocks[k], sums.setdefault(path[k], [0.0] * 4)
        for i, x in enumerate((b.open_length, len(PUNCTUATION.findall(b.text)), len(b.text), 1)):
            s[i] += x
    if not sums:
        return ""
    score = path_scores(page.above, sums, most_linked=most_linked)
    best = max(sums, key=score.__getitem__)
    holder = {elements[blocks[k].element].parent for k in inside if path[k] == best}
    around = page.above[best] if all(elements[i].tag not in ("html", "body", "") for i in holder) else -1
    under = [False] * len(page.above)
    for p in range(1, len(under)):
        under[p] = p == around or under[page.above[p]]
    chosen = {p for p in sums if marked or score[p] > 0 and (under[p] or score[p] >= share * score[best])}
    at = [i for i, k in enumerate(inside) if path[k] in chosen]
    after, kept = False, []
    for i in range(len(inside) - 1, -1, -1):
        k = inside[i]
        between = bool(at) and at[0] < i < at[-1] and score[path[k]] > 0
        if after := path[k] in chosen or between or elements[blocks[k].element].tag in HEADINGS and after:
            kept.append(k)
    kept.reverse()
    if kept and not marked:
        kept = _title(page, kept[0]) + kept
    return "\n".join(blocks[k].text for k in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of the whole html of every row. A null page has an empty text;
    null and repeated ids stay rows of their own; other columns are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [main_text(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return given.mapInArrow(each, "page_id long, url string, text string")
