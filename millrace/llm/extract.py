"""Main text of web pages by tag-path ratios.

A page is read once, in time linear in its length and nesting, into blocks of text with the path of tags above each. Blocks of one path are taken together: the path's
ratios are text and punctuation per block. The path's score is both ratios fused, times a prior for paths under an article or main element; scores are smoothed along the page by a
Gaussian, and blocks over a threshold are content. Content chooses the element: the deepest container that holds most of it, not
going on below an article. That element's blocks are the text, but for parts of it that are links without content; where only the whole page
holds most of the content, the parts of it that are content for the most part, and content elsewhere.
Elements that say by tag, role or a whole name in class or id that they're no article (menus, notices, comments, ...) don't count; one that
is only named so and yet holds most of the page's content does.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import appended

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ENDS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed".split())
#: Those of them that go on to the page's end without an end tag.
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav header footer aside form menu dialog button select fieldset audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices promo promotion "
    "sponsor sponsored comment comments respond reply replies discussion disqus share sharing social related recommended breadcrumb breadcrumbs widget popup modal overlay newsletter "
    "subscribe subscription login signup search pagination pager toolbar masthead topbar skip".split()
)
#: What a name may hold besides WORDS and still be one of theirs: site-footer is, has-sidebar and related-work aren't.
NEUTRAL = frozenset("site page main top bottom left right list item items box bar bars container wrapper wrap section block area inner outer primary secondary post posts article articles entry button buttons link links form global sticky mobile desktop js".split())
#: A comment may be an article by its tag.
COMMENTS = frozenset("comment comments reply replies respond".split())
#: An open element that a start tag of these ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where CLOSED_BY stops looking.
SCOPES = ("ul", "ol", "table", "dl", "select")
MAIN = ("article", "main")
#: What a path's score is worth under these.
PRIOR = {"article": 2.0, "main": 1.5}
#: Elements that are a piece of text: the element that holds the content is above them.
PIECES = frozenset("p li dt dd td th tr pre blockquote q caption figcaption summary address center h1 h2 h3 h4 h5 h6".split())
SIGMA, RADIUS, SHARE, MOST = 1.0, 2, 0.1, 0.8


@dataclass
class Block:
    path: int  # of the page's paths
    node: int  # the innermost element that isn't inline, 0 for the page
    text: str
    linked: int = 0  # characters inside of links


HARD, SOFT = 2, 1


def says(token: str, words: frozenset[str]) -> bool:
    parts = {p for p in re.split(r"[^a-z0-9]+", token) if p}
    return bool(parts & words) and parts <= words | NEUTRAL


def named_away(name: str, attributes: str) -> int:
    """Does an element say that it's no article? HARD: by its tag or role, as a comment, or in a line; SOFT: by another name."""
    if name in NEVER:
        return HARD
    if not attributes or name in ("html", "body"):
        return 0
    given = [(kind.lower(), "".join(values).lower().split()) for kind, *values in ATTRIBUTE.findall(attributes)]
    titled = name == "section" or any(kind == "class" and "section" in tokens for kind, tokens in given)  # its id is a place in the text
    soft = 0
    for kind, tokens in given:
        if kind == "role":
            if ROLES.intersection(tokens):
                return HARD
        elif kind == "class" or name not in INLINE and name not in HEADINGS:
            if any(says(t, COMMENTS) for t in tokens):
                return HARD
            if name not in MAIN and not (kind == "id" and titled) and any(says(t, WORDS) for t in tokens):
                soft = HARD if name in INLINE else SOFT
    return soft


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, attributes) of each tag; kind is "" or "/", or "!" for comments and what else is no element.

    A > in quotes ends no tag. Where a tag starts that has no end, its < is text. Quotes that lead to no end are remembered, so none is followed twice.
    """
    lost: set[int] = set()
    closing = {q: 0 for q in "\"'"}  # from there on no such quote is closed, once it's known
    known = (0, -1)  # between these two there is nothing that ends or quotes

    def next_end(at: int) -> int:
        nonlocal known
        if not known[0] <= at <= known[1]:
            found = ENDS.search(page, at)
            known = (at, found.start() if found else len(page))
        return known[1]

    def tag_end(at: int) -> int:
        seen = []
        while (k := next_end(at)) < len(page):
            if page[k] == ">":
                return k
            seen.append(k)
            at = page.find(page[k], k + 1) + 1 if k not in lost and not closing[page[k]] else 0
            if not at:
                closing[page[k]] |= k not in lost
                break
        lost.update(seen)
        return -1

    at = page.find("<")
    while at >= 0:
        end = at + 1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "!", "", ""
        elif found := NAME.match(page, at + 1):
            close = tag_end(found.end())
            if close >= 0:
                end = close + 1
                yield at, end, found[1], found[2].lower(), page[found.end() : close]
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            close = page.find(">", at + 1)
            end = close + 1 if close >= 0 else at + 1
            if close >= 0:
                yield at, end, "!", "", ""
        at = page.find("<", end)


class Page:
    """A page's blocks outside of elements that are named away for certain; elements, by number, with their parents; and paths, which are shared."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parents, self.names, self.soft = [0], [""], [False]  # of elements that aren't inline; 0 is the page
        self.paths: dict[tuple[int, str], int] = {}
        self.priors = [1.0]  # of paths
        self._stack: list[tuple[str, int, int, int]] = []  # name, named away, element and path
        self._open: dict[str, list[int]] = defaultdict(list)  # places of each name in the stack
        self._hidden: list[int] = []  # places of what is named away
        self._away, self._parts, self._linked, self._in_links = 0, [], 0, 0
        self._read(page)

    def _flush(self) -> None:
        text = "".join(self._parts)
        text = SPACES.sub(" ", references.unescape(text) if "&" in text else text).strip()
        if text:
            _, _, node, path = self._stack[-1] if self._stack else ("", 0, 0, 0)
            self.blocks.append(Block(path, node, text, self._linked))
        self._parts, self._linked = [], 0

    def _text(self, text: str) -> None:
        if not self._away:
            self._parts.append(text)
            self._linked += len(text) if self._in_links else 0

    def _push(self, name: str, hidden: int) -> None:
        _, _, node, path = self._stack[-1] if self._stack else ("", 0, 0, 0)
        if name not in INLINE:
            self.parents.append(node)
            self.names.append(name)
            self.soft.append(hidden > 0)
            node = len(self.parents) - 1
            above, path = path, self.paths.setdefault((path, name), len(self.priors))
            if path == len(self.priors):
                self.priors.append(max(self.priors[above], PRIOR.get(name, 1.0)))
        self._open[name].append(len(self._stack))
        if hidden:
            self._hidden.append(len(self._stack))
        self._stack.append((name, hidden, node, path))
        self._away += hidden == HARD
        self._in_links += name == "a"

    def _pop_to(self, depth: int) -> None:
        if any(self._stack[i][0] not in INLINE for i in range(len(self._stack) - 1, depth - 1, -1)):
            self._flush()
        while len(self._stack) > depth:
            name, hidden, _, _ = self._stack.pop()
            self._open[name].pop()
            if hidden:
                self._hidden.pop()
            self._away -= hidden == HARD
            self._in_links -= name == "a"

    def _last(self, names: tuple[str, ...] | set[str]) -> int:
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _read(self, page: str) -> None:
        unclosed: set[str] = set()
        seen_main, at = False, 0
        for start, end, kind, name, attributes in tags(page):
            if start < at:
                continue  # inside of a script
            self._text(page[at:start])
            at = end
            if kind == "!":
                continue
            if kind:
                depth = self._last((name,))
                if depth >= 0:
                    self._pop_to(depth)
                elif name not in INLINE:
                    self._flush()
                continue
            if name in RAW:
                close = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if not close and name not in TO_THE_END:  # read on after the start tag; no later one has an end either
                    unclosed.add(name)
                    self._flush()
                    continue
                if name not in ("svg", "math"):
                    self._text(" ")
                at = close.end() if close else (at if attributes.rstrip().endswith("/") else len(page))
                continue
            if name in VOID:
                if name == "hr":
                    self._flush()
                elif name not in INLINE:
                    self._text(" ")
                continue
            if name not in INLINE:
                self._flush()
                if self._open["p"]:  # a block ends the paragraph before it
                    self._pop_to(self._open["p"][-1])
            ended = CLOSED_BY.get(name)
            if ended and (last := self._last(ended)) > self._last(SCOPES):
                self._pop_to(last)
            bad = named_away(name, attributes)
            if name in MAIN and self._hidden and not bad and not seen_main:  # an element before the article was left open
                self._pop_to(self._hidden[0])
            seen_main |= name in MAIN and not bad
            if bad:
                self._flush()
            if not (attributes.endswith("/") and name in INLINE):
                self._push(name, bad)
        self._text(page[at:])
        self._flush()

    def sums(self, amounts: dict[int, float] | list[float]) -> list[float]:
        """Of each element: what it and all elements in it have. A parent's number is smaller than its children's."""
        out = [0.0] * len(self.parents)
        for node in range(len(self.parents)):
            out[node] = amounts[node]
        for node in range(len(self.parents) - 1, 0, -1):
            out[self.parents[node]] += out[node]
        return out


def smoothed(scores: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(scores, RADIUS, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def over_threshold(found: list[Block], priors: list[float]) -> np.ndarray:
    """Which blocks are content by the ratios of their paths."""
    path = np.array([b.path for b in found])
    lengths = np.bincount(path, [len(b.text) for b in found])
    marks = np.bincount(path, [len(PUNCTUATION.findall(b.text)) for b in found])
    number = np.maximum(np.bincount(path), 1)
    fused = np.log1p(lengths / number) * np.log1p(marks / number + 0.5) * np.log1p(lengths) * np.array(priors[: len(number)])
    score = smoothed(fused[path])
    return score >= SHARE * score.max()


def outside_named(page: Page) -> list[Block]:
    """Blocks outside of named elements. A named element counts as any other if it holds most of the content, and that is prose (a mark per block at least), and no article with content is elsewhere."""
    found = page.blocks
    if not found or not any(page.soft):
        return found
    held, marks, number, main = (defaultdict(float) for _ in range(4))
    for b, good in zip(found, over_threshold(found, page.priors).tolist(), strict=True):
        if good:
            held[b.node] += len(b.text)
            marks[b.node] += len(PUNCTUATION.findall(b.text))
            number[b.node] += 1
            main[b.node] += len(b.text) * (page.priors[b.path] > 1)
    length, mark, count, article = page.sums(held), page.sums(marks), page.sums(number), page.sums(main)
    gone = [False] * len(page.parents)
    for node in range(1, len(gone)):
        excused = 2 * length[node] > length[0] and mark[node] >= count[node] and article[0] - article[node] <= SHARE * length[0]
        gone[node] = gone[page.parents[node]] or page.soft[node] and not excused
    return [b for b in found if not gone[b.node]]


def content(page: Page) -> list[str]:
    """Texts of the article's blocks, in order."""
    found = outside_named(page)
    if not found:
        return []
    good = over_threshold(found, page.priors).tolist()
    lengths, chosen, linked = (defaultdict(float) for _ in range(3))
    for b, is_good in zip(found, good, strict=True):
        lengths[b.node] += len(b.text)
        linked[b.node] += b.linked
        chosen[b.node] += is_good * len(b.text)
    length, weight, links = page.sums(lengths), page.sums(chosen), page.sums(linked)
    home = 0
    for node in range(1, len(weight)):  # the elements that hold most of the content are one inside of the other
        if weight[node] >= MOST * weight[0] and page.names[node] not in PIECES and (page.names[home] not in MAIN or page.names[home] == "main" and page.names[node] == "article"):
            home = node
    whole = page.names[home] in ("", "html", "body")
    state = [0] * len(weight)  # 0: outside; 1: taken; 2: only what is content; 3: none
    for node in range(len(weight)):
        above = page.parents[node]
        if node == home:
            state[node] = 2 if whole else 1
        elif node and above == home:
            if whole:
                state[node] = 1 if weight[node] and 2 * weight[node] >= length[node] else 2
            else:
                state[node] = 3 if not weight[node] and 2 * links[node] > length[node] and page.names[home] not in MAIN else 1
        elif node:
            state[node] = state[above]
    kept = lambda b, is_good: state[b.node] == 1 or state[b.node] == 2 and (is_good or page.names[b.node] in HEADINGS)
    return [b.text for b, is_good in zip(found, good, strict=True) if kept(b, is_good)]


def main_text(page: str | None) -> str:
    return "\n".join(content(Page(page or "")))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text and n_chars to every row, in place of columns of these names; other columns stay, whatever their names.

    Null or empty html, or none with an article: an empty text. A page of any length is one row of a task, read in linear time. Ties between elements go to the
    innermost; repeated rows are read alike; an empty table gives no rows.
    """
    place = pages.drop("text", "n_chars").columns.index(html)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [main_text(page) for page in batch.column(place).to_pylist()]
        return {"text": pa.array(made, pa.string()), "n_chars": pa.array([len(t) for t in made], pa.int64())}

    return appended(pages, "text string, n_chars bigint", run)
