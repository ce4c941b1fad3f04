"""Main text of web pages by tag-path ratios.

A page becomes its blocks of text, each with its root-to-leaf tag path. Per path, the length of its text outside links and
its punctuation are aggregated over its blocks. Both are smoothed over neighbouring blocks in page order, aggregated again and fused by
multiplication: the text of a path times one and its marks a block. A path that is named as a menu, header, footer,
sidebar, notice, advert or comments counts half (``NAMED``). Paths at ``SHARE`` of the best path are content, with everything below their containers but
named elements and, outside articles, links alone; if one of them lies in an article or main element, all articles are content.

Ratios tell nothing where a named path holds about as much text as the best other one (less than ``CLEAR`` times as much): there, names decide, and
a page without other text has no content.

What is never text goes by its element: scripts, styles, the head, forms and their controls, drawings, embedded objects, hidden elements and markup comments.
A name is a class, id or role token that is a boilerplate word, or one made of such words and of words for places alone: ``cookie-notice`` and
``site-footer`` are, ``search-algorithms`` and ``share-price`` are not.

Blocks are runs of text between block-level tags; character references are decoded, white space
becomes one space, blocks are joined by a newline.

Defined results: null or empty html and pages without content give an empty string; pages may have any length and are read in linear time, broken ones too;
unclosed and stray tags, comments and scripts are taken as browsers do, but a tag that never ends for an open quote ends at its next ``>``,
and quotes count no more after it; repeated rows are extracted alike; an empty table gives an empty result; other columns, whatever their names but
text and n_chars, are returned untouched.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = (0.1, 0.8, 0.1)
#: Share of the best path's score that makes a path content.
SHARE = 0.3
#: Factor of the score of a path that is named as boilerplate.
NAMED = 0.5
#: How many times the text of the best named path the best other path must hold for ratios to decide.
CLEAR = 4.0

# Tags and attribute words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER_TEXT = frozenset("head form button select noscript template svg canvas object datalist".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE_TAGS = frozenset("nav aside footer dialog menu".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead comment comments respond disqus share sharing social "
    "related recommended newsletter subscribe signup login search form toolbar pagination pager widget widgets skip contentinfo complementary dialog".split()
)
PLACES = frozenset(
    "site page main global top bottom left right center inner outer primary secondary box wrapper wrap container content slot unit block area section list bar item items "
    "group row col column panel inline sticky fixed mobile desktop header post posts article story links link text body".split()
)

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"[\"'>]")
_COMMENT_END = re.compile(r"--!?>")
RAW = {t: re.compile(rf"</{t}(?![^\s/>])", re.I) for t in "script style textarea title iframe xmp noembed noframes".split()}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？¿¡]")


def read_attributes(text: str) -> dict[str, str]:
    """Values by lower-cased name, the first of each."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def is_named_boilerplate(tag: str, named: list[str]) -> bool:
    """Whether an element's tag or its class, id and role tokens call it something other than content."""
    if tag in BOILERPLATE_TAGS:
        return True
    if tag in ("html", "body", "main"):
        return False
    for token in named:
        if token in BOILERPLATE:
            return True
        parts = [w for w in re.split(r"[^a-z]+", token) if w]
        # an article's classes also list its categories
        if tag != "article" and any(w in BOILERPLATE for w in parts) and all(w in BOILERPLATE or w in PLACES for w in parts):
            return True
    return False


class Paths:
    """Tag paths of a page as numbers: of each its parent, label, and the path without the inline or flow elements at its end."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.above, self.label, self.no_inline, self.no_flow = [0], [""], [0], [0]

    def below(self, path: int, label: str) -> int:
        k = self.number.setdefault((path, label), len(self.above))
        if k == len(self.above):
            self.above.append(path)
            self.label.append(label)
            self.no_inline.append(self.no_inline[path] if label in INLINE else k)
            self.no_flow.append(self.no_flow[path] if label in FLOW else k)
        return k


class Element:
    """An open element: tag, number of its path, and whether it is never text, named boilerplate, an article, a link."""

    __slots__ = ("article", "link", "named", "never", "path", "tag")

    def __init__(self, tag: str, attributes: str, above: Element | None, paths: Paths):
        held = read_attributes(attributes) if attributes.strip(" \t\r\n/") else {}
        tokens = [t for k in ("class", "id", "role") for t in held.get(k, "").lower().split()]
        hidden = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", held.get("style", ""), re.I)
        inside = bool(above and above.article)
        self.tag = tag
        self.never = bool(above and above.never) or tag in NEVER_TEXT or bool(hidden)
        self.named = bool(above and above.named) or (tag == "header" and not inside) or is_named_boilerplate(tag, tokens)
        self.article = inside or tag in ("article", "main")
        self.link = tag == "a" or bool(above and above.link)
        # flow and inline elements go by their tag alone, containers by their names too
        self.path = paths.below(above.path if above else 0, tag if not tokens or tag in FLOW or tag in INLINE else f"{tag}.{'.'.join(tokens)}")


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of each tag, an empty tag for comments and raw text; each character is passed a bounded number of times."""
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while m := _OPEN.search(page, at):
        start = m.start()
        if page.startswith("<!--", start):
            end = _COMMENT_END.search(page, start + 4)
            at = end.end() if end else n
            yield start, at, "", False, ""
            continue
        if start > last:
            return  # no tag ends any more
        k = m.end()
        if m[2] is None:
            at = page.index(">", k) + 1
            yield start, at, "", False, ""
            continue
        if quotes:
            while (e := _TAG_END.search(page, k)) and e[0] != ">":
                k = page.find(e[0], e.end()) + 1
                if not k:
                    e = None
                    break
            quotes = e is not None
        end = e.start() if quotes else page.index(">", m.end())
        at, tag = end + 1, m[2].lower()
        yield start, at, tag, bool(m[1]), page[m.end() : end]
        if tag in RAW and not m[1]:
            # the element's text is no markup
            close = RAW[tag].search(page, at)
            close = page.find(">", close.end()) + 1 if close else 0
            yield at, (close or n), "", False, ""
            at = close or n
            yield at, at, tag, True, ""


class Stack:
    """Open elements, with the places of each tag's and of those that are not inline."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        if element.tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            element = self.open.pop()
            self.places[element.tag].pop()
            if element.tag not in INLINE:
                self.blocks.pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def block(self) -> str:
        """Tag of the innermost element that is not inline."""
        return self.open[self.blocks[-1]].tag if self.blocks else ""


def text_nodes(page: str, paths: Paths | None = None) -> list[tuple[int, Element | None, str]]:
    """(block, innermost element, raw text) of each text node in page order."""
    out: list[tuple[int, Element | None, str]] = []
    stack, paths = Stack(), paths or Paths()
    block = at = 0

    def add(text: str) -> None:
        if text and not text.isspace():
            out.append((block, stack.open[-1] if stack.open else None, text))
        elif text and out and out[-1][0] == block:
            out.append((block, out[-1][1], " "))

    for start, end, tag, closing, attributes in tags_of(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if tag == "br":
            if out and out[-1][0] == block:
                out.append((block, out[-1][1], " "))
        elif closing:
            if (k := stack.last((tag,))) >= 0:
                stack.cut(k)
        elif tag not in VOID:
            if tag in CLOSES_P:
                # a button left open ends where a block begins
                for ends in ("p", "button"):
                    if stack.block() == ends:
                        stack.cut(stack.blocks[-1])
            elif tag in SIBLINGS:
                k = stack.last(SIBLINGS[tag])
                if k >= 0 and stack.last(("ul", "ol", "dl", "table", "select")) < k:
                    stack.cut(k)
            elif tag == "body":
                k = stack.last(("html",))
                stack.cut(k + 1)
            if not attributes.rstrip().endswith("/"):
                stack.push(Element(tag, attributes, stack.open[-1] if stack.open else None, paths))
    add(page[at:])
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 1, "edge"), SMOOTHING, "valid")


def path_scores(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Fused score of each path. Per block in page order: path number, text outside links, punctuation there; per path: factor."""
    n = len(factors)
    blocks = np.bincount(paths, minlength=n)

    def smooth(x: np.ndarray) -> np.ndarray:
        # a neighbour gives a block half of what it has at most, so that one long block lifts no short ones, nor links alone
        own = (np.bincount(paths, x, n) / blocks)[paths]
        return np.bincount(paths, np.minimum(_smooth(own), 1.5 * own), n)

    return smooth(lengths) * (1 + smooth(marks) / blocks) * factors


def ratios_decide(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray, named: np.ndarray) -> bool:
    """Whether the best path that is not named holds ``CLEAR`` times the text and marks of the best named one."""
    n = len(named)
    raw = np.bincount(paths, lengths, n) * (1 + np.bincount(paths, marks, n) / np.bincount(paths, minlength=n))
    return raw[~named].max(initial=0.0) >= CLEAR * raw[named].max(initial=0.0)


def content_paths(held: Paths, paths: list[int], scores: np.ndarray, named: np.ndarray, article: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Which paths are content; ``named``: named as boilerplate; ``article``: in an article or main element; ``linked``: links alone."""
    chosen = (scores > 0) & (scores >= SHARE * scores.max(initial=0.0))
    own = [held.no_flow[p] for p in paths]
    beside = {(own[k], bool(named[k])) for k in np.flatnonzero(chosen).tolist()}
    # everything below a content path's container, unless that holds the whole page; parents have smaller numbers
    below = [False] * len(held.above)
    for k in range(1, len(below)):
        below[k] = below[held.above[k]] or ((k, False) in beside and held.label[k] not in ("html", "body"))
    open_ = ~linked | article
    found = chosen | (open_ & np.array([(c, bool(n)) in beside or (not n and below[p]) for p, c, n in zip(paths, own, named, strict=True)], bool))
    if (chosen & article).any():
        found |= article & ~named
    return found


def main_text(page: str) -> str:
    held = Paths()
    blocks: dict[int, tuple[list[str], Element | None, list[int]]] = {}
    for block, element, raw in text_nodes(page, held):
        if element is not None and element.never:
            continue
        text = entities.unescape(raw) if "&" in raw else raw
        parts, _, counts = blocks.setdefault(block, ([], element, [0, 0]))
        parts.append(text)
        if element is None or not element.link:
            counts[0] += len(text.strip())
            counts[1] += len(_PUNCTUATION.findall(text))
    texts, found = [], []
    for parts, element, counts in blocks.values():
        text = " ".join("".join(parts).split())
        if text:
            texts.append(text)
            found.append((element, *counts))
    if not texts:
        return ""
    number: dict[tuple[int, bool, bool], int] = {}
    which = []
    for element, _, _ in found:
        path = held.no_inline[element.path] if element else 0
        which.append(number.setdefault((path, bool(element and element.named), bool(element and element.article)), len(number)))
    which, lengths, marks = np.array(which), np.array([f[1] for f in found], float), np.array([f[2] for f in found], float)
    named, article = np.array([n for _, n, _ in number]), np.array([a for _, _, a in number])
    scores = path_scores(which, lengths, marks, np.where(named, NAMED, 1.0))
    if not ratios_decide(which, lengths, marks, named):
        scores = np.where(named, 0.0, scores)
    linked = np.bincount(which, lengths, len(number)) == 0
    chosen = content_paths(held, [p for p, _, _ in number], scores, named, article, linked)
    return "\n".join(t for t, k in zip(texts, which.tolist(), strict=True) if chosen[k])


def extract_pages(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but html, and text and n_chars."""
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"]
            )

    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"row {kind}, text string, n_chars long")
    return out.select(*[F.col("row")[c].alias(c) for c in rest], "text", "n_chars")
