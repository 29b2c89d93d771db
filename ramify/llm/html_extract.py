"""Operator 4: main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path. A step of
a path is an element's tag with its class and id. For every path the text and the
punctuation of all its blocks are added up and divided by the number of blocks,
and the two ratios are fused into one. Text inside page furniture (navigation, sides,
reader comments and so on) doesn't count, link text counts little, and so does text in
elements whose class or id sounds like furniture, unless it is the page's best. The fused ratios are smoothed over the tag tree: a path takes the best
ratio that it meets under one of its ancestors, less a share for every level
between, or none inside an article. Paths over a threshold of the page's own are
content, and their blocks are the text. A block outside the element that holds
most of it stays only where its own ratio is over the threshold too.

Pages are independent rows in Arrow batches; nothing is shuffled. Reading and
scoring take time in proportion to the page, however broken its tags are.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup and never page text.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes plaintext".split())
#: Elements that don't begin a new block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom semantics".split()
)
#: Elements that are page furniture or no text wherever they stand.
FURNITURE = frozenset(
    "nav aside footer menu dialog button fieldset template select svg object canvas datalist audio video annotation annotation-xml".split()
)
#: Words of a class, id or role that mark page furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner banners "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar skip "
    "footer foot colophon copyright legal disclaimer social share sharing related recommended recommendations widget widgets "
    "pagination pager login search form contentinfo complementary".split()
)
#: Words of a class or id that mark an advert inside a paragraph.
INLINE_MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner banners".split())
#: Words of a class or id that mark reader comments.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond reactions discussion".split())
#: Marks that are furniture outside an article only.
HEADERS = frozenset("header head".split())
#: Punctuation of running text.
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،।]")

#: What text counts in an element whose names mark it as furniture, for each of them that it lies in.
MARKED = 0.1
#: Characters of text in marked elements alone that make a story; less is the furniture that the names say.
LEAST_MARKED = 200
#: Share of the page's mean ratio that a content path reaches.
THRESHOLD = 0.5
#: What is left of a ratio for every level that it is handed up outside an article.
DECAY = 0.65
#: What a character of link text counts.
LINK_TEXT = 0.1
#: Share of the chosen text that the content element must hold.
HELD = 0.75

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"(?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+")
_MARKED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Path:
    """A tag path: its last step, its parent, whether it lies in furniture or in an article, whether it is marked itself, and what its text counts."""

    number: int
    parent: Path | None
    tag: str
    depth: int = 0
    furniture: bool = False
    article: bool = False
    marked: bool = False
    factor: float = 1.0
    steps: dict[tuple, Path] = field(default_factory=dict)


@dataclass(slots=True)
class Block:
    """Text of one block, how much of it is link text, its path, and the chain of open elements' numbers."""

    path: Path
    elements: tuple | None
    text: str
    linked: int


def _attributes(attrs: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role; whether the element is hidden, and hidden from readers aloud only."""
    words: set[str] = set()
    hidden = silent = False
    for name, a, b, c in _MARKED.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            silent |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in _SPACE.sub("", value.lower())
        else:
            words.update(_WORDS.findall(_CAMEL.sub(" ", value).lower()))
    return words, hidden, silent


def _is_furniture(tag: str, words: set[str], hidden: bool, inside_article: bool) -> bool:
    if tag in FURNITURE or hidden:
        return True
    if tag == "header":
        return not inside_article
    return tag not in ("html", "body") and bool(words & COMMENTS)


def _is_marked(tag: str, words: set[str], silent: bool, inside_article: bool) -> bool:
    """Whether an element's names say that it is furniture, which a page's story may overrule."""
    if tag in ("html", "body", "article", "main"):
        return False
    return tag == "form" or silent or bool(words & MARKS) or not inside_article and bool(words & HEADERS)


#: Elements that end when a sibling of the second kind begins.
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}


def tokens(page: str):
    """(text before, tag, is an end tag, attributes) of a page in order; the last one has no tag.

    Comments, declarations and raw elements are left out. Where all ``>`` after a tag
    are in quoted values, it ends at the first of them, and from there on quotes
    aren't heeded any more. A ``<`` that begins no tag is text.
    """
    at = start = 0
    quoted = True
    size = len(page)
    parts: list[str] = []
    last_end = page.rfind(">")
    while (k := page.find("<", at)) >= 0:
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            end = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", k):
            end = page.find("]]>", k)
            end = size if end < 0 else end + 3
        elif k > last_end:  # no tag ends any more
            break
        elif page[k + 1 : k + 2] in ("!", "?"):
            end = page.find(">", k) + 1
        else:
            name = k + 1 + (page[k + 1 : k + 2] == "/")
            found = _TAG_NAME.match(page, name)
            if not found:
                at = k + 1
                continue
            end = -1
            if quoted:
                end = _ATTRIBUTES.match(page, found.end()).end()
                if page[end : end + 1] != ">":
                    quoted, end = False, -1
            if end < 0:
                end = page.find(">", found.end())
            parts.append(page[start:k])
            tag = found[0].lower()
            closing = name > k + 1
            yield "".join(parts), tag, closing, page[found.end() : end]
            parts, start = [], end + 1
            at = start
            if tag in RAW and not closing:
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I).search(page, at)
                at = start = over.end()
            continue
        parts.append(page[start:k])
        at = start = end
    parts.append(page[start:])
    yield "".join(parts), "", False, ""


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order, those in page furniture included."""
    out: list[Block] = []
    root = Path(0, None, "")
    paths = numbers = 1
    stack: list[tuple[str, Path, tuple | None]] = [("", root, None)]  # tag, path, chain of element numbers
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = in_link = 0
    adverts: list[str] = []  # open inline elements from an advert on

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            if text := _SPACE.sub(" ", html_entities.unescape("".join(parts))).strip():
                out.append(Block(stack[-1][1], stack[-1][2], text, min(linked, len(text))))
            parts, linked = [], 0

    for text, tag, closing, attrs in tokens(page):
        if text and not adverts:
            parts.append(text)
            linked += len(text) if in_link else 0
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            if adverts:
                if closing and tag in adverts:
                    while adverts.pop() != tag:
                        pass
                elif not closing and tag not in VOID:
                    adverts.append(tag)
            elif attrs and not closing and tag not in VOID:
                words, hidden, _ = _attributes(attrs)
                if hidden or words & INLINE_MARKS:
                    adverts.append(tag)
            continue
        adverts = []
        if closing:
            if open_tags[tag] and (tag != "p" or stack[-1][0] == "p"):
                end_block()
                while (own := stack.pop()[0]) != tag:
                    open_tags[own] -= 1
                open_tags[tag] -= 1
            else:
                end_block()
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                end_block()
            continue
        end_block()
        while len(stack) > 1 and tag in CLOSES.get(stack[-1][0], ()):
            open_tags[stack.pop()[0]] -= 1
        in_link = 0
        _, parent, chain = stack[-1]
        words, hidden, silent = _attributes(attrs) if attrs else (set(), False, False)
        furniture = parent.furniture or _is_furniture(tag, words, hidden, parent.article)
        marked = _is_marked(tag, words, silent, parent.article)
        article = not furniture and (parent.article and not marked or tag in ("article", "main") or "articlebody" in attrs.lower())
        step = (tag, *sorted(words), furniture, article, marked)
        if (path := parent.steps.get(step)) is None:
            path = parent.steps[step] = Path(paths, parent, tag, parent.depth + 1, furniture, article, marked, parent.factor * (MARKED if marked else 1.0))
            paths += 1
        if attrs.rstrip().endswith("/") and tag not in ("p", "div", "span", "li"):
            continue
        stack.append((tag, path, (numbers, chain, parent.depth + 1)))
        open_tags[tag] += 1
        numbers += 1
    end_block()
    return out


def _chars(b: Block) -> float:
    """Characters of a block; link text counts little."""
    return len(b.text) - (1 - LINK_TEXT) * b.linked


def _fused(chars: float, marks: float) -> float:
    return (chars * (1 + marks)) ** 0.5


def path_ratios(found: list[Block]) -> dict[int, float]:
    """The fused ratio of every path that has blocks: characters a block, raised by its punctuation; less where marked, none in furniture."""
    count: Counter = Counter()
    chars: Counter = Counter()
    marks: Counter = Counter()
    for b in found:
        count[b.path.number] += 1
        if not b.path.furniture:
            chars[b.path.number] += _chars(b)
            marks[b.path.number] += len(PUNCTUATION.findall(b.text))
    factors = {b.path.number: b.path.factor for b in found}
    return {k: factors[k] * _fused(chars[k] / n, marks[k] / n) for k, n in count.items()}


def smoothed(found: list[Block], ratios: dict[int, float]) -> dict[int, float]:
    """Every path's ratio, or the best that an ancestor has from another path below it, if that is more.

    A ratio loses a share for each level it goes up, none within an article and two
    for leaving it. Two passes over the tag tree: the best from below, then the best from above.
    Nothing is handed into a marked element or out of it, and paths in furniture keep
    their own.
    """
    nodes: dict[int, Path] = {}
    for b in found:
        path = b.path
        while path is not None and path.number not in nodes:
            nodes[path.number] = path
            path = path.parent
    order = sorted(nodes.values(), key=lambda p: p.depth)
    best = {p.number: ratios.get(p.number, 0.0) for p in order}
    for p in reversed(order):
        if p.parent is not None and not p.furniture and not p.marked:
            handed = best[p.number] * (1.0 if p.parent.article else DECAY**2 if p.article else DECAY)
            best[p.parent.number] = max(best[p.parent.number], handed)
    for p in order:
        if p.parent is not None and not p.furniture and not p.marked:
            best[p.number] = max(best[p.number], best[p.parent.number])
    return {p.number: ratios.get(p.number, 0.0) if p.furniture else best[p.number] for p in order}


def _holder(chosen: list[Block]) -> int:
    """The deepest element that holds most of the chosen text, 0 for the page itself.

    Where that is the element of a single block, its parent, as neighbours count too.
    """
    total = sum(len(b.text) for b in chosen)
    weight: Counter = Counter()
    chains: dict[int, tuple] = {}
    for b in chosen:
        if b.elements is not None:
            weight[b.elements[0]] += len(b.text)
            chains[b.elements[0]] = b.elements
    # sums go up the tree, deepest elements first
    waiting = sorted(chains.values(), key=lambda c: -c[2])
    by_depth: dict[int, list[tuple]] = {}
    for c in waiting:
        by_depth.setdefault(c[2], []).append(c)
    own = {c[0] for c in waiting}
    for depth in range(max(by_depth, default=0), 0, -1):
        for c in by_depth.get(depth, ()):
            if weight[c[0]] >= HELD * total:
                leaf = c[0] in own and len(chosen) > 1
                return (c[1][0] if c[1] is not None else 0) if leaf else c[0]
            if c[1] is not None:
                if c[1][0] not in chains:
                    chains[c[1][0]] = c[1]
                    by_depth.setdefault(depth - 1, []).append(c[1])
                weight[c[1][0]] += weight[c[0]]
    return 0


def _inside(found: list[Block], element: int) -> list[bool]:
    """Whether each block lies in an element."""
    known: dict[int, bool] = {}
    out = []
    for b in found:
        seen, chain = [], b.elements
        while chain is not None and chain[0] not in known and chain[0] != element:
            seen.append(chain[0])
            chain = chain[1]
        inside = element == 0 or chain is not None and (chain[0] == element or known[chain[0]])
        for e in seen:
            known[e] = inside
        out.append(inside)
    return out


def main_text(page: str | None) -> str:
    """The page's article as one line of text, blocks joined by a space; empty if there is none."""
    found = blocks(page or "")
    ratios = path_ratios(found)
    weights = [0.0 if b.path.furniture else b.path.factor * _chars(b) for b in found]
    if not (total := sum(weights)):
        return ""
    bound = THRESHOLD * sum(w * ratios[b.path.number] for w, b in zip(weights, found, strict=True)) / total
    content = {k for k, r in smoothed(found, ratios).items() if r >= bound}
    chosen = [b for b in found if b.path.number in content]
    inside = _inside(chosen, _holder(chosen))
    own = [
        b for b, near in zip(chosen, inside, strict=True)
        if near or b.path.article or b.path.factor * _fused(_chars(b), len(PUNCTUATION.findall(b.text))) >= bound
    ]
    if all(b.path.factor < 1 for b in own) and sum(len(b.text) for b in own) < LEAST_MARKED:
        return ""
    return " ".join(b.text for b in own)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every page; a null or empty page gives an empty text. Repeated rows stay."""
    small_batches(pages.sparkSession)

    def run(batches):
        for ids, urls, pages_ in rows_of(batches, "id", "url", "html"):
            texts = [main_text(x) for x in pages_]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"`{key}` bigint, url string, text string, n_chars bigint")
