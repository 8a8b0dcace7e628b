"""Text blocks of raw HTML with the costs of calling them content or boilerplate."""

from __future__ import annotations

import html
import math
import re
from typing import NamedTuple

#: HTML's element kinds.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
HIDDEN = frozenset("head noscript template svg math object canvas select datalist button audio video map".split())
SEMANTIC = frozenset("nav aside footer menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag here closes an open one of the same kind, or an open paragraph.
SIBLINGS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "option": "option", "td": "td", "th": "th"}
#: Words of class, id and role that name parts of a page beside its article; those of REMARKS never name an article's frame.
REMARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising cookie cookies consent gdpr newsletter comment comments commentlist respond reply replies disqus discussion kommentar kommentare commentaire commentaires comentario comentarios commenti opiniones".split()
)
STRONG = REMARKS | frozenset(
    "adv banner sponsor sponsored promo promos promotion promoted aside sidebar rail "
    "related recommended recirculation share sharing social subscribe subscription signup login popup modal overlay "
    "pager pagination breadcrumb breadcrumbs navigation contentinfo complementary search "
    "werbung anzeige publicidad anuncio anuncios publicite seitenleiste barra".split()
)
WEAK = frozenset("nav navbar menu header masthead footer foot side widget notice notices alert toolbar skip copyright legal disclaimer form follow teaser topbar bottombar".split())
GOOD = frozenset("article content post entry story main body text prose".split())
#: A name that has one of these in it tells how a page is laid out, not what an element holds.
LAYOUT = frozenset("with without no not has have is hide hidden show free less only open closed enabled disabled wrap wrapper layout page container grid row col outer".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.DOTALL
)
OPENED = re.compile(r"<[a-zA-Z/!?]")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
CONCEALED = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

NEUTRAL, CONTENT, BESIDE, FIRM, MAIN, TEXT = range(6)
#: A hint that leaves less prose on the page than 1/4, 1/2 or 1/20 of what it would remove is dropped.
WRAPPER, FORM, PLAIN = 4, 2, 20
#: Words of prose without which an element that holds no heading, article or main part is no article.
LEAST_WORDS = 50


class Block(NamedTuple):
    text: str
    words: int
    linked: float
    state: int
    tag: str
    parent: int


class Element(NamedTuple):
    parent: int
    hint: int
    tag: str
    #: How many times the prose left beside it an element must hold for its hint to be dropped.
    bound: int


def _element(tag: str, attributes: str, parent: int) -> Element:
    """What an element's tag and names hint at, whatever stands around it."""
    named = set()
    if attributes:
        for m in NAMES.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = {w.lower() for w in PART.findall(name)}
                named |= words & GOOD if words & LAYOUT else words
    strong, weak, good = named & STRONG, named & WEAK, named & GOOD
    if tag == "main":
        return Element(parent, MAIN, tag, 0)
    if tag == "article" and not strong:
        return Element(parent, TEXT, tag, 0)
    if strong and not (good and tag != "article" and not strong & REMARKS):
        return Element(parent, FIRM, tag, PLAIN if strong & REMARKS or tag in SEMANTIC else WRAPPER)
    if tag in SEMANTIC:
        return Element(parent, FIRM, tag, PLAIN)
    if tag == "form":
        return Element(parent, FIRM, tag, FORM)
    if tag == "header" or (weak and not good):
        return Element(parent, BESIDE, tag, PLAIN if tag == "header" else WRAPPER)
    return Element(parent, CONTENT if good else NEUTRAL, tag, 0)


def _states(elements: list[Element], hints: list[int]) -> list[int]:
    """The state of each element: its hint in the light of those around it, parents before children."""
    out = [NEUTRAL]
    for e, hint in zip(elements[1:], hints[1:]):
        state = out[e.parent]
        if hint == MAIN:
            state = CONTENT
        elif hint in (TEXT, FIRM) or state == FIRM:
            state = FIRM if hint == FIRM or state == FIRM else CONTENT
        elif hint == BESIDE:
            state = state if state == CONTENT and e.tag == "header" else BESIDE
        elif hint == CONTENT and state == NEUTRAL:
            state = CONTENT
        out.append(state)
    return out


def settled(elements: list[Element], prose: list[int]) -> list[int]:
    """States of the elements, once hints that would leave the page without an article are dropped.

    prose: words outside links by element. The elements that hold most go first, until what stands beside the hinted ones
    is a fair part of what any of them holds. An element that is named for remarks, or a bar by its very
    tag, keeps its hint unless next to nothing else is on the page; one without a heading, an article or a
    main part in it likewise.
    """
    inside = list(prose)
    article = [e.tag in ("main", "article", "h1") for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        inside[elements[i].parent] += inside[i]
        article[elements[i].parent] |= article[i]
    hints = [e.hint for e in elements]
    hinted = [i for i, e in enumerate(elements) if e.bound and inside[i]]
    while True:
        states = _states(elements, hints)
        left = sum(n for n, s in zip(prose, states) if s in (NEUTRAL, CONTENT))
        wide = [i for i in hinted if inside[i] > left * (elements[i].bound if article[i] or elements[i].bound == FORM else PLAIN)]
        # bars by tag and remarks are never taken for the article of a page that has nothing to show for it
        wide = [i for i in wide if article[i] or (elements[i].bound != PLAIN and inside[i] >= LEAST_WORDS)]
        if not wide:
            return states
        most = max(inside[i] for i in wide)
        gone = {i for i in wide if inside[i] >= 0.8 * most}
        for i in gone:
            hints[i] = NEUTRAL
        hinted = [i for i in hinted if i not in gone]


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    found: list[tuple[str, int, float, int, str, int]] = []
    elements = [Element(0, NEUTRAL, "", 0)]
    #: (tag, its element, whether it is hidden), where each tag is open, and where the block elements are.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: dict[str, list[int]] = {}
    walls = [0]
    pieces: list[str] = []
    linked = in_link = 0
    at, end = 0, len(page)
    last = page.rfind(">")

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(raw)

    def close() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                whole = " ".join(words)
                tag, number, _ = stack[-1]
                group = stack[-2][1] if tag in HEADINGS or tag in ("p", "li", "td", "blockquote", "pre") else number
                found.append((whole, len(words), min(1.0, linked / len(whole)), number, tag, group))
            pieces.clear()
        linked = 0

    def push(tag: str, number: int, hidden: bool) -> None:
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            walls.append(len(stack))
        stack.append((tag, number, hidden))

    def cut(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()
        while walls[-1] >= depth:
            walls.pop()

    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if not m:
            # a tag or comment that never ends hides what follows
            text(OPENED.split(page[at:], maxsplit=1)[0])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        block = tag in BLOCK
        if block:
            close()
        elif tag in ("br", "td", "th"):
            pieces.append(" ")
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            where = opened.get(tag)
            # an inline element that is closed outside its block stays open
            if where and (block or where[-1] > walls[-1]):
                cut(where[-1])
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link += not attributes.rstrip().endswith("/")
        if block and stack[-1][0] in ("b", "i", "em", "strong", "span", "font", "u", "small", "a"):
            # an inline element left open does not hold blocks
            if stack[walls[-1]][0] == "p" or stack[-1][0] not in ("a", "span"):
                cut(walls[-1] + 1)
        if block and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in SIBLINGS and stack[-1][0] in (tag, SIBLINGS[tag]):
            cut(len(stack) - 1)
        if block and (tag in SEMANTIC or tag == "form") or tag in ("article", "section", "div"):
            in_link = 0
        number = stack[-1][1]
        hidden = stack[-1][2] or tag in HIDDEN or bool(attributes and CONCEALED.search(attributes))
        if not hidden and (block or attributes) and tag not in ("html", "body"):
            number = len(elements)
            elements.append(_element(tag, attributes, stack[-1][1]))
        push(tag, number, hidden)
    close()
    prose = [0] * len(elements)
    for _, words, part, number, _, _ in found:
        prose[number] += round(words * (1 - part))
    states = settled(elements, prose)
    return [Block(whole, words, part, states[number], tag, group) for whole, words, part, number, tag, group in found]


#: The linear classifier: what speaks for a block being content. Set by hand, as no page comes with labels.
BASE, LONG, SENTENCE, LINKED, HEADING = -0.6, 1 / 12, 1.0, -3.0, 0.8
BY_STATE = {NEUTRAL: 0.0, CONTENT: 2.5, BESIDE: -5.0, FIRM: -8.0}


def margin(b: Block) -> float:
    ends = b.text[-1] in ".!?…\"'”»:;" or b.text[-1] in "。！？"
    return BASE + BY_STATE[b.state] + min(2.5, b.words * LONG) + SENTENCE * ends + LINKED * b.linked + HEADING * (b.tag in HEADINGS and b.state in (NEUTRAL, CONTENT))


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling it content, cost of calling it boilerplate): the logistic losses."""
    z = margin(b)
    return math.log1p(math.exp(-z)) if z > -30 else -z, math.log1p(math.exp(z)) if z < 30 else z
