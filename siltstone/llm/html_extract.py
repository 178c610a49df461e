"""Main-text extraction from HTML by tree scoring.

A tolerant tokenizer builds the element tree (void elements, implied end tags,
unclosed elements, comments and raw-text elements are understood; what cannot be
a tag is text; character references are decoded in each text on its own).

1. Elements that are never an article by their tag, role or visibility (menus, page
   headers, footers, sidebars, dialogs) are set aside; so are forms that hold less than
   NOTABLE of the page's unlinked characters.
2. A class or id name is a name of such parts if every word of it is one of theirs or a general
   one (left, box, wrapper), and one at least is theirs; words are parted by hyphens, underscores and capitals.
   An element of that name is set aside if it holds less than NOTABLE of the page's unlinked characters, or
   if as much as LEAST_PROSE unlinked characters of paragraphs stand outside all such elements: inside <article>
   or <main> for any but readers' comments, anywhere for those (else they go below ALL_BUT).
   One that holds an <article> is judged by NOTABLE alone.  Paragraphs and list items of an article only go as adverts or
   comments.  What stays has a fifth of its score.
3. Every paragraph-like element passes points to its ancestors, for its length and its
   commas: all of them to its parent, half to its grandparent, and ever less further up.
   <article> gets the points of all its paragraphs whole and ARTICLE_POINTS more, <main> at least half of them.
   An element's points are discounted by its link density; the best one is the container.
   Unless it is an <article>, its parent takes its place while that holds CLIMB times the points or more.
4. Siblings of the container are kept when they score well beside it, read like prose or hold a
   heading; beside an <article>, the other articles that are not mostly links, teasers (by name, or with a
   linked heading) apart.  Of a whole page
   without containers, lists of nothing but links at its top level go.

Inside what is kept nothing but the elements set aside is dropped: lists of linked
sources, sections, formulas and a button within a sentence stay.

The text of each block has its white space folded; blocks are joined by a newline in page
order.  The whole page is read.

Edge cases: null and empty pages give an empty text, as do pages without text;
a page without any paragraph gives what remains after setting elements aside;
ties go to the element that opens first; repeated rows are extracted each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
SET_ASIDE = frozenset("nav footer aside dialog head menu".split())
FORMS = frozenset("form fieldset".split())
SET_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
PART_WORDS = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promotion promotions recommended related share sharing sidebar signup skip social sponsor sponsored sponsors subscribe teaser teasers toolbar topbar widget".split()
)
AD_WORDS = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors".split())
TEASER_WORDS = frozenset("teaser teasers".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
GENERAL_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons column container content form global group icons inner item items left link links list main outer page panel post posts primary reader readers reply right row secondary section site slot stories story text thread top unit user users wrap wrapper zone".split()
)
_NEVER_BY_NAME = frozenset("html body main".split())
#: Share of the page's unlinked characters with which an element stays whatever its names; for readers' comments.
NOTABLE, ALL_BUT = 0.4, 0.9
#: Unlinked characters of paragraphs beside which named parts go at any size.
LEAST_PROSE = 80
CLIMB = 1.25
ARTICLE_POINTS = 25.0
PENALTY = 0.2
#: An end is implied for an open element of the value when an element of the key starts.
_CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tbody": frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPE = frozenset("table ul ol dl body html td th article section div main".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


NONE, NAMED, COMMENTS, FORM, TEASER, ASIDE = range(6)
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(4096)
def _words(name: str) -> frozenset[str]:
    """The words of a name if all are those of parts other than articles, or general ones."""
    words = frozenset(_WORD.findall(_CAPITAL.sub("-", name).lower()))
    return words if words <= PART_WORDS | COMMENT_WORDS | GENERAL_WORDS | {"header"} else frozenset()


class Node:
    __slots__ = ("tag", "parent", "children", "kind", "aside", "chars", "linked", "commas", "points", "full", "tail")

    def __init__(self, tag: str, parent: Node | None, kind: int = NONE):
        self.tag, self.parent, self.kind, self.aside = tag, parent, kind, kind == ASIDE
        self.children: list[Node | str] = []
        self.chars = self.linked = self.commas = 0
        self.points = self.full = 0.0
        self.tail = ""


def _kind(tag: str, attributes: str, inside_article: bool, parent: Node) -> int:
    """What an element with these attributes may be, other than a part of an article."""
    if tag in SET_ASIDE or (tag == "header" and not inside_article):
        return ASIDE
    kind = FORM if tag in FORMS else NONE
    if not attributes or attributes.isspace():
        return kind
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        key, value = (name or bare).lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return ASIDE
        if tag in _NEVER_BY_NAME:
            continue
        if key == "role":
            value = value.lower()
            if value in SET_ASIDE_ROLES:
                return ASIDE
            if value == "form":
                kind = FORM
        elif key in ("class", "id") and tag not in HEADINGS and kind in (NONE, NAMED):
            words = frozenset().union(*map(_words, value.split()))
            if tag == "article":
                if not TEASER_WORDS.isdisjoint(words):
                    kind = NAMED if _inside(parent, "article") else TEASER
            elif not COMMENT_WORDS.isdisjoint(words):
                kind = COMMENTS
            elif not (AD_WORDS if inside_article and tag in PARAGRAPHS else PART_WORDS).isdisjoint(words) or (not inside_article and "header" in words):
                kind = NAMED
    return kind


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


def parse(html: str) -> Node:
    """The element tree of a page; character references are decoded in each run of text."""
    root = node = Node("#root", None)
    at, end, article = 0, len(html), 0
    match = _TOKEN.search
    while at < end:
        token = match(html, at)
        if token is None:
            node.children.append(unescape(html[at:]))
            break
        if token.start() > at:
            node.children.append(unescape(html[at : token.start()]))
        at = token.end()
        name = token[2] or token[5]
        if not name:
            continue
        tag, attributes = name.lower(), token[3] or token[6] or ""
        if token[1] or token[4]:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                while node is not up.parent:
                    article -= node.tag in ("article", "main")
                    node = node.parent
            elif tag == "br":
                node.children.append(Node("br", node))
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag != "svg":
                closing = _RAW_END[tag].search(html, at)
                at = closing.end() if closing else end
            continue
        if tag in BLOCK:
            up = node
            closes = _CLOSES.get(tag, ())
            last = None
            while up.parent is not None:
                if up.tag == "p" or up.tag in closes:
                    last = up
                if up.tag in _SCOPE and up.tag not in closes:
                    break
                up = up.parent
            if last is not None:
                node = last.parent
        child = Node(tag, node, _kind(tag, attributes, article > 0, node))
        node.children.append(child)
        if tag not in VOID:  # a slash before the end does not close an HTML element
            node = child
            article += tag in ("article", "main")
    return root


def _kept(node: Node) -> list[Node]:
    """The elements that are not set aside, each before what it holds, in page order."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        if not n.aside:
            order.append(n)
            stack += [c for c in reversed(n.children) if type(c) is Node]
    return order


def _count(order: list[Node]) -> None:
    """Characters, linked characters and commas of every element, without what is set aside."""
    for n in reversed(order):
        n.chars = n.linked = n.commas = 0
        for c in n.children:
            if type(c) is str:
                text = c.strip()
                if text:
                    n.chars += len(text)
                    n.commas += text.count(",") + text.count("،") + text.count("、") + text.count("，")
                    n.tail = text
            elif not c.aside:
                n.chars += c.chars
                n.linked += c.linked
                n.commas += c.commas
                n.tail = c.tail or n.tail
        if n.tag == "a":
            n.linked = n.chars


def _prose_outside(order: list[Node]) -> tuple[int, int]:
    """Unlinked characters of paragraphs outside all parts that may go: in the whole page, inside articles."""
    page = article = 0
    part, within, counted = set(), set(), set()
    for n in order:
        up = id(n.parent)
        if n.kind != NONE or up in part:
            part.add(id(n))
        if n.tag in ("article", "main") or up in within:
            within.add(id(n))
        if up in counted:
            counted.add(id(n))
        elif n.tag in PARAGRAPHS and id(n) not in part:
            counted.add(id(n))
            page += n.chars - n.linked
            article += (n.chars - n.linked) * (id(n) in within)
    return page, article


def _set_aside(order: list[Node]) -> bool:
    """Set aside forms and named elements that hold too little of the page; whether there were any."""
    parts = [n for n in order if n.kind not in (NONE, TEASER)]
    if not parts:
        return False
    total, found = order[0].chars - order[0].linked, False
    page, article = _prose_outside(order)
    holds = set()
    for n in order:
        if n.tag in ("article", "main"):
            up = n.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for n in parts:
        own = n.chars - n.linked
        if n.kind == COMMENTS:
            gone = page >= LEAST_PROSE or own < ALL_BUT * total
        else:
            gone = own < NOTABLE * total or (n.kind == NAMED and article >= LEAST_PROSE and id(n) not in holds)
        if gone or not own:
            n.aside = found = True
    return found


def _button(n: Node) -> bool:
    """Whether a button is no part of a sentence."""
    up = n.parent
    while up.tag not in BLOCK and up.parent is not None:
        up = up.parent
    return up.tag not in PARAGRAPHS or up.chars <= n.chars


def _measure(root: Node) -> list[Node]:
    """Set elements aside, count what is left and pass points to ancestors; the elements that stay."""
    order = _kept(root)
    _count(order)
    changed = _set_aside(order)
    for n in order:
        if n.tag == "button" and _button(n):
            n.aside = changed = True
    if changed:
        order = _kept(root)
        _count(order)
    for n in order:
        own = n.tag in PARAGRAPHS or (n.tag in ("div", "section", "article", "main", "form", "body", "#root") and any(type(c) is str and len(c.strip()) > 20 for c in n.children))
        if not own or n.chars < 1:
            continue
        points = (min(1.0, n.chars / 25) + n.commas + min(n.chars / 100, 30.0)) * (1 - n.linked / n.chars)
        up = n.parent if n.tag in PARAGRAPHS else n
        level = 0
        while up is not None:
            up.full += points
            if up.tag in BLOCK or up.parent is None:  # inline elements, often unclosed, hold no article
                share = 1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level)
                up.points += points * (1.0 if up.tag == "article" else max(0.5, share) if up.tag == "main" else share)
                level += 1
            up = up.parent
    for n in order:
        n.points += ARTICLE_POINTS if n.tag == "article" and n.points else 0.0
        if n.kind in (NAMED, COMMENTS, TEASER):
            n.points *= PENALTY
    return order


def _score(node: Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def _container(root: Node, order: list[Node]) -> list[Node | str]:
    """What is kept: the best container and its siblings worth keeping, in page order."""
    best = max((n for n in order if n.points), key=_score, default=root)
    if best.parent is None:
        return [best]
    if best.tag != "article":
        up = best.parent
        while up.tag not in ("#root", "html", "body") and up.kind == NONE and up.full >= CLIMB * best.full and up.linked < 0.3 * up.chars:
            best, up = up, up.parent
    least = max(10.0, PENALTY * _score(best))
    kept: list[Node | str] = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif type(c) is str:
            if best.tag != "article" and len(c.strip()) > 25:
                kept.append(c)
        elif not c.aside and c.kind == NONE and c.chars:
            density = c.linked / c.chars
            if best.tag == "article":
                wanted = c.tag == "article" and density < 0.5 and not _teaser(c)
            else:
                prose = c.tag in BLOCK and density < 0.25 and (c.chars > 80 or _SENTENCE_END.search(c.tail) is not None)
                wanted = _score(c) >= least or prose or (density < 0.5 and any(h.tag in HEADINGS and h.chars for h in _kept(c)))
            if wanted:
                kept.append(c)
    return kept


def _teaser(node: Node) -> bool:
    """Whether an article's headings are links."""
    headings = [n for n in _kept(node) if n.tag in HEADINGS and n.chars]
    return any(n.linked >= n.chars for n in headings)


def _blocks(kept: list[Node | str]) -> list[str]:
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        text = " ".join("".join(inline).split())
        if text:
            out.append(text)
        inline.clear()

    stack: list[Node | str | None] = [x for k in reversed(kept) for x in (None, k)]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif type(n) is str:
            inline.append(n)
        elif n.aside:
            continue
        elif n.tag == "br":
            inline.append(" ")
        else:
            if n.parent is not None and (n.parent.tag == "#root" or n.parent.tag == "body") and n.tag in _LISTS and n.chars and n.linked >= 0.8 * n.chars and _links(n) >= 3:
                continue  # a menu without a name
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(n.children)
    flush()
    return out


_LISTS = frozenset("ul ol div dl table".split())


def _links(node: Node) -> int:
    count, stack = 0, [node]
    while stack:
        n = stack.pop()
        count += n.tag == "a"
        stack += [c for c in n.children if type(c) is Node]
    return count


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html.replace("\x00", "\ufffd"))
    return "\n".join(_blocks(_container(root, _measure(root))))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Columns ``keep`` of pages and text, the main text of each page."""
    source = pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("_html"))
    schema = source.drop("_html").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return source.mapInArrow(run, schema)
