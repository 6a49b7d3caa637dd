"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Each block has its text (white space
as one space), its length, the share of its characters inside links and the
share of stop words among its words.

*First pass*, block by block.  Left out are blocks in containers that announce what they are: by tag, role or being
hidden (navigation, page header and footer, aside, form, dialog), or by a class or id that is as a whole the name
of reader comments, related pages, adverts or consent and newsletter notices (``comments``, ``related-posts``, ``ad-slot``).
Other such names (``sidebar``, ``widget``) are a prior: blocks inside are bad, unless one of the container's is good by its length, stop words and
few links, which disproves the name.  Names in a part with a modifier (``has-sidebar``, ``no-ads``)
say nothing.  An article that begins in a container of such a name isn't under it, unless good text came before.
Of the others, blocks with many link characters are bad, short blocks are undecided (bad, if they hold a
link), and longer ones are judged by stop words: many and long is good, many or
some is nearly good, few is bad.  Inside an article element the limits are wider: only
links throughout are bad, short blocks stay undecided, and longer ones are good with some stop words, nearly good without.

*Second pass*, over the page; blocks left out are passed over.  Undecided blocks take the label of the nearest decided
neighbours if these agree; if they differ, the label of the side on which a
nearly good block comes before the decided one, else bad.  Beyond the page is bad.  In an article, a paragraph, list item or the
like, or whatever ends like a sentence, needs a good neighbour of that article on one side only; so does what
ends like a sentence in a main element.  Nearly good blocks
become good if a neighbour is good, else bad.  A heading that is followed by a
good block within ``heading_reach`` characters is good if it was undecided.

If no article has a good block then, the undecided and nearly good ones of articles stand; on a page
without a good block and without these, all undecided and nearly good ones.  Good blocks, joined by a newline in page order, are the text.

Both passes take time in proportion to the page.

Broken markup: unclosed and stray tags are tolerated; an end tag closes the nearest
open container of its name and what is open inside; an article start ends open navigation,
headers and the like around it if the page has fewer end tags of that kind than start tags, or none after this place.

Edge cases: a null or empty page has an empty text; a page without any good block, too;
repeated rows are extracted each; an empty table gives no rows; other columns
aren't touched.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm.tables import small_text_batches

# Function words of the four languages.
STOP_WORDS = frozenset(
    "a an the and or but if of to in on at by for from with as is are was were be been being it its this that these those "
    "he she they we you i his her their our your not no so than then there which who what when where will would can could "
    "has have had do does did about into over after also more most other some such only "
    "le la les un une des du de et ou où mais que qui dans sur pour par avec sans ce cette ces il elle ils elles nous vous je "
    "est sont était être a ont au aux en ne pas plus se sa son ses leur leurs comme tout "
    "der die das den dem des ein eine einen einem einer und oder aber in im auf für mit von zu zum zur bei nach aus an am als "
    "ist sind war waren sein wird werden nicht auch sich es er sie wir ihr ich dass so wie noch nur "
    "el los las una unos unas y o pero que en con por para sin sobre su sus se lo al del es son era ser ha han no más como "
    "este esta estos estas ya muy".split())

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul title head".split())
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "noembed", "noframes", "xmp")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
#: Raw elements that hold the rest of the page if they aren't closed.
_SWALLOWS = frozenset("script style textarea title xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd td th caption figcaption".split())
#: Elements whose own text is running text, not a label of something.
_FLOW = _HEADINGS | _ITEMS | frozenset("p blockquote pre".split())
_ENDS = frozenset(".!?\u2026:;\"'\u201d\u2019\xbb\u300d\u3002\uff01\uff1f)")
_DROPPED = frozenset("head nav footer aside form menu dialog select button option fieldset".split())
_ARTICLE = frozenset("article main".split())
_CONTAINERS = _DROPPED | _ARTICLE | frozenset("header section div ul ol table figure body p".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination paywall popup promo promos promotion promoted recommended related reply "
    "replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toolbar "
    "topbar widget widgets".split())
#: Those that aren't overruled by density, if the other parts of the name are of these or the next kind.
_FINAL_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus gdpr newsletter promo "
    "promos promoted promotion recommended related replies reply respond sponsor sponsored".split())
_NAME_FILLERS = frozenset(
    "area article articles bar block body box card cards container content entry feed form holder inner item items link links list main news "
    "outer page pages panel post posts section slot stories story text thread title unit wrap wrapper".split())
#: Before a name they say that something has it or hasn't, not that it is it.
_MODIFIERS = frozenset("has have with without no not is hide hides show shows".split())
#: Inside an article they are parts of it.
_TITLES = frozenset("banner header teaser widget widgets".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())

# possessive and without "<" outside quotes, so that broken tags cost no more than their length
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""", re.S)
_HINT = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$|["'])""", re.I | re.S)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")

class Block(NamedTuple):
    text: str
    #: its characters inside links
    links: int
    #: the element it is directly in, if that holds text by itself
    kind: str
    #: in a container that announces that it is no content
    out: bool
    #: number of the article or main element it is in, else 0
    article: int
    main: bool
    #: number of the container whose name says that it is no content, else 0
    named: int
    #: whether the article began in such a container
    under: bool


class _Open(NamedTuple):
    tag: str
    out: bool = False
    article: int = 0
    main: bool = False
    named: int = 0
    under: bool = False


def _announces(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether role, hiding or a whole name say that an element is no content, and whether a part of class or id
    does.  inside: an article, whose own header holds its title."""
    named = final = False
    for m in _HINT.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            final = True
        elif name == "style":
            final = final or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "role":
            final = final or value.strip().lower() in _BAD_ROLES
        elif name in ("class", "id"):
            for one in value.split():
                parts = {x.lower() for x in _NAME_PARTS.findall(one)}
                if not parts.isdisjoint(_MODIFIERS):
                    continue
                final = final or not parts.isdisjoint(_FINAL_NAMES) and parts <= _BAD_NAMES | _NAME_FILLERS
                named = named or not parts.isdisjoint(_BAD_NAMES - _TITLES if inside else _BAD_NAMES)
    return final, named


def blocks(page: str) -> Iterator[Block]:
    """The blocks that have text, in page order."""
    held: list[str] = []
    linked: list[str] = []
    stack = [_Open("")]
    depth: Counter[str] = Counter()
    endless: set[str] = set()       # raw elements that don't end any more
    ends: dict[str, int] = {}
    kind = ""
    links = at = articles = names = 0

    def flush() -> Iterator[Block]:
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            yield Block(text, len(_SPACE.sub(" ", "".join(linked)).strip()), kind, *stack[-1][1:])
        held.clear()
        linked.clear()

    def put(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                linked.append(text)

    def pop() -> None:
        depth[stack.pop().tag] -= 1

    def closes(tag: str) -> bool:
        """Whether each such element is closed, and one after this place."""
        if tag not in ends:
            last = [m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)]
            ends[tag] = last[-1] if last and len(re.findall(rf"<{tag}(?=[\s/>])", page, re.I)) <= len(last) else -1
        return ends[tag] > at

    n = len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at: m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            held.append(m[0][9:].removesuffix("]]>"))
        name = m[2] or m[5]
        if name is None:
            continue
        closing, tag, attributes = bool(m[1] or m[4]), name.lower(), (m[3] if m[2] else m[6])
        if tag in _RAW and not closing:
            if not attributes.endswith("/") and tag not in endless:
                end = _RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            if tag in endless and tag in _SWALLOWS:
                break
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in _BLOCK and tag not in _CONTAINERS:
            continue
        yield from flush()
        links = 0
        kind = tag if tag in _FLOW and not closing else ""
        if closing:
            if depth[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in _ARTICLE or tag == "body":
            # navigation and the like that was left open doesn't swallow the article
            while stack[-1].tag in _DROPPED | {"header", "ul", "ol", "p"} and not (stack[-1].tag in _DROPPED and closes(stack[-1].tag)):
                pop()
        if tag in _CONTAINERS and not attributes.endswith("/"):
            if tag == "p" and stack[-1].tag == "p":
                pop()
            around = stack[-1]
            inside = around.article > 0
            final, named = _announces(attributes, inside and tag != "article") if tag not in ("main", "body") else (False, False)
            out = around.out or final or tag in _DROPPED or tag == "header" and not inside
            article, main, own, under = around.article, around.main, around.named, around.under
            if tag == "article" and inside and not main:
                # comments are often articles inside an article
                out = out or named
            elif tag in _ARTICLE and (not inside or main and tag == "article"):
                articles += 1
                article, main, under, own = articles, tag == "main", under or own > 0 or named, 0
            elif named and not own:
                names += 1
                own = names
            stack.append(_Open(tag, out, article, main, own, under))
            depth[tag] += 1
    yield from flush()


def _stop_share(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def _judged(b: Block, max_links: float, short: int, long: int, few: float, many: float) -> str:
    """The first pass on one block, its container's name aside."""
    density, in_article = b.links / len(b.text), b.article and not b.main
    if density > (0.9 if in_article else max_links) or "\xa9" in b.text and not in_article:
        return "bad"
    if len(b.text) < short:
        return "bad" if b.links and not in_article else "short"
    share = _stop_share(b.text)
    if in_article:
        return "good" if share >= few and density <= 0.5 else "near"
    if share >= many:
        return "good" if len(b.text) >= long else "near"
    return "near" if share >= few else "bad"


def _first_pass(found: list[Block], max_links: float, short: int, long: int, few: float, many: float) -> list[str]:
    strict = (max_links, short, long, few, many)
    dense = [b._replace(article=0) for b in found]
    # names that a good block of the container disproves
    content = {b.named for b, d in zip(found, dense) if b.named and not b.out and len(b.text) >= long and _judged(d, *strict) == "good"}
    label, seen = [], False
    for b in found:
        if b.out:
            label.append("out")
        elif b.named and b.named not in content:
            label.append("bad")
        elif b.under and seen:
            label.append("bad")
        else:
            label.append(_judged(b, *strict))
            seen = seen or label[-1] == "good" and not b.under
    return label


def _neighbours(found: list[Block], first: list[str], order: range) -> list[tuple[str, int, bool]]:
    """For each block the nearest decided label before it in ``order`` and the article that is from, and whether
    a nearly good block comes between; bad and -1 beyond the page."""
    out = [("bad", -1, False)] * len(found)
    label, article, near = "bad", -1, False
    for i in order:
        out[i] = label, article, near
        if first[i] in ("good", "bad"):
            label, article, near = first[i], found[i].article, False
        elif first[i] == "near":
            near = True
    return out


def _second_pass(found: list[Block], first: list[str], heading_reach: int) -> list[str]:
    label = list(first)
    n = len(found)
    sides = zip(_neighbours(found, first, range(n)), _neighbours(found, first, range(n - 1, -1, -1)))
    for i, (b, one, (before, after)) in enumerate(zip(found, first, sides)):
        if one not in ("short", "near"):
            continue
        own = [s for s in (before, after) if s[1] == b.article > 0]
        sentence = b.text[-1] in _ENDS
        flows = b.kind in _HEADINGS or (sentence or bool(b.kind) and (b.kind not in _ITEMS or before in own) and not b.main)
        if one == "near":
            label[i] = "good" if "good" in (before[0], after[0]) else "bad"
        elif own and flows:
            label[i] = "good" if any(s[0] == "good" for s in own) else "bad"
        elif before[0] == after[0]:
            label[i] = before[0]
        else:
            label[i] = "good" if (before if before[0] == "bad" else after)[2] else "bad"
    gone = heading_reach + 1
    for i in range(n - 1, -1, -1):
        if found[i].kind in _HEADINGS and first[i] in ("short", "near") and gone <= heading_reach:
            label[i] = "good"
        gone = 0 if label[i] == "good" else gone + len(found[i].text)
    return label


def main_text(page: str, max_links: float = 0.2, short: int = 70, long: int = 200, few: float = 0.2, many: float = 0.3,
              heading_reach: int = 200) -> str:
    found = list(blocks(page))
    first = _first_pass(found, max_links, short, long, few, many)
    label = _second_pass(found, first, heading_reach)
    stand = [x in ("short", "near") for x in first]
    in_article = [b.article > 0 and not b.main for b in found]
    if not any(a and x == "good" for a, x in zip(in_article, label)) and any(a and s for a, s in zip(in_article, stand)):
        label = ["good" if a and s else x for a, s, x in zip(in_article, stand, label)]
    elif "good" not in label:
        label = ["good" if s else x for s, x in zip(stand, label)]
    return "\n".join(b.text for b, x in zip(found, label) if x == "good")


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", **rules) -> DataFrame:
    """``pages`` with the main text of ``html_col`` in place of it, as ``text_col`` and last."""
    small_text_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    kind = pages.select(F.struct(*rest).alias("k")).schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(x.as_py() or "", **rules) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", text_col])

    got = pages.select(F.struct(*rest).alias("k"), F.col(html_col).alias("h")).mapInArrow(run, f"k {kind}, {text_col} string")
    return got.select("k.*", text_col)
