"""The blocks of one HTML page, each with the region it stands in."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

BODY, OPEN, CHROME = "body", "open", "chrome"
HEADER = "header"  # of an article: its headings belong to the body, the rest does not

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head script style noscript template object svg math canvas audio video textarea select datalist option iframe title".split())
_APART = frozenset("nav footer aside form button dialog menu fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td textarea tfoot th thead tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCK - {"br", "button", "option", "select", "textarea"}
_CELLS = frozenset(["td", "th"])
_TERMS = frozenset(["dt", "dd"])
_SAME_LEVEL = {"li": frozenset(["li"]), "dt": _TERMS, "dd": _TERMS, "tr": _CELLS | {"tr"}, "td": _CELLS, "th": _CELLS}
_PARAGRAPH = frozenset(["p"])
_LEVEL_ENDS = frozenset("ul ol dl table select div section article main body".split())
# names of parts that are not the article, as words of class, id, role and the like
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar widget "
    "widgets related recommended recommendations trending share sharing social menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager masthead topbar header footer copyright comment comments commentlist discussion disqus "
    "reply replies respond login search toolbar skip complementary contentinfo".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    region: str
    text: str
    linked: int  # characters inside links


class _Node:
    __slots__ = ("tag", "parent", "hinted", "silent", "article", "holds", "link", "region")

    def __init__(self, tag: str, parent: _Node | None, attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        named = " ".join(attributes.get(a, "") for a in ("class", "id", "role", "data-role", "data-testid", "aria-label"))
        self.hinted = bool(named) and any(w.lower() in _HINTS for w in _WORD.findall(named))
        self.silent = tag in _SILENT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        role = attributes.get("role", "")
        main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
        self.article = main and not self.hinted
        self.holds = False  # an article stands below
        self.link = tag == "a" or (parent is not None and parent.link and tag not in _ENDS_PARAGRAPH)
        self.region: str | None = OPEN

    def place(self) -> None:
        """Set the region, once those above have theirs and all articles are known."""
        above = self.parent.region
        if above is None or self.silent:
            self.region = None
        elif above == CHROME:
            self.region = CHROME
        elif above == HEADER:
            self.region = BODY if self.tag in _HEADINGS else HEADER
        elif self.tag == "header" and above == BODY:
            self.region = HEADER
        elif self.tag in _APART or self.tag == "header":
            self.region = above if self.holds else CHROME
        elif self.hinted and not self.holds and self.tag not in ("html", "body"):
            self.region = CHROME
        elif self.article and not (self.tag == "main" and self.holds):
            self.region = BODY
        else:
            self.region = above


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _parse(html: str) -> list[tuple[_Node, str] | None]:
    """Pieces of text with the element they stand in; None where a block begins or ends."""
    root = _Node("", None, {})
    stack, nodes, out, at = [root], [], [], 0
    is_open: Counter = Counter()
    lower = None

    def close(depth: int) -> None:
        is_open.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    # nothing after the last ">" can be a tag, and looking for one there could take long
    last = html.rfind(">") + 1
    while at < len(html):
        m = _TAG.search(html, at, last) if at < last else None
        if m is None:
            out.append((stack[-1], html[at:].partition("<!--")[0]))
            break
        if m.start() > at:
            out.append((stack[-1], html[at : m.start()]))
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        closing, tag = (m[1], m[2]) if m[2] else (m[4], m[5])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            out.append(None)
        if closing:
            if is_open[tag] > 0:
                close(max(d for d in range(len(stack)) if stack[d].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
            continue
        ended = _SAME_LEVEL.get(tag, frozenset()) | (_PARAGRAPH if tag in _ENDS_PARAGRAPH else frozenset())
        if any(is_open[t] > 0 for t in ended):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended:
                    close(depth)
                    break
                if stack[depth].tag in _LEVEL_ENDS:
                    break
        if tag in _VOID:
            continue
        rest = m[3] if m[2] else m[6]
        node = _Node(tag, stack[-1], _attributes(rest))
        nodes.append(node)
        if node.article:
            above = node.parent
            while above is not None and not above.holds:
                above.holds = True
                above = above.parent
        if tag in _RAW:
            lower = html.lower() if lower is None else lower
            end = lower.find("</" + tag, at)
            shut = html.find(">", end) if end >= 0 else -1
            at = shut + 1 if shut >= 0 else len(html)
            continue
        if not rest.endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    for node in nodes:
        node.place()
    return out


def blocks(html: str | None) -> list[Block]:
    """The visible blocks of a page in page order.

    BODY is the declared article (``article``, or ``main`` without one in it) but for the parts that are
    marked as something else; CHROME is what is marked as something else: by its element or by the words
    of its class, id or role; OPEN is the rest. Scripts, styles and hidden parts are left out.
    """
    out: list[Block] = []
    parts: list[str] = []
    where, linked = None, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(where, text, linked))
            parts.clear()
        linked = 0

    for piece in _parse(html or ""):
        if piece is None:
            flush()
            continue
        node, text = piece
        if node.region is None:
            continue
        region = CHROME if node.region == HEADER else node.region
        if region != where:
            flush()
            where = region
        parts.append(text)
        if node.link:
            linked += len(text.strip())
    flush()
    return out
