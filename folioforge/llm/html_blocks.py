"""Leaf blocks of HTML pages: their text, their ancestors, and how much of them is links.

Tags are read as HTML's tokenizer reads them: an attribute value ends at its own quote or, without one, at white space or
``>``; a lone quote is part of a name or value. A page is read once, in time linear in its length: a tag or comment that
the page's end cuts off hides what is left of the page, a quote or an element that is never closed is looked for once, and
the open elements are found by tables of their places, not by walks over the stack. What isn't shown is no text: hidden
elements, and what stands for scripts where they are off.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_BLANK = r"[ \t\n\f\r]"
_ATTRIBUTE = rf"""[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{_BLANK}*+={_BLANK}*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*+)?+)?+"""
_TAG = re.compile(rf"(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_ATTRIBUTE})*+)>")
_MARKS = re.compile(rf"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:{_BLANK}*+={_BLANK}*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r"'>][^ \t\n\f\r>]*+))?+)?+""")
_SPLIT = re.compile(r"[^a-z]+")

#: Fixed values of HTML: elements whose content is no text of the page, those of them that an open end makes the rest of
#: the page, elements without an end, and elements that don't end a block.
RAW = {"script", "style", "template", "textarea", "select", "title", "noscript"}
OPEN_ENDED = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input map area "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "svg g text tspan iframe object canvas audio video embed param source track".split()
)
#: What a start tag closes when it is open above it, up to the first of the barriers; the last three close all of them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CLOSES_ALL = ("tr", "tbody", "tfoot")
BARRIERS = {"ul", "ol", "dl", "table", "select", "body", "article", "section", "main", "nav", "aside", "footer", "header"}


@dataclass(eq=False)
class Element:
    """An open element that ends a block: its tag, the words of its class, id and role, and the one around it."""

    tag: str
    words: tuple[str, ...]
    above: Element | None
    #: What readers of blocks keep here (the features of a path are made from those of the path above).
    notes: dict = field(default_factory=dict, repr=False)

    def path(self) -> list[Element]:
        """The elements from the outside in."""
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.above
        return out[::-1]


@dataclass(frozen=True)
class Block:
    """A leaf block: its text with white space made single, the innermost element around it, and the length of link text."""

    text: str
    inside: Element | None
    linked: int


def _words(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, id and role, sorted."""
    if "=" not in attributes:
        return ()
    values = (m[2] or m[3] or m[4] or "" for m in _MARKS.finditer(attributes) if m[1].lower() in ("class", "id", "role"))
    return tuple(sorted({w for v in values for w in _SPLIT.split(v.lower()) if w}))


_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hidden(attributes: str) -> bool:
    """Whether an element isn't shown: the attribute hidden, or a style that says so."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and _UNSEEN.search(value):
            return True
    return False


class _Stack:
    """The open elements, with the places of each tag, of blocks, of barriers and of hidden elements."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.hidden: list[int] = []
        self.elements: list[Element] = []

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, words: tuple[str, ...], hidden: bool = False) -> None:
        k = len(self.tags)
        if hidden:
            self.hidden.append(k)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(k)
        if tag not in INLINE:
            self.blocks.append(k)
            self.elements.append(Element(tag, words, self.elements[-1] if self.elements else None))
        if tag in BARRIERS:
            self.barriers.append(k)

    def pop(self, k: int) -> None:
        """Closes the element at a place and all inside it."""
        while self.hidden and self.hidden[-1] >= k:
            self.hidden.pop()
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                self.elements.pop()
            if tag in BARRIERS:
                self.barriers.pop()


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page's body in their order; blocks without text are left out."""
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    texts: list[str] = []
    linked = 0
    at, n = 0, len(page)
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, stack.elements[-1] if stack.elements else None, linked))
            texts.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text and not stack.hidden:
            if "&" in text:
                text = html.unescape(text)
            texts.append(text)
            if stack.at.get("a"):
                linked += len(text.strip())

    def skipped(tag: str, start: int) -> int:
        """Where the page goes on behind an element whose content is no text."""
        if tag not in unclosed:
            close = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\f\r/>])", re.I).search(page, start)
            if close:
                end = page.find(">", close.end())
                return end + 1 if end >= 0 else n
            unclosed.add(tag)
        return n if tag in OPEN_ENDED else start

    while at < n:
        begin = page.find("<", at)
        while begin >= 0 and not (begin + 1 < n and (page[begin + 1] in "!?/" or "a" <= page[begin + 1].lower() <= "z")):
            begin = page.find("<", begin + 1)  # no markup: a sign of the text
        read(page[at : begin if begin >= 0 else n])
        if begin < 0:
            break
        m = _TAG.match(page, begin + 1)
        if not m:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)
                at = end + 3 if end >= 0 else n
            elif page[begin + 1] in "!?" or page[begin + 1] == "/" and not page[begin + 2 : begin + 3].isalpha():
                end = page.find(">", begin + 2)
                at = end + 1 if end >= 0 else n
            else:
                at = n  # the page ends inside a tag
            continue
        at = m.end()
        tag = m[2].lower()
        block = tag not in INLINE
        if m[1]:
            k = stack.last(tag)
            if block:
                flush()
            if k >= 0 and (block or k > (stack.blocks[-1] if stack.blocks else -1)):  # an inline end tag closes nothing outside its block
                stack.pop(k)
            continue
        if tag in RAW:
            at = skipped(tag, at)
            continue
        if block:
            flush()
            if stack.blocks and stack.tags[stack.blocks[-1]] == "p":  # any block ends a paragraph
                stack.pop(stack.blocks[-1])
            closes = CLOSES.get(tag)
            while closes:
                k = max(map(stack.last, closes))
                if k <= (stack.barriers[-1] if stack.barriers else -1):
                    break
                stack.pop(k)
                if tag not in CLOSES_ALL:
                    break
        elif tag == "br":
            texts.append(" ")
        if tag not in VOID:
            stack.push(tag, _words(m[3]) if block else (), _hidden(m[3]))
    flush()
    return out
