"""Text blocks of a web page with the path of tags that leads to each."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Fixed values of the HTML standard: elements without content, elements whose content is raw
# text, elements that run inside a line of text, and what closes an open paragraph-like element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br input".split()
)
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}
_HOLDS_ITEMS = frozenset("ul ol dl table select body".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)>""",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")


class Element:
    """An open element; it shares the path above it with all that stand beside it."""

    __slots__ = ("above", "names", "new", "last", "depth")

    def __init__(self, above: Element | None, names: list[str], new: list[str]):
        self.above, self.names, self.new = above, names, new  # new: names that no element above has
        self.last = ((above.last if above else []) + names)[-2:]  # the end of the path
        self.depth = above.depth + 1 if above else 0


@dataclass
class Block:
    """A run of text between two block borders, inside `element` (None: at the top)."""

    element: Element | None
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> list[str]:
        """Elements with their classes and ids from the top."""
        names, at = [], self.element
        while at:
            names.append(at.names)
            at = at.above
        return [n for part in reversed(names) for n in part]


def _names(tag: str, rest: str) -> list[str]:
    out = [tag]
    for m in _NAMED.finditer(rest) if "=" in rest else ():
        value = m[2] or m[3] or m[4] or ""
        for name in value.split():
            out.append("." + name.lower())
            parts = [p.lower() for p in _PARTS.findall(name)]
            out += ["." + p for p in parts if len(parts) > 1]
    return out


class _Open:
    """The open elements. Each operation costs what it opens or closes for good, however deep it happens."""

    def __init__(self):
        self.stack: list[tuple[str, Element]] = []
        self.live: list[bool] = []             # an inline element can be closed below others
        self.at: dict[str, list[int]] = {}     # where each tag stands in the stack, closed ones left out
        self.outer: list[int] = []             # where the elements stand that are not inline
        self.on_path: dict[str, int] = {}

    @property
    def element(self) -> Element | None:
        return self.stack[-1][1] if self.stack else None

    def inside(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def push(self, tag: str, names: list[str]) -> None:
        new = [n for n in dict.fromkeys(names) if not self.on_path.get(n)]
        for n in names:
            self.on_path[n] = self.on_path.get(n, 0) + 1
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((tag, Element(self.element, names, new)))
        self.live.append(True)

    def _pop(self) -> None:
        tag, element = self.stack.pop()
        for n in element.names:
            self.on_path[n] -= 1
        if self.live.pop():
            self.at[tag].pop()
        if tag not in INLINE:
            self.outer.pop()

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > place:
            self._pop()

    def end_inline(self, tag: str) -> None:
        """Close the innermost element of an inline tag, if no other block holds what follows."""
        places = self.at.get(tag)
        if places and (not self.outer or places[-1] > self.outer[-1]):
            self.live[places.pop()] = False
            while self.live and not self.live[-1]:
                self._pop()

    def ended_by(self, tag: str) -> int | None:
        """Where the element stands that a new `tag` ends without an end tag."""
        for place in reversed(self.outer):
            open_tag = self.stack[place][0]
            if open_tag == "p" or tag in ENDED_BY.get(open_tag, ()):
                return place
            if open_tag in _HOLDS_ITEMS or open_tag not in ENDED_BY:
                return None
        return None


def parse(html: str | None) -> list[Block]:
    """Blocks in page order, without empty ones. Broken markup is read as browsers do in the main:
    a new paragraph ends an open one, an end tag closes what it holds, a stray one is ignored."""
    html = html or ""
    open_ = _Open()
    blocks: list[Block] = []
    buffer: list[tuple[str, bool]] = []

    def flush() -> None:
        if buffer:
            # references are decoded once the pieces of the block are together
            text = " ".join(unescape("".join(t for t, _ in buffer)).split())
            if text:
                linked = sum(len(t) for t, inside in buffer if inside)
                blocks.append(Block(open_.element, text, linked))
            buffer.clear()

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        stop = token.start() if token else end
        if stop > at:
            buffer.append((html[at:stop], open_.inside("a")))
        if not token:
            break
        at = token.end()
        tag = (token["name"] or token["name2"] or "").lower()
        if not tag:
            continue
        rest = token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            if tag in INLINE:
                open_.end_inline(tag)
            elif open_.inside(tag):
                flush()
                open_.cut(open_.at[tag][-1])
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = shut.end() if shut else end
            continue
        if tag == "br":
            buffer.append((" ", False))
            continue
        if tag in VOID or tag in INLINE:
            if tag not in INLINE:
                flush()
            elif tag not in VOID:
                open_.push(tag, _names(tag, rest))
            continue
        flush()
        ended = open_.ended_by(tag)
        if ended is not None:
            open_.cut(ended)
        if not rest.endswith("/"):
            open_.push(tag, _names(tag, rest))
    flush()
    return blocks
