"""Leaf blocks of an HTML page: runs of text between block-level tags, with what stands above and around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# fixed values: element names of the HTML standard by their role here
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style template noscript iframe object svg math canvas audio video".split())
RAW = set("script style textarea title iframe".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul label".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
PARAGRAPH_FENCE = set("button table td th caption html body".split())

_QUOTED = r"""(?:[^>"'<]|"[^"<]*"|'[^'<]*')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/><]*)({_QUOTED}|[^<>]*)>", re.S)
NAMED = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # from the root to the block
    names: frozenset[str]  # words of class, id, role of all ancestors
    parent_names: frozenset[str]  # of the nearest element
    link_chars: int = 0
    emphasis: bool = False


@dataclass
class _Open:
    tag: str
    names: frozenset[str] = field(default_factory=frozenset)


def _names(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = set()
    for _, value in NAMED.findall(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value.strip("\"'"))
        found.update(WORDS.findall(value.lower()))
    return frozenset(found)


class _Builder:
    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.links = 0
        self.in_link = 0
        self.emphasis = False
        self.skipping = 0

    def text(self, raw: str) -> None:
        if self.skipping or not raw:
            return
        text = html.unescape(raw)
        self.parts.append(text)
        if self.in_link:
            self.links += len("".join(text.split()))
        if self.stack and self.stack[-1].tag in ("b", "strong", "em"):
            self.emphasis = True

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tags, names, nearest = [], set(), frozenset()
            for element in self.stack:
                names |= element.names
                if element.tag in BLOCK:
                    tags.append(element.tag)
                    nearest = element.names
            self.blocks.append(Block(text, tuple(tags), frozenset(names), nearest, self.links, self.emphasis))
        self.parts, self.links, self.emphasis = [], 0, False

    def _pop_to(self, at: int) -> None:
        for element in self.stack[at:]:
            self.in_link -= element.tag == "a"
            self.skipping -= element.tag in SKIPPED
        del self.stack[at:]

    def _close_implied(self, tags: set[str], fence: set[str]) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in tags:
                self._pop_to(at)
                return
            if self.stack[at].tag in fence:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if tag in CLOSED_BY:
                self._close_implied(CLOSED_BY[tag], FENCE[tag])
            elif tag not in ("option", "optgroup", "label", "button", "select"):
                self._close_implied({"p"}, PARAGRAPH_FENCE)
        if tag in VOID:
            return
        if tag == "a" and self.in_link:
            self._close_implied({"a"}, BLOCK)
        if attributes.endswith("/") and tag in ("svg", "path", "use", "rect", "g"):
            return
        self.in_link += tag == "a"
        self.skipping += tag in SKIPPED
        self.stack.append(_Open(tag, _names(attributes)))

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self._pop_to(at)
                return
            if tag not in BLOCK and self.stack[at].tag in BLOCK:
                return


def leaf_blocks(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles and comments are left out. Markup need not be well-formed."""
    builder, at = _Builder(), 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            builder.text(page[at:])
            break
        builder.text(page[at : m.start()])
        at = m.end()
        if m[1]:
            builder.end(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            builder.start(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(page, at)
                stop = close.start() if close else len(page)
                builder.text(page[at:stop])
                at = stop
    builder.flush()
    return builder.blocks
