"""HTML to leaf blocks: pieces of text between block-level tags, with the tags above them."""

from __future__ import annotations

import functools
import html
import re
from typing import NamedTuple

#: A comment's start; a tag with its attributes; a declaration or another end; text; a lone `<`.
_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|[^<]++|<", re.S)
_TEXT = re.compile(r"(?:[^<]++|<(?![a-zA-Z/!?]))*+")
_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.S)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is raw text: they end at their end tag only, or with the page; `/>` does not close them.
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp", "title"}
#: Elements whose content is no text of the page.
SILENT = RAW | {"noscript", "template", "head", "svg", "select", "canvas", "video", "audio"}
#: Elements a head may hold; any other start tag, an end tag of head, body or html, and text end it.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags within a block; all others start and end blocks.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "semantics",
}
#: An open element of the first kind ends where one of the second starts.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Node:
    """A block-level element above some text: its tag, the words of its class, id and role, and what it is in. Blocks below it share it."""

    __slots__ = ("names", "parent", "vector")

    def __init__(self, names: tuple[str, ...], parent: Node | None):
        self.names, self.parent, self.vector = names, parent, None


class Block(NamedTuple):
    node: Node | None
    text: str
    linked: int  # characters inside links


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)


def _after_head(page: str, at: int) -> int:
    """The place after a head whose content starts at `at`: after its end tag, or before the first thing a head can't hold."""
    while m := _TOKEN.match(page, at):
        tag = (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        elif not tag:
            if m[0][:2] not in ("<!", "<?", "</") and m[0].strip():
                return at
            at = m.end()
        elif m[1]:
            if tag == "head":
                return m.end()
            if tag in ("body", "html"):
                return at
            at = m.end()
        elif tag not in IN_HEAD:
            return at
        else:
            at = m.end()
            if tag not in VOID:
                end = _end_of(tag).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
    return at


class _Open(NamedTuple):
    tag: str
    node: Node | None  # the nearest block-level element, itself included
    inline: bool


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, in time and memory linear in the page.

    Character references are decoded; white space becomes one space; empty
    blocks are left out. Unclosed elements end with their parent; end tags
    without a start are ignored; an inline end tag ends what is open within its
    element, and nothing beyond its block. An unclosed comment or raw element
    (script, style, ...) runs to the end of the page. A head ends at its end tag
    or before what it can't hold; of other silent elements without an end tag,
    and of those closed by `/>`, only the tag is left out. A tag whose quotes
    don't close ends at its first `>`.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    count: dict[str, int] = {}  # open elements by tag
    parts: list[str] = []
    linked = at = 0
    unclosed: set[str] = set()  # silent tags without an end tag in the rest of the page
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1].node if stack else None, text, linked))
            parts.clear()
        linked = 0

    def close() -> None:
        count[stack.pop().tag] -= 1

    n = len(page)
    while at < n:
        m = _TOKEN.match(page, at) if at <= last_end else None
        if m is None:  # no tag can end any more: what begins like one is none of the text
            parts.append(_TEXT.match(page, at)[0])
            linked += count.get("a", 0) > 0 and len(parts[-1])
            break
        start, at, tag, is_end, attributes = at, m.end(), m[2], m[1], m[3]
        if tag is None:
            t = m[0]
            named = _NAMED.match(page, start) if t == "<" else None
            if named:  # a tag whose quotes don't close
                tag, is_end, attributes = named[2], named[1], ""
                at = page.find(">", named.end()) + 1 or n
            else:
                if t == "<!--":
                    end = page.find("-->", at)
                    at = n if end < 0 else end + 3
                elif t[0] != "<" or t == "<":
                    parts.append(t)
                    linked += count.get("a", 0) > 0 and len(t)
                continue
        tag = tag.lower()
        if is_end:
            inline = tag in INLINE
            if not inline:
                flush()
            if count.get(tag):
                if inline:
                    k = len(stack) - 1
                    while k >= 0 and stack[k].inline and stack[k].tag != tag:
                        k -= 1
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            close()
                else:
                    while stack[-1].tag != tag:
                        close()
                    close()
            continue
        closed = page[at - 2] == "/"
        if tag in SILENT:
            if tag == "head":
                at = _after_head(page, at)
            elif tag in RAW or not closed and tag not in unclosed:
                end = _end_of(tag).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = n
                else:
                    unclosed.add(tag)
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if tag in VOID:
            continue
        if not inline:
            # formatting left open within a paragraph doesn't go on in the next block
            while stack and (stack[-1].inline or stack[-1].tag in ENDS and (ENDS[stack[-1].tag] is None or tag in ENDS[stack[-1].tag])):
                close()
        node = stack[-1].node if stack else None
        if not inline:
            names = (f"<{tag}>",)
            if attributes and not attributes.isspace():
                for a in _ATTRIBUTE.finditer(attributes):
                    if a[1].lower() in ("class", "id", "role"):
                        names += tuple(_NAME.findall((a[2] or a[3] or a[4] or "").lower()))
            node = Node(names, node)
        stack.append(_Open(tag, node, inline))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out
