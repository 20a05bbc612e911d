"""A small tree of an HTML page, as far as decisions and listings need one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from lodestone.functions.cleaning import clean

#: Elements that are no part of a text.
DROPPED = frozenset({"script", "style", "cite", "noscript"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends if it is open: an element, up to those that hold it.
_ENDS = {"p": ({"p"}, {"td", "div", "li", "body", "blockquote"}), "li": ({"li", "p"}, {"ul", "ol"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"})}
_ENDS["th"] = _ENDS["td"]
_BLOCKS = frozenset("div table ul ol h1 h2 h3 h4 blockquote".split())


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node | str]:
        for child in self.children:
            yield child
            if isinstance(child, Node):
                yield from child.walk()

    def find_all(self, name: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.name == name]

    def find_id(self, value: str) -> Node | None:
        return next((x for x in self.walk() if isinstance(x, Node) and x.attrs.get("id") == value), None)

    def text(self, separator: str = " ") -> str:
        return separator.join(x for x in self.walk() if isinstance(x, str))

    def clean_text(self) -> str:
        """Cleaned text, in which <br> ends a line."""
        return clean(self.text("\n" if self.find_all("br") else " "))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.open = [self.root]
        self.dropped = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropped:
            return
        if tag in DROPPED:
            self.dropped = tag
            return
        ends, within = _ENDS.get(tag, ({"p"}, {"td", "li", "body"}) if tag in _BLOCKS else (set(), set()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in within:
                break
            if self.open[k].name in ends:
                del self.open[k:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            self.dropped = "" if tag == self.dropped else self.dropped
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def links(html: str) -> list[str]:
    return [a.attrs["href"].strip() for a in tree(html).find_all("a") if a.attrs.get("href") is not None]


def page_text(html: str) -> str:
    return tree(html).clean_text()


def decode(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1; byte-order marks at the beginning go."""
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(encoding).lstrip("﻿")
        except UnicodeDecodeError:
            continue
    return ""
