"""A small HTML tree: tolerant of unclosed tags, enough for reading pages.

Built on the standard library's tokenizer. Elements that HTML closes implicitly are closed; formatting elements that a
paragraph's end cuts off are not reopened, which changes no text. Tables are not repaired.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: tag -> (open tags that it ends, tags beyond which it ends none)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("button table td th caption object".split())


class Node:
    """An element; its children are nodes and strings in page order."""

    __slots__ = ("tag", "attrs", "parent", "children", "marks")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.marks = tag, attrs, parent, [], {}

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def elements(self) -> Iterator[Node]:
        """Descendants in page order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.elements() if n.tag in tags)

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def strings(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in without:
                stack.extend(reversed(n.children))

    def text(self) -> str:
        return "".join(self.strings())


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head, self.body, self.at = None, None, self.root

    def open_until(self, tags: set[str], limit) -> Node | None:
        n = self.at
        while n is not None and n is not self.root:
            if n.tag in tags:
                return n
            if n.tag in limit:
                return None
            n = n.parent
        return None

    def inside(self) -> Node:
        """Where content goes: a body is made for content outside head and body."""
        if self.at is self.root:
            self.body = self.body or self.add("body", {})
            self.at = self.body
        return self.at

    def add(self, tag: str, attrs: dict[str, str]) -> Node:
        n = Node(tag, attrs, self.at)
        self.at.children.append(n)
        return n

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "html":
            for k, v in a.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head" and self.head is None and self.body is None:
            self.at = self.head = self.add("head", a)
            return
        if tag == "body":
            if self.body is None:
                self.at = self.root
                self.body = self.add("body", a)
            else:
                for k, v in a.items():
                    self.body.attrs.setdefault(k, v)
            self.at = self.body
            return
        if self.at is self.head and tag not in ("base", "link", "meta", "script", "style", "title", "noscript", "template"):
            self.at = self.root
        self.inside() if self.at is self.root and tag not in ("base", "link", "meta", "title") or self.body else None
        if self.at is self.root:
            self.head = self.head or self.add("head", {})
            self.at = self.head
        if tag in ENDS_P and (p := self.open_until({"p"}, SCOPE)):
            self.at = p.parent
        if tag in ENDS:
            while n := self.open_until(*ENDS[tag]):
                self.at = n.parent
        n = self.add(tag, a)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("path", "circle", "rect", "use", "g", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.at = self.root
            return
        if tag == "br":
            self.handle_starttag("br", [])
        n = self.at
        limit = () if tag in SCOPE or tag in ENDS_P else SCOPE
        if n := self.open_until({tag}, limit):
            self.at = n.parent

    def handle_data(self, data):
        if self.at in (self.root, self.head) and not data.strip():
            return
        if self.at is self.head:
            self.at = self.root
        self.inside().children.append(data)


#: A script or style, which has no references, or an ampersand with what could be its reference.
REFERENCE = re.compile(r"(<(script|style)\b.*?</\2)|&(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*)(;?)", re.S | re.I)


def closed_only(html: str) -> str:
    """``html`` with the ampersand written out of each character reference that no semicolon ends."""
    return REFERENCE.sub(lambda m: m[0] if m[1] or m[4] and (m[3][0] == "#" or f"{m[3]};" in html5) else f"&amp;{m[0][1:]}", html)


def parse(html: str, open_references: bool = True) -> Node:
    """The root element, ``html``, of a page; it has a body. As HTML has it, ``&amp`` is read without a semicolon too; without
    ``open_references`` it is text, like any name without one."""
    b = Builder()
    b.feed(html if open_references else closed_only(html))
    b.close()
    if b.body is None:
        b.at = b.root
        b.body = b.add("body", {})
    b.root.marks["body"] = b.body
    return b.root
