"""A page's HTML read once into blocks, links, images, data and declarations.

:func:`read_page` first marks every element from the top down (hidden, skipped, in chrome, visible bytes), then everything
else asks the marks. :func:`extract_pages` runs it over a table of pages in Arrow batches; child tables are made from its
struct by the functions of :mod:`sievework.operators`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from .dom import Node, parse

# The element and name lists, marks and limits that decide what a reader sees and what a block is.
SKIP = frozenset("script style noscript nav footer aside form svg button iframe template select input textarea dialog canvas video audio object".split())
INLINE = frozenset("a span em strong b i code small sup sub abbr mark u s del ins time br kbd q cite label var samp dfn bdi wbr font img picture data".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PARAGRAPHS = ("p", "figcaption", "dt", "dd", "summary")
OWN_BLOCKS = frozenset((*HEADINGS, *PARAGRAPHS, "pre", "blockquote", "li", "ul", "ol", "table"))
CHROME_ROLES = frozenset("navigation complementary contentinfo search menu menubar".split())
CHROME_NAMES = frozenset("navbox vertical-navbox sidebar toc vector-toc references reflist mw-references-wrap catlinks mw-editsection mw-jump-link breadcrumb breadcrumbs sistersitebox printfooter".split())
CAROUSEL = ("slide", "slider", "carousel", "swiper", "splide", "glide", "owl-", "slick", "gallery")
SCREEN_READER = frozenset(("sr-only", "visually-hidden", "screen-reader-text"))
PERMALINKS = ("", "¶", "#", "§", "🔗", "⚓")
NOISE = ("sprite", "pixel", "tracking", "spacer", "blank.gif", "favicon", "1x1", "spinner", "emoji")
FORMATS = ("jpg", "jpeg", "png", "webp", "avif")
CURRENCY = "$€£¥₹₩₽₺"
UNITS = ("a", "per", "mo", "month", "yr", "year", "user", "seat")
SEPARATORS = ".,/-–|·"
SHORT, JOINED, CARD_CHARS, CARD_MEMBERS, BLOCK_LINKS = 25, 400, 1200, 3, 20
DEEP, SHARE, SHAPE_DEPTH, SHAPE_CHILDREN, BUTTON_WORDS, SLOTS = 256, 5, 3, 16, 6, 100_000
UNREAD = frozenset(("script", "style", "noscript", "template"))
BREAK = "\x1f"
GAP = re.compile(r"[\s\x1f]+")


def collapse(text: str) -> str:
    """Runs of white space become a blank, or a newline where they cross a block's edge."""
    return GAP.sub(lambda m: "\n" if BREAK in m[0] else " ", re.sub(r"[\x1c-\x1e]", "\0", text)).strip(" \n").replace("\0", "\x1c")


# Marks


def style_of(n: Node) -> dict[str, str]:
    out = {}
    for part in (n.get("style") or "").split(";"):
        name, cut, value = part.partition(":")
        if cut:
            out[name.strip().lower()] = re.sub(r"!\s*important\s*$", "", value, flags=re.I).strip().lower()
    return out


def number(value: str | None) -> float | None:
    try:
        return float((value or "").rstrip("%"))
    except ValueError:
        return None


def in_carousel(n: Node) -> bool:
    for k, x in enumerate([n, *n.up()]):
        if k >= 8:
            break
        if any(w in (x.get("class") or "").lower() for w in CAROUSEL):
            return True
    return False


def hides_itself(n: Node) -> bool:
    """A hidden attribute or style, or a transparent state beside an opaque one of its kind."""
    a = n.attrs
    if "hidden" in a and not is_segment(n):
        return True
    css = style_of(n) if "style" in a else {}
    if css.get("display") == "none" or css.get("visibility") in ("hidden", "collapse"):
        return True
    if "opacity-0" not in n.classes and number(css.get("opacity")) != 0:
        return False
    beside = [c for c in n.parent.children if isinstance(c, Node)] if n.parent else []
    at = next((i for i, c in enumerate(beside) if c is n), 0)
    return any(c.tag == n.tag and opaque(c) for c in beside[max(0, at - 1) : at] + beside[at + 1 : at + 2]) and not in_carousel(n)


def opaque(n: Node) -> bool:
    value = style_of(n).get("opacity") if "style" in n.attrs else None
    return "opacity-100" in n.classes or value is not None and number(value) == (100 if value.endswith("%") else 1)


def is_segment(n: Node) -> bool:
    return n.tag == "div" and (n.get("id") or "").startswith("S:")


def is_chrome(n: Node) -> bool:
    return n.get("role") in CHROME_ROLES or n.get("id") in CHROME_NAMES or not CHROME_NAMES.isdisjoint(n.classes)


def content_button(n: Node) -> bool:
    """A button that is content: a heading or six words that are seen, or the question of an accordion."""
    if not SCREEN_READER.isdisjoint(n.classes):
        return False
    if "aria-expanded" in n.attrs and n.parent is not None and n.parent.tag in HEADINGS:
        return True
    words, stack = 0, list(n.children)
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            words += len(c.split())
        elif not (c.tag in SKIP or is_chrome(c) or hides_itself(c) or not SCREEN_READER.isdisjoint(c.classes)):
            if c.tag in HEADINGS:
                return True
            stack.extend(c.children)
    return words >= BUTTON_WORDS


def mark(root: Node) -> None:
    """hidden, skip and blocks (has a block inside) of each element; size: UTF-8 bytes of the text that could be seen."""
    order = [root, *root.elements()]
    for n in order:
        m = n.marks
        m["hidden"] = hides_itself(n) if n.attrs else False
        m["skip"] = n.tag in SKIP and not (n.tag == "button" and content_button(n)) or (bool(n.attrs) and is_chrome(n)) or m["hidden"]
        m["size"], m["blocks"] = sum(len(c.encode()) for c in n.children if isinstance(c, str)), False
    for n in reversed(order):
        if n.tag in UNREAD:
            n.marks["size"] = 0
        if n.parent is not None:
            n.parent.marks["size"] += n.marks["size"]
            n.parent.marks["blocks"] |= n.tag not in INLINE or n.marks["blocks"]
    for n in order:  # a subtree in script or the like is not seen either
        n.marks["under"] = n.parent is not None and (n.parent.marks["under"] or n.parent.marks["hidden"])
        n.marks["within"] = n.parent is not None and (n.parent.marks["within"] or n.parent.marks["skip"])


def content_root(root: Node, share: int | None = SHARE) -> Node:
    """The largest article, main or body by visible bytes; one of less than a ``share``-th of the body's doesn't count (without ``share``
    any does), nor do articles if there are several."""
    body = root.marks["body"]
    several = len(list(root.find("article"))) > 1
    wanted = [(lambda n: n.tag == "main"), (lambda n: n.get("role") == "main")]
    for test in wanted if several else [(lambda n: n.tag == "article"), *wanted]:
        best = None
        for n in root.elements():
            if test(n) and (best is None or n.marks["size"] >= best.marks["size"]):
                best = n
        if best is not None and (share is None or best.marks["size"] * share >= body.marks["size"]):
            return best
    return body


# Text


def permalink(n: Node) -> bool:
    return n.tag == "a" and (n.get("href") or "").startswith("#") and collapse(n.text()) in PERMALINKS


def inline(n: Node, masthead: bool = False) -> str:
    """The text of an element with a break around blocks and at line breaks; what a reader does not see is left out."""
    out: list[str] = []
    stack: list = list(reversed(n.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(BREAK)
        elif not (c.marks["skip"] or masthead and c.tag == "header" or permalink(c)):
            if c.tag not in INLINE:
                out.append(BREAK)
                stack.append(BREAK)
            stack.extend(reversed(c.children))
    return "".join(out)


def is_price(text: str) -> bool:
    t = text.strip()
    head, plus, _ = t.partition("+")
    return bool(plus) and any(c in CURRENCY for c in head) and bare_price(head) or bare_price(t)


def bare_price(text: str) -> bool:
    t = text.strip()
    if not re.search(r"[0-9]", t):
        return False
    if t[0] in CURRENCY:
        return True
    plain = all(c.isalpha() or c in "0123456789" or c.isspace() or c in CURRENCY or c in SEPARATORS for c in t)
    return plain and all(w.lower().rstrip("s") in UNITS for w in re.findall(r"[^\W\d_]+", t))


# Blocks


class Reader:
    """Walks the content root into blocks: dicts with kind, level, lang, text, list, href, record, links."""

    def __init__(self, root: Node, page: str, base: str, share: int | None = SHARE):
        self.root, self.page, self.base = root, page, base
        self.content = content_root(root, share)
        self.masthead = self.content.tag == "body"
        self.segments = {n.get("id")[2:]: n for n in root.find("div") if is_segment(n) and "hidden" in n.attrs}
        self.blocks: list[dict] = []
        self.run: list[str] = []
        self.run_links: list[str] = []
        self.list_at, self.lists = None, 0

    def skipped(self, n: Node) -> bool:
        return n.marks["skip"] or self.masthead and n.tag == "header"

    def links(self, n: Node, into: list[str] | None = None) -> list[str]:
        out = [] if into is None else into
        for a in [*([n] if n.tag == "a" else []), *n.find("a")]:
            if len(out) >= BLOCK_LINKS:
                break
            if "href" in a.attrs and not a.marks["hidden"] and (url := urls.join(self.base, a.get("href"))):
                url = urls.bare(url)
                if url != urls.bare(self.page) and url not in out:
                    out.append(url)
        return out

    def put(self, kind: str, text: str, links=(), **more) -> None:
        if text.strip():
            self.blocks.append({"kind": kind, "text": text, "links": list(links), "list": self.list_at if kind == "item" else None, **more})

    def end_run(self) -> None:
        text, links = collapse("".join(self.run)), self.run_links
        self.run, self.run_links = [], []
        self.put("para", text, links)

    def read(self) -> list[dict]:
        self.container(self.content, 0)
        self.end_run()
        out = join_short(self.blocks)
        n = 0
        out += [{"kind": "para", "text": t, "links": [], "list": None} for t in variants(self.root)]
        for i, b in enumerate(out):
            b["i"] = i
            if b.get("record"):
                n += 1
                b["record"] = n
        return out

    def container(self, el: Node, deep: int) -> None:
        if deep >= DEEP:
            self.run += [BREAK, inline(el, self.masthead), BREAK]
            self.links(el, self.run_links)
            return
        members: list[tuple[str, int, int]] = []
        for c in el.children:
            if isinstance(c, str):
                self.run.append(c)
                continue
            if c.tag == "template" and (c.get("id") or "").startswith("B:") and (late := self.segments.get(c.get("id")[2:])) is not None:
                self.end_run()
                self.container(late, deep + 1)
                self.end_run()
            elif self.skipped(c) or is_segment(c) or permalink(c):
                continue
            elif c.tag == "br":
                self.run.append("")  # a bare break between inline runs holds no text
            elif c.tag in INLINE and not c.marks["blocks"]:
                self.run.append(inline(c))
                self.links(c, self.run_links)
            else:
                self.end_run()
                first = len(self.blocks)
                self.element(c, deep + 1)
                if c.tag not in OWN_BLOCKS:
                    members.append((shape(c, SHAPE_DEPTH), first, len(self.blocks)))
        self.merge(members)

    def element(self, el: Node, deep: int) -> None:
        tag = el.tag
        if tag in HEADINGS:
            self.put("heading", collapse(inline(el)), self.links(el), level=int(tag[1]), href=self.headline(el))
        elif tag in PARAGRAPHS or tag == "blockquote":
            self.put("quote" if tag == "blockquote" else "para", collapse(inline(el)), self.links(el))
        elif tag == "pre":
            code = next(el.find("code"), None)
            names = (code.get("class") if code is not None and code.get("class") is not None else el.get("class")) or ""
            lang = next((m[1] for k in names.split() if (m := re.match(r"lang(?:uage)?-(.*)", k))), None)
            self.put("code", el.text(), lang=lang)
        elif tag == "li":
            own, links, nested = [], [], []
            for c in el.children:
                if isinstance(c, str):
                    own.append(c)
                elif c.tag in ("ul", "ol"):
                    nested.append(c)
                elif not self.skipped(c):
                    own.append(" " + inline(c))
                    self.links(c, links)
            self.put("item", collapse("".join(own)), links)
            for c in nested:
                self.element(c, deep + 1)
        elif tag in ("ul", "ol"):
            outer, self.list_at = self.list_at, self.lists
            self.lists += 1
            self.container(el, deep)
            self.end_run()
            self.list_at = outer
        elif tag == "table" and next(el.find("table"), None) is None:
            self.put("table", "\n".join(f"| {' | '.join(row)} |" for row in grid(el)), self.links(el))
        else:
            first = len(self.blocks)
            self.container(el, deep)
            self.end_run()
            if tag == "a" and len(self.blocks) > first:
                b = self.blocks[first]
                b["links"] = list(dict.fromkeys([*self.links(el)[:1], *b["links"]]))[:BLOCK_LINKS]

    def headline(self, el: Node) -> str | None:
        """Where a heading leads that is one link, or stands in one, to another page."""
        text = collapse(inline(el))
        inside = (a for a in el.find("a") if "href" in a.attrs and not permalink(a) and collapse(a.text()) == text)
        for a in [*inside, *(a for a in el.up() if a.tag == "a")]:
            url = urls.join(self.base, a.get("href"))
            if url and urls.bare(url) != urls.bare(self.page):
                return url
        return None

    def merge(self, members: list[tuple[str, int, int]]) -> None:
        """Siblings of one shape, three at least and all card-like, become a block each."""
        by_shape: dict[str, list[tuple[int, int]]] = {}
        for s, a, b in members:
            if b > a:
                by_shape.setdefault(s, []).append((a, b))
        cards = sorted(r for rs in by_shape.values() if len(rs) >= CARD_MEMBERS and all(card_like(self.blocks[a:b]) for a, b in rs) for r in rs)
        for a, b in reversed(cards):
            own = self.blocks[a:b]
            links = list(dict.fromkeys(u for x in own for u in x["links"]))[:BLOCK_LINKS]
            self.blocks[a:b] = [{"kind": "para", "text": "\n".join(x["text"] for x in own), "links": links, "href": next((x["href"] for x in own if x.get("href")), None), "record": 1, "list": None}]


def shape(el: Node, depth: int) -> str:
    kids = []
    if depth:
        for c in el.children:
            if isinstance(c, Node) and not (c.tag in SKIP and not (c.tag == "button" and content_button(c))) and not (c.tag in INLINE and not c.marks["blocks"]):
                kids.append(shape(c, depth - 1))
                if len(kids) == SHAPE_CHILDREN:
                    break
    return el.tag + (f"({','.join(kids)})" if kids else "")


def card_like(pieces: list[dict]) -> bool:
    def is_field(b: dict) -> bool:
        return all(len(f.strip()) < SHORT for line in b["text"].splitlines() for f in re.split(r" [·•|] ", line))

    return len(pieces) > 1 and all(b["kind"] in ("heading", "para", "item") for b in pieces) and sum(len(b["text"]) + 1 for b in pieces) <= CARD_CHARS and sum(not is_field(b) for b in pieces) <= 1


def join_short(blocks: list[dict]) -> list[dict]:
    """Runs of short paragraphs, items and prices become one block, a line each, up to JOINED characters."""
    out: list[dict] = []
    run: list[dict] = []

    def done() -> None:
        if len(run) == 1:
            out.append(run[0])
        elif run:
            lists = {b["list"] if b["kind"] == "item" else None for b in run}
            links = list(dict.fromkeys(u for b in run for u in b["links"]))[:BLOCK_LINKS]
            out.append({"kind": "para", "text": "\n".join(b["text"] for b in run), "links": links, "list": lists.pop() if len(lists) == 1 else None})
        run.clear()

    for b in blocks:
        short = not b.get("record") and len(b["text"]) < SHORT and (b["kind"] in ("para", "item") or b["kind"] == "heading" and is_price(b["text"]))
        if not short or sum(len(x["text"]) + 1 for x in run) + len(b["text"]) > JOINED:
            done()
        (run if short else out).append(b)
    done()
    return out


def grid(table: Node) -> list[list[str]]:
    """Rows as laid out: a cell's text stands in every slot that it spans."""
    trs = list(table.find("tr"))
    slots: list[dict[int, str]] = [{} for _ in trs]
    used = 0
    for r, tr in enumerate(trs):
        at = 0
        for cell in tr.find("th", "td"):
            while at in slots[r]:
                at += 1
            wide = min(max(span(cell, "colspan", 1), 1), 1000)
            tall = span(cell, "rowspan", 1)
            tall = len(trs) - r if tall == 0 else min(tall, len(trs) - r)
            used += wide * tall
            if used > SLOTS:
                break
            text = collapse(inline(cell))
            for row in slots[r : r + tall]:
                row.update(dict.fromkeys(range(at, at + wide), text))
            at += wide
    return [[row.get(i, "") for i in range(max(row, default=-1) + 1)] for row in slots]


def span(cell: Node, name: str, default: int) -> int:
    text = (cell.get(name) or "").strip()
    return int(text) if re.fullmatch(r"\+?[0-9]{1,9}", text) else default


# Links and images


def add_link(out: dict[str, dict], page: str, url: str | None, text: str, context: str, marginal: bool) -> None:
    if url is None or (url := urls.bare(url)) == urls.bare(page):
        return
    if (old := out.get(url)) is not None:
        old["text"] = old["text"] or text
        old["marginal"] &= marginal
    else:
        out[url] = {"i": len(out), "url": url, "text": text, "context": context, "marginal": marginal}


def marginal(a: Node) -> bool:
    return any(n.tag == "sup" for n in a.up()) or not a.text().strip() and next(a.find("img"), None) is not None


# Elements that are the context of a link in them.
CONTEXT = frozenset("p li td dd blockquote figcaption h1 h2 h3 h4".split())


def content_links(r: Reader) -> list[dict]:
    out: dict[str, dict] = {}
    for a in r.content.find("a"):
        if "href" not in a.attrs or a.marks["hidden"] or a.marks["within"] or r.masthead and any(n.tag == "header" for n in a.up()):
            continue
        text = collapse(a.text())
        if not text:
            image = next(a.find("img"), None)
            text = collapse(next((v for v in (a.get("aria-label"), a.get("title"), image.get("alt") if image is not None else None) if v is not None), ""))
        near = next((n for n in a.up() if n.tag in CONTEXT), None)
        context = collapse(inline(near)) if near is not None else ""
        add_link(out, r.page, urls.join(r.base, a.get("href")), text, "" if context == text else context[:200], marginal(a))
    return list(out.values())


def site_links(r: Reader) -> list[dict]:
    out: dict[str, dict] = {}
    for a in r.root.find("a"):
        if "href" in a.attrs and not a.marks["hidden"] and not a.marks["under"]:
            text = collapse(a.text()) or collapse(next((v for v in (a.get("aria-label"), a.get("title")) if v is not None), ""))
            add_link(out, r.page, urls.join(r.base, a.get("href")), text, "", marginal(a))
    return list(out.values())


def candidates(srcset: str) -> list[tuple[str, str]]:
    """(address, descriptor) of a srcset; an address may hold commas inside."""
    return [(m[1].rstrip(","), "" if m[1].endswith(",") else (m[2] or "").strip()) for m in re.finditer(r"[\s,]*(\S+)((?<!,)[^,]*)", srcset) if m[1].strip(",")]


def scale(descriptor: str) -> float:
    return number(descriptor.split()[0].rstrip("wx")) or 1.0 if descriptor.split() else 1.0


def images(r: Reader, photos: list[str]) -> list[dict]:
    """og:image, photos of the page's data, then images of the content; the same picture is kept once and filled in."""
    out: list[dict] = []

    def pixels(v: str | None) -> int | None:
        return int(v) if v and re.fullmatch(r"[0-9]{1,9}", v.strip()) else None

    def add(src: str | None, alt="", caption="", width=None, height=None, preview=None, card="") -> None:
        url = urls.join(r.base, src)
        if url is None or urls.bare(url).partition("?")[0] == urls.bare(r.page).partition("?")[0]:
            return
        low, path = url.lower(), urls.bare(url).partition("?")[0]
        if path.lower().endswith((".svg", ".ico")) or any(x is not None and x < 48 for x in (width, height)) or any(w in low for w in NOISE):
            return
        stem, _, ext = path.rpartition(".")
        same = (stem, url.partition("?")[2]) if ext.lower() in FORMATS else url
        for old in out:
            if old["url"] == url or old["same"] == same:
                old["alt"], old["caption"], old["card"] = old["alt"] or alt, old["caption"] or caption, old["card"] or card
                old["width"] = width if old["width"] is None else old["width"]
                old["height"] = height if old["height"] is None else old["height"]
                return
        out.append({"i": len(out), "url": url, "preview": urls.join(r.base, preview) or url, "alt": alt, "caption": caption, "card": card, "width": width, "height": height, "same": same})

    for m in r.root.find("meta"):
        if m.get("property") == "og:image":
            add(m.get("content"))
            break
    for p in photos:
        add(p)
    for img in r.content.find("img"):
        sliding = in_carousel(img)
        if img.marks["hidden"] and not sliding or any(n.tag in SKIP or is_chrome(n) or n.marks["hidden"] and not sliding for n in img.up()):
            continue
        source = next((x for x in img.parent.find("source") if x.get("srcset")), None) if img.parent is not None and img.parent.tag == "picture" else None
        best = max(candidates((source or img).get("srcset") or ""), key=lambda c: scale(c[1]), default=None)
        lazy = img.get("data-src") or img.get("data-lazy-src") or img.get("data-original")
        small = min(((scale(d), u) for u, d in candidates((source or img).get("srcset") or "") if d.endswith("w") and scale(d) >= 320), default=(0, None))[1]
        figure = next((n for k, n in enumerate(img.up()) if k < 4 and n.tag == "figure"), None)
        title = next(figure.find("figcaption"), None) if figure is not None else None
        add(best[0] if best else lazy or img.get("src"), collapse(img.get("alt") or ""), collapse(title.text()) if title is not None else "", pixels(img.get("width")), pixels(img.get("height")), small or lazy or img.get("src"), card_words(img, collapse(img.get("alt") or "")))
    return out


# The page's data

# Types that are a site's machinery, and keys that name a node rather than say something of it.
MACHINERY = ("BreadcrumbList", "SiteNavigationElement", "SearchAction")
NODE_KEYS = ("@context", "@id", "@type", "@language")
ASSIGNED = re.compile(r"([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\s*(?<![=!<>+\-*/&|%^])=(?!=)\s*(?=[{\[])", re.A)


def loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def page_data(root: Node) -> list[tuple[str, object]]:
    """(name, value): ld:N, json:ID and var:NAME of the page's scripts, the first of each name."""
    out: dict[str, object] = {}
    ld = plain = tried = 0
    reader = json.JSONDecoder()
    for s in root.find("script"):
        kind, body = s.get("type") or "", s.text()
        if kind == "application/ld+json":
            if (v := loads(body)) is not None:
                out.setdefault(f"ld:{ld}", v)
            ld += 1
        elif kind == "application/json":
            if (v := loads(body)) is not None:
                out.setdefault(f"json:{s.get('id') if s.get('id') is not None else plain}", v)
            plain += 1
        elif kind in ("", "text/javascript", "application/javascript", "module") and len(body) <= 8_000_000:
            for m in ASSIGNED.finditer(body):
                tried += 1
                if tried > 5000:
                    break
                try:
                    v, _ = reader.raw_decode(body, m.end())
                except ValueError:
                    continue
                out.setdefault("var:" + re.sub(r"^(window|self|globalThis)\.", "", m[1]), v)
    return list(out.items())


def kinds(o: dict) -> list[str]:
    t = o.get("@type")
    return [x.rpartition("/")[2] for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def scalar(v) -> str | None:
    """A value as the page wrote it; nothing for objects, lists, nulls and blank text."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return v if isinstance(v, str) and v.strip() else None


def leaves(path: str, v, cut: int = 200):
    """(path, text) of every value below; schema.org terms are the vocabulary's, not the page's."""
    if isinstance(v, dict):
        for k in sorted(v):
            if k not in NODE_KEYS:
                yield from leaves(path if k == "@value" else f"{path}.{k}", v[k], cut)
    elif isinstance(v, list):
        for x in v:
            yield from leaves(path, x, cut)
    elif (s := scalar(v)) is not None:
        s = " ".join(s.split()) if isinstance(v, str) else s
        if isinstance(v, str) and s.startswith(("https://schema.org/", "http://schema.org/")):
            return
        yield path, s if len(s) <= cut or s.startswith(("https://", "http://")) else s[:cut] + "…"


def said(head: str, values) -> str | None:
    out, seen = "", set()
    for path, v in values:
        if (k := (path.rpartition(".")[2], v)) in seen:
            continue
        seen.add(k)
        part = f"{path}: {v}"
        if out and len(head) + len(out) + 2 + len(part) > CARD_CHARS:
            continue
        out += ("; " if out else "") + part
    return head + out if out else None


def typed(v) -> list[dict]:
    return [o for o in v if isinstance(o, dict) and kinds(o)] if isinstance(v, list) else []


def things(value) -> list[str]:
    """A text for each thing in JSON-LD: its type, then each value with its path; a list of three typed things gives its own."""
    out: dict[str, None] = {}

    def thing(o: dict, listed: bool) -> None:
        if listed and "name" not in o and len(inner := [v for v in o.values() if isinstance(v, dict) and kinds(v)]) == 1:
            o = inner[0]
        keys = sorted((k for k in o if k not in NODE_KEYS), key=lambda k: (k != "name", k))
        lists = [] if listed else [k for k in keys if len(typed(o[k])) >= 3]
        if text := said(f"{(kinds(o) or ['Thing'])[0]} (JSON-LD): ", (x for k in keys if k not in lists for x in leaves(k, o[k]))):
            out.setdefault(text)
        for k in lists:
            for x in typed(o[k]):
                thing(x, True)

    def visit(v) -> None:
        if isinstance(v, list):
            for x in v:
                visit(x)
        elif isinstance(v, dict):
            own = kinds(v)
            if any(k in MACHINERY for k in own):
                return
            if not own or any(k.endswith("Page") or k == "WebSite" for k in own):
                for k in sorted(v):
                    if k not in NODE_KEYS and isinstance(v[k], (dict, list)):
                        visit(v[k])
            else:
                thing(v, False)

    visit(value)
    return list(out)[:300]


def photos(value) -> list[str]:
    """Addresses under ``image`` of the page's typed things: a gallery of 40 for one thing, 8 of a listing."""
    found: dict[str, None] = {}
    holders = 0

    def take(v) -> None:
        for x in v if isinstance(v, list) else [v]:
            u = x if isinstance(x, str) else x.get("url") or x.get("contentUrl") if isinstance(x, dict) else None
            if isinstance(u, str):
                found.setdefault(u)

    def visit(v) -> None:
        nonlocal holders
        if isinstance(v, list):
            for x in v:
                visit(x)
        elif isinstance(v, dict):
            if kinds(v) and "image" in v:
                holders += 1
                take(v["image"])
            for k in sorted(v):
                if k != "image":
                    visit(v[k])

    visit(value)
    return list(found)[: 40 if holders == 1 else 8]


def json_ld_values(value) -> list[str]:
    """Event dates, course durations and offer prices in JSON-LD, a sentence each, with the name of what holds them."""
    fields = {"Event": ("startDate", "endDate"), "Course": ("duration",)}
    out: dict[str, None] = {}

    def said_of(v) -> str:
        v = v.get("name") if isinstance(v, dict) else v
        return (scalar(v) or "").strip() if not isinstance(v, bool) else ""

    def visit(v, holder: str) -> None:
        if isinstance(v, list):
            for x in v:
                visit(x, holder)
        elif isinstance(v, dict):
            name = said_of(v.get("name"))
            types = v.get("@type")
            for t in types if isinstance(types, list) else [types]:
                parts = [f"{k} {said_of(v.get(k))}" for k in fields.get(t, ()) if said_of(v.get(k))] if isinstance(t, str) else []
                if t == "Offer" and said_of(v.get("price")):
                    parts = [f"price {said_of(v['price'])} {said_of(v.get('priceCurrency'))}".rstrip()]
                if parts:
                    out.setdefault(f"{t}{' ' + name if name else ''} (JSON-LD{', ' + holder if holder else ''}): {', '.join(parts)}.")
            for k in sorted(v):
                if k != "@type" and isinstance(v[k], (dict, list)):
                    visit(v[k], name or holder)

    visit(value, "")
    return list(out)[:40]


# What a form that buys says, what an option that chooses nothing begins with, names of amounts.
CART = ("add to cart", "add to basket", "add to bag", "buy now", "add-to-cart", "add_to_cart", "/cart/add", "añadir al carrito", "añadir a la cesta", "comprar", "ajouter au panier", "in den warenkorb")
NO_CHOICE = ("choose", "select", "please", "elige", "seleccion", "choisir")
AMOUNTS = ("quantity", "qty", "quantité", "cantidad")


def variants(root: Node) -> list[str]:
    """Lines of the drop-downs of forms that buy: ``Name: chosen (other options: ...)``; none if over three forms have some."""
    labels = {n.get("for"): collapse(n.text()) for n in root.find("label") if n.get("for")}
    gone = frozenset("nav footer aside dialog template noscript".split())

    def unseen(n: Node) -> bool:
        return any(is_chrome(x) or x.marks["hidden"] or x.tag in gone for x in (n, *n.up()))

    def buys(f: Node) -> bool:
        says = lambda t: any(w in (t or "").lower() for w in CART)
        return says(f.get("action")) or any(
            n.tag == "input" and (n.get("name") in ("quantity", "qty") or says(n.get("name"))) or n.get("data-button-action") == "add-to-cart" or n.tag in ("button", "input") and any(map(says, (n.get("name"), n.get("value"), n.get("id"), n.text())))
            for n in f.elements())

    def line(f: Node, s: Node) -> str | None:
        options: dict[str, bool] = {}
        for o in s.find("option"):
            t = collapse(o.text())
            empty = not o.get("value").strip() if "value" in o.attrs else t.lstrip("- ").lower().startswith(NO_CHOICE)
            if not empty and "disabled" not in o.attrs and t and len(t) <= 60:
                options.setdefault(t, "selected" in o.attrs)
        around = next((x for x in s.up() if x.tag == "label"), None)
        label = labels.get(s.get("id")) if s.get("id") else None
        label = label or (collapse(s.get("aria-label")) if s.get("aria-label") else None) or (collapse("".join(c for c in around.children if isinstance(c, str))) if around is not None else None)
        if not 2 <= len(options) <= 30 or all(re.fullmatch(r"[0-9]+", t) for t in options) or any((x or "").lower().rstrip(":") in AMOUNTS for x in (s.get("name"), s.get("id"), label)):
            return None
        pick = next((t for t, on in options.items() if on), next(iter(options)))
        return f"{label.rstrip(':') + ': ' if label else ''}{pick} (other options: {', '.join(t for t in options if t != pick)})"

    out: dict[str, None] = {}
    n = 0
    for f in root.find("form"):
        if unseen(f) or not buys(f):
            continue
        selects = [*f.find("select"), *(s for s in root.find("select") if f.get("id") and s.get("form") == f.get("id") and f not in s.up())]
        found = [x for s in selects if not unseen(s) and (x := line(f, s))]
        n += bool(found)
        out.update(dict.fromkeys(found))
    return [] if n > 3 else list(out)


def card_words(img: Node, alt: str) -> str:
    """What stands with an image: its title, then its link's text led by the link's one heading, or the one heading near by."""
    def heading(n: Node) -> str | None:
        found = list(n.find(*HEADINGS))
        return collapse(inline(found[0])) if len(found) == 1 else None

    words = [t for t in (collapse(img.get("title") or ""),) if t and t != alt]
    link = next((n for n in img.up() if n.tag == "a"), None)
    said = collapse(inline(link)) if link is not None else ""
    if said:
        head = heading(link)
        around = [head, *(x for x in said.splitlines() if x != head)] if head else [said]
    else:
        around = [h for k, n in enumerate(img.up()) if k < 4 and (h := heading(n)) is not None][:1]
    return "\n".join(dict.fromkeys([*words, *(x for x in around if x)]))[:200]


# Declarations

# Marks before a placeholder in braces, and elements whose text is no prose.
SIGILS = "!^$#%@"
PLACEHOLDER = re.compile(r"\{\{\s*[A-Za-z_][\w.]+\s*\}\}|[" + re.escape(SIGILS) + r"]\{\s*[A-Za-z_][\w.]+\s*\}", re.A)
NOT_PROSE = frozenset("head script style noscript template textarea pre code kbd samp var".split())


def title(root: Node) -> str:
    for m in root.find("meta"):
        if m.get("property") == "og:title":
            if (m.get("content") or "").strip():
                return collapse(m.get("content"))
            break
    for tag in ("title", "h1"):
        n = next(root.find(tag), None)
        if n is not None and n.text().strip():
            return collapse(n.text())
    return ""


def declared_lang(root: Node) -> str | None:
    return next((v for v in ((root.get(k) or "").strip() for k in ("lang", "xml:lang")) if v), None)


def alternates(root: Node, tag: str, base: str) -> list[dict]:
    out = []
    for n in root.find(tag):
        if "hreflang" in n.attrs and "href" in n.attrs and (tag == "a" or "alternate" in (n.get("rel") or "").split()):
            url = urls.join(base, n.get("href"))
            if n.get("hreflang").strip() and url:
                out.append({"hreflang": n.get("hreflang").strip(), "url": urls.bare(url)})
    return out


def forms(root: Node, base: str) -> list[dict]:
    """Search forms: sent by GET, with a field to type in, without a password or a file."""
    out = []
    for f in root.find("form"):
        if (f.get("method") or "get").lower() != "get" or f.marks["hidden"] or len(out) == 4:
            continue
        fields = [{"name": n.get("name"), "kind": n.tag if n.tag != "input" else (n.get("type") or "text").lower(), "value": (n.get("value") or "")[:256]} for n in f.find("input", "select", "textarea") if n.get("name")][:60]
        own = {x["kind"] for x in fields}
        if own & {"text", "search", "textarea"} and not own & {"password", "file"}:
            out.append({"action": urls.join(base, f.get("action")) or urls.bare(base), "fields": fields})
    return out


def chosen(root: Node) -> list[str]:
    """Lines for groups of radio-like options of which exactly one is selected."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    labels = {n.get("for"): collapse(n.text()) for n in root.find("label") if n.get("for")}
    for n in root.elements():
        if n.marks["hidden"] or n.marks["under"]:
            continue
        role = n.get("role")
        if n.tag == "input" and (n.get("type") or "").lower() == "radio" and n.get("name"):
            near = next((x for x in n.up() if x.tag == "label"), None)
            groups.setdefault("radio:" + n.get("name"), []).append((labels.get(n.get("id")) or (collapse(near.text()) if near is not None else ""), "checked" in n.attrs))
        elif role in ("radio", "tab", "option"):
            holder = next((x for x in n.up() if x.get("role") in ("radiogroup", "tablist", "listbox")), n.parent)
            name = (holder.get("aria-label") if holder is not None else None) or ""
            groups.setdefault(f"{role}:{id(holder)}:{name}", []).append((n.get("aria-label") or collapse(n.text()), (n.get("aria-checked") or n.get("aria-selected")) == "true"))
    out = []
    for k, options in groups.items():
        on = [t for t, c in options if c]
        others = [t for t, c in options if not c and t]
        if len(on) == 1 and on[0] and len(on[0]) <= 60 and others:
            name = k.rpartition(":")[2]
            out.append(f"{name}: {on[0]} (other options: {', '.join(others[:5])})" if name else f"{on[0]} (other options: {', '.join(others[:5])})")
    return out[:6]


STRING, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def array(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


LINKS = array(i=INT, url=STRING, text=STRING, context=STRING, marginal=BOOL)
VERSIONS = array(hreflang=STRING, url=STRING)
PAGE = struct(
    title=STRING, lang=STRING, root=STRING, root_bytes=LONG, body_bytes=LONG,
    blocks=array(i=INT, kind=STRING, level=INT, lang=STRING, text=STRING, list=INT, href=STRING, record=INT, links=T.ArrayType(STRING)),
    links=LINKS, site_links=LINKS, images=array(i=INT, url=STRING, preview=STRING, alt=STRING, caption=STRING, card=STRING, width=INT, height=INT),
    data=array(name=STRING, value=STRING), things=T.ArrayType(STRING), values=T.ArrayType(STRING), alternates=VERSIONS, link_languages=VERSIONS, rel_next=STRING,
    forms=array(action=STRING, fields=array(name=STRING, kind=STRING, value=STRING)), chosen=T.ArrayType(STRING), app_shell=BOOL, placeholders=BOOL,
)


class Page:
    """A page's parts, each worked out when it is asked for; what several need is worked out once.

    ``open_references``: whether a character reference may lack its semicolon, as in HTML (see :func:`parse`). ``share``: how small
    an article or main may be (see :func:`content_root`).
    """

    def __init__(self, html: str, url: str, open_references: bool = True, share: int | None = SHARE):
        self.html, self.root, self.share = html, parse(html, open_references), share
        self.url = urls.normal(url or "") or url or ""

    @cached_property
    def base(self) -> str:
        at = next((n for n in self.root.find("base") if "href" in n.attrs), None)
        return (urls.join(self.url, at.get("href")) if at is not None else None) or self.url

    @cached_property
    def marked(self) -> Node:
        mark(self.root)
        return self.root

    @cached_property
    def reader(self) -> Reader:
        return Reader(self.marked, self.url, self.base, self.share)

    @cached_property
    def found(self) -> list[tuple[str, object]]:
        return page_data(self.root)

    @property
    def ld(self) -> list[object]:
        return [v for k, v in self.found if k.startswith("ld:")]

    @cached_property
    def scripted(self) -> bool:
        return next(self.root.find("script"), None) is not None

    def rel_next(self) -> str | None:
        for n in self.marked.find("link", "a"):
            if "next" in (n.get("rel") or "").split() and not n.marks["hidden"]:
                u = urls.join(self.base, n.get("href"))
                if u and urls.bare(u) != urls.bare(self.url) and same_site(u, self.url):
                    return urls.bare(u)
        return None

    def app_shell(self) -> bool:
        return self.scripted and (len(self.html.encode()) > 4096 or any(n.tag == "noscript" or n.get("id") in ("root", "app", "__next", "__nuxt") or "data-reactroot" in n.attrs or "ng-app" in n.attrs for n in self.root.elements()))

    def placeholders(self) -> bool:
        n = 0
        for e in self.marked.elements() if self.scripted else ():
            if e.tag in NOT_PROSE or e.marks["hidden"] or e.marks["under"] or any(u.tag in NOT_PROSE for u in e.up()):
                continue
            n += sum(len(PLACEHOLDER.findall(c)) for c in e.children if isinstance(c, str) and "{" in c)
        return n >= 2


PARTS = {
    "title": lambda p: title(p.root), "lang": lambda p: declared_lang(p.root), "root": lambda p: p.reader.content.tag, "root_bytes": lambda p: p.reader.content.marks["size"], "body_bytes": lambda p: p.marked.marks["body"].marks["size"],
    "blocks": lambda p: p.reader.read(), "links": lambda p: content_links(p.reader), "site_links": lambda p: site_links(p.reader), "images": lambda p: images(p.reader, [x for v in p.ld for x in photos(v)]),
    "data": lambda p: [{"name": k, "value": json.dumps(v, ensure_ascii=False)} for k, v in p.found], "things": lambda p: [t for v in p.ld for t in things(v)][:300], "values": lambda p: [t for v in p.ld for t in json_ld_values(v)][:40],
    "alternates": lambda p: alternates(p.root, "link", p.base), "link_languages": lambda p: alternates(p.root, "a", p.base), "rel_next": lambda p: p.rel_next(), "forms": lambda p: forms(p.marked, p.base), "chosen": lambda p: chosen(p.marked),
    "app_shell": lambda p: p.app_shell(), "placeholders": lambda p: p.placeholders(),
}


def read_page(html: str, url: str, parts: Iterable[str] | None = None, **how) -> dict:
    """What ``parts`` names of PAGE, everything without, for one page. Blocks are read before links and images, which look at them.
    ``how`` goes to :class:`Page`."""
    p = Page(html, url, **how)
    return {k: f(p) for k, f in PARTS.items() if parts is None or k in parts}


def same_site(a: str, b: str) -> bool:
    def cut(u: str) -> tuple[str, str]:
        scheme, _, rest = u.partition("://")
        return scheme, re.split(r"[/?#]", rest)[0].removeprefix("www.")

    return cut(a) == cut(b)


def extract_pages(pages: DataFrame, parts: list[str] | None = None, **how) -> DataFrame:
    """(page_id, url, the fields of PAGE that ``parts`` names) of (page_id, url, html); a null html is an empty page. ``how`` goes to :class:`Page`."""
    fields = [f for f in PAGE.fields if parts is None or f.name in parts]
    wanted = [f.name for f in fields]
    return by_rows(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), fields, lambda url, html: read_page(html or "", url or "", wanted, **how))


def by_rows(df: DataFrame, fields: list[T.StructField], read) -> DataFrame:
    """(page_id, url, ``fields``) of rows (page_id, url, ...): ``read`` gives a dict of the fields for the columns from url on."""
    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), *fields])
    given = df.columns

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                rows = [{"page_id": r[0], "url": r[1], **read(*r[1:])} for r in zip(*(b.column(c).to_pylist() for c in given), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(df).mapInArrow(run, out)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are fewer than these, as one small file; a larger input is left as it lies."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    jvm = spark._jvm
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in at)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * split else df


def child(pages: DataFrame, name: str) -> DataFrame:
    """(page_id, url of the page, the fields of each element) of an array column of :func:`extract_pages`."""
    return pages.select("page_id", F.col("url").alias("page_url"), F.explode(name).alias("x")).select("page_id", "page_url", "x.*")
