"""Bodies that are not HTML pages: markdown, feeds, bare JSON, packed and labelled bytes; and tables of responses."""

from __future__ import annotations

import codecs
import html
import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 8 << 20


# Bytes to text


def decoded(body: bytes, content_type: str | None) -> str:
    """Text by byte order mark, then the declared charset, then UTF-8; what can't be decoded is replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    name = m[1].lower() if m else "utf-8"
    name = "cp1252" if name in ("iso-8859-1", "latin1", "ascii", "us-ascii") else name
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def inflated(body: bytes, most: int | None = MOST_BYTES) -> bytes | None:
    """A gzip body unpacked, others as they are; None beyond ``most`` bytes if that is a number, an error for broken gzip."""
    if body[:2] != b"\x1f\x8b":
        return body if most is None or len(body) <= most else None
    try:
        d = zlib.decompressobj(31)
        out = d.decompress(body, 0 if most is None else most + 1)
    except zlib.error as e:
        raise ValueError(f"broken gzip: {e}") from None
    return out if most is None or len(out) <= most else None


def served_markdown(content_type: Column, body: Column) -> Column:
    """Whether a body is markdown: by its type, or as plain text that does not begin as HTML."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("markdown") | kind.startswith("text/plain") & ~F.ltrim(body).startswith("<")


def served_as_markdown(content_type: str | None, body: str) -> bool:
    kind = (content_type or "").lower()
    return "markdown" in kind or kind.startswith("text/plain") and not body.lstrip().startswith("<")


def within(responses: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Responses whose body is not larger than ``most`` bytes."""
    return responses.where(F.octet_length("body") <= most)


# Feeds

ENTRY = re.compile(r"<(?:[\w-]+:)?(item|entry)(?=[\s>])[^>]*>(.*?)</(?:[\w-]+:)?\1\s*>", re.S | re.I)


def xml_text(raw: str) -> str:
    """Character data with CDATA and entities read, tags dropped."""
    parts = re.split(r"<!\[CDATA\[(.*?)\]\]>", raw, flags=re.S)
    return "".join(p if i % 2 else html.unescape(p) for i, p in enumerate(parts))


def field(entry: str, *tags: str) -> str:
    for tag in tags:
        if (m := re.search(rf"<(?:[\w-]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[\w-]+:)?{tag}\s*>", entry, re.S | re.I)) and (t := xml_text(m[1]).strip()):
            return t
    return ""


def is_feed(body: str) -> bool:
    m = re.search(r"<(?![?!])(?:[\w-]+:)?([\w-]+)", body)
    return bool(m) and m[1].lower() in ("rss", "rdf", "feed")


def feed_entries(body: str) -> list[dict]:
    """title, url, date, summary and image of the entries of an RSS 2.0, RSS 1.0 or Atom feed."""
    out = []
    for m in ENTRY.finditer(body):
        e = m[2]
        links = [dict(re.findall(r"([\w:-]+)\s*=\s*[\"']([^\"']*)[\"']", x)) for x in re.findall(r"<(?:\w+:)?link\b([^>]*?)/?>", e, re.I)]
        href = next((x["href"] for x in links if x.get("rel", "alternate") == "alternate" and "href" in x), "")
        image = re.search(r"<(?:enclosure|media:content|media:thumbnail)\b[^>]*?url\s*=\s*[\"']([^\"']+)", e, re.I)
        text = re.sub(r"<[^>]+>", " ", field(e, "description", "summary", "content", "encoded"))
        out.append({"title": re.sub(r"<[^>]+>", "", field(e, "title")), "url": field(e, "link") or html.unescape(href), "date": field(e, "pubDate", "published", "updated", "date"), "summary": " ".join(html.unescape(text).split()), "image": html.unescape(image[1]) if image else ""})
    return out


def feed_html(body: str) -> str | None:
    """A feed as a page with one list item an entry; None if it is no feed."""
    if not is_feed(body):
        return None
    esc = html.escape
    items = "".join(f"<li><a href=\"{esc(e['url'])}\">{esc(e['title'])}</a> · {esc(e['date'])} · {esc(e['summary'])}" + (f"<img src=\"{esc(e['image'])}\" alt=\"{esc(e['title'])}\">" if e["image"] else "") + "</li>" for e in feed_entries(body))
    return f"<html><head><title>{esc(field(re.sub(ENTRY, '', body), 'title'))}</title></head><body><main><ul>{items}</ul></main></body></html>"


def json_document(body: str) -> object | None:
    """The value of a body that is JSON, or JSON shown in a page's only ``pre`` and nothing beside it."""
    text = body.lstrip()
    if text.startswith("<") and "<pre" in text:
        from .dom import parse

        root = parse(text)
        shown = list(root.find("pre"))
        if len(shown) != 1 or root.text().strip() != shown[0].text().strip():
            return None
        text = shown[0].text().strip()
    if not text.startswith(("{", "[")):
        return None
    try:
        v = json.loads(text)
    except ValueError:
        return None
    return v if isinstance(v, (dict, list)) else None


# Markdown

FENCE = re.compile(r"^(\s{0,3})(`{3,}|~{3,})\s*([\w+-]*).*$")


def markdown_blocks(body: str) -> tuple[str | None, list[dict]]:
    """(title of the front matter, blocks): headings, fenced code whole, quotes, list items, tables and paragraphs."""
    title = None
    if m := re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", body, re.S):
        t = re.search(r"^title:\s*[\"']?(.*?)[\"']?\s*$", m[1], re.M)
        title, body = (t[1] if t else None), body[m.end() :]
    out: list[dict] = []
    para: list[str] = []

    def put(kind: str, text: str, **more) -> None:
        if text.strip():
            out.append({"i": len(out), "kind": kind, "text": text, **more})

    def end() -> None:
        if para:
            is_table = all(x.lstrip().startswith("|") for x in para) and len(para) > 1
            put("table" if is_table else "para", "\n".join(para) if is_table else words(" ".join(x.strip() for x in para)))
            para.clear()

    lines, at = body.split("\n"), 0
    while at < len(lines):
        line = lines[at]
        if m := FENCE.match(line):
            end()
            close = next((k for k in range(at + 1, len(lines)) if re.fullmatch(rf"\s{{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}\s*", lines[k])), len(lines))
            put("code", "\n".join(lines[at + 1 : close]), lang=m[3] or None)
            at = close + 1
            continue
        if not line.strip():
            end()
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            end()
            put("heading", words(m[2]), level=len(m[1]))
        elif m := re.match(r"\s*(?:[-*+]|(\d+)[.)])\s+(.*)$", line):
            end()
            put("item", words(m[2]))
        elif line.lstrip().startswith(">"):
            end()
            quote = [re.sub(r"^\s*>\s?", "", line)]
            while at + 1 < len(lines) and lines[at + 1].lstrip().startswith(">"):
                at += 1
                quote.append(re.sub(r"^\s*>\s?", "", lines[at]))
            put("quote", words(" ".join(quote)))
        else:
            para.append(line)
        at += 1
    end()
    return title, out


IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^)\s]+)[^)\n]*\)")
ANCHOR = re.compile(r"(?<!!)\[([^\]\n]*)\]\(([^)\s]+)[^)\n]*\)")


def markdown_page(body: str, base: str) -> dict:
    """title, blocks, links, site_links and images of a markdown page, as a page of HTML has them; addresses are resolved against ``base``."""
    from ..functions import urls

    title, blocks = markdown_blocks(body)
    head = next((b["text"] for b in blocks if b["kind"] == "heading"), "")
    links, images = {}, {}
    prose = re.sub(r"(?ms)^\s{0,3}(`{3,}|~{3,}).*?(?:^\s{0,3}\1[`~]*\s*$|\Z)", "", body)
    for m in ANCHOR.finditer(prose):
        url = urls.join(base, m[2])
        if url and urls.bare(url) != urls.bare(base):
            links.setdefault(urls.bare(url), words(m[1]))
    for m in IMAGE.finditer(prose):
        if url := urls.join(base, m[2]):
            images.setdefault(url, m[1].strip())
    listed = [{"i": i, "url": u, "text": t, "context": "", "marginal": False} for i, (u, t) in enumerate(links.items())]
    return {"title": title or head, "blocks": blocks, "links": listed, "site_links": listed, "images": [{"i": i, "url": u, "alt": t, "caption": ""} for i, (u, t) in enumerate(images.items())]}


def words(text: str) -> str:
    """Inline markdown as the words a reader sees."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__|\*|`)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    return " ".join(re.sub(r"<[^>]+>", "", text).split())


def markdown_links(text: Column) -> Column:
    """array<struct<text, url>> of a markdown text's links; images are left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!!)(\[[^\]\n]*\]\([^)\s]+\))"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("text"), F.regexp_extract(x, r"\]\(([^)\s]+)\)$", 1).alias("url")))


def markdown_images(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]\n]*\]\(([^)\s]+)"), 1)


# Captured responses


def captured(responses: DataFrame, by, most: int = 8, chars: int = 1_000_000) -> DataFrame:
    """The first response of each path (by, path, pos, body), up to ``most`` and while they stay within ``chars`` together."""
    from pyspark.sql import Window

    from ..operators.select import first_of, names

    keys = names(by)
    one = first_of(responses, [*keys, "path"], [F.col("pos")])
    w = Window.partitionBy(*keys).orderBy("pos")
    d = one.withColumns({"_n": F.row_number().over(w), "_sum": F.sum(F.char_length("body")).over(w)})
    return d.where((F.col("_n") <= most) & (F.col("_sum") <= chars)).drop("_n", "_sum")
