"""Spans of a block that can be an answer: values, names, lists, lines, clauses, sentences, table cells and code lines.

Offsets count characters. Every span is a piece of its block's text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import percent

# Limits, and the word lists of names and values.
MOST, MOST_CHARS, VALUE_RUN, NAME_WORDS, SNIPPET_LINES, MOST_PIECES, REFINE_WORDS = 200, 400, 4, 8, 3, 100, 8
CONNECTORS = ("of", "the", "and", "for", "de", "del", "la", "von", "van", "&")
DANGLING = ("per", "of", "the", "and", "or", "to", "a", "an", "in", "for", "with", "at", "by", "from", "on")
CURRENCY = ("$", "€", "£", "¥", "US$", "USD", "EUR", "GBP")
NOTE = re.compile(r"(?:\[[^\]\s]{1,12}\])+$")

Range = tuple[int, int]


def tokens(text: str) -> list[Range]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def pieces(text: str, cut: str) -> list[Range]:
    """Stretches between matches of ``cut``; a match belongs to the stretch before it."""
    out, at = [], 0
    for m in re.finditer(cut, text):
        out.append((at, m.end()))
        at = m.end()
    return [*out, (at, len(text))] if at < len(text) else out


def trimmed(text: str, r: Range) -> Range | None:
    """Without blanks, quotes, brackets and punctuation around it, and without footnote marks; a bracket that the span opens stays."""
    a, b = r
    while True:
        before = (a, b)
        while a < b and (text[a].isspace() or text[a] in "\"'“”‘’«»,;:.!?([{*_|·•-–—" and not (text[a] in "([" and text[a:b].count(text[a]) == text[a:b].count({"(": ")", "[": "]"}[text[a]]))):
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in "\"'“”‘’«»,;:.!?[{*_|·•–—" or text[b - 1] in ")]}" and text[a:b].count(text[b - 1]) > text[a:b].count({")": "(", "]": "[", "}": "{"}[text[b - 1]])):
            b -= 1
        if m := NOTE.search(text[a:b]):
            b = a + m.start()
        if (a, b) == before:
            return (a, b) if a < b else None


def value_spans(text: str, toks: list[Range]) -> Iterator[Range]:
    for t, (a, b) in enumerate(toks):
        word = text[a:b]
        if not re.search(r"\d", NOTE.sub("", word)):
            continue
        starts = [toks[t - 1][0] if t and text[slice(*toks[t - 1])] in CURRENCY else a]
        if (m := re.search(r"[0-9$€£¥]", word)) and m.start() and re.search(r"[^\W\d_]", word[: m.start()]):
            starts.append(a + m.start())
        if m := re.match(r"[^0-9]*[0-9][^A-ZÀ-ÖØ-Þ]*(?=[A-ZÀ-ÖØ-Þ])", word):
            yield from ((s, a + m.end()) for s in starts if s < a + m.end())
        for s in starts:
            for n, (x, y) in enumerate(toks[t : t + VALUE_RUN]):
                if not n or text[x:y].lower().rstrip(",.") not in DANGLING:
                    yield s, y


def name_spans(text: str, toks: list[Range]) -> list[Range]:
    def capital(r: Range) -> bool:
        w = text[slice(*r)].lstrip("(\"'“‘")
        return bool(w) and w[0].isupper()

    out, t = [], 0
    while t < len(toks):
        if not capital(toks[t]):
            t += 1
            continue
        last, k = t, t + 1
        while k < len(toks) and k - t < NAME_WORDS and "\n" not in text[toks[k - 1][1] : toks[k][0]] and not re.search(r"[.!?]['\")\]]*$", text[slice(*toks[k - 1])]):
            if capital(toks[k]):
                last = k
            elif text[slice(*toks[k])].lower() not in CONNECTORS:
                break
            k += 1
        out.append((toks[t][0], toks[last][1]))
        t = last + 1
    return out


def name_lists(text: str, found: list[Range]) -> Iterator[Range]:
    """Names that fill a line each, one below another, as one span."""
    def alone(r: Range) -> bool:
        return re.search(r"(?:^|[\n|])[^\S\n]*$", text[: r[0]]) is not None and re.match(r"[^\S\n]*(?:$|[\n|])", text[r[1] :]) is not None

    run: list[Range] = []
    for r in [*found, None]:
        if r and alone(r) and (not run or not text[run[-1][1] : r[0]].strip() and "\n" in text[run[-1][1] : r[0]]):
            run.append(r)
            continue
        if len(run) > 1:
            yield run[0][0], run[-1][1]
        run = [r] if r and alone(r) else []


def enumerations(text: str, parts: list[Range]) -> Iterator[Range]:
    """What follows a part's last colon, if it is a list of two items or more outside brackets."""
    for a, b in parts:
        flat = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", lambda m: "x" * len(m[0]), text[a:b])
        colon = max((m.end() for m in re.finditer(r":(?=\s)", flat)), default=None)
        if colon is not None and re.search(r"[,;·]|\s(?:and|or)\s", flat[colon:]) and len(flat[colon:].strip()) > 1:
            yield a + colon, b


LINK = re.compile(r"\[[^\[\]\n]*\]\([^)\s]*\)")


def link_runs(text: str) -> Iterator[Range]:
    """Markdown links with nothing but separators between them."""
    run: list[re.Match] = []
    for m in [*LINK.finditer(text), None]:
        gap = text[run[-1].end() : m.start()] if run and m else ""
        if run and m and re.fullmatch(r"(?:\s|[,;·|/]|\band\b|\bor\b|\([^()\[\n]*\))*", gap):
            run.append(m)
            continue
        if len(run) > 1:
            after = re.match(r"[ \t]*\([^)\[\n]*\)", text[run[-1].end() :])
            yield run[0].start(), run[-1].end() + (after.end() if after else 0)
        run = [m] if m else []


def prose_spans(text: str) -> list[Range]:
    toks = tokens(text)
    found = name_spans(text, toks)
    lines, sentences = pieces(text, r"\n"), pieces(text, r"[.!?](?=\s|\[|$)")
    return [*value_spans(text, toks), *name_lists(text, found), *found, *enumerations(text, lines + sentences), *link_runs(text), *lines, *pieces(text, r"[,;:—–](?=\s|$)"), *sentences]


def table_rows(text: str) -> list[Range]:
    """Rows from a line that begins with a bar to the first one that ends with one; a separator of dashes is none."""
    out = []
    for m in re.finditer(r"^[^\S\n]*(\|.*?\|)[^\S\n]*$", text, re.M | re.S):
        if len(m[1]) >= 2 and not re.fullmatch(r"[-:| \n]*", m[1][1:-1]):
            out.append(m.span(1))
    return out


def table_cells(text: str) -> list[tuple[Range, str | None]]:
    """Cells below the head, each labelled ``value (row · column)``."""
    rows = []
    for a, b in table_rows(text):
        at, cells = a + 1, []
        for c in text[a + 1 : b - 1].split("|"):
            cells.append((at, at + len(c)))
            at += len(c) + 1
        rows.append(cells)
    if len(rows) < 2:
        return []
    say = lambda r: re.sub(r"\s+", " ", text[slice(*r)]).strip().strip("*_")
    head, out, above = [say(c) for c in rows[0]], [], say(rows[0][0])
    for row in rows[1:]:
        name = say(row[0])
        for j, c in enumerate(row):
            if not (value := say(c)) or j == 0 and name == above:
                continue
            where = [x for x in ((say(row[1]) if len(row) > 1 else "") if j == 0 else name, head[j] if j < len(head) else "") if x]
            out.append((c, f"{value} ({' · '.join(where)})" if where else None))
        above = name
    return out


def code_spans(text: str) -> list[Range]:
    out = pieces(text, r"\n")
    return [*out, (0, len(text))] if len(out) <= SNIPPET_LINES else out


def candidates(blocks: list[tuple[int, str, str]]) -> list[tuple[int, int, int, str | None]]:
    """(block, start, end, label) for blocks (i, kind, text): blocks take turns, a text or label comes once, MOST in all."""
    def queue(kind: str, text: str):
        yield from table_cells(text)
        grid = kind != "code" and len(table_rows(text)) >= 2
        yield from ((r, None) for r in (code_spans(text) if kind == "code" else prose_spans(text)) if not (grid and "|" in text[slice(*r)]))

    queues = [(i, text, queue(kind, text)) for i, kind, text in blocks]
    out, seen = [], set()
    while queues and len(out) < MOST:
        alive = []
        for i, text, q in queues:
            for r, label in q:
                r = trimmed(text, r)
                if r is None or r[1] - r[0] > MOST_CHARS or (label or text[slice(*r)]) in seen:
                    continue
                seen.add(label or text[slice(*r)])
                out.append((i, *r, label))
                alive.append((i, text, q))
                break
            if len(out) >= MOST:
                break
        queues = alive
    return out


def refinements(text: str) -> list[Range]:
    """Shorter spans of a long one: pieces at punctuation and link edges, then runs of words, the longest first; MOST_PIECES at most."""
    out = dict.fromkeys(r for p in pieces(text, r"[,;:.()\[\]—–](?=\s|$)|[()\[\]]") if (r := trimmed(text, p)))
    toks = tokens(text)
    for n in range(min(REFINE_WORDS, len(toks) - 1), 0, -1):
        for t in range(len(toks) - n + 1):
            if r := trimmed(text, (toks[t][0], toks[t + n - 1][1])):
                out.setdefault(r)
    return [r for r in out if r != (0, len(text))][:MOST_PIECES]


def fragment_link(url: str, text: str, r: Range) -> str:
    """The page's address with a text fragment: the span, long ones by their edges, with three words around it."""
    words = lambda s: s.split()
    span, before, after = words(text[slice(*r)]), words(text[: r[0]].rpartition("\n")[2])[-3:], words(text[r[1] :].partition("\n")[0])[:3]
    enc = lambda ws: percent(" ".join(ws))
    middle = enc(span) if len(span) <= 10 else f"{enc(span[:5])},{enc(span[-5:])}"
    return f"{url.partition('#')[0]}#:~:text=" + (f"{enc(before)}-," if before else "") + middle + (f",-{enc(after)}" if after else "")


def spans(blocks: DataFrame, by: str = "page_id", quotes: bool = False) -> DataFrame:
    """(by, i, block, start, end, text, label, length): the candidate spans of each group's blocks (i, kind, text).

    The blocks of a group come as one array: a handful, chosen before. With ``quotes`` every block has one more row, with its
    whole text, its kind as label and i = -1, so that what a span is quoted from needs no join.
    """
    g = blocks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "kind", "text"))).alias("b"))
    kind = f"{by} {blocks.schema[by].dataType.simpleString()}, i int, block int, start int, end int, text string, label string, length int"

    def run(batches):
        for batch in batches:
            rows = []
            for key, bs in zip(batch.column(by).to_pylist(), batch.column("b").to_pylist(), strict=True):
                texts = {b["i"]: b["text"] or "" for b in bs}
                for n, (i, a, z, label) in enumerate(candidates([(b["i"], b["kind"], b["text"] or "") for b in bs])):
                    rows.append((key, n, i, a, z, texts[i][a:z], label, len(texts[i][a:z].encode())))
                if quotes:
                    rows += [(key, -1, b["i"], 0, len(texts[b["i"]]), texts[b["i"]], b["kind"], 0) for b in bs]
            types = [batch.schema.field(by).type, *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[by, "i", "block", "start", "end", "text", "label", "length"])

    return g.mapInArrow(run, kind)


def refinable(text: str, r: Range, label: str | None) -> bool:
    """A long winner without a label may hold more than the answer."""
    return label is None and len(text[slice(*r)].split()) > REFINE_WORDS


def refine_options(winners: DataFrame, inside: DataFrame | None = None, by: str = "page_id") -> DataFrame:
    """(by, k, start, end, text): the options of a second choice about long winners (by, quote, start, end, label): the whole (k = 0), shorter spans
    inside it (by, start, end), and its own pieces, each once and MOST_PIECES besides the whole."""
    if inside is not None:
        own = inside.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "start", "end"))).alias("inside"))
        winners = winners.join(own, by, "left")
    else:
        winners = winners.withColumn("inside", F.lit(None).cast("array<struct<i:int,start:int,end:int>>"))
    kind = winners.schema[by].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for key, quote, a, z, label, found in zip(*(b.column(c).to_pylist() for c in (by, "quote", "start", "end", "label", "inside")), strict=True):
                if not refinable(quote or "", (a, z), label):
                    continue
                pieces_ = [(a + x, a + y) for x, y in refinements(quote[a:z])]
                options = list(dict.fromkeys([(a, z), *((f["start"], f["end"]) for f in found or ()), *pieces_]))[: MOST_PIECES + 1]
                rows += [(key, k, x, y, quote[x:y]) for k, (x, y) in enumerate(options)]
            types = [b.schema.field(by).type, *[pa.int32()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[by, "k", "start", "end", "text"])

    return winners.select(by, "quote", "start", "end", "label", "inside").mapInArrow(run, f"{by} {kind}, k int, start int, end int, text string")
