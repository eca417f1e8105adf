"""Operator 1, token counts: a linear-time longest-match automaton that counts word pieces without building them.

A vocabulary becomes a trie over bytes. Each node has a failure link and the number of pieces that are complete, and popped,
when the link is taken; reading a word follows trie edges, takes links where there is no edge, and adds up popped
counts, so that each byte is read once and no piece is ever cut out. The result equals that of taking the
longest vocabulary piece at each position from the left.

Words are maximal runs without blanks. With the default vocabulary each is read with one space before it, as that writes its
pieces; with a vocabulary of first and continuing pieces (one piece a line, the latter marked by ``##`` or the like) the first
ones bear a mark that the automaton reads before the word. A word that can't be cut into pieces counts as one unknown token. Counts of distinct words are kept in a bounded
table in each worker.

Edge cases: null and empty texts have 0 words and 0 tokens; null ids and repeated rows are kept; a word of any length
takes one pass; an empty table gives an empty result; extra columns are not carried by the query, so none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pieces, vocabulary_path
from .common import documents

CACHED_WORDS = 200_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    """``count(bytes)``: the number of longest-match pieces, or None where some byte starts no piece."""

    def __init__(self, vocabulary: Iterable[bytes]):
        edges: dict[int, int] = {}
        final, parent, byte, level = [False], [0], [0], [0]
        for piece in vocabulary:
            node = 0
            for b in piece:
                nxt = edges.get(node << 8 | b)
                if nxt is None:
                    nxt = edges[node << 8 | b] = len(final)
                    final.append(False)
                    parent.append(node)
                    byte.append(b)
                    level.append(level[node] + 1)
                node = nxt
            final[node] = final[node] or bool(piece)
        link, popped = [-1] * len(final), [0] * len(final)
        for v in sorted(range(1, len(final)), key=level.__getitem__):
            if final[v]:
                link[v], popped[v] = 0, 1
                continue
            u, b, n = parent[v], byte[v], popped[parent[v]]
            z = link[u]
            while z >= 0 and (z << 8 | b) not in edges:
                n += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = edges[z << 8 | b], n
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int | None:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for b in word:
            while (nxt := edges.get(node << 8 | b)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return None
            node = nxt
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return None
        return total


class Counts(dict):
    """word -> number of tokens, computed at the first look-up. ``lead`` is read before each word."""

    def __init__(self, automaton: Automaton, lead: bytes = b" "):
        self.automaton, self.lead = automaton, lead

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(self.lead + word.encode())
        self[word] = n = 1 if n is None else n
        return n


@lru_cache(maxsize=2)
def default_automaton(path: str) -> Automaton:
    return Automaton(pieces(path))


#: Before a first piece and before each word; in no UTF-8.
FIRST = b"\xff"


@lru_cache(maxsize=2)
def word_piece_automaton(path: str, continuing: str) -> Automaton:
    """Of a file with a piece a line, the ones that ``continuing`` starts being those that don't begin a word."""
    with open(path, encoding="utf-8") as f:
        lines = [x.rstrip("\r\n") for x in f]
    return Automaton(x.removeprefix(continuing).encode() if x.startswith(continuing) else FIRST + x.encode() for x in lines if x not in ("", continuing))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, continuing: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row; with ``continuing``, ``path`` is a file of pieces, see :func:`word_piece_automaton`."""
    path = path or vocabulary_path()
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts = Counts(word_piece_automaton(path, continuing), FIRST) if continuing else Counts(default_automaton(path))
        for b in batches:
            words, tokens = [], []
            for text in b.column("text"):
                found = WORD.findall(text.as_py() or "")
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
                if len(counts) > CACHED_WORDS:
                    counts.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return d.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
