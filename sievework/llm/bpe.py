"""Operator 10, BPE encoding and decoding through a table of distinct words.

Spark splits each text into the tokenizer's words with one regular expression; a Python worker turns the words of an Arrow
batch into indexes of the batch's distinct words, has the tokenizer encode each distinct word once, and puts the ids
back by position with array gathers. The table of distinct words belongs to a batch (and a bounded cache of it to a
worker), not to the corpus: a table for the corpus would have to be joined with every occurrence, and shuffling those costs more than
encoding anew.

Decoding (:func:`decode`) is a join: each distinct sequence of ids is dealt out by position, every id joined with its piece in the
table of the vocabulary, and the pieces put together in order of position where the sequence lies already. That table is
broadcast up to MOST_BROADCAST pieces and joined by a shuffle beyond. The query, which decodes each document that it has just encoded, joins the ids
of an Arrow batch with the table by position, as the ids of a corpus are too many to shuffle; see README for figures.

Texts that the split can't be trusted with go to the tokenizer whole: those with an added token's string, and those with
characters that this Java's Unicode tables don't know.

Edge cases: null and empty texts have no ids and decode to the empty text; null ids and repeated rows are kept; very long
texts are one row each, and decoding holds one text's pieces in a task; a null array of token ids decodes to null, an id that the vocabulary
lacks to U+FFFD, as do bytes that are no UTF-8; an empty table gives an empty result; extra columns are carried by :func:`encode`
and :func:`decode`, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

#: The tokenizer's split, in Java's syntax, for Unicode classes. Fixed value of the vocabulary's format.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 200_000
#: Words whose encodings exist at once.
ENCODED_WORDS = 8192
#: Pieces that a table has at most to be broadcast; at some 40 bytes each in memory, 20 MB.
MOST_BROADCAST = 500_000
#: Columns in flight, by names that no table has.
TEXT, WORDS = "__sievework_text", "__sievework_words"
BATCH_ROWS = 200


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> dict[str, int]:
    """Character of byte-level vocabularies -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """id -> bytes. Pieces of added tokens are their own UTF-8."""
    t, back = tokenizer(path), byte_alphabet()
    added = {i for i in t.get_added_tokens_decoder()}
    out = [b""] * (max(t.get_vocab().values()) + 1)
    for piece, i in t.get_vocab().items():
        out[i] = piece.encode() if i in added else bytes(back[c] for c in piece)
    return out


def added_tokens(path: str) -> list[str]:
    return [x.content for x in tokenizer(path).get_added_tokens_decoder().values()]


class Words:
    """The table of distinct words: word -> ids, kept between batches up to CACHED_WORDS."""

    def __init__(self, path: str):
        self.tokenizer, self.known = tokenizer(path), {}

    def ids(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        for at in range(0, len(new), ENCODED_WORDS):  # an encoding holds far more than its ids
            part = new[at : at + ENCODED_WORDS]
            known.update(zip(part, (e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)), strict=True))
        return [known[w] for w in words]

    def batch(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, offsets of the rows) of rows of words."""
        flat = words.flatten().dictionary_encode()
        table = self.ids(flat.dictionary.to_pylist())
        size = np.fromiter(map(len, table), np.int64, len(table))
        ids = np.fromiter((i for x in table for i in x), np.uint32, int(size.sum()))
        first, at = np.cumsum(size) - size, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size[at]
        ends = np.cumsum(n)
        gather = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - (ends - n), n)
        rows = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)]
        return ids[gather], rows


def split(docs: DataFrame, path: str) -> DataFrame:
    """Adds WORDS, the words of the text, or null where the tokenizer has to read the whole text, which is then in TEXT."""
    t = text_of()
    hard = t.rlike(r"\p{Cn}")
    for token in added_tokens(path):
        hard = hard | t.contains(token)
    return docs.withColumn(TEXT, F.when(hard, t)).withColumn(WORDS, F.when(~hard, F.regexp_extract_all(t, F.lit(PATTERN), 0)))


def encoded(docs: DataFrame, per_batch, fields: str, path: str | None = None, carry=("doc_id",)) -> DataFrame:
    """``carry`` and the ``fields`` that ``per_batch(ids)`` gives as a tuple for each row's ids (arrays of unsigned 32-bit numbers)."""
    path = path or vocabulary_path()
    d = split(docs, path).select(*[F.col(f"`{c}`") for c in carry], TEXT, WORDS)
    kept = docs.select(*[F.col(f"`{c}`") for c in carry]).schema
    added = docs.sparkSession.createDataFrame([], fields).schema
    names = added.names

    def run(batches):
        table = Words(path)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(added)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                ids, row = table.batch(b.column(WORDS))
                whole_texts = b.column(TEXT).to_pylist()
                out = per_batch([ids[row[i] : row[i + 1]] if t is None else np.array(table.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(whole_texts)])
                cols = [pa.array([r[k] for r in out], schema.field(n).type) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(carry))], *cols], names=[*carry, *names])

    return d.mapInArrow(run, type(kept)(kept.fields + added.fields))


def encode(docs: DataFrame, path: str | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """The columns of ``docs`` that ``carry`` names, all without, and ``token_ids``, an array of integers, in place of a column of that
    name. A text that is not carried goes to the workers as its words only."""
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() != "token_ids"]
    return encoded(docs, lambda rows: [(ids.astype(np.int32),) for ids in rows], "token_ids array<int>", path, keep)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary, a piece's bytes as a string that need not be UTF-8."""
    known = pieces(path)
    d = spark.createDataFrame(pa.table({"id": pa.array(range(len(known)), pa.int32()), "piece": pa.array(known, pa.binary())}))
    d = d.select("id", F.col("piece").cast("string").alias("piece"))
    return F.broadcast(d) if len(known) <= MOST_BROADCAST else d


def texts_of(sequences: DataFrame, path: str) -> DataFrame:
    """(key, decoded) of (key, ids), equal keys having equal ids; none for ids that are null or empty."""
    one = sequences.where(F.size("ids") > 0).groupBy("key").agg(F.any_value("ids").alias("ids"))
    each = one.select("key", F.posexplode("ids").alias("pos", "id"))
    found = each.join(piece_table(sequences.sparkSession, path), "id", "left")
    parts = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("\ufffd")).alias("piece"))))
    return found.groupBy("key").agg(F.make_valid_utf8(F.array_join(F.transform(parts, lambda x: x["piece"]), "")).alias("decoded"))


def decode(rows: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """All columns of ``rows`` and ``decoded``, in place of a column of that name: the text of each row's token ids."""
    keep = [c for c in rows.columns if c.lower() != "decoded"]
    ids = F.col(f"`{ids_col}`").cast("array<int>")
    d = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), ids.alias("ids"), F.struct(F.xxhash64(ids).alias("a"), F.xxhash64(F.lit(1), ids).alias("b"), F.size(ids).alias("n")).alias("key"))
    d = d.join(texts_of(d.select("key", "ids"), path or vocabulary_path()), "key", "left")
    return d.select("row.*", F.when(F.col("ids").isNotNull(), F.coalesce("decoded", F.lit(""))).alias("decoded"))


def digest_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    path = path or vocabulary_path()

    def digests(rows: list[np.ndarray]):
        table = pa.array(pieces(path), pa.large_binary())
        joined = table.take(pa.array(np.concatenate([*rows, np.zeros(0, np.uint32)])))  # id -> piece, in order of position
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, rows)])].tolist()
        raw = memoryview(data) if data else b""
        texts = [str(raw[a:z], "utf-8", "replace") for a, z in zip(at, at[1:], strict=False)]
        return [(len(r), hashlib.sha256(r.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, texts, strict=True)]

    return encoded(docs.select("doc_id", "text"), digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path)


def query(spark, sf_dir: str) -> DataFrame:
    return digest_columns(documents(spark, sf_dir))
