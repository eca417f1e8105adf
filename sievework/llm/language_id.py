"""Operator 6, language ID: bit-sliced Bloom filters over letter trigrams, a few bits of each slot for a language.

Training counts trigrams by language. A language has one filter for all its trigrams and one more for each share in
SHARES, holding those that make up at least that share of its occurrences; all filters of all languages lie side by side as the bits
of a slot. One look-up, the AND of PROBES slots, so returns every language that contains a trigram, and how often it does, by
the number of its bits. A text's votes for a language are the popcounts of its bits over all trigrams, less the false positives
expected at its filters' fill; most votes win, the language that sorts first on a tie.

A trigram is a letter with its neighbours, letters in lower case and everything else a blank. All trigrams of the training texts
are in the filters, however rare, in every language that has them. There are at most 2 ** MOST_BITS slots, fewer with over 96 languages
so that all filters stay below 256 MB; beyond 2 ** MOST_BITS / SLOTS_PER_GRAM trigrams they fill further, and the false positives expected of
them rise.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with letters but no votes it gets the commonest
training language; without training rows everything is ``und``; rows without a language or an id train nothing; a null id is
held_out false; repeated rows count each; a very long text is read in slices, cut at blanks where there are any, and its votes
added up; more than MOST_LANGUAGES languages are an error; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

PROBES, SLOTS_PER_GRAM, MOST_BITS = 3, 16, 22
#: Shares of a language's occurrences from which a trigram is in a further filter of it.
SHARES = (1e-6, 1e-5, 1e-4, 1e-3)
BANDS = len(SHARES) + 1
#: Languages whose bits share a 64-bit number.
WORD = 63 // BANDS
MOST_LANGUAGES = 10_000
SLICE = 1 << 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each trigram, index of its letter) of a text with a blank put at both ends."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    is_letter = letters()[code]
    code = np.where(is_letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    h = code[at - 1] * MIX[0] + code[at] * MIX[1] + code[at + 1] * MIX[2]
    h ^= h >> np.uint64(29)
    return h * MIX[5], at


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h ^ (h >> np.uint64(31))) * MIX[i] >> np.uint64(64 - bits)).astype(np.int64) for i in range(PROBES)]


def slices(text: str):
    """Pieces of a text, each cut where no letters meet if there is such a place."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
        cut = cut if cut > at else at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text), summed within each task's batches and then by Spark."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).extend(slices(text))
                for lang, texts in by_lang.items():
                    part, size, found = [], 0, []
                    for t in [*texts, None]:
                        if part and (t is None or size + len(t) > 4 * SLICE):
                            found.append(np.unique(trigrams(" ".join(part))[0], return_counts=True))
                            part, size = [], 0
                        if t is not None:
                            part.append(t)
                            size += len(t)
                    for h, n in found:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Bloom filters of all languages side by side: bits from l % WORD * BANDS on of words[l // WORD, slot] belong to language l."""

    def __init__(self, langs: list[str], commonest: str | None, bits: int, words: np.ndarray):
        self.langs, self.commonest, self.bits, self.words = langs, commonest, bits, words
        fill = np.array([[((words[i // WORD] >> np.int64(i % WORD * BANDS + k)) & 1).mean() for k in range(BANDS)] for i in range(len(langs))]).reshape(-1, BANDS)
        self.false = (fill**PROBES).sum(axis=1)

    def votes(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Set bits by text and language; text i has the trigrams from starts[i] to starts[i + 1]."""
        at = slots(h, self.bits)
        masks = [w[at[0]] & w[at[1]] & w[at[2]] for w in self.words]
        out = np.zeros((len(starts) - 1, len(self.langs)))
        for i in range(len(self.langs)):
            bits = np.bitwise_count(masks[i // WORD] & np.int64((1 << BANDS) - 1 << i % WORD * BANDS))
            sums = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
            out[:, i] = sums[starts[1:]] - sums[starts[:-1]]
        return out


def train(rows: DataFrame) -> Filter:
    """The filters learnt from rows (lang, text). To the driver come a row for each language and the slots in use, which MOST_BITS bounds."""
    counts = gram_counts(rows.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")).persist()
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
        if len(totals) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        langs = sorted(totals)
        if not langs:
            return Filter([], None, 1, np.zeros((1, 2), np.int64))
        known = rows.sparkSession.createDataFrame([(k, i, float(totals[k])) for i, k in enumerate(langs)], "lang string, l int, total double")
        share, first = F.col("n") / F.col("total"), F.col("l") % WORD * BANDS
        band = F.lit(1).cast("long")
        for k, least in enumerate(SHARES, 1):
            band = band + F.when(share >= least, 1 << k).otherwise(0).cast("long")
        placed = counts.join(F.broadcast(known), "lang").select("gram", (F.col("l") / WORD).cast("int").alias("word"), band.alias("band"), first.alias("first"))
        used = placed.selectExpr("gram", "word", "shiftleft(band, first) AS bits").groupBy("gram", "word").agg(F.expr("bit_or(bits)").alias("mask")).persist()
        n, wide = used.select("gram").distinct().count(), (-(-len(langs) // WORD) - 1).bit_length()
        bits = min(MOST_BITS - max(0, wide - 3), max(10, (SLOTS_PER_GRAM * n - 1).bit_length()))

        def probe(batches):
            for b in batches:
                word, mask = b.column("word"), b.column("mask")
                for at in slots(b.column("gram").to_numpy().view(np.uint64), bits):
                    yield pa.RecordBatch.from_arrays([word, pa.array(at), mask], names=["word", "slot", "mask"])

        set_bits = used.mapInArrow(probe, "word int, slot bigint, mask bigint").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
        used.unpersist()
        words = np.zeros((-(-len(langs) // WORD), 1 << bits), np.int64)
        words[set_bits["word"].to_numpy(), set_bits["slot"].to_numpy()] = set_bits["mask"].to_numpy()
        return Filter(langs, max(langs, key=lambda k: (totals[k], k)), bits, words)
    finally:
        counts.unpersist()


def predict(docs: DataFrame, filt: Filter, carry=("doc_id", "held_out")) -> DataFrame:
    """``carry``, lang_pred and score for each row; score is the winner's share of the corrected votes."""
    d = docs.select(*carry, "text")
    sent = docs.sparkSession.sparkContext.broadcast(filt)  # bounded: see MOST_BITS

    def run(batches):
        f = sent.value
        prior = (f.commonest or "und", 1 / max(1, len(f.langs)))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                votes, n = np.zeros((b.num_rows, len(f.langs))), np.zeros(b.num_rows, np.int64)
                for owner, texts in packs(b.column("text").to_pylist()):
                    h, where = trigrams(" ".join(texts))
                    starts = np.searchsorted(where, np.concatenate(([0], np.cumsum([len(t.lower()) + 1 for t in texts]))))
                    np.add.at(votes, owner, f.votes(h, starts))
                    np.add.at(n, owner, np.diff(starts))
                votes = np.maximum(0, votes - n[:, None] * f.false)
                out = [("und", 0.0)] * b.num_rows
                for i in np.flatnonzero(n):
                    total = votes[i].sum()
                    if f.langs:
                        best = int(votes[i].argmax()) if total > 0 else -1
                        out[i] = (f.langs[best], float(votes[i, best] / total)) if total > 0 else prior
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array([x for x, _ in out]), pa.array([x for _, x in out], pa.float64())], names=[*carry, "lang_pred", "score"])

    kept = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in carry)
    return d.mapInArrow(run, f"{kept}, lang_pred string, score double")


def packs(texts: list[str | None]):
    """(indexes of the texts, slices of them) with at most about 4 SLICE characters together."""
    owner, part, size = [], [], 0
    for i, t in enumerate(texts):
        for piece in slices(t or ""):
            if part and size + len(piece) > 4 * SLICE:
                yield owner, part
                owner, part, size = [], [], 0
            owner.append(i)
            part.append(piece)
            size += len(piece)
    if part:
        yield owner, part


def fold(docs: DataFrame, by: int) -> DataFrame:
    """Adds fold, crc32 of the id as text modulo ``by``; null for a null id."""
    return docs.withColumn("fold", F.expr(f"crc32(cast(doc_id AS string)) % {by}"))


def query(spark, sf_dir: str) -> DataFrame:
    d = fold(documents(spark, sf_dir).select("doc_id", "text", "lang"), 3)
    model = train(d.where("fold <> 1"))
    return predict(d.withColumn("held_out", F.coalesce(F.col("fold") == 1, F.lit(False))), model)
