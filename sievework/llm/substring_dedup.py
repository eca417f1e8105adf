"""Operator 2, substring dedup: compressed FM-indexes of shards, and the matching statistics of the text that streams past them.

Every window of WINDOW words whose words also start earlier -- in a smaller id, or earlier in the document -- is a repeat,
and each word that a repeat covers is removed. The input is cut so that equal windows meet in one shard:

1. A window's anchor is the least hash among its runs of GRAM words; neighbours with one anchor form a segment, the text from
   the first word of its first window to the last of its last. Equal windows have equal anchors. Anchors are counted, and
   segments whose anchor occurs once in the corpus hold no repeat and go no further.
2. Equal segments have equal statistics: they are folded into one, with the smallest id that has it, which streams for all. All
   windows of the others are repeats of its windows.
3. The distinct segments go to shards by anchor. A shard numbers its words, builds an FM-index (wavelet matrix over the
   transform, sampled suffix array) of its segments, and streams them past it: backward search gives, at each place, the longest match
   that starts there and the interval of its occurrences. Intervals of WINDOW words are reported; of those with an
   occurrence elsewhere all places are located, and the earliest decides.
4. Each document gets its repeats and drops the words they cover.

A task reads its segments in order of anchor and cuts them into shards of about SHARD words, so an index stays small whatever
the partition holds. An anchor with over HOT occurrences is split: each of its segments is indexed in one of its parts and
streams past all of them, in pieces, so neither an index nor what a task holds grows with the anchor.

Words are compared by a 64-bit hash, segments by one of theirs. Ids are integers above -2 ** 62. Edge cases: null and blank texts
have no words; a text below WINDOW words keeps all; null ids are the smallest, in an order of their texts' hashes, rows with null id
and equal text counting as one document; rows that share an id count as one document, so a row doesn't make its own
repetition a repeat, and of rows with one id and different texts the earlier start wins; an empty table gives an empty
result; a very long text is one row and needs some 15 times its size in a worker; extra columns are carried, whatever their names, by
:func:`without_repeats` and ignored by :func:`digests`.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .fm_index import FMIndex
from .word_hashes import U, blocks, mixed, powers, windows, words

WINDOW, GRAM = 20, 6
SHARD, HOT = 1_000_000, 40_000
#: Words that stream in one piece, with WINDOW - 1 more.
PIECE = 64
#: Ids from here up to -2 ** 62 stand for rows without one.
NO_ID = -(1 << 63)


def segments(h: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text, first word, number of words, anchor, hash) of the segments of texts whose words are h[at[i]:at[i + 1]], in order."""
    none = np.zeros(0, np.int64)
    n = len(h) - window + 1
    if n <= 0:
        return none, none, none, none.view(U), none.view(U)
    grams, reach, width = windows(h, gram, 3), 1, window - gram + 1
    least = grams
    while reach < width:  # least of the next `width` grams
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    start = np.arange(n)
    text = np.searchsorted(at, start, "right") - 1
    valid = start + window <= at[text + 1]
    same = np.zeros(n, bool)
    same[1:] = valid[1:] & valid[:-1] & (text[1:] == text[:-1]) & (least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~same)
    if not len(first):
        return none, none, none, none.view(U), none.view(U)
    cut = np.flatnonzero(~same)
    after = np.append(cut, n)[np.searchsorted(cut, first, "right")]
    size = after - first + window - 1
    up, down = powers(len(h) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(h * up[: len(h)], dtype=U)))
    own = mixed((sums[first + size] - sums[first]) * down[first] + size.astype(U))
    return text[first], first, size, least[first], own


def anchored_twice(h: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Which segments have their anchor at two or more places, as those have that repeat a window of their own."""
    grams, n = windows(h, gram, 3), size - gram + 1
    ends = np.cumsum(n)
    hit = np.flatnonzero(grams[np.arange(int(n.sum())) + np.repeat(start - (ends - n), n)] == np.repeat(anchor, n))
    return np.diff(np.searchsorted(hit, np.append(0, ends))) > 1


def keyed(docs: DataFrame) -> DataFrame:
    """(_id, text, doc_id, row) of ``docs``: row holds the columns other than the text, so that no name of theirs can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2)
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), stand_in).alias("_id"), "text", row.alias("row"))


def raw(d: DataFrame) -> DataFrame:
    """Adds the text's bytes, after the exchanges: these carry each text once."""
    return d.withColumn("_raw", F.col("text").cast("string").cast("binary"))


def anchors(d: DataFrame) -> DataFrame:
    """(anchor, seg, id) of every segment of (_id, _raw), twice for one that may repeat a window of its own."""

    def run(batches):
        for b in batches:
            ids = b.column("_id")
            for lo, texts in blocks(b.column("_raw")):
                h, _, _, at = words(texts)
                text, start, size, anchor, own = segments(h, at)
                rows = np.repeat(np.arange(len(own)), 1 + anchored_twice(h, start, size, anchor)) if len(own) else np.zeros(0, np.int64)
                text, anchor, own = text[rows], anchor[rows], own[rows]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), ids.take(pa.array(text + lo))], names=["anchor", "seg", "id"])

    found = raw(d).select("_id", "_raw").mapInArrow(run, "anchor bigint, seg bigint, id bigint")
    return found.where("anchor IS NOT NULL AND seg IS NOT NULL AND id IS NOT NULL")  # as joins would add: one exchange then serves all


def contents(d: DataFrame) -> DataFrame:
    """(anchor, part, indexed, id, start, body): the first segment of each hash in ``segs`` in each row of (_id, _raw, segs).

    One row for a segment of one part; else one for each part, indexed in the part that its hash names.
    """

    def run(batches):
        for b in batches:
            ids, wanted = b.column("_id"), b.column("segs")
            for lo, texts in blocks(b.column("_raw")):
                h, first, after, at = words(texts)
                text, start, size, anchor, own = segments(h, at)
                joined = b" ".join([b"", *texts, b""])
                rows = ([], [], [], [], [], [])
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    a, z = bounds[i], bounds[i + 1]
                    value = wanted[lo + i].values
                    want, parts = np.array(value.field("seg").to_numpy(), np.int64).view(U), np.array(value.field("parts").to_numpy(), np.int64)
                    kinds, place = np.unique(own[a:z], return_index=True)
                    by = np.argsort(want)
                    hit = np.minimum(np.searchsorted(want[by], kinds), len(by) - 1)
                    found = np.flatnonzero(want[by][hit] == kinds)
                    for k, n in zip((place[found] + a).tolist(), parts[by][hit[found]].tolist(), strict=True):
                        s, e = start[k], start[k] + size[k]
                        body = b" ".join(joined[first[s] : after[e - 1]].split())
                        home = int(own[k]) % n
                        for part in range(n):
                            for col, v in zip(rows, (anchor[k], part, part == home, ids[lo + i].as_py(), s - at[i], body), strict=True):
                                col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(rows[0], U).view(np.int64)), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.int64()), pa.array(np.array(rows[4], np.int64)), pa.array(rows[5], pa.binary())], names=["anchor", "part", "indexed", "id", "start", "body"])

    return d.mapInArrow(run, "anchor bigint, part int, indexed boolean, id bigint, start bigint, body binary")


def repeats(ids: np.ndarray, starts: np.ndarray, bodies: list[bytes], indexed: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(id, first word, word after) of stretches of windows of the segments that start earlier in an ``indexed`` one."""
    h, _, _, at = words(bodies)
    n = np.diff(at)
    kinds, symbol = np.unique(h, return_inverse=True)
    segment = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(len(h)) - at[segment]
    place = np.arange(len(h)) + segment  # a 1 after each segment, a 0 after all
    text = np.ones(len(h) + len(bodies) + 1, np.int64)
    text[place], text[-1] = symbol.reshape(-1) + 2, 0
    inside = np.append(np.repeat(indexed, n + 1), True)  # by position of the text
    index = FMIndex(text[inside], len(kinds) + 2, window)

    begins = np.flatnonzero(offset + window <= n[segment])
    piece = begins[offset[begins] % PIECE == 0]
    size = np.minimum(PIECE + window - 1, n[segment[piece]] - offset[piece])
    # pieces overlap: each is read from its end, so a place takes what the piece says that it begins in
    length, lo, hi = (np.zeros(len(text), np.int64) for _ in range(3))
    for k in (0, 1):
        turn = offset[piece] // PIECE % 2 == k
        found = index.statistics(text, place[piece[turn]], place[piece[turn]] + size[turn])
        own = place[offset // PIECE % 2 == k]
        length[own], lo[own], hi[own] = (x[own] for x in found)

    spot = place[begins]
    many = np.flatnonzero((length[spot] == window) & ((hi[spot] - lo[spot] > 1) | ~indexed[segment[begins]]))
    if not len(many):
        return []
    by = np.lexsort((starts[segment] + offset, ids[segment]))
    a, b = ids[segment][by], (starts[segment] + offset)[by]
    where = np.zeros(len(text), np.int32)  # rank of each position by (id, word); equal places rank equal
    where[place[by]] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    low, first, which = np.unique(lo[spot[many]], return_index=True, return_inverse=True)
    count = hi[spot[many]][first] - low
    ends = np.cumsum(count)
    rows = np.arange(int(ends[-1])) + np.repeat(low - (ends - count), count)  # of all intervals, which are apart
    earliest = np.minimum.reduceat(where[np.flatnonzero(inside)[index.locate(rows)]], ends - count)
    late = begins[many][earliest[which.reshape(-1)] < where[spot[many]]]
    out = []
    for run in np.split(late, np.flatnonzero((np.diff(late) != 1) | (np.diff(segment[late]) != 0)) + 1):
        if len(run):
            k = segment[run[0]]
            out.append((int(ids[k]), int(starts[k] + offset[run[0]]), int(starts[k] + offset[run[-1]]) + window))
    return out


def search(content: DataFrame) -> DataFrame:
    """(id, a, b): the words from a to b of document id are covered by repeats, as the shards of :func:`contents` find."""

    def shard(t: pa.Table):
        t = t.combine_chunks()
        ids, starts, indexed = (np.array(t.column(c).to_numpy()) for c in ("id", "start", "indexed"))
        found = repeats(ids, starts, t.column("body").to_pylist(), indexed.astype(bool))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["id", "a", "b"])

    def run(batches):
        held, size = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held, size = t if held is None else pa.concat_tables([held, t]), size + b.nbytes // 6
            if size < SHARD:
                continue
            key = np.array(held.column("anchor").to_numpy()) ^ (np.array(held.column("part").to_numpy()).astype(np.int64) << 40)
            cut = np.flatnonzero(key != key[-1])
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last group may go on
            if cut:
                yield shard(held.slice(0, cut))
                held = held.slice(cut)
            elif size >= 4 * SHARD and not held.column("indexed")[held.num_rows - 1].as_py():
                yield shard(held)  # more of one group: its indexed segments, which came first, stay
                held = held.filter(held.column("indexed"))
            size = held.nbytes // 6
        if held is not None and held.num_rows:
            yield shard(held)

    order = ("anchor", "part")
    return content.repartition(*order).sortWithinPartitions(*order, F.col("indexed").desc()).mapInArrow(run, "id bigint, a bigint, b bigint")


def marked(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, _id and _raw, and what of the text is repeated: full (segment hashes), part (word ranges)."""
    d = keyed(docs)
    all_ = anchors(keyed(docs.select("doc_id", "text")))
    shared = all_.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    rows = all_.join(shared, "anchor")
    distinct = rows.groupBy("anchor", "seg").agg(F.min("id").alias("first"), F.max("parts").alias("parts"))
    wanted = distinct.groupBy(F.col("first").alias("_id")).agg(F.collect_list(F.struct("seg", "parts")).alias("segs"))
    part = search(contents(raw(d.join(wanted, "_id").select(*d.columns, "segs"))))
    full = rows.select("anchor", "seg", "id").join(distinct.select("anchor", "seg", "first"), ["anchor", "seg"]).where("id <> first").select("id", "seg")
    both = full.select("id", "seg", F.lit(None).cast("struct<a:bigint,b:bigint>").alias("part")).union(part.select("id", F.lit(None).cast("bigint").alias("seg"), F.struct("a", "b").alias("part")))
    found = both.groupBy(F.col("id").alias("_id")).agg(F.collect_list("seg").alias("full"), F.collect_list("part").alias("part"))
    return raw(d.join(found, "_id", "left").select(*d.columns, "full", "part"))


def kept_words(texts: list[bytes], full: list, part: list):
    """(words, which are kept) for each text."""
    h, _, _, at = words(texts)
    text, start, size, _, own = segments(h, at)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        a, z = bounds[i], bounds[i + 1]
        again = np.ones(z - a, bool)
        again[np.unique(own[a:z], return_index=True)[1]] = False  # a segment that this text had before
        if full[i]:
            again |= np.isin(own[a:z], np.array(full[i], np.int64).view(U))
        steps = np.zeros(at[i + 1] - at[i] + 1, np.int64)
        np.add.at(steps, start[a:z][again] - at[i], 1)
        np.add.at(steps, start[a:z][again] - at[i] + size[a:z][again], -1)
        for p in part[i] or ():
            if p["b"] < len(steps):
                steps[p["a"]] += 1
                steps[p["b"]] -= 1
        yield t.split(), np.cumsum(steps[:-1]) == 0


def rebuilt(docs: DataFrame, fields: T.StructType, per_row) -> DataFrame:
    """(row, text, the ``fields`` that ``per_row(words, kept)`` gives) for each row of ``docs``."""
    m = marked(docs)
    out = T.StructType([m.schema["row"], m.schema["text"], *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            for lo, texts in blocks(b.column("_raw")):
                p = b.slice(lo, len(texts))
                rows = [per_row(w, k) for w, k in kept_words(texts, p.column("full").to_pylist(), p.column("part").to_pylist())]
                yield pa.RecordBatch.from_arrays([p.column("row"), p.column("text"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=out.names)

    return m.mapInArrow(run, out)


def digest_row(w: list[bytes], keep: np.ndarray):
    gone = len(w) - int(keep.sum())
    return len(w), gone, hashlib.sha256(b" ".join(compress(w, keep.tolist()) if gone else w)).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    fields = T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
    return rebuilt(docs.select("doc_id", "text"), fields, digest_row).select("row.doc_id", *fields.names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; a text with repeats becomes its kept words joined by blanks, others stay as they are."""
    fields = T.StructType().add("new", T.StringType())
    out = rebuilt(docs, fields, lambda w, k: (None if k.all() else b" ".join(compress(w, k.tolist())).decode("utf-8", "replace"),))
    return out.select(*[F.coalesce("new", "text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
