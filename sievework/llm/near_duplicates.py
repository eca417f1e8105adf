"""Operator 8, MinHash near-dedup: a chosen-path set similarity join, confirmed on full sets.

1. Each document becomes its set of distinct 5-word shingles (64-bit hashes), a fingerprint of the set, and a MinHash
   signature. Documents with equal sets are one class from here on, so exact copies cost nothing more.
2. Chosen paths: in each independent tree a node selects two coordinates of the signature, and a class goes on to the
   child of its value at each. Two children at similarity 0.75 make more than one common child of each common node, so
   a pair stays together on some path of a tree however deep it is: the chance of losing it is the extinction of that branching,
   q = (1 - s + s q) ** 2, 1 / 9 for s = 0.75. :func:`trees_for` takes as many trees as bring q ** trees below the miss that
   TARGET leaves: 4 trees and 0.0002, whatever the depth.
3. Small nodes are compared exhaustively by signature, at a bar four standard deviations below the threshold. That gives
   a spanning forest of each node, and the forests' connected components group all classes that may be linked.
   A node above LEAF classes is first compared in parts. If then at most LEAF of its classes lie outside its largest component,
   these are compared with the whole node, in blocks; else it branches on, and at DEEPEST its classes outside
   the largest component are compared with the whole node however many they are. No pair of a node is left uncompared.
4. Within a group, full sets are compared through an inverted index, exactly: |A and B| * 100 >= 75 * |A or B|. A group with
   more than BLOCK shingles is dealt out in blocks that share hub classes; further rounds make hubs of classes that the
   first left apart, until each class outside the largest part of its group has been compared with the whole group.

Ids are integers below 2 ** 62. Edge cases: a null or blank text has no shingles and is linked with nothing; below five words the whole sequence is
one shingle; a null id counts as larger than any other and is linked like them: its row takes the component's smallest id, null
if that has none, and :func:`deduplicated` keeps one of the rows of a component without ids; rows that repeat an id share its
fate, rows with one id and different texts are linked to whatever each text is; an empty table gives an empty result; a very
long text is one row and needs about 12 times its size in a worker; extra columns are ignored by :func:`near_duplicates` and kept, whatever
their names, by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, documents, shared_dir, written
from .graph import components
from .word_hashes import U, blocks, mixed, windows, words

SHINGLE, PERCENT = 5, 75
COORDINATES, DEPTH, DEEPEST = 128, 2, 6
#: Recall of pairs at the threshold that the number of trees is derived from.
TARGET = 0.9998
LEAF = 4096
BLOCK = 4_000_000
HUBS = 16
BAR = PERCENT / 100 - 4 * (PERCENT / 100 * (1 - PERCENT / 100) / COORDINATES) ** 0.5
#: Ids from here on stand for rows without one.
NO_ID = 1 << 62
FACTORS = np.random.default_rng(8).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | U(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, _, _, at = words(texts, lower=True)
    grams = windows(h, k, k)
    out = []
    for i, j in zip(at, at[1:], strict=False):
        if j - i >= k:
            out.append(np.unique(grams[i : j - k + 1]))
        else:
            out.append(windows(h[i:j], j - i, j - i) if j > i else np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> bytes:
    """16 bits of the least value under each of COORDINATES hash functions."""
    least = np.full(COORDINATES, ~U(0))
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048]
        np.minimum(least, (FACTORS[:, None] * (x ^ (x >> U(32)))[None, :]).min(axis=1), out=least)
    return (least * U(0x9E3779B97F4A7C15) >> U(48)).astype(np.uint16).tobytes()


def fingerprint(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n, fp, sig) for each row."""
    d = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for lo, texts in blocks(b.column("text")):
                sets = shingle_sets(texts)
                ids = b.column("doc_id").slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets]), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "fp", "sig"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n bigint, fp string, sig binary")


def extinction(s: float = PERCENT / 100) -> float:
    """Chance that a pair whose signatures agree in a share ``s`` of the coordinates is parted on all paths of a tree without end."""
    q = 0.0
    for _ in range(200):
        q = (1 - s + s * q) ** 2
    return q


def trees_for(target: float = TARGET, s: float = PERCENT / 100) -> int:
    """The fewest trees that keep a pair of similarity ``s`` together somewhere with probability ``target``, at any depth."""
    n = 1
    while extinction(s) ** n > 1 - target:
        n += 1
    return n


def step(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node): each row's node branches on two coordinates that the node chooses."""
    rows, out, own = [], [], np.arange(len(node))
    for branch in range(2):
        c = mixed(node + U(1 + branch)) % U(COORDINATES)
        rows.append(own)
        out.append(mixed(mixed(node + c * U(0x9E3779B97F4A7C15)) + sig[own, c.astype(np.int64)].astype(U) + U(branch)))
    return np.concatenate(rows), np.concatenate(out)


def sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def roots(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(key, cls): the nodes at ``depth`` that each class of (cls, sig) reaches."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sig, ids = sig_matrix(b.column("sig")), b.column("cls")
                for t in range(trees):
                    row, node = np.arange(len(sig)), np.full(len(sig), mixed(np.array([t + 1], U))[0])
                    for _ in range(depth):
                        up, node = step(node, sig[row])
                        row = row[up]
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), ids.take(pa.array(row))], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key bigint, cls bigint")


def deeper(nodes: DataFrame) -> DataFrame:
    """The children of (key, cls, sig)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 20000):
                b = whole.slice(at, 20000)
                row, node = step(np.array(b.column("key").to_numpy()).view(U), sig_matrix(b.column("sig")))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("cls").take(pa.array(row))], names=["key", "cls"])

    return nodes.select("key", "cls", "sig").mapInArrow(run, "key bigint, cls bigint")


def groups(batches, keys: list[str]):
    """Record batches sorted by ``keys`` -> a table for each run of equal keys; a group may span batches."""
    held, last = [], None
    for b in batches:
        k = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1]), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if held and k[i] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(i, j - i))
                last = k[i]
    if held:
        yield pa.Table.from_batches(held)


def forest(sig: np.ndarray, bar: float = BAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows whose signatures agree in at least ``bar`` of the coordinates."""
    rest, out = np.arange(len(sig)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.concatenate([(sig[rest[i : i + 2048]] == sig[x]).sum(axis=1) for i in range(0, len(rest), 2048)]) >= bar * COORDINATES
            out += [(x, y) for y in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return out


def agreeing(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of ``sig`` agrees with ``one``."""
    return np.concatenate([np.count_nonzero(sig[i : i + 2048] == one, axis=1) for i in range(0, len(sig), 2048)])


def may_link(nodes: DataFrame, keys=("key",)) -> DataFrame:
    """(a, b) of a spanning forest of each node of (keys, cls, sig)."""

    def run(batches):
        for t in groups(batches, list(keys)):
            ids, sig = t.column("cls").to_numpy(), sig_matrix(t.column("sig").combine_chunks() if t.column("sig").num_chunks > 1 else t.column("sig").chunk(0))
            ids, first = np.unique(ids, return_index=True)
            if pairs := forest(sig[first]):
                x = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[:, 0]]), pa.array(ids[x[:, 1]])], names=["a", "b"])

    return nodes.select(*keys, "cls", "sig").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def spread(n: str):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))


def in_parts(large: DataFrame, leaf: int) -> DataFrame:
    """(a, b) of the forests of large nodes (key, cls, sig, size, head), each dealt into parts that share the node's first class."""
    parts = large.withColumn("part", F.pmod(F.xxhash64("key", "cls"), F.ceil(F.col("size") / leaf)))
    heads = large.where("cls = head").withColumn("parts", F.ceil(F.col("size") / leaf)).select("key", "cls", "sig", spread("parts").alias("part"))
    return may_link(parts.select("key", "cls", "sig", "part").union(heads), ("key", "part"))


def labelled(large: DataFrame, edges: DataFrame, folder: str, leaf: int, depth: int) -> DataFrame:
    """Adds to large nodes each class's component by ``edges`` (c), the node's largest (most) and the shares of LEAF that lie outside it."""
    c = components(edges, folder, f"parts-{depth}").withColumnRenamed("v", "cls")
    rows = written(large.join(c, "cls", "left").withColumn("c", F.coalesce("c", "cls")), folder, f"large-{depth}")
    top = rows.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("n"))
    top = top.select("key", F.col("top.c").alias("most"), F.ceil((F.col("n") - F.col("top.k")) / leaf).alias("shares"))
    return rows.join(top, "key").where("shares > 0").withColumn("parts", F.ceil(F.col("size") / leaf))


def across(rows: DataFrame) -> DataFrame:
    """(a, b) between components of a node of :func:`labelled` rows, so that with its edges all pairs that may be linked are connected.

    The classes outside the largest component are open; each is compared with every class of the node, in blocks of one
    share of the open classes and one part of all. Pairs that are both outside the open ones are connected.
    A block gives a pair of components once.
    """
    dealt = rows.withColumns({"part": F.pmod(F.xxhash64("key", "cls"), "parts"), "share": spread("shares"), "open": F.lit(False)})
    opened = rows.where("c <> most").withColumns({"share": F.pmod(F.xxhash64("cls", "key"), "shares"), "part": spread("parts"), "open": F.lit(True)})
    keys = ["key", "share", "part"]

    def run(batches):
        for t in groups(batches, keys):
            label, is_open, sig = t.column("c").to_numpy(), t.column("open").to_numpy(zero_copy_only=False), sig_matrix(t.column("sig"))
            all_label, all_sig, pairs = label[~is_open], sig[~is_open], set()
            for x in np.flatnonzero(is_open) if len(all_sig) else ():
                near = np.unique(all_label[agreeing(all_sig, sig[x]) >= BAR * COORDINATES])
                pairs.update((int(label[x]), y) for y in near.tolist() if y != label[x])
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    names = [*keys, "c", "open", "sig"]
    return dealt.select(names).union(opened.select(names)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def candidates(classes: DataFrame, folder: str, trees: int | None = None, leaf: int = LEAF, deepest: int = DEEPEST) -> DataFrame:
    """Edges (a, b) that connect all classes that may be linked, from all nodes of all trees."""
    nodes, edges, depth = written(roots(classes, trees or trees_for(), DEPTH), folder, "nodes-0"), None, DEPTH
    sigs = classes.select("cls", "sig")
    while True:
        sizes = nodes.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("head")).where("size > 1")
        full = written(nodes.join(sizes, "key").join(sigs, "cls"), folder, f"full-{depth}")
        found = may_link(full.where(F.col("size") <= leaf))
        edges = found if edges is None else edges.union(found)
        large = full.where(F.col("size") > leaf)
        if large.isEmpty():
            return edges
        edges = written(edges.union(in_parts(large, leaf)), folder, f"edges-{depth}")
        rows = written(labelled(large, edges, folder, leaf, depth), folder, f"open-{depth}")
        last = depth >= deepest
        edges = edges.union(across(rows if last else rows.where("shares = 1")))
        wide = rows.where("shares > 1")
        if last or wide.isEmpty():
            return edges
        nodes, depth = written(deeper(wide), folder, f"nodes-{depth + 1}"), depth + 1


def linked(sets: list[np.ndarray], first: int, percent: int = PERCENT) -> np.ndarray:
    """Root index of each set, linking by the exact rule. With ``first``, only the first so many are compared with the others, else all."""
    n = len(sets)
    root = np.arange(n)
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i in range(min(n, first)):
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        k = hi - lo
        at = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        common = np.bincount(owner[at], minlength=n)
        hits = root[np.flatnonzero(100 * common >= percent * (size[i] + size - common))]
        root[np.isin(root, hits)] = hits.min()
        if not root.any():
            break
    return root


def confirm(members: DataFrame, keys: tuple[str, ...], hubs_only: bool) -> DataFrame:
    """(a, b), b the smallest class linked with a, within each group of (keys, cls, hub, shingles)."""

    def run(batches):
        for t in groups(batches, list(keys)):
            ids, hub = t.column("cls").to_pylist(), t.column("hub").to_pylist()
            own = {}
            for c, h, s in zip(ids, hub, t.column("shingles"), strict=True):
                old = own.get(c)
                own[c] = (h or bool(old and old[0]), s.as_buffer())
            ordered = sorted(own, key=lambda c: (not own[c][0], c))
            root = linked([np.frombuffer(own[c][1], U) for c in ordered], sum(own[c][0] for c in ordered) if hubs_only else len(ordered))
            least = {}
            for c, r in zip(ordered, root.tolist(), strict=True):
                least[r] = min(c, least.get(r, c))
            yield pa.RecordBatch.from_arrays([pa.array(ordered, pa.int64()), pa.array([least[r] for r in root.tolist()], pa.int64())], names=["a", "b"])

    return members.select(*keys, "cls", "hub", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (cls, fp, ...) with their shingles, computed anew from the texts of documents cls."""
    d = docs.select(F.col("doc_id").alias("cls"), F.col("text").cast("string").cast("binary").alias("text"))
    d = d.join(members.hint("merge"), "cls")  # the same exchange at every size
    rest = [c for c in d.columns if c not in ("text", "fp")]
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for b in batches:
            for lo, texts in blocks(b.column("text")):
                part = b.slice(lo, len(texts))
                sets = shingle_sets(texts)
                same = [fingerprint(s) == f for s, f in zip(sets, part.column("fp").to_pylist(), strict=True)]
                at = pa.array([i for i, x in enumerate(same) if x], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in rest], pa.array([s.tobytes() for s, x in zip(sets, same, strict=True) if x], pa.binary())], names=[*rest, "shingles"])

    return d.mapInArrow(run, f"{kinds}, shingles binary")


def class_links(docs: DataFrame, classes: DataFrame, folder: str, trees: int | None = None, leaf: int = LEAF, block: int = BLOCK, deepest: int = DEEPEST) -> DataFrame:
    """(cls, root) for classes (cls, fp, n, sig) that are linked with another."""
    group = components(candidates(classes, folder, trees, leaf, deepest), folder, "groups").select(F.col("v").alias("cls"), F.col("c").alias("grp"))
    group = group.join(classes.select("cls", "fp", "n"), "cls")
    weight = group.groupBy("grp").agg(F.sum("n").alias("weight"))
    group = group.join(weight, "grp").withColumn("parts", F.ceil(F.col("weight") / block).cast("int"))
    group = written(group.select("cls", "fp", "grp", "parts"), folder, "members")
    small = confirm(full_sets(docs, group.where("parts = 1")).withColumn("hub", F.lit(False)), ("grp",), False)
    if group.where("parts > 1").isEmpty():
        return small.where("a <> b").select(F.col("a").alias("cls"), F.col("b").alias("root"))
    large = written(full_sets(docs, group.where("parts > 1")), folder, "sets")
    ids, used, found, turn = large.select("cls", "grp", "parts").distinct(), None, None, 0
    labels = ids.withColumn("root", F.col("cls"))
    while True:
        sizes = labels.groupBy("grp", "root").agg(F.count("*").alias("k"))
        top = sizes.groupBy("grp").agg(F.max(F.struct("k", "root")).alias("top"))
        open_ = labels.join(top, "grp").where(F.col("top.root") != F.col("root")).select("cls", "grp")
        if used is not None:
            open_ = open_.join(used, "cls", "left_anti")
        hubs = written(open_.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("cls"))).where(F.col("r") <= HUBS).select("cls", "grp"), folder, f"hubs-{turn}")
        if hubs.isEmpty():
            out = labels.select("cls", "root")
            return out.union(small.select(F.col("a").alias("cls"), F.col("b").alias("root"))).where("cls <> root")
        used = hubs.select("cls") if used is None else used.union(hubs.select("cls"))
        dealt = large.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts"))).withColumn("hub", F.lit(False))
        everywhere = large.join(hubs.select("cls"), "cls").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).withColumn("hub", F.lit(True))
        edges = confirm(dealt.unionByName(everywhere), ("grp", "part"), True).where("a <> b")
        found = edges if found is None else found.union(edges)
        found = written(found, folder, f"links-{turn}")
        c = components(found, folder, f"linked-{turn}")
        labels = written(ids.join(c.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "grp", "parts", F.coalesce("c", "cls").alias("root")), folder, f"labels-{turn}")
        turn += 1


def number() -> Column:
    """The id, or for a null id a number from NO_ID on that equal texts share."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2))


def linked_rows(docs: DataFrame, trees: int | None = None, leaf: int = LEAF, block: int = BLOCK, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text), ids as :func:`number` gives them."""
    folder = shared_dir(docs.sparkSession)
    docs = docs.select(number().alias("doc_id"), "text")
    rows = written(sketch(docs), folder, "sketch")
    classes = written(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("cls"), F.min("n").alias("n"), F.min("sig").alias("sig")), folder, "classes")
    root = class_links(docs, classes, folder, trees, leaf, block, deepest).groupBy("cls").agg(F.min("root").alias("root"))
    ends = written(classes.select("fp", "cls").join(root, "cls", "left").select("fp", F.coalesce("root", "cls").alias("component_id")), folder, "ends")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(ends, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text)."""
    def real(c):
        return F.when(F.col(c) < NO_ID, F.col(c)).alias(c)

    return linked_rows(docs, **how).select(real("doc_id"), "n_shingles", real("component_id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Of rows without id that share a text with words and are so kept, the one that is first as JSON stays.
    """
    rows = linked_rows(docs, **how)
    lost = rows.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(number().alias("key"), row.alias("row")).join(lost.hint("merge"), "key", "left_anti")
    if rows.where(F.col("doc_id") >= NO_ID).isEmpty():
        return d.select("row.*")
    single = (F.col("key") >= NO_ID) & (F.length(F.translate(F.coalesce(F.col("row.text").cast("string"), F.lit("")), BLANKS, "")) > 0)
    one = d.where(single).groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return d.where(~single).select("row.*").union(one.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
