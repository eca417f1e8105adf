"""Operator 3, mixing sources to target weights: a time-varying curriculum. DataFrame and SQL functions only.

Each source has a target number of words and a schedule, its relative rate of being trained on over time 0..1. The integral of
the schedule, scaled to the target, is the source's cumulative demand; a document that fills the words a..b of its source's
stream stands where demand reaches a. Sorting by that position interleaves the sources as the schedules ask.

A source's stream is all its documents in the order of a hash of their ids, repeated while the target asks for more; the
last document of the stream is cut at the target. Running sums over a source are made in two steps, within ranges of the
hash and over the ranges, so that a source with a large share of the rows is summed by many tasks.

Edge cases: a null or empty text has size 0 and 0 words of it are taken, in as many copies as all its source has; null sources are one source, the last in order; null
ids are allowed; rows with equal ids are separate documents; an empty table gives an empty result; a very long text is one row, whose words
one task counts; extra columns stay out
of the way of computed ones in :func:`mix` and are carried by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, text_of, words_of, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
#: Schedules by weight class, as (time, rate) knots joined by lines: heavy sources early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
#: Rows that one range of hashes holds at most, about, should all be of one source.
RANGE_ROWS = 2_500


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, rows, source_size, k) -> target by filling: shares by weight, none above ``most`` times its size.

    In order of size per weight, a source is full if the level that the rest would share is above its own; the level is
    then what is left over for the first that is not full. One row for each source.
    """
    n = len(weights)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    fill = Window.partitionBy(F.lit(0)).orderBy("ceiling", F.col("source").asc_nulls_last())
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = sizes.withColumn("k", ((F.row_number().over(by_name) - 1) % n).cast("int"))
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    d = d.withColumn("ceiling", F.col("cap") / F.col("weight"))
    d = d.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("level", F.col("left") / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("open", F.min(F.when(F.col("ceiling") >= F.col("level"), F.struct("ceiling", "level"))).over(everything)["level"])
    return d.select("source", "rows", "source_size", "k", F.least(F.col("cap"), F.col("weight") * F.col("open")).alias("target"))


def position(k: Column, share: Column, schedules=SCHEDULES) -> Column:
    """Time at which the integral of schedule ``k`` reaches ``share`` (0..1) of its whole."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        parts = [(t0, r0, t1 - t0, r1 - r0, (t1 - t0) * (r0 + r1) / 2) for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
        whole, before, at = sum(p[4] for p in parts), 0.0, F.lit(1.0)
        pieces = []
        for t0, r0, dt, dr, area in parts:
            x = (share * whole - before) / dt  # r0 u + dr u^2 / 2 = x for u in 0..1
            u = x / r0 if dr == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + 2 * dr * x)) - r0) / dr
            pieces.append((before + area, t0 + dt * u))
            before += area
        at = pieces[-1][1]
        for end, value in reversed(pieces[:-1]):
            at = F.when(share * whole < end, value).otherwise(at)
        out = F.when(k % len(schedules) == i, at).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def order_hash(seed: int) -> Column:
    """60 bits of the md5 of seed and id: the order of a source's stream, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS, schedules=SCHEDULES, seed: int = 11, carry: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, copies, and position (null if none is taken).

    copies counts how often the whole document stands in the mix, the cut copy being one if half of it is taken; position
    is the first copy's, last_position the last one's (null without copies).
    """
    more = carry or {}
    d = docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), F.size(words_of(text_of())).cast("long").alias("size"), order_hash(seed).alias("h"), *[c.alias(k) for k, c in more.items()])
    if not more:  # few bytes a row: the texts are then read once
        d = written(d, shared_dir(docs.sparkSession), "sizes")
    bits = max(0, (-(-docs.count() // range_rows) - 1).bit_length())
    d = d.withColumn("part", F.shiftright(F.col("h"), 60 - bits).cast("long"))
    ranges = d.groupBy("name", "unnamed", "part").agg(F.count("*").alias("part_rows"), F.sum("size").alias("part_size"))
    per_source = ranges.groupBy("name", "unnamed").agg(F.sum("part_rows").alias("rows"), F.sum("part_size").alias("source_size"))
    goal = targets(per_source.withColumn("source", F.when(~F.col("unnamed"), F.col("name"))), weights, most)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "target", "k")
    ranges = ranges.withColumn("before", F.sum("part_size").over(Window.partitionBy("name", "unnamed").orderBy("part")) - F.col("part_size"))
    d = d.join(ranges.join(goal, ["name", "unnamed"]).drop("part_rows", "part_size"), ["name", "unnamed", "part"])
    inside = Window.partitionBy("name", "unnamed", "part").orderBy("h", "doc_id", "size")
    d = d.withColumn("a", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size") - F.col("a")
    d = d.withColumn("rest", F.least(F.col("size"), F.greatest(F.lit(0), rest)))
    taken = F.col("whole") * F.col("size") + F.col("rest")
    at = position(F.col("k"), F.col("a") / F.nullif(F.col("target"), F.lit(0.0)), schedules)
    d = d.withColumn("copies", (F.col("whole") + F.when((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size")), 1).otherwise(0)).cast("int"))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", F.when(taken > 0, at).alias("position"),
                    F.when(F.col("copies") > 0, copy_position(F.col("copies") - 1, schedules)).alias("last_position"), "k", "a", *more)


def copy_position(copy: Column, schedules=SCHEDULES) -> Column:
    """Where copy 0, 1, ... of a document stands, over k, a, source_size and target."""
    return position(F.col("k"), (F.col("a") + copy * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)), schedules)


def ordered(mixed: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted by position: reading the partitions in order is the curriculum."""
    return mixed.repartitionByRange("position", F.xxhash64("doc_id")).sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs``, a row for each copy of a document in the mix, in training order."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    m = mix(docs, carry={"row": row}, **how).where("copies > 0")
    again = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    m = m.select("row", "doc_id", "source_size", "target", "k", "a", again).withColumn("position", copy_position(F.col("copy")))
    return m.repartitionByRange("position", F.xxhash64("doc_id")).sortWithinPartitions("position", "doc_id").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return ordered(mix(documents(spark, sf_dir))).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round("position", 6).alias("position"), F.round("last_position", 6).alias("last_position"))
