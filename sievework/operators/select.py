"""Selection: thresholds, top-k with stable ties, page order, and votes of nested spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def first_of(df: DataFrame, by, order: Sequence[Column], n: int | None = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, all without ``n``; with ``rank``, their number as a column."""
    w = Window.partitionBy(*names(by)).orderBy(*order)
    col = rank or "_rank"
    out = df.withColumn(col, F.row_number().over(w))
    out = out if n is None else out.where(F.col(col) <= n)
    return out if rank else out.drop(col)


def top_k(scored: DataFrame, by, k: int, threshold: float, p: str = "p", position: str = "i", rank: str | None = None) -> DataFrame:
    """The best ``k`` rows of each group with ``p`` of at least ``threshold``, earlier rows first among equals."""
    return first_of(scored.where(F.col(p) >= threshold), by, [F.col(p).desc(), F.col(position).asc()], k, rank)


def candidate(code: bool = False) -> Column:
    """Whether a block is worth scoring: records and longer texts, headings only if they lead somewhere; or code."""
    is_code = (F.col("kind") == "code") & (F.trim("text") != "")
    if code:
        return is_code
    longer = (F.char_length("text") >= 25) & ((F.col("kind") != "heading") | F.col("href").isNotNull())
    return F.col("record").isNotNull() | is_code | (F.col("kind") != "code") & longer


def candidates(blocks: DataFrame, code: bool = False) -> DataFrame:
    """The blocks that are a :func:`candidate`."""
    return blocks.where(candidate(code))


def selected_in_page_order(blocks: DataFrame, kept: str = "kept", by="page_id") -> DataFrame:
    """Kept blocks, and the headings that stand before the last of them, in page order (``i``)."""
    last = F.max(F.when(F.col(kept), F.col("i"))).over(Window.partitionBy(*names(by)))
    return blocks.withColumn("_last", last).where(F.col(kept) | (F.col("kind") == "heading") & (F.col("i") < F.col("_last"))).drop("_last")


def ranked(spans: DataFrame, by, rank: str = "rank") -> DataFrame:
    """Spans numbered by probability in hundredths, shorter ones first among equals, then in order of ``i``."""
    hundredths = F.floor(F.col("p") * 100 + 0.5)
    return spans.withColumn(rank, F.row_number().over(Window.partitionBy(*names(by)).orderBy(hundredths.desc_nulls_last(), F.col("length").asc(), F.col("i").asc())))


def nested_vote(spans: DataFrame, by) -> DataFrame:
    """For each span (start, end, p): its own p and those of other ranges that hold it or lie in it, at most 1, in hundredths.

    The join is within ``by``, which names a block, and so as large as the square of a block's candidates (200 at most);
    for the best span of a group alone :func:`best_with_vote` needs no join.
    """
    keys = names(by)
    a, b = spans.alias("a"), spans.select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("p").alias("p2")).alias("b")
    other = (F.col("s2") != F.col("start")) | (F.col("e2") != F.col("end"))
    holds = (F.col("s2") <= F.col("start")) & (F.col("e2") >= F.col("end")) | (F.col("s2") >= F.col("start")) & (F.col("e2") <= F.col("end"))
    voted = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [holds & other], "left")
    own = [F.col(f"a.{c}").alias(c) for c in spans.columns]
    return voted.groupBy(*own).agg(F.sum("p2").alias("_more")).withColumn("share", F.least(F.lit(1.0), F.floor((F.col("p") + F.coalesce("_more", F.lit(0.0))) * 100 + 0.5) / 100)).drop("_more")


def best_with_vote(spans: DataFrame, by, within: str = "block", carry: dict[str, Column] | None = None) -> DataFrame:
    """The best span of each group as :func:`ranked` orders them, with ``share`` as in :func:`nested_vote`, in one pass over
    the group: the winner is spread over its window, and the spans nested with it are summed there. Rows without p are no
    spans; ``carry`` takes values for the winner from the rows of its block."""
    keys = names(by)
    w = Window.partitionBy(*keys)
    d = ranked(spans, keys, "_rank").withColumn("_w", F.max(F.when((F.col("_rank") == 1) & F.col("p").isNotNull(), F.struct(within, "start", "end"))).over(w))
    same = F.col(within) == F.col(f"_w.{within}")
    holds = (F.col("start") <= F.col("_w.start")) & (F.col("end") >= F.col("_w.end")) | (F.col("start") >= F.col("_w.start")) & (F.col("end") <= F.col("_w.end"))
    other = (F.col("start") != F.col("_w.start")) | (F.col("end") != F.col("_w.end"))
    d = d.withColumn("_sum", F.coalesce(F.sum(F.when(same & holds & other, F.col("p"))).over(w), F.lit(0.0)))
    d = d.withColumns({k: F.max(F.when(same, c)).over(w) for k, c in (carry or {}).items()})
    return d.where("_rank = 1 AND p IS NOT NULL").withColumn("share", F.least(F.lit(1.0), F.floor((F.col("p") + F.col("_sum")) * 100 + 0.5) / 100)).drop("_rank", "_w", "_sum")


def inside(spans: DataFrame, winners: DataFrame, by) -> DataFrame:
    """Spans strictly inside their group's winner (start, end); ``by`` names the block too, as a winner's pieces are of its block."""
    keys = names(by)
    w = winners.select(*keys, F.col("start").alias("_ws"), F.col("end").alias("_we"))
    strict = (F.col("start") >= F.col("_ws")) & (F.col("end") <= F.col("_we")) & (F.col("end") - F.col("start") < F.col("_we") - F.col("_ws"))
    return spans.join(w, keys).where(strict).drop("_ws", "_we")


def interleaved(a: DataFrame, b: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """Rows of two ordered lists by turns, ``a`` first, up to ``most``; adds ``turn`` and ``side``."""
    def numbered(df, side):
        # a total order with a limit first: the window then sees at most `most` rows
        return df.orderBy(*order).limit(most).withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(side)).orderBy(*order))).withColumn("side", F.lit(side))

    return numbered(a, 0).unionByName(numbered(b, 1)).orderBy("turn", "side").limit(most)


def tiers(df: DataFrame, by, tier: str, order: Sequence[Column], most: int) -> DataFrame:
    """Rows by tier, then ``order``, as long as there is room for ``most`` in a group; adds ``place``."""
    return first_of(df, by, [F.col(tier).asc(), *order], most, "place")


def spread_tiers(links: DataFrame, by, tier: str, score: str, most: int) -> DataFrame:
    """:func:`tiers` of links whose directories take turns within a tier, as in :func:`.links.spread`; adds ``place``."""
    from .links import spread

    keys = names(by)
    turns = spread(links, [*keys, tier], score, most).withColumnRenamed("place", "_turn")
    return tiers(turns, keys, tier, [F.col("_turn")], most).drop("_turn")


def first_wins(df: DataFrame, by, position: str, fill: Sequence[str] = (), all_true: Sequence[str] = ()) -> DataFrame:
    """The first row of each key, its empty ``fill`` columns taken from the first row that has them; ``all_true`` are ANDed."""
    keys = names(by)
    rest = [c for c in df.columns if c not in keys and c not in fill and c not in all_true]
    aggs = [F.min_by(F.col(c), F.col(position)).alias(c) for c in rest]
    aggs += [F.min_by(F.col(c), F.when(F.col(c) != "", F.col(position))).alias(c) for c in fill]
    aggs += [F.bool_and(F.col(c)).alias(c) for c in all_true]
    return df.groupBy(*keys).agg(*aggs)
