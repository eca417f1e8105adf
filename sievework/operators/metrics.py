"""Measures of runs: nearest-rank percentiles, replay against a recording, usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import names


def nearest_rank(df: DataFrame, by, value: str, percents=(50, 90)) -> DataFrame:
    """(by, n, p50, p90, ...): the smallest value that at least so many percent of the group's values don't exceed.

    Values are counted first, so a group is summed by distinct value rather than sorted as rows.
    """
    keys = names(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    up = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value))
    d = counted.withColumns({"_up": up, "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    return d.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_up") >= F.ceil(F.col("_n") * p / 100), F.col(value))).alias(f"p{p}") for p in percents])


def compared(recorded: DataFrame, replayed: DataFrame, keys, p: str = "p", bar: float = 0.5) -> DataFrame:
    """(n, mae, same_side): mean absolute difference of paired answers, and the share on one side of the bar."""
    ks = names(keys)
    j = recorded.select(*ks, F.col(p).alias("a")).join(replayed.select(*ks, F.col(p).alias("b")), ks)
    return j.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.avg(((F.col("a") >= bar) == (F.col("b") >= bar)).cast("double")).alias("same_side"))


def top_agreement(recorded: DataFrame, replayed: DataFrame, by, item: str, p: str = "p", k: int = 3) -> DataFrame:
    """(by, top1, jaccard): whether the best item is the same, and how far the best ``k`` are the same."""
    keys = names(by)

    def best(df, name):
        w = Window.partitionBy(*keys).orderBy(F.col(p).desc(), item)
        top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        return top.groupBy(*keys).agg(F.min_by(item, "_r").alias(f"{name}1"), F.collect_set(item).alias(name))

    j = best(recorded, "x").join(best(replayed, "y"), keys)
    return j.select(*keys, (F.col("x1") == F.col("y1")).alias("top1"), (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def spearman(recorded: DataFrame, replayed: DataFrame, by, item: str, p: str = "p") -> DataFrame:
    """(by, n, spearman): how far two runs order a group's items alike, equal values sharing their mean rank; null where one orders nothing."""
    keys = names(by)

    def ranks(df: DataFrame, name: str) -> DataFrame:
        # a group's distinct values are ranked, not its rows
        n = df.groupBy(*keys, p).agg(F.count("*").alias("_c"))
        up = F.sum("_c").over(Window.partitionBy(*keys).orderBy(p))
        return df.select(*keys, item, p).join(n.select(*keys, p, (up - (F.col("_c") - 1) / 2).alias(name)), [*keys, p]).select(*keys, item, name)

    j = recorded.select(*keys, item).join(replayed.select(*keys, item), [*keys, item], "left_semi")
    x = ranks(recorded.join(j, [*keys, item], "left_semi"), "x")
    y = ranks(replayed.join(j, [*keys, item], "left_semi"), "y")
    return x.join(y, [*keys, item]).groupBy(*keys).agg(F.count("*").alias("n"), (F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))).alias("spearman"))


def stratified(rows: DataFrame, stratum: str, order: Column, most: int) -> DataFrame:
    """Up to ``most`` rows of each stratum, the first in ``order`` (a hash of their keys, so that runs agree)."""
    w = Window.partitionBy(stratum).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def usage(df: DataFrame, group: str, **sums: str) -> DataFrame:
    """Totals by group and over all (group null), as a rollup."""
    return df.rollup(group).agg(F.count("*").alias("requests"), *[F.sum(c).alias(k) for k, c in sums.items()], F.grouping(group).cast("int").alias("is_total"))
