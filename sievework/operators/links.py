"""Links: one per page key, word overlap with a question, directories by turns, menus, hosts and language copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .select import first_of, names

#: Endings of addresses that are no pages.
ASSETS = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".zip", ".gz", ".xml", ".json", ".css", ".js", ".mp4", ".mp3", ".dmg", ".exe", ".tar", ".ico")


def union_distinct(sources: list[DataFrame], by, cap: int | None = None) -> DataFrame:
    """Links (url, text, i, ...) of several sources as one list: the first of each page key, renumbered from 0; at most ``cap``."""
    keys = names(by)
    all_ = None
    for n, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(n))
        all_ = s if all_ is None else all_.unionByName(s, allowMissingColumns=True)
    one = first_of(all_.withColumn("_key", urls.key(F.col("url"))), [*keys, "_key"], [F.col("_source"), F.col("i")])
    out = one.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("_source", "i")) - 1).drop("_source", "_key")
    return out.where(F.col("i") < cap) if cap else out


def words(text: Column) -> Column:
    """Lower-case words of at least four bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 4)


def stems(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.left(w, F.lit(5)))


def overlap(question: Column, text: Column) -> Column:
    """How many words of the question share their first five letters with a word of the text."""
    # the text's stems are bound once for a row, as the array's one element
    return F.element_at(F.transform(F.array(stems(text)), lambda t: F.size(F.filter(stems(question), lambda s: F.array_contains(t, s)))), 1)


def most_relevant(links: DataFrame, by, score: str, cap: int) -> DataFrame:
    """All links where they fit in ``cap``, else those with the highest score, earlier ones first among equals."""
    return first_of(links, by, [F.col(score).desc(), F.col("i").asc()], cap)


def spread(links: DataFrame, by, score: str, cap: int) -> DataFrame:
    """Links by score, then depth, then directories taking turns in the order they first come up; adds ``place`` from 1."""
    keys = names(by)
    d = links.withColumns({"_depth": urls.depth(F.col("url")), "_dir": urls.directory(F.col("url"))})
    group = Window.partitionBy(*keys, score, "_depth", "_dir")
    d = d.withColumn("_turn", F.row_number().over(group.orderBy("i"))).withColumn("_first", F.min("i").over(group))
    return first_of(d, keys, [F.col(score).desc(), F.col("_depth"), F.col("_turn"), F.col("_first")], cap, "place").drop("_depth", "_dir", "_turn", "_first")


def menus(site: DataFrame, content: DataFrame, by) -> DataFrame:
    """Keys of site links that no content link has."""
    keys = names(by)
    k = urls.key(F.col("url")).alias("key")
    return site.select(*keys, k).distinct().join(content.select(*keys, k).distinct(), [*keys, "key"], "left_anti")


def linked_hosts(links: DataFrame, by, cap: int = 3) -> DataFrame:
    """(by, host, n, first) of the other hosts under the page's registrable domain, by distinct addresses, first seen first among equals."""
    keys = names(by)
    d = links.withColumns({"host": urls.host(F.col("url")), "_own": urls.host(F.col("page_url"))}).where("host <> _own")
    d = d.where(urls.registrable(F.col("host")) == urls.registrable(F.col("_own")))
    hosts = d.groupBy(*keys, "host").agg(F.countDistinct("url").alias("n"), F.min("i").alias("first"))
    return first_of(hosts, keys, [F.col("n").desc(), F.col("first").asc()], cap)


def without_language_copies(links: DataFrame, by, locale: Column, own: Column, asked: list[str] = ()) -> DataFrame:
    """Of addresses that differ only in a language segment: the one in the reader's own, else the one without, else all; copies in
    languages that are asked for stay as well. ``locale`` is the segment (:func:`..functions.languages.path_copy`)."""
    keys = names(by)
    d = links.withColumns({"_l": locale, "_own": own})
    d = d.withColumn("_k", F.when(F.col("_l").isNull(), urls.key(F.col("url"))).otherwise(F.regexp_replace(urls.key(F.col("url")), r"^([a-z]+://[^/]+)/+[^/]+", "$1")))
    w = Window.partitionBy(*keys, "_k")
    is_own, plain = F.col("_l").eqNullSafe(F.col("_own")), F.col("_l").isNull()
    d = d.withColumns({"_o": F.max(is_own).over(w), "_p": F.max(plain).over(w)})
    wanted = F.coalesce(F.substring_index("_l", "-", 1).isin(*asked), F.lit(False)) if asked else F.lit(False)
    keep = F.when(F.col("_o"), is_own | wanted).when(F.col("_p"), plain | wanted).otherwise(F.lit(True))
    return d.where(keep).drop("_l", "_own", "_k", "_o", "_p")


def reachable(url: Column) -> Column:
    """An address of the web that is no file of another kind."""
    return url.rlike("^https?://") & ~F.lower(urls.path(url)).rlike("(" + "|".join(ASSETS).replace(".", r"\.") + ")$")


def with_field(p: Column, f: Column, weight: float = 0.3) -> Column:
    """A link's probability raised by its page's field score, unknown ones left alone."""
    return p + (1 - p) * weight * F.coalesce(f, F.lit(0.0))


def field_scored(links: DataFrame, fields: DataFrame, by) -> DataFrame:
    """Links (by, url, p) with p raised by what is remembered of their pages' fields (by, key, f), by :func:`with_field`."""
    keys = names(by)
    memo = fields.groupBy(*keys, "key").agg(F.max("f").alias("_f"))
    return links.withColumn("key", urls.key(F.col("url"))).join(memo, [*keys, "key"], "left").withColumn("p", with_field(F.col("p"), F.col("_f"))).drop("_f", "key")
