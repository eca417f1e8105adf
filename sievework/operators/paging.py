"""Lists over several pages: the next page by number or by step, and the loop that reads on while there is something new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .select import first_of, names

#: Limits of lists and their steps.
MOST_PAGES, MOST_STEP, MOST_POSITION = 50, 1000, 10_000_000
#: Parts of parameter names whose numbers are never a position in a list.
NOT_A_POSITION = ("id", "price", "prec", "prix", "preis", "cost", "min", "max", "year", "ano", "año", "date", "time", "sort", "order", "limit", "size", "per", "count", "num", "show", "rows", "zoom", "lat", "lng", "lon", "version", "item", "ipp", "top", "take", "view", "display", "hits", "result", "nb", "qty", "radius", "dist", "km")


def numbered_next(links: DataFrame, by="page_id") -> DataFrame:
    """(by, next): the first link of a page (page_url, i, url) with the same slot and the page's number plus one."""
    keys = names(by)
    d = links.withColumns({"_h": urls.page_slot(F.col("page_url")), "_l": urls.page_slot(F.col("url"))})
    here = F.coalesce(F.col("_h.page"), F.when(~F.col("page_url").rlike(r"(?i)[?&][^=&]*paged?=\d+|/page/\d+"), 1))
    return d.where((F.col("_h.slot") == F.col("_l.slot")) & (F.col("_l.page") == here + 1)).groupBy(*keys).agg(F.min_by("url", "i").alias("next"))


def pairs_of(url: Column) -> Column:
    return F.array_remove(F.split(urls.query(url), "&"), "")


def named(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def small_number(text: Column) -> Column:
    """A whole number below MOST_POSITION; null for anything else."""
    n = F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("bigint"))
    return F.when(n < MOST_POSITION, n)


def split_at(url: Column, name: Column) -> Column:
    """struct(list, value): an address without the position ``name`` (a parameter, or the path's last part where it is null), and the
    number there, 0 where there is none; null where it stands twice or is no number."""
    pairs, parts = pairs_of(url), urls.segments(url)
    own = F.filter(pairs, lambda p: named(p) == name)
    last = small_number(F.get(parts, F.size(parts) - 1))
    path = F.when(name.isNull() & last.isNotNull(), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rest = F.array_sort(F.when(name.isNull(), pairs).otherwise(F.filter(pairs, lambda p: named(p) != name)))
    value = F.when(name.isNull(), F.coalesce(last, F.lit(0).cast("bigint"))).when(F.size(own) == 0, F.lit(0).cast("bigint")).when(F.size(own) == 1, small_number(F.regexp_replace(F.get(own, F.lit(0)), "^[^=]*=?", "")))
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z]+://)", 1))
    return F.when(value.isNotNull(), F.struct(F.concat(scheme, urls.host(url), F.lit("/"), F.concat_ws("/", path), F.lit("?"), F.concat_ws("&", rest)).alias("list"), value.alias("value")))


def stepped_next(links: DataFrame, by="page_id", items: str | None = None) -> DataFrame:
    """(by, next): the link one step on in a list whose address counts items (``offset=24``, ``/shoes/48``).

    A position is the end of the path or a parameter of some link whose name says nothing else. The numbers that links to the
    same list have there, and the page's own, must hold three a step apart with the page's among them, the step being 2 to
    MOST_STEP and every number whole steps away. With ``items``, the records that the page holds, the step is between half of
    them and all, and a parameter that one link alone sets to the page's number plus them is enough. The first position
    that has such a link gives it.
    """
    keys = names(by)
    extra = [items] if items else []
    l = links.select(*keys, "page_url", "i", "url", *extra)
    may = lambda p: ~F.lower(named(p)).rlike("paged?$") & ~F.lower(named(p)).rlike("|".join(NOT_A_POSITION))
    params = l.select(*keys, "i", F.posexplode(F.transform(F.filter(pairs_of(F.col("url")), may), named)).alias("at", "name"))
    params = params.groupBy(*keys, "name").agg(F.min(F.struct("i", "at")).alias("order"))
    tail = l.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("name"), F.struct(F.lit(-1).cast(links.schema["i"].dataType).alias("i"), F.lit(-1).alias("at")).alias("order"))
    d = l.join(params.unionByName(tail), keys).withColumns({"_l": split_at(F.col("url"), F.col("name")), "_h": split_at(F.col("page_url"), F.col("name"))})
    d = d.where((F.col("_l.list") == F.col("_h.list")) & (F.col("_l.value") != F.col("_h.value"))).select(*keys, "name", "order", "i", "url", F.col("_l.value").alias("value"), F.col("_h.value").alias("here"), *extra)
    n = F.col(items).cast("bigint") if items else F.lit(None).cast("bigint")
    g = d.groupBy(*keys, "order", "here", n.alias("n")).agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("value"), F.array("here")))).alias("v"), F.first("name").alias("name"))
    gaps = F.zip_with(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, F.size("v") - 1), lambda b, a: b - a)
    g = g.withColumn("step", F.array_min(gaps))
    has = lambda x: F.array_contains("v", x)
    here, step = F.col("here"), F.col("step")
    three = has(here + step) & (has(here - step) | has(here + 2 * step))
    regular = step.between(2, MOST_STEP) & F.forall("v", lambda x: F.abs(x - here) % step == 0)
    sized = F.coalesce((F.col("n") <= 0) | step.between(F.floor(F.col("n") / 2), F.col("n")), F.lit(True))
    two = F.coalesce((F.col("n") >= 2) & F.col("name").isNotNull() & (F.size("v") == 2), F.lit(False))
    target = g.select(*keys, "order", F.when(two, here + F.col("n")).when(three & regular & sized, here + step).alias("value")).where("value IS NOT NULL")
    return first_of(d.join(target, [*keys, "order", "value"]), keys, [F.col("order"), F.col("i")]).select(*keys, F.col("url").alias("next"))


def guessed_next(url: Column) -> Column:
    """The address with its page number one on, or page 2 added; null with a page 0 or two numbers."""
    slot = urls.page_slot(url)
    up = (slot["page"] + 1).cast("string")
    has_query, has_path = url.rlike(r"(?i)[?&][^=&#]*paged?=[0-9]+"), urls.path(url).rlike(r"(?i)/page/[0-9]+/?$")
    swapped = F.when(has_query, F.regexp_replace(url, F.lit(r"(?i)([?&][^=&#]*paged?=)[0-9]+"), F.concat(F.lit("$1"), up))).otherwise(F.regexp_replace(url, F.lit(r"(?i)(/page/)[0-9]+"), F.concat(F.lit("$1"), up)))
    added = F.concat(F.regexp_replace(url, "#.*$", ""), F.when(urls.query(url) != "", "&page=2").otherwise("?page=2"))
    return F.when(slot["page"] >= 1, swapped).when(~has_query & ~has_path, added)


def read_list(rows: DataFrame, start: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(list, page, item) read page by page from (list, page, item, next): a list goes on while its next page holds an item
    that it has not shown yet, at most ``most`` pages.

    The loop's state -- where each list stands and what it has shown -- are tables; each turn is one join by (list, page), and
    the lineage is cut by a checkpoint each turn.
    """
    at, seen = start.select("list", "page"), None
    for _ in range(most):
        got = rows.join(at, ["list", "page"]).select("list", "page", "item", "next")
        new = got.join(seen.select("list", "item"), ["list", "item"], "left_anti") if seen is not None else got
        new = new.dropDuplicates(["list", "item"]).checkpoint()
        if new.isEmpty():
            break
        # a page is read if anything on it is new; its next is the page's own
        at = got.join(new.select("list", "page").distinct(), ["list", "page"], "left_semi").where("next IS NOT NULL").groupBy("list").agg(F.min("next").alias("page"))
        shown = new.select("list", "page", "item")
        seen = (shown if seen is None else seen.unionByName(shown)).checkpoint()
        at = at.checkpoint()
    return seen if seen is not None else rows.select("list", "page", "item").limit(0)


#: Where a candidate for the next page comes from: the platform's interface, a link, the page's data, a guess.
PLATFORM, LINKED, DATA, GUESSED = "platform", "linked", "data", "guessed"


def read_pages(items: DataFrame, nexts: DataFrame, starts: DataFrame, most: int = MOST_PAGES, blocked: DataFrame | None = None, shapes: DataFrame | None = None) -> DataFrame:
    """(list, n, page, resume): the pages that lists go over, from their first one (list, page) on.

    ``items`` are (page, item), what makes a page new; ``nexts`` (page, place, next, kind), in order of trying, kind being
    one of PLATFORM, LINKED, DATA, GUESSED, data ones with ``keys``; ``shapes`` (page, keys) the lists in a page's data. The first candidate that can
    be read and gives something new goes on. One that was read already, is refused (``blocked``: page), is unknown or gives nothing new
    ends the list, but for data, whose next candidate is tried if it was read already, can't be read or holds no list like its own,
    and for the platform's, after which the page's own link is. A page that data named and that names none ends the list,
    as does a page with neither (guesses are candidates only where ``nexts`` has them). ``resume``, on the last of ``most`` pages, is where
    a later read goes on: the next page that is linked or named, not read and not refused.

    All lists go on together; a turn is a few joins, its state tables that a checkpoint cuts.
    """
    known = items.select("page").distinct().withColumn("_known", F.lit(True))
    keyed = "keys" in nexts.columns and shapes is not None
    read = starts.select("list", F.lit(1).alias("n"), "page", F.lit(LINKED).alias("_kind")).checkpoint()
    seen = items.join(starts.select("list", "page"), "page").select("list", "item").distinct().checkpoint()
    at = read
    for n in range(2, most + 2):
        c = at.select("list", "page", F.col("_kind").alias("_by")).join(nexts, "page").withColumn("_kind", F.col("kind")).withColumnRenamed("page", "_from").withColumnRenamed("next", "page")
        c = c.where((F.col("_by") != DATA) | (F.col("kind") != GUESSED))
        first_kind = F.min(F.struct("place", "kind"))["kind"]
        c = c.join(c.groupBy("list").agg(first_kind.alias("_first")), "list").where((F.col("kind") == F.col("_first")) | ((F.col("_first") == PLATFORM) & (F.col("kind") == LINKED)))
        c = c.join(read.select("list", "page").distinct().withColumn("_read", F.lit(True)), ["list", "page"], "left").join(known, "page", "left")
        c = c.join(blocked.select("page").distinct().withColumn("_blocked", F.lit(True)), "page", "left") if blocked is not None else c.withColumn("_blocked", F.lit(None).cast("boolean"))
        if n > most:
            break
        new = c.select("list", "page").distinct().join(items, "page").join(seen, ["list", "item"], "left_anti").groupBy("list", "page").agg(F.count("*").alias("_new"))
        c = c.join(new, ["list", "page"], "left")
        if keyed:
            like = c.where(F.col("kind") == DATA).select("list", "page", F.col("keys").alias("_wanted")).join(shapes.select("page", "keys"), "page")
            like = like.where((F.size("_wanted") > 0) & (2 * F.size(F.array_intersect("keys", "_wanted")) >= F.size("_wanted"))).select("list", "page").distinct().withColumn("_like", F.lit(True))
            c = c.join(like, ["list", "page"], "left")
        else:
            c = c.withColumn("_like", F.lit(True))
        is_data, is_platform = F.col("kind") == DATA, F.col("kind") == PLATFORM
        stale = F.coalesce("_new", F.lit(0)) == 0
        goes_on = F.col("_read").isNull() & F.col("_blocked").isNull() & F.col("_known").isNotNull() & ~stale & (~is_data | F.coalesce("_like", F.lit(False)))
        passed = is_data & F.col("_blocked").isNull() & (F.col("_read").isNotNull() | F.col("_known").isNull() | ~F.coalesce("_like", F.lit(False))) | is_platform & F.col("_read").isNull() & ~goes_on
        pick = first_of(c.withColumns({"_ok": goes_on, "_pass": passed}).where("NOT _pass"), "list", [F.col("place"), F.col("page")]).where("_ok")
        at = pick.select("list", F.lit(n).alias("n"), "page", "_kind").checkpoint()
        if at.isEmpty():
            c = None
            break
        read = read.unionByName(at).checkpoint()
        seen = seen.unionByName(at.join(items, "page").select("list", "item")).distinct().checkpoint()
    resume = read.select("list").limit(0).withColumn("resume", F.lit(None).cast("string"))
    if c is not None:
        open_ = c.where(F.col("kind").isin(LINKED, DATA) & F.col("_blocked").isNull())
        resume = first_of(open_, "list", [F.col("place"), F.col("page")]).where("_read IS NULL").select("list", F.col("page").cast("string").alias("resume"))
    out = read.select("list", "n", "page").join(resume, "list", "left")
    return out.withColumn("resume", F.when(F.col("n") == most, F.col("resume")))


def new_texts(df: DataFrame, text: str, order: str) -> DataFrame:
    """Rows whose text no earlier row has: the first of each text, by a minimum and not by a window over hot texts."""
    return df.groupBy(text).agg(F.min(order).alias(order))
