"""Best-first search of sites: a frontier table for many searches at once, a few pages of each a step, leads worth less with each hop and on cold pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .select import first_of

#: What a lead loses each hop and on cold pages, when a search ends, how many leads it looks at, how many pages a
#: step reads (from LONG pages on more, and then menus count less).
HOP_DECAY, COLD_PAGE, COLD_TRAIL, BETTER_BY, SHORTLIST, LEAST_LEAD = 0.85, 0.3, 0.02, 0.15, 10, 0.05
BEST, BEST_LONG, LONG, LONG_MENU, HINTS = 2, 3, 10, 0.3, 300

READ = "search bigint, step int, url string, key string, path array<string>, lead double, p double, rank double, found boolean, error string"


def optional(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(name), otherwise) if name in df.columns else otherwise


def follow(edges: DataFrame, scores: DataFrame, starts: str | DataFrame, most: int = 5, bar: float = 0.5, width: int | None = None,
           hints: DataFrame | None = None, blocked: DataFrame | None = None, choices: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """(search, step, url, key, path, lead, p, rank, found, error) of the pages that each search reads.

    ``edges`` are (src, dst, p, pos) and may have ``menu``; ``scores`` (url, p), how well a page answers, and may have ``warmth``
    (its best block, else p), ``error`` and ``tokens``; ``starts`` is an address or (search, url). A lead is worth its link's p times
    HOP_DECAY for each hop times the heat of the page it stands on: 1 on the start page, else between COLD_PAGE and 1
    as the page is warm, has a good link, or a better one than led to it. A step reads the best leads that were not read, by
    page key, and that ``blocked`` (url) does not refuse: BEST of them, or BEST_LONG where ``most`` is LONG or more; short searches
    take them in the order of ``choices`` (search, url, p) where more than those stand in the shortlist. A page that failed is opened but gives
    no leads. A search ends when no lead beats the best rank (p times lead) found by BETTER_BY, or is colder than COLD_TRAIL,
    or when ``most`` pages are open or its ``tokens`` reach ``budget``. ``hints`` (search, url, p) are leads from the start on; the start
    page's own hint is what its answer counts, COLD_PAGE at least.

    All searches go on together: a step is a few joins whatever their number. State is tables, cut by a checkpoint each step.
    """
    spark = edges.sparkSession
    if isinstance(starts, str):
        starts = spark.createDataFrame([(0, starts)], "search bigint, url string")
    key = urls.key(F.col("url"))
    long = most >= LONG
    width = width or (BEST_LONG if long else BEST)
    menu = optional(edges, "menu", F.lit(False))
    e = edges.select(urls.key(F.col("src")).alias("key"), "dst", urls.key(F.col("dst")).alias("dst_key"), F.when(menu & F.lit(long), F.col("p") * LONG_MENU).otherwise(F.col("p")).alias("link_p"), F.col("pos").cast("bigint").alias("pos"), menu.alias("menu")).checkpoint()
    own = F.struct(F.coalesce("p", F.lit(0.0)).alias("p"), optional(scores, "warmth", F.coalesce("p", F.lit(0.0))).alias("warmth"), optional(scores, "error", F.lit(None).cast("string")).alias("error"), optional(scores, "tokens", F.lit(0.0)).cast("double").alias("tokens"))
    s = scores.groupBy(key.alias("key")).agg(F.max(own).alias("s")).select("key", "s.*").checkpoint()

    first = starts.select(F.col("search").cast("bigint").alias("search"), "url", key.alias("key"))
    lead = F.lit(1.0)
    if hints is not None:
        h = hints.select(F.col("search").cast("bigint").alias("search"), "url", key.alias("key"), F.col("p").alias("hint")).checkpoint()
        first = first.join(h.groupBy("search", "key").agg(F.max("hint").alias("hint")), ["search", "key"], "left")
        lead = F.greatest(F.coalesce("hint", F.lit(0.0)), F.lit(COLD_PAGE))
    leads = first.select("search", "url", "key", lead.alias("lead"), F.lit(1.0).alias("link_p"), F.array().cast("array<string>").alias("path"), F.lit(0).cast("bigint").alias("seq"))
    read = spark.createDataFrame([], READ + ", tokens double")
    known = spark.createDataFrame([], "search bigint, dst_key string")
    refused = blocked.select(key.alias("key")).distinct() if blocked is not None else None
    for step in range(1, most + 1):
        fresh = leads.join(read.select("search", "key"), ["search", "key"], "left_anti")
        fresh = fresh.join(refused, "key", "left_anti") if refused is not None else fresh
        fresh = first_of(fresh, ["search", "key"], [F.col("lead").desc(), F.col("seq")])
        so_far = read.groupBy("search").agg(F.count("*").alias("opened"), F.max("found").alias("any_found"), F.max(F.when(F.col("found"), F.col("rank"))).alias("best"), F.sum("tokens").alias("spent"))
        by_lead = Window.partitionBy("search").orderBy(F.col("lead").desc(), "seq")
        d = fresh.withColumns({"n": F.row_number().over(by_lead), "top": F.max("lead").over(Window.partitionBy("search"))}).join(so_far, "search", "left")
        over = F.coalesce(F.col("any_found"), F.lit(False)) & (F.col("top") <= F.col("best") + BETTER_BY)
        room = F.least(F.lit(width), F.lit(most) - F.coalesce("opened", F.lit(0)))
        goes = ~over & (F.col("top") >= COLD_TRAIL) & (room > 0) & ((F.coalesce("spent", F.lit(0.0)) < budget) if budget is not None else F.lit(True))
        short = d.where(goes & (F.col("n") <= SHORTLIST)).withColumn("room", room)
        if choices is not None and not long:
            c = choices.groupBy(F.col("search").cast("bigint").alias("search"), key.alias("key")).agg(F.max("p").alias("choice"))
            many = F.max("n").over(Window.partitionBy("search")) > F.col("room")
            short = short.join(c, ["search", "key"], "left").withColumn("n", F.when(many, F.row_number().over(Window.partitionBy("search").orderBy(F.col("choice").desc_nulls_last(), "n"))).otherwise(F.col("n")))
        chosen = short.where("n <= room").select("search", "url", "key", "lead", "link_p", F.concat("path", F.array("url")).alias("path"), "n")
        visits = chosen.join(s, "key", "left").withColumns({"p": F.coalesce("p", F.lit(0.0)), "warmth": F.coalesce("warmth", F.lit(0.0)), "tokens": F.coalesce("tokens", F.lit(0.0))})
        visits = visits.withColumn("p", F.when(F.col("error").isNull(), F.col("p")).otherwise(0.0)).checkpoint()
        if visits.isEmpty():
            break
        rank = F.col("p") * F.col("lead")
        new = visits.select("search", F.lit(step).alias("step"), "url", "key", "path", "lead", "p", rank.alias("rank"), (F.col("error").isNull() & (F.col("p") >= bar)).alias("found"), "error", "tokens")
        read = read.unionByName(new).checkpoint()
        out = linked(visits.where("error IS NULL"), e, known)
        best = F.max("link_p_e").over(Window.partitionBy("search", "key"))
        heat = F.when(F.size("path") == 1, 1.0).otherwise(COLD_PAGE + (1 - COLD_PAGE) * F.greatest("warmth", best, F.least(best / F.greatest("came_p", F.lit(LEAST_LEAD)), F.lit(1.0))))
        worth = F.col("link_p_e") * F.pow(F.lit(HOP_DECAY), F.size("path") - 1) * heat
        found = out.select("search", F.col("dst").alias("url"), F.col("dst_key").alias("key"), worth.alias("lead"), F.col("link_p_e").alias("link_p"), "path", (F.lit(step) * (1 << 40) + F.col("n") * (1 << 32) + F.col("pos")).alias("seq"))
        leads = fresh.select(leads.columns).unionByName(found.select(leads.columns))
        if step == 1 and hints is not None:
            told = h.join(starts.select(F.col("search").cast("bigint").alias("search"), F.col("url").alias("start")), "search").where(F.col("key") != urls.key(F.col("start")))
            leads = leads.unionByName(told.select("search", "url", "key", F.col("hint").alias("lead"), F.col("hint").alias("link_p"), F.array("start").alias("path"), F.lit(2 << 40).alias("seq")))
        leads = leads.checkpoint()
        if "menu" in edges.columns:
            known = known.union(visits.where("error IS NULL").join(e.where("menu"), "key").select("search", "dst_key")).distinct().checkpoint()
    return read.drop("tokens")


def linked(visits: DataFrame, e: DataFrame, known: DataFrame) -> DataFrame:
    """The links of the pages just read; a menu's link counts on the first page that has it."""
    out = visits.select("search", "key", "path", "n", "warmth", F.col("link_p").alias("came_p")).join(e.withColumnRenamed("link_p", "link_p_e"), "key")
    again = known.withColumn("_again", F.lit(True))
    return out.join(again, ["search", "dst_key"], "left").where("NOT (menu AND coalesce(_again, false))").drop("_again")


def side_by_side(leads: DataFrame, choices: DataFrame, by="search", cap: int = SHORTLIST) -> DataFrame:
    """The best leads (by, url, lead) of each group in the order of a choice among them (by, url, p), as ``place``; those that it
    does not name come last, as they were."""
    keys = [by] if isinstance(by, str) else list(by)
    best = first_of(leads, keys, [F.col("lead").desc(), F.col("url")], cap, "_n")
    c = choices.groupBy(*keys, "url").agg(F.max("p").alias("choice"))
    w = Window.partitionBy(*keys).orderBy(F.col("choice").desc_nulls_last(), "_n")
    return best.join(c, [*keys, "url"], "left").withColumn("place", F.row_number().over(w)).drop("_n")


def hints(listed: DataFrame, starts: DataFrame, cap: int = HINTS, least: float = COLD_PAGE) -> DataFrame:
    """(search, url, p, place): listed pages (search, url, p) as first leads; the start page (search, url) comes first and counts ``least`` at least."""
    s = starts.select("search", urls.key(F.col("url")).alias("_key"), F.col("url").alias("_start"))
    own = listed.withColumn("_key", urls.key(F.col("url"))).join(s, ["search", "_key"], "left")
    start = s.join(own.where("_start IS NOT NULL").groupBy("search").agg(F.max("p").alias("p")), "search", "left").select("search", F.col("_start").alias("url"), F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(least)).alias("p"), F.lit(0).alias("_rest"))
    rest = own.where("_start IS NULL").select("search", "url", "p", F.lit(1).alias("_rest"))
    return first_of(start.unionByName(rest), "search", [F.col("_rest"), F.col("p").desc(), F.col("url")], cap, "place").drop("_rest")


def second_pass(read: DataFrame, edges: DataFrame, scores: DataFrame, more: DataFrame, starts: str | DataFrame, extra: int = 3, **how) -> DataFrame:
    """``read`` as it is for searches that found something, the others with up to ``extra`` pages that a site's own search gives: (dst, p, pos)
    or, for several searches, (search, dst, p, pos)."""
    done = read.groupBy("search").agg(F.max("found").alias("any"), F.max("step").alias("last"))
    open_ = done.where("NOT any").select("search", "last")
    if isinstance(starts, str):
        starts = edges.sparkSession.createDataFrame([(0, starts)], "search bigint, url string")
    starts = starts.join(open_.select("search"), "search", "left_semi")
    given = more.join(starts.select("search", F.col("url").alias("src")), "search") if "search" in more.columns else more.crossJoin(F.broadcast(starts.select("search", F.col("url").alias("src")).limit(1)))  # one row
    # each search has its own result page: its leads stand on an address of its own
    own = given.select(F.concat(F.lit("search:"), F.col("search").cast("string"), F.lit("/"), "src").alias("src"), F.col("dst"), "p", "pos")
    from_ = starts.select("search", F.concat(F.lit("search:"), F.col("search").cast("string"), F.lit("/"), "url").alias("url"))
    again = follow(own, scores, from_, extra + 1, **how).where(~F.col("url").startswith("search:"))
    new = again.join(read.select("search", "key"), ["search", "key"], "left_anti").join(open_, "search").withColumn("step", F.col("step") + F.col("last")).drop("last")
    return read.unionByName(new)


def concluded(read: DataFrame) -> DataFrame:
    """The answer's row of each search: the page that answers with the best rank, else the closest one, else ``miss`` with what was read."""
    some = read.where("found OR p > 0")
    best = first_of(some, "search", [F.col("found").desc(), F.col("rank").desc(), F.col("step"), F.col("url")])
    pages = read.groupBy("search").agg(F.count("*").alias("pages"))
    out = pages.join(best, "search", "left")
    return out.withColumn("miss", F.when(~F.coalesce("found", F.lit(False)), F.concat(F.lit("nothing answers on the "), F.col("pages").cast("string"), F.lit(" pages read"))))


def trail(path: Column) -> Column:
    """A way through a site, its addresses without their scheme."""
    return F.array_join(F.transform(path, lambda u: F.regexp_replace(u, "^https?://", "")), " → ")
