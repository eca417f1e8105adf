"""Blocks as text: joining, packing and cutting, with running totals that start anew when a piece is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import folded
from .select import names


def ordered_list(df: DataFrame, by, order: str, **fields: Column) -> DataFrame:
    """One row a group with ``rows``, an array of structs sorted by ``order``."""
    item = F.struct(F.col(order).alias("_o"), *[c.alias(k) for k, c in fields.items()])
    return df.groupBy(*names(by)).agg(F.sort_array(F.collect_list(item)).alias("rows"))


def excerpt(df: DataFrame, by, order: str = "i", text: str = "text", chars: int = 800) -> DataFrame:
    """The first ``chars`` characters of a group's texts, a line each; null texts have no line, and a group of these alone no excerpt. Rows
    beyond them are dropped before texts are put together; one that begins right behind them still gives the line break before it."""
    keys = names(by)
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce(F.char_length(text) + 1, F.lit(0))).over(w), F.lit(0))
    near = df.select(*keys, F.left(F.col(text), F.lit(chars)).alias("_t"), before.alias("_before")).where(F.col("_before") <= chars)
    rows = F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_before", "_t"))))  # each text adds to what is before the next
    whole = F.concat_ws("\n", F.transform("rows", lambda r: r["_t"]))
    return near.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.when(F.size("rows") > 0, F.left(whole, F.lit(chars))).alias("excerpt"))


def lines(df: DataFrame, text: str = "text", chars: int = 1200, keep=("doc_id",)) -> DataFrame:
    """(keep, line, text): the trimmed lines of a text that hold something, each cut to ``chars``; ``line`` counts those from 0."""
    trimmed = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*keep, F.posexplode(trimmed).alias("line", "t")).select(*keep, "line", F.left("t", F.lit(chars)).alias("text"))


def packed(df: DataFrame, by, order: str, size: Column, most_items: int = 255, most_size: int = 50_000) -> DataFrame:
    """Adds ``pack``: consecutive rows of a group share one as long as they are at most so many and so large together."""

    def step(state, n):
        pack, items, total = state or (0, 0, 0)
        if items and (items >= most_items or total + n > most_size):
            pack, items, total = pack + 1, 0, 0
        return (pack, items + 1, total + n), (pack,)

    return folded(df, by, [order], step, "pack int", size=F.coalesce(size.cast("bigint"), F.lit(0)))


def joined_runs(df: DataFrame, by, order: str, text: str = "text", short: int = 25, most: int = 400) -> DataFrame:
    """(by, run, text, pieces): neighbours below ``short`` characters become one text, a line each, as long as it stays within ``most``."""

    def step(state, n):
        run, total, open_ = state or (-1, 0, False)
        if open_ and n < short and total + 1 + n <= most:
            return (run, total + 1 + n, True), (run,)
        return (run + 1, n, n < short), (run + 1,)

    runs = folded(df.select(*names(by), order, text), by, [order], step, "run int", n=F.coalesce(F.char_length(text), F.lit(0)))
    d = ordered_list(runs, [*names(by), "run"], order, t=F.col(text))
    return d.select(*names(by), "run", F.concat_ws("\n", F.transform("rows", lambda r: r["t"])).alias("text"), F.size("rows").alias("pieces"))


#: Currency signs, the words that a price may hold, and the marks between its figures.
CURRENCY, UNITS, SEPARATORS = "$€£¥₹₩₽₺", ("a", "per", "mo", "month", "yr", "year", "user", "seat"), ".,/-–|·"
SIGNED = rf"^[{CURRENCY}].*[0-9]"
FIGURES = rf"^(?=.*[0-9])(?:[0-9\s{CURRENCY}{SEPARATORS.replace('-', '')}\-]|(?i:(?<!\p{{L}})(?:{'|'.join(UNITS)})s*(?!\p{{L}})))+$"


def is_price(text: Column) -> Column:
    """A currency sign first and a digit behind, or figures and unit words only; of a text with a plus also what stands before it, with a sign."""
    bare = lambda t: t.rlike("(?s)" + SIGNED) | t.rlike("(?sU)" + FIGURES)
    blank = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    head = blank(F.substring_index(text, "+", 1))
    return bare(blank(text)) | (text.contains("+") & head.rlike(f"[{CURRENCY}]") & bare(head))


def markdown(kind: Column, text: Column, level: Column | None = None, lang: Column | None = None) -> Column:
    """A block as markdown: number signs, a fence longer than any inside, ``> `` and ``- ``."""
    inner = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`{3,})"), 1), lambda x: F.length(x))), F.lit(2))
    fence = F.repeat(F.lit("`"), F.greatest(inner + 1, F.lit(3)))
    quoted = F.concat_ws("\n", F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1)) if level is not None else F.lit(1)), F.lit(" "), text))
        .when(kind == "code", F.concat(fence, F.coalesce(lang, F.lit("")) if lang is not None else F.lit(""), F.lit("\n"), text, F.lit("\n"), fence))
        .when(kind == "quote", quoted)
        .when(kind == "item", F.concat(F.lit("- "), text))
        .otherwise(text)
    )


def bare_urls(text: Column) -> Column:
    """Addresses written in a text, the punctuation of the sentence around them cut off, each once."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"]+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?'\")\]}]+$", "")))


def short_items_of_kept_lists(blocks: DataFrame, by="page_id", short: int = 25) -> DataFrame:
    """Adds ``beside``: a short item of a list in a run of short items of that list with a kept neighbour at either end."""
    keys = names(by)
    w = Window.partitionBy(*keys).orderBy("i")
    b = blocks.withColumn("_s", F.col("list").isNotNull() & (F.char_length("text") < short) & ~F.col("kept"))
    same = F.lag("list").over(w).eqNullSafe(F.col("list"))
    b = b.withColumn("_new", F.when(F.col("_s") & F.lag("_s").over(w) & same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    touch = F.lag("kept").over(w) & same | F.lead("kept").over(w) & F.lead("list").over(w).eqNullSafe(F.col("list"))
    b = b.withColumn("_t", F.coalesce(touch, F.lit(False)))
    return b.withColumn("beside", F.col("_s") & F.max("_t").over(Window.partitionBy(*keys, "_run"))).drop("_s", "_new", "_run", "_t")


def merged_pages(blocks: DataFrame, by, page: str = "page") -> DataFrame:
    """Blocks of several pages as one list: ``i``, ``list`` and ``record`` go on from those of the pages before."""
    keys = names(by)
    per = blocks.groupBy(*keys, page).agg((F.max("i") + 1).alias("_n"), F.coalesce(F.max("list") + 1, F.lit(0)).alias("_l"), F.coalesce(F.max("record"), F.lit(0)).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*keys, page, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("_n", "_l", "_r")])
    return blocks.join(base, [*keys, page]).withColumns({"i": F.col("i") + F.col("_n"), "list": F.col("list") + F.col("_l"), "record": F.col("record") + F.col("_r")}).drop("_n", "_l", "_r")
