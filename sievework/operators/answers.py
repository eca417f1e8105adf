"""From scores to an answer: fallbacks, the best line, shorter spans, the quote and its context."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import first_of, names
from .spans import table_rows

#: The most rows and characters of a context.
CONTEXT_ROWS, CONTEXT_CHARS = 60, 6000


def with_fallback(picks: DataFrame, structured: DataFrame, by) -> DataFrame:
    """Text picks, and for groups without any the best structured one (by p, the last among equals)."""
    keys = names(by)
    best = first_of(structured, keys, [F.col("p").desc(), F.col("i").desc()])
    return picks.withColumn("source", F.lit("text")).unionByName(best.join(picks.select(*keys).distinct(), keys, "left_anti").withColumn("source", F.lit("data")), allowMissingColumns=True)


def option_scores(options: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Options with the probability they were given; 0 where none was."""
    return options.join(answers.groupBy(*keys).agg(F.max("p").alias("_p")), list(keys), "left").withColumn("p", F.coalesce("_p", F.lit(0.0))).drop("_p")


def best_line(lines: DataFrame, windows: DataFrame, by) -> DataFrame:
    """(by, line, text, p, exists): in the window (window, exists) that is surest to answer, the line with the highest p.

    The last window wins among equals, and the first line.
    """
    keys = names(by)
    sure = first_of(windows, keys, [F.col("exists").desc(), F.col("window").desc()])
    return first_of(lines.join(sure, [*keys, "window"]), keys, [F.col("p").desc(), F.col("line").asc()]).select(*keys, "line", "text", "p", "exists")


def refined(options: DataFrame, by, threshold: float) -> DataFrame:
    """Of each group's options (k = 0 the whole): the best piece if it is at least as likely as the whole and reaches the
    threshold, the earlier one among equals; else the whole."""
    keys = names(by)
    whole = options.where("k = 0").select(*keys, F.col("p").alias("_whole"))
    best = first_of(options.where("k > 0"), keys, [F.col("p").desc(), F.col("k").asc()]).select(*keys, F.col("k").alias("_k"), F.col("p").alias("_p"))
    pick = whole.join(best, keys, "left").select(*keys, F.when((F.col("_p") >= threshold) & (F.col("_p") >= F.col("_whole")), F.col("_k")).otherwise(0).alias("k"))
    return options.join(pick, [*keys, "k"])


def tightened(options: DataFrame, choices: DataFrame, by) -> DataFrame:
    """The option that a choice (choice ``oN``, confidence) names with a confidence of a half or more, else option 0."""
    keys = names(by)
    n = F.regexp_extract("choice", "^o([0-9]+)$", 1)
    named = choices.where((F.col("confidence") >= 0.5) & (n != "")).select(*keys, n.try_cast("int").alias("_k"))
    named = named.join(options.select(*keys, F.col("k").alias("_k")), [*keys, "_k"], "left_semi")
    pick = options.select(*keys).distinct().join(named, keys, "left").select(*keys, F.coalesce("_k", F.lit(0)).alias("k"))
    return options.join(pick, [*keys, "k"])


def table_quote(text: str, at: int) -> str | None:
    """The head of a table and the row in which ``at`` lies."""
    rows = table_rows(text)
    row = next((r for r in rows if r[0] <= at < r[1]), None)
    if row is None:
        return None
    return text[slice(*rows[0])] if row == rows[0] else f"{text[slice(*rows[0])]}\n{text[slice(*row)]}"


def kept_rows(sizes: list[int], lead: int, hot: int) -> list[int] | None:
    """Rows of a context: the lead rows and the hot one, and neighbours below and above in turn while all fit."""

    def rows(lo: int, hi: int) -> list[int] | None:
        own = sorted({*range(lead), *range(lo, hi + 1)})
        return own if len(own) <= CONTEXT_ROWS and sum(sizes[k] for k in own) + len(own) - 1 <= CONTEXT_CHARS else None

    lo = hi = hot
    kept = rows(lo, hi)
    while kept is not None and len(kept) < len(sizes):
        below = rows(lo, hi + 1) if hi + 1 < len(sizes) else None
        hi, kept = (hi + 1, below) if below else (hi, kept)
        above = rows(lo - 1, hi) if lo > lead else None
        lo, kept = (lo - 1, above) if above else (lo, kept)
        if not (below or above):
            break
    return kept


def context(kind: str, text: str, at: int, items: list[str] | None = None, hot: int | None = None) -> tuple[str, bool] | None:
    """(text, cut) around an answer: its list's items, or its table's rows; None for other blocks."""
    if items is not None and hot is not None:
        kept = kept_rows([len(x) for x in items], 0, hot)
        return ("\n".join(items[k] for k in kept), len(kept) < len(items)) if kept is not None else None
    rows = table_rows(text) if kind not in ("code", "structured") else []
    at_row = next((k for k, r in enumerate(rows) if r[0] <= at < r[1]), None)
    if len(rows) < 2 or at_row is None:
        return None
    kept = kept_rows([b - a for a, b in rows], 1, at_row)
    if kept is None:
        return None
    if len(kept) == len(rows) and len(text) <= CONTEXT_CHARS:
        return text, False
    return "\n".join(text[slice(*rows[k])] for k in kept), True


def in_context(answers: DataFrame) -> DataFrame:
    """Adds ``context``, ``cut`` and ``table_quote`` to answers (quote, kind, start and, of a list's item, items and hot): the list's items or the
    table's rows around the answer while they fit, whether some are left out, and the table's head with the answer's row."""
    kind = "struct<context:string,cut:boolean,table_quote:string>"
    listed = "items" in answers.columns

    @F.pandas_udf(kind)
    def around(quote: pd.Series, kind: pd.Series, start: pd.Series, items: pd.Series, hot: pd.Series) -> pd.DataFrame:
        out = []
        for q, k, a, own, h in zip(quote, kind, start, items, hot, strict=True):
            found = context(k or "", q or "", int(a), None if own is None or not len(own) else list(own), None if h is None or h != h else int(h))
            out.append((*(found or (None, None)), table_quote(q or "", int(a)) if k != "code" else None))
        return pd.DataFrame(out, columns=["context", "cut", "table_quote"])

    none = F.lit(None)
    items = (F.col("items"), F.col("hot").cast("double")) if listed else (none.cast("array<string>"), none.cast("double"))
    return answers.withColumn("_x", around("quote", "kind", "start", *items)).select("*", "_x.*").drop("_x")


def page_kind(answers: DataFrame, by) -> DataFrame:
    """(by, kind, confidence) from rows (by, kind, p) of a choice."""
    keys = names(by)
    return first_of(answers, keys, [F.col("p").desc(), F.col("kind")]).select(*keys, "kind", F.col("p").alias("confidence"))


def owner_note(question: Column, url: Column) -> Column:
    """A question about a site is about its owner when the reading starts at the site's front page."""
    from ..functions import urls

    front = urls.path(url).isin("", "/")
    return F.when(front, F.concat(question, F.lit(" (about the owner of "), urls.host(url), F.lit(")"))).otherwise(question)


def within_tokens(requests: DataFrame, by, order: str, tokens: str, budget: int) -> DataFrame:
    """The requests that were sent: those before which the tokens used stay below the budget."""
    w = Window.partitionBy(*names(by)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("used", F.coalesce(F.sum(tokens).over(w), F.lit(0))).where(F.col("used") < budget)
