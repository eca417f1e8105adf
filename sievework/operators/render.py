"""Results as text and JSON: blocks as markdown, a run's document with its status, the log of pages read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import first_of, names
from .text import markdown


def blocks_document(blocks: DataFrame, by, question: str | None = None) -> DataFrame:
    """(by, text, json) of selected blocks (url, title, i, kind, level, lang, text, record, p), in page order.

    Absent values are left out of the JSON.
    """
    keys = names(by)
    said = F.concat(F.when(F.col("record").isNotNull(), F.concat(F.lit("[record "), "record", F.lit("]\n"))).otherwise(""), markdown(F.col("kind"), F.col("text"), F.col("level"), F.col("lang")), F.lit("\n\n"))
    item = F.struct("i", said.alias("said"), F.struct("i", "kind", "level", "lang", "text", "record", "p").alias("block"))
    d = blocks.groupBy(*keys).agg(F.first("url").alias("url"), F.first("title").alias("title"), F.sort_array(F.collect_list(item)).alias("b"))
    head = F.concat(F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise(""), F.lit("<"), "url", F.lit(">\n\n"))
    doc = F.struct("url", "title", F.lit(question).alias("ask"), F.transform("b", lambda x: x["block"]).alias("blocks"))
    return d.select(*keys, F.concat(head, F.array_join(F.transform("b", lambda x: x["said"]), "")).alias("text"), F.to_json(doc).alias("json"))


def precise_document(answers: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Adds ``json``: the answer, or the closest span below the threshold, its probability, quote and link; ``answer`` may be null. Context,
    chosen options, and the way to the page are in it where there are columns context, cut, chosen and path."""
    sure = F.col("p") >= threshold
    more = [c for c in ("context", "cut", "chosen", "path") if c in answers.columns]
    fields = F.struct("url", F.when(sure, F.col("text")).alias("answer"), F.when(~sure, F.col("text")).alias("closest"), "p", "quote", "block", "kind", "link", *more)
    return answers.withColumn("json", F.to_json(fields, {"ignoreNullFields": "false"}))


def run_status(found: Column, error: Column) -> Column:
    """0 printed, 1 read but nothing answers, 2 failed."""
    return F.when(error.isNotNull(), 2).when(found, 0).otherwise(1)


def run_document(results: DataFrame, usage: DataFrame, by) -> DataFrame:
    """(by, status, json) of results (by, json, error) with the run's usage; a failed run has its error."""
    keys = names(by)
    u = usage.select(*keys, F.struct(*[c for c in usage.columns if c not in keys]).alias("usage"))
    d = results.join(u, keys, "left")
    return d.select(*keys, run_status(F.col("json").isNotNull(), F.col("error")).alias("status"), F.to_json(F.struct(F.col("json").alias("result"), "usage", "error")).alias("json"))


#: What the log of pages says of each, where it is known.
LOGGED = ("url", "route", "blocks", "items", "sources", "images", "forms", "rows")


def pages_log(loads: DataFrame, by) -> DataFrame:
    """(by, pages): the pages read in the order of their loads (n, key, and of LOGGED what there is), each key once, as JSON."""
    keys = names(by)
    one = first_of(loads, [*keys, "key"], [F.col("n")])
    item = F.struct("n", F.struct(*[c for c in LOGGED if c in loads.columns]).alias("page"))
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("x")).select(*keys, F.to_json(F.transform("x", lambda v: v["page"])).alias("pages"))


def listed_json(rows: DataFrame, by, order: str, *fields: str) -> DataFrame:
    """(by, json): a group's rows as a JSON array of the fields, in order."""
    keys = names(by)
    d = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("x")))).alias("l"))
    return d.select(*keys, F.to_json(F.transform("l", lambda v: v["x"])).alias("json"))


def decorated(answers: DataFrame, by, name: str, found: DataFrame, error: Column | None = None) -> DataFrame:
    """Answers with a struct column ``name`` of what was found beside them, null where nothing was."""
    keys = names(by)
    f = found.select(*keys, F.struct(*[c for c in found.columns if c not in keys]).alias(name))
    out = answers.join(f, keys, "left")
    return out.withColumn(f"{name}_error", error) if error is not None else out
