"""What a caller asks of a table of pages: gist, answers, spans, code, links, images, rows. Every function keeps (page_id, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import answers, select, spans, structured
from ..operators import images as pictures
from ..operators import links as linking
from ..operators import search as searching
from ..operators.scoring import LexicalScorer
from ..sources.page import child, extract_pages

#: How many results a mode gives, and the bars they have to reach.
GIST, ASK, CODE, LINKS = 12, 5, 8, 20
THRESHOLD, PRECISE, FLOOR, PRECISE_BLOCKS = 0.5, 0.4, 0.1, 3


def scored_blocks(pages: DataFrame, scorer, code: bool = False) -> DataFrame:
    """All blocks, with p for the candidates and null for the others, so that the pages are read once."""
    blocks = child(extract_pages(pages, ["blocks"]), "blocks").withColumn("candidate", F.coalesce(select.candidate(code), F.lit(False)))
    if isinstance(scorer, LexicalScorer):
        scored = scorer.score(blocks.withColumn("text_cut", F.when(F.col("candidate"), F.left("text", F.lit(1200)))), "text_cut").drop("text_cut")
    else:
        scored = scorer.score(blocks)
    return scored.withColumn("p", F.when(F.col("candidate"), F.col("p"))).drop("candidate")


def best_blocks(scored: DataFrame, k: int, threshold: float) -> DataFrame:
    """Adds ``kept``: the best ``k`` blocks of each page that reach the threshold, earlier ones first among equals."""
    good = F.coalesce(F.col("p") >= threshold, F.lit(False))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(good.desc(), F.col("p").desc_nulls_last(), F.col("i")))
    return scored.withColumn("kept", good & (place <= k))


def chosen(pages: DataFrame, scorer, k: int, threshold: float, code: bool = False) -> DataFrame:
    """(page_id, i, kind, level, text, p): the best blocks in page order, with the headings before them (p null)."""
    marked = best_blocks(scored_blocks(pages, scorer, code), k, threshold)
    out = marked.where("kept") if code else select.selected_in_page_order(marked)
    return out.select("page_id", "i", "kind", "level", "text", F.when(F.col("kept"), F.col("p")).alias("p"))


def ask(pages: DataFrame, question: str, k: int = ASK, threshold: float = 0.2, scorer=None) -> DataFrame:
    return chosen(pages, scorer or LexicalScorer(question), k, threshold)


def gist(pages: DataFrame, scorer, k: int = GIST, threshold: float = THRESHOLD) -> DataFrame:
    return chosen(pages, scorer, k, threshold)


def code(pages: DataFrame, question: str, k: int = CODE, threshold: float = 0.2, scorer=None) -> DataFrame:
    return chosen(pages, scorer or LexicalScorer(question), k, threshold, code=True)


@F.pandas_udf(T.StringType())
def fragment_links(url: pd.Series, text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([spans.fragment_link(u or "", t, (a, b)) for u, t, a, b in zip(url, text, start, end, strict=True)], dtype=object)


def precise(pages: DataFrame, question: str, threshold: float = 0.2, scorer=None, refine: bool = False) -> DataFrame:
    """(page_id, answer, p, share, block, start, end, quote, kind, context, cut, table_quote, link): each page's best span, its vote, what it is quoted
    from and a link to it. ``refine`` scores the pieces of a long winner, and keeps the best that is as likely as the whole."""
    s = scorer or LexicalScorer(question)
    scored = scored_blocks(pages, s)
    best = best_blocks(scored, PRECISE_BLOCKS, FLOOR).where("kept")
    found = spans.spans(best.select("page_id", "i", "kind", "text"), quotes=True)
    is_quote = F.col("i") < 0
    said = found.withColumn("said", F.when(~is_quote, F.coalesce("label", "text")))
    ranked = (s.score(said, "said") if isinstance(s, LexicalScorer) else s.score(said)).withColumn("p", F.when(~is_quote, F.col("p")))
    carry = {"quote": F.when(is_quote, F.col("text")), "kind": F.when(is_quote, F.col("label"))}
    top = select.best_with_vote(ranked, "page_id", carry=carry).where(F.col("p") >= threshold)
    if refine:
        options = s.score(spans.refine_options(top.select("page_id", "quote", "start", "end", "label")), "text")
        pick = answers.refined(options, "page_id", threshold).select("page_id", F.col("start").alias("_a"), F.col("end").alias("_z"), F.col("text").alias("_t"))
        top = top.join(pick, "page_id", "left").withColumns({"start": F.coalesce("_a", "start"), "end": F.coalesce("_z", "end"), "text": F.coalesce("_t", "text")}).drop("_a", "_z", "_t")
    top = answers.in_context(top).join(pages.select("page_id", "url"), "page_id")
    return top.select("page_id", F.col("text").alias("answer"), "p", "share", "block", "start", "end", "quote", "kind", "context", "cut", "table_quote", fragment_links("url", "quote", "start", "end").alias("link"))


def links(pages: DataFrame, question: str, k: int = LINKS, threshold: float = 0.2, cap: int = 250) -> DataFrame:
    """(page_id, i, url, text, p): links that may lead to the answer, pruned by shared words before they are scored."""
    p = extract_pages(pages, ["links", "site_links"])
    all_ = linking.union_distinct([child(p, "links").where("NOT marginal"), child(p, "site_links").where("NOT marginal")], "page_id").where(linking.reachable(F.col("url")))
    rough = linking.most_relevant(all_.withColumn("_o", linking.overlap(F.lit(question), F.concat_ws(" ", "text", "url"))), "page_id", "_o", cap)
    scored = LexicalScorer(question).score(rough.withColumn("said", F.concat_ws(" ", "text", "context", "url")), "said")
    return select.top_k(scored, "page_id", k, threshold).select("page_id", "i", "url", "text", "p")


def images(pages: DataFrame, question: str | None = None, k: int = 12, threshold: float = 0.2) -> DataFrame:
    found = child(extract_pages(pages, ["images"]), "images")
    said = F.concat_ws(" ", "alt", "caption")
    scored = LexicalScorer(question).score(found.withColumn("said", said), "said") if question else found.withColumn("p", F.when(F.trim(said) != "", 1.0).otherwise(0.5))
    return pictures.keep(scored, "page_id", threshold, k).select("page_id", "i", "url", "alt", "caption", "p")


def with_line(pages: DataFrame, question: str, scorer=None) -> DataFrame:
    """(page_id, line, text, p, exists): of each page the line of its text that answers best, in the window that is surest to."""
    from ..operators import text as texts

    s = scorer or LexicalScorer(question)
    blocks = child(extract_pages(pages, ["blocks"]), "blocks")
    line = F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    l = blocks.select("page_id", "i", line.alias("at", "text")).withColumn("line", F.row_number().over(Window.partitionBy("page_id").orderBy("i", "at")) - 1)
    l = texts.packed(l.select("page_id", "line", "text"), "page_id", "line", F.octet_length("text"), 255, 50_000).withColumnRenamed("pack", "window")
    l = s.score(l)
    windows = l.groupBy("page_id", "window").agg(F.max("p").alias("exists"))
    return answers.best_line(l, windows, "page_id")


def find(pages: DataFrame, words: str) -> DataFrame:
    """(page_id, i, kind, text): the blocks that hold all of the words as they are written, in any case."""
    blocks = child(extract_pages(pages, ["blocks"]), "blocks")
    wanted = [w for w in words.lower().split() if w]
    for w in wanted:
        blocks = blocks.where(F.lower("text").contains(w))
    return blocks.select("page_id", "i", "kind", "text") if wanted else blocks.select("page_id", "i", "kind", "text").limit(0)


def dump(pages: DataFrame) -> DataFrame:
    """(page_id, text, json): whole pages as markdown and JSON."""
    from ..operators import render

    p = extract_pages(pages, ["title", "blocks"])
    b = p.select("page_id", "url", "title", F.explode("blocks").alias("x")).select("page_id", "url", "title", "x.*")
    return render.blocks_document(b.withColumn("p", F.lit(None).cast("double")), "page_id")


def follow(pages: DataFrame, question: str, starts: DataFrame | str, most: int = 5, **how) -> DataFrame:
    """A search of the sites that ``pages`` (page_id, url, html) hold, from each start on: the pages read, best leads first, and what they score."""
    p = extract_pages(pages, ["blocks", "links", "site_links"])
    s = LexicalScorer(question)
    scored = s.score(p.select("url", F.explode("blocks").alias("x")).select("url", "x.*").where(select.candidate()).select("url", F.left("text", F.lit(1200)).alias("text")))
    scores = scored.groupBy("url").agg(F.max("p").alias("p"))
    listed = p.select("url", F.explode(F.concat(F.transform("links", lambda x: F.struct(x["url"].alias("dst"), x["text"].alias("text"), x["i"].alias("pos"), F.lit(False).alias("menu"))), F.transform("site_links", lambda x: F.struct(x["url"].alias("dst"), x["text"].alias("text"), (x["i"] + 10_000).alias("pos"), F.lit(True).alias("menu"))))).alias("x")).select(F.col("url").alias("src"), "x.*")
    edges = s.score(listed.where(linking.reachable(F.col("dst"))).withColumn("said", F.concat_ws(" ", "text", "dst")), "said").groupBy("src", "dst").agg(F.max("p").alias("p"), F.min("pos").alias("pos"), F.min("menu").alias("menu"))
    return searching.follow(edges, scores, starts, most, **how)


def read_list(pages: DataFrame, starts: DataFrame, most: int = 50, guess: bool = False, **how) -> DataFrame:
    """(list, n, page, resume): the pages (page_id, url, html) that lists go over from their first address (list, page): declared, linked or named next, or guessed."""
    from ..operators import paging

    p = extract_pages(pages, ["blocks", "rel_next", "site_links", "data"])
    linked = next_of(p).select(F.col("url").alias("page"), F.lit(0).alias("place"), "next", F.lit(paging.LINKED).alias("kind"))
    data = structured.page_next_links(p).join(p.select("page_id", "url"), "page_id").select(F.col("url").alias("page"), (F.col("place") + 1).alias("place"), "next", F.lit(paging.DATA).alias("kind"), "keys")
    nexts = linked.withColumn("keys", F.lit(None).cast("array<string>")).unionByName(data)
    if guess:
        nexts = nexts.unionByName(p.select(F.col("url").alias("page"), F.lit(9).alias("place"), paging.guessed_next(F.col("url")).alias("next"), F.lit(paging.GUESSED).alias("kind"), F.lit(None).cast("array<string>").alias("keys")))
    items = p.select(F.col("url").alias("page"), F.explode("blocks").alias("x")).select("page", F.col("x.text").alias("item"))
    shapes = structured.page_shapes(p).join(p.select("page_id", "url"), "page_id").select(F.col("url").alias("page"), "keys")
    return paging.read_pages(items, nexts.where("next IS NOT NULL"), starts, most, shapes=shapes, **how)


def with_link(found: DataFrame, pages: DataFrame, question: str, bar: float = 0.5) -> DataFrame:
    """Answers with the page's best link to what the question names, null below the bar."""
    from ..operators.render import decorated

    best = links(pages, question, 1, bar).select("page_id", "url", "text", "p")
    return decorated(found, "page_id", "page_link", best)


def with_image(found: DataFrame, pages: DataFrame, question: str) -> DataFrame:
    """Answers with the best image of their page, by its words."""
    from ..operators.render import decorated

    return decorated(found, "page_id", "image", images(pages, question, 1, 0.0).select("page_id", "url", "alt", "caption", "p"))


def attached_images(pages: DataFrame) -> DataFrame:
    """(page_id, i_image, i_block): which block each image belongs to."""
    p = extract_pages(pages, ["images", "blocks"])
    return pictures.attach(child(p, "images"), child(p, "blocks"))


def values(pages: DataFrame) -> DataFrame:
    """(page_id, i, text): values that a page states in its structured data only, for answers that its text lacks."""
    p = extract_pages(pages, ["values"])
    return p.select("page_id", F.posexplode("values").alias("i", "text"))


def next_pages(pages: DataFrame) -> DataFrame:
    """(page_id, next): a list's next page: declared, else by number, else by step."""
    return next_of(extract_pages(pages, ["rel_next", "site_links"])).select("page_id", "next")


def next_of(p: DataFrame) -> DataFrame:
    """(page_id, url, next) of extracted pages (rel_next, site_links)."""
    from ..operators import paging

    site = child(p, "site_links")
    d = p.select("page_id", "url", "rel_next").join(paging.numbered_next(site).withColumnRenamed("next", "_n"), "page_id", "left").join(paging.stepped_next(site).withColumnRenamed("next", "_s"), "page_id", "left")
    return d.select("page_id", "url", F.coalesce("rel_next", "_n", "_s").alias("next")).where("next IS NOT NULL")


def sources(pages: DataFrame) -> DataFrame:
    """The largest lists in each page's data."""
    return structured.page_lists(extract_pages(pages, ["data"]))


def recipe(pages: DataFrame, text: str, by_shape: bool = False) -> DataFrame:
    """Rows of a recipe (JSON) from each page's data, from its own place or from whichever list is shaped like it."""
    rows = structured.page_rows_by_shape if by_shape else structured.page_rows
    return rows(extract_pages(pages, ["data"]), structured.recipe_of(text))


#: Modes that print something else, of which a call names one.
MODES = ("gist", "ask", "precise", "code", "links", "images", "sources", "recipe", "find", "dump", "follow", "read_list")


def checked(modes: list[str], question: str | None = None) -> str:
    """The one mode that a call names; an error for none, two, an unknown one, or a question where the mode takes none or lacks one."""
    unknown = [m for m in modes if m not in MODES]
    if unknown:
        raise ValueError(f"no mode {unknown[0]}: the modes are {', '.join(MODES)}")
    if len(modes) != 1:
        raise ValueError("name one mode" if not modes else f"{modes[0]} can't go with {modes[1]}")
    if modes[0] in ("ask", "precise", "code", "links", "follow", "find") and not (question or "").strip():
        raise ValueError(f"{modes[0]} needs a question")
    if modes[0] in ("gist", "sources", "recipe", "dump", "read_list") and question:
        raise ValueError(f"{modes[0]} takes no question")
    return modes[0]
