"""Structured data: recipes over JSON, discovered lists, shapes, and listing joins (overlap, division, exclusion)."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .select import first_of, names

#: Limits of rows, lists, elements looked into and samples.
MOST_ROWS, MOST_LISTS, MOST_SHAPES, WALKED, SAMPLES, SAMPLE_VALUES, SAMPLE_CHARS = 1000, 8, 16, 50, 2, 60, 120


def recipe_of(text: str) -> dict:
    """A recipe from its JSON: source, path and fields (name -> path of at least one step); anything else is an error."""
    try:
        r = json.loads(text)
    except ValueError as e:
        raise ValueError(f"not a recipe: {e}") from None
    if not isinstance(r, dict) or set(r) != {"source", "path", "fields"}:
        raise ValueError("not a recipe: it has source, path and fields")
    for name, path in r["fields"].items():
        if not path:
            raise ValueError(f"not a recipe: the path of `{name}` is empty")
    return r


def json_path(steps: list[str]) -> str:
    """Keys and indexes as a JSON path for ``get_json_object``."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else "['" + s.replace("'", "\\'") + "']" for s in steps)


def recipe_columns(value: Column, fields: dict[str, list[str]]) -> list[Column]:
    """A column for each field of a JSON object; blank text is no value. For paths of plain keys and indexes."""
    out = []
    for name, steps in fields.items():
        v = F.get_json_object(value, json_path(steps))
        out.append(F.when(F.trim(v) != "", v).alias(name))
    return out


def step_into(v, steps: list[str]):
    for s in steps:
        if isinstance(v, dict):
            if s.endswith("*"):
                found = [k for k in v if k.startswith(s[:-1])]
                v = v[found[0]] if len(found) == 1 else None
            else:
                v = v.get(s)
        elif isinstance(v, list):
            v = v[int(s)] if re.fullmatch(r"\d+", s) and int(s) < len(v) else None
        else:
            return None
    return v


def text_of(v) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else v if isinstance(v, str) and v.strip() else None


def recipe_rows(data: list[tuple[str, object]], recipe: dict) -> tuple[list[dict], bool, str | None]:
    """(rows, cut off, error) of a recipe on one page's data."""
    root = next((v for k, v in data if k == recipe["source"]), None)
    if root is None:
        return [], False, f"the page has no {recipe['source']}"
    found = step_into(root, recipe["path"])
    if not isinstance(found, list):
        return [], False, f"no list at {recipe['source']} {' '.join(recipe['path'])}"
    objects = [o for o in found if isinstance(o, dict)]
    rows = [{n: t for n, p in sorted(recipe["fields"].items()) if (t := text_of(step_into(o, p))) is not None} for o in objects[:MOST_ROWS]]
    return rows, len(objects) > MOST_ROWS, None


def lists_in(value, least: int = 3, path: tuple[str, ...] = ()):
    """(path, objects) of every array with ``least`` objects or more; the first elements of an array are looked into."""
    if isinstance(value, list):
        objects = [o for o in value if isinstance(o, dict)]
        if len(objects) >= max(1, least):
            yield path, objects
        for i, x in enumerate(value[:WALKED]):
            yield from lists_in(x, least, (*path, str(i)))
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from lists_in(value[k], least, (*path, k))


def sample(o: dict) -> list[str]:
    out: list[str] = []

    def visit(v, path: str) -> None:
        if isinstance(v, dict):
            for k in sorted(v):
                visit(v[k], f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                visit(x, f"{path}.{i}")
        elif len(out) < SAMPLE_VALUES and (t := text_of(v)) is not None:
            out.append(f"{path}: {t[:SAMPLE_CHARS]}{'…' if len(t) > SAMPLE_CHARS else ''}")

    visit(o, "")
    return out


def page_lists(pages: DataFrame) -> DataFrame:
    """(page_id, source, path, count, score, sample, keys): the largest lists of each page's data, by objects times distinct keys (15 at most)."""
    kind = "page_id bigint, source string, path array<string>, count int, score bigint, sample array<array<string>>, keys array<string>"

    def run(batches):
        for b in batches:
            rows = []
            for page, data in zip(b.column("page_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                found = [(len(o) * min(15, len({k for x in o for k in x})), d["name"], path, o) for d in data or () for path, o in lists_in(json.loads(d["value"]))]
                for score, name, path, o in sorted(found, key=lambda f: -f[0])[:MOST_LISTS]:
                    rows.append({"page_id": page, "source": name, "path": list(path), "count": len(o), "score": score, "sample": [sample(x) for x in o[:SAMPLES]], "keys": sorted({k for x in o[:5] for k in x})})
            types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.string())), pa.list_(pa.string())]
            cols = ["page_id", "source", "path", "count", "score", "sample", "keys"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(cols, types, strict=True)], names=cols)

    return pages.select("page_id", "data").mapInArrow(run, kind)


def page_rows(pages: DataFrame, recipe: dict) -> DataFrame:
    """(page_id, row, fields, truncated, error): the rows that a recipe takes from each page's data."""

    def run(batches):
        for b in batches:
            out = []
            for page, data in zip(b.column("page_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                rows, cut, error = recipe_rows([(d["name"], json.loads(d["value"])) for d in data or ()], recipe)
                out += [(page, i, list(r.items()), cut, None) for i, r in enumerate(rows)] or [(page, None, None, cut, error)]
            types = [pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["page_id", "row", "fields", "truncated", "error"])

    return pages.select("page_id", "data").mapInArrow(run, "page_id bigint, row int, fields map<string,string>, truncated boolean, error string")


def by_page(pages: DataFrame, kind: str, rows_of) -> DataFrame:
    """The rows (page_id first, as ``kind`` says) that ``rows_of(page_id, url, data)`` gives for each page (page_id, url, data); data as (name, value) pairs."""
    schema = T.StructType.fromDDL(kind)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = []
                for page, url, data in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("data").to_pylist(), strict=True):
                    rows += [dict(zip(schema.names, (page, *r), strict=True)) for r in rows_of(page, url or "", [(d["name"], json.loads(d["value"])) for d in data or ()])]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select("page_id", "url", "data").mapInArrow(run, schema)


def page_rows_by_shape(pages: DataFrame, recipe: dict) -> DataFrame:
    """As :func:`page_rows`, from whichever list of a page gives at least half of the recipe's fields, where its place is not known."""
    from .listing import rows_by_shape

    def rows_of(page, url, data):
        rows, cut, error = rows_by_shape(data, recipe)
        return [(i, r, cut, None) for i, r in enumerate(rows)] or [(None, None, cut, error)]

    return by_page(pages, "page_id bigint, row int, fields map<string,string>, truncated boolean, error string", rows_of)


def page_next_links(pages: DataFrame, batch: bool = False) -> DataFrame:
    """(page_id, place, next, keys): the next addresses that a page's data names beside its largest list, with the keys of its things."""
    from .listing import next_links

    def rows_of(page, url, data):
        found = next_links(data, url, batch)
        return [(i, u, found[1]) for i, u in enumerate(found[0])] if found else []

    return by_page(pages, "page_id bigint, place int, next string, keys array<string>", rows_of)


def page_shapes(pages: DataFrame, most: int = MOST_SHAPES) -> DataFrame:
    """(page_id, place, count, keys): the keys of each list in a page's data, of its first five things; the longest lists first, ``most`` of them."""

    def rows_of(page, url, data):
        found = [(len(o), sorted({k for x in o[:5] for k in x})) for _, v in data for _, o in lists_in(v, 1)]
        return [(i, n, keys) for i, (n, keys) in enumerate(sorted(found, key=lambda f: -f[0])[:most])]

    return by_page(pages, "page_id bigint, place int, count int, keys array<string>", rows_of)


def holds_like(shapes: DataFrame, wanted: DataFrame, by) -> DataFrame:
    """(by) of pages one of whose lists (by, keys) has at least half of the wanted keys (by, wanted)."""
    return shapes.join(wanted, names(by)).where(similar(F.col("keys"), F.col("wanted"))).select(*names(by)).distinct()


def page_data_things(pages: DataFrame) -> DataFrame:
    """(page_id, i, text): the things of a page that is data, as texts."""
    from .listing import data_things

    return by_page(pages, "page_id bigint, i int, text string", lambda page, url, data: list(enumerate(data_things(data, url))))


def similar(keys: Column, wanted: Column) -> Column:
    """At least half of the wanted keys are there."""
    return 2 * F.size(F.array_intersect(keys, wanted)) >= F.size(wanted)


def largest(lists: DataFrame, by, cap: int = MOST_LISTS) -> DataFrame:
    """The best lists (n, keys, i) of each group by n times min(keys, 15), earlier ones first among equals; adds score."""
    return first_of(lists.withColumn("score", F.col("n") * F.least(F.col("keys"), F.lit(15))), by, [F.col("score").desc(), F.col("i").asc()], cap)


# Listings


def overlaps(offers: DataFrame, shown: DataFrame, by, item: str, least: int = 3) -> DataFrame:
    """(by, n): how many distinct items of each offer are shown, where that is ``least`` or more."""
    return offers.join(shown.select(item).distinct(), item, "left_semi").groupBy(*names(by)).agg(F.countDistinct(item).alias("n")).where(F.col("n") >= least)


def narrowing_term(terms: DataFrame, shown: DataFrame, item: str, term: str) -> DataFrame:
    """(term, dropped): the term that all shown items have and that leaves out most of the others; the smaller among equals."""
    have = terms.select(item, term).distinct()
    inside = have.join(shown.select(item).distinct(), item, "left_semi").groupBy(term).agg(F.count("*").alias("k"))
    n_shown = shown.select(item).distinct().agg(F.count("*").alias("n"))
    all_ = inside.join(F.broadcast(n_shown), F.col("k") == F.col("n")).select(term)  # one row
    others = have.select(item).distinct().join(shown.select(item).distinct(), item, "left_anti").agg(F.count("*").alias("m"))
    with_it = have.join(shown.select(item).distinct(), item, "left_anti").groupBy(term).agg(F.count("*").alias("w"))
    d = all_.join(with_it, term, "left").crossJoin(F.broadcast(others))  # one row
    d = d.withColumn("dropped", F.col("m") - F.coalesce("w", F.lit(0)))
    return d.orderBy(F.col("dropped").desc(), term).limit(1).select(term, "dropped")


def unshown_terms(terms: DataFrame, shown: DataFrame, item: str, term: str, least: int = 3) -> DataFrame:
    """(term, n): terms of no shown item that ``least`` or more of the others have."""
    have = terms.select(item, term).distinct()
    ids = shown.select(item).distinct()
    bad = have.join(ids, item, "left_semi").select(term).distinct()
    return have.join(ids, item, "left_anti").join(bad, term, "left_anti").groupBy(term).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def named_term(terms: DataFrame, question_words: Column, by=()) -> DataFrame:
    """The term (by, name, n) of each group all of whose words the question has, two at least, with 3 things or more; most words first, then most things."""
    from .links import words

    w = F.array_distinct(words(F.col("name")))
    d = terms.withColumn("_w", F.size(w)).where((F.size(w) > 1) & (F.col("n") >= 3) & (F.size(F.array_except(w, question_words)) == 0))
    order = [F.col("_w").desc(), F.col("n").desc(), F.col("name")]
    return (first_of(d, by, order) if names(by) else d.orderBy(*order).limit(1)).drop("_w")


def day_before_oldest(dates: DataFrame, date: str = "date") -> DataFrame:
    return dates.agg(F.date_sub(F.min(F.to_date(F.left(F.col(date).cast("string"), F.lit(10)))), 1).alias("day"))


def minor_units(amount: Column, digits: int | Column = 2) -> Column:
    """Text of an amount given in its smallest unit: 1350 -> 13.50. ``digits`` may be a column."""
    n, text = F.lit(digits) if isinstance(digits, int) else digits, amount.cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), n + 1), F.lit("0"))
    return F.when(n == 0, text).otherwise(F.concat(F.substring(padded, F.lit(1), F.length(padded) - n), F.lit("."), F.right(padded, n)))


def commonest(df: DataFrame, by, kind: str) -> DataFrame:
    """(by, kind, n): the commonest value of each group, the smaller among equals."""
    keys = names(by)
    return first_of(df.groupBy(*keys, kind).agg(F.count("*").alias("n")), keys, [F.col("n").desc(), F.col(kind).asc()]) if keys else df.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), kind).limit(1)


def key_prefix_rank(a: Column, b: Column) -> Column:
    """Length of the common beginning of two paths."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("bigint"))
