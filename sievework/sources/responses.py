"""Bodies as pages: one entry for HTML, feeds, markdown and JSON, packed or not, with a typed reason where there is none to read."""

from __future__ import annotations

import json
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from .documents import MOST_BYTES, decoded, feed_html, inflated, json_document, markdown_page, served_as_markdown
from .page import PAGE, by_rows, read_page

#: Why a response is no page.
STATUS, TOO_LARGE, BROKEN = "status", "too large", "broken gzip"


def refusal(status: int | None, body: bytes | None, most: int | None = MOST_BYTES) -> str | None:
    if status is not None and not 200 <= status < 300:
        return f"{STATUS} {status}"
    if body is not None and most is not None and len(body) > most:
        return TOO_LARGE
    if body is not None and body[:2] == b"\x1f\x8b":
        try:
            return TOO_LARGE if inflated(body, most) is None else None
        except ValueError:
            return BROKEN
    return None


def read_body(url: str, content_type: str | None, body: bytes, parts: list[str] | None = None, most: int | None = MOST_BYTES, **how) -> dict:
    """``kind`` (html, feed, markdown or json) and what ``parts`` names of PAGE of a body that :func:`refusal` lets through.

    A feed is the page of its entries; markdown is told by its type, or by plain text that is no HTML; JSON, bare or shown
    in a page's only ``pre``, is a page of data named by its path. ``how`` goes to :class:`~sievework.sources.page.Page`.
    """
    text = decoded(inflated(body, most) or b"", content_type)
    empty = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in PAGE.fields if parts is None or f.name in parts}
    if (page := feed_html(text)) is not None:
        return {"kind": "feed", **read_page(page, url, parts, **how)}
    value = json_document(text)
    if value is not None:
        path = urlsplit(url).path or "/"
        return {"kind": "json", **empty, **{k: v for k, v in {"data": [{"name": f"json:fetch:{path}", "value": json.dumps(value, ensure_ascii=False)}]}.items() if k in empty}}
    if served_as_markdown(content_type, text):
        return {"kind": "markdown", **empty, **{k: v for k, v in markdown_page(text, urls.normal(url) or url).items() if k in empty}}
    return {"kind": "html", **read_page(text, url, parts, **how)}


def extract_responses(responses: DataFrame, parts: list[str] | None = None, most: int | Column | None = MOST_BYTES, **how) -> DataFrame:
    """(page_id, url, kind, refused, the fields of PAGE that ``parts`` names) of (page_id, url, status, content_type, body).

    ``body`` is binary, or text. A response that is no page has its reason in ``refused`` and nothing else; bodies above ``most``
    bytes are refused before they reach a worker, packed ones also where they unpack to more. A null body is an empty one.
    ``most`` is a number, or a column of the responses that gives each its own; null is no limit. ``how`` goes to
    :class:`~sievework.sources.page.Page`.
    """
    fields = [f for f in PAGE.fields if parts is None or f.name in parts]
    wanted = [f.name for f in fields]
    raw = F.col("body").cast("binary")
    size, limit = F.octet_length(raw), (most if isinstance(most, Column) else F.lit(most)).cast("bigint")
    d = responses.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("status").cast("int").alias("status"), "content_type", F.when(limit.isNull() | (size <= limit), raw).alias("body"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), limit.alias("most"))

    def read(url, status, content_type, body, size, most):
        reason = refusal(status, body, most) or (TOO_LARGE if most is not None and size > most else None)
        if reason:
            return {"refused": reason}
        return read_body(url or "", content_type, body or b"", wanted, most, **how)

    return by_rows(d, [T.StructField("kind", T.StringType()), T.StructField("refused", T.StringType()), *fields], read)
