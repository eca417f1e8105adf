"""A site's files: robots rules and the longest match, sitemaps and their ranking, languages and markets of addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.batch import by_batch
from ..functions.languages import canonical, language, likely_language, likely_region, path_tag, region
from .select import first_of, names


# Robots


def robots_lines(files: DataFrame) -> DataFrame:
    """(host, line_no, field, value) of robots files (host, body), comments cut."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    d = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line")).withColumn("line", line).where(F.col("line").contains(":"))
    return d.select("host", "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, rule_no, allow, pattern): the rules of the groups for every crawler, in file order.

    A group begins at the first user-agent line after a rule: a running count of such lines numbers the groups.
    """
    w = Window.partitionBy("host").orderBy("line_no")
    d = robots_lines(files).where(F.col("field").isin("user-agent", "allow", "disallow"))
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("allow")) != "user-agent")
    d = d.withColumn("grp", F.sum(begins.cast("int")).over(w))
    d = d.withColumn("ours", F.max(((F.col("field") == "user-agent") & (F.col("value") == "*")).cast("int")).over(Window.partitionBy("host", "grp")))
    rules = d.where((F.col("field") != "user-agent") & (F.col("ours") == 1) & (F.col("grp") > 0) & (F.col("value") != ""))
    return rules.select("host", F.col("line_no").alias("rule_no"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_sitemaps(files: DataFrame, cap: int = 3) -> DataFrame:
    """(host, line_no, url): sitemaps that robots files name, in any group, each once, without the usual one."""
    d = robots_lines(files).where((F.col("field") == "sitemap") & (F.col("value") != "") & ~urls.path(F.col("value")).eqNullSafe(F.lit("/sitemap.xml")))
    one = first_of(d.select("host", "line_no", F.col("value").alias("url")), ["host", "url"], [F.col("line_no")])
    return first_of(one, "host", [F.col("line_no")], cap)


def normal_octets(text: str | None) -> str | None:
    """Unreserved octets plain, all others percent-encoded in upper case."""
    if text is None:
        return None
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or b in b"-._~" else f"%{b:02X}" for b in raw)


def pattern_regex(pattern: str | None) -> str | None:
    if pattern is None:
        return None
    body = pattern.removesuffix("$")
    return "^" + ".*".join(re.sub(r"([^A-Za-z0-9%_])", r"\\\1", normal_octets(p)) for p in body.split("*")) + ("$" if pattern.endswith("$") else "")


def allowed(pages: DataFrame, rules: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Adds ``allowed``: of the rules of the page's host that match, the longest decides, an allow among equals; none allows.

    Patterns become regular expressions once a rule, paths their normal form once a page; the join is by host.
    """
    octets, regex = by_batch(normal_octets), by_batch(pattern_regex)
    path = F.concat(urls.path(F.col("url")), F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise(""))
    p = pages.select(page_key, urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("_path"), octets(path).alias("_octets"))
    r = rules.select("host", "allow", F.octet_length("pattern").alias("_len"), regex("pattern").alias("_regex"))
    hit = p.join(r, "host").where(F.expr("_octets rlike _regex")).groupBy(page_key).agg(F.max_by("allow", F.struct("_len", "allow")).alias("_a"))
    return pages.join(hit, page_key, "left").join(p.select(page_key, "_path"), page_key).withColumn("allowed", (F.col("_path") == "/robots.txt") | F.coalesce("_a", F.lit(True))).drop("_a", "_path")


# Sitemaps

ENTRY = r"(?s)<url>(.*?)(?:</url>|$)"


def _tag(xml: Column, tag: str) -> Column:
    return F.replace(F.trim(F.regexp_extract(xml, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit("&amp;"), F.lit("&"))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(sitemap, pos, loc, hreflang) of (sitemap, xml); the language is that of the entry's own alternate."""
    e = files.select("sitemap", F.posexplode(F.regexp_extract_all("xml", F.lit(ENTRY), 1)).alias("pos", "entry")).withColumn("loc", _tag(F.col("entry"), "loc")).where("loc <> ''")
    links = F.regexp_extract_all("entry", F.lit(r"<xhtml:link\b([^>]*)>"), 1)
    attr = lambda x, n: F.replace(F.regexp_extract(x, n + r"\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("&amp;"), F.lit("&"))
    own = F.filter(links, lambda x: (attr(x, "rel") == "alternate") & (attr(x, r"\bhref") == F.col("loc")) & (F.lower(attr(x, "hreflang")) != "x-default") & (attr(x, "hreflang") != ""))
    return e.select("sitemap", "pos", "loc", attr(F.get(own, F.lit(0)), "hreflang").alias("hreflang"))


def sitemap_index(files: DataFrame) -> DataFrame:
    """(sitemap, pos, loc, lastmod) of sitemap indexes (sitemap, xml)."""
    e = files.select("sitemap", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<sitemap>(.*?)(?:</sitemap>|$)"), 1)).alias("pos", "entry"))
    return e.select("sitemap", "pos", _tag(F.col("entry"), "loc").alias("loc"), F.nullif(_tag(F.col("entry"), "lastmod"), F.lit("")).alias("lastmod")).where("loc <> ''")


W3C = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def lastmod_seconds(text: Column) -> Column:
    """Seconds since 1970 of a W3C date and time; null for anything else. Days 29 to 31 run on into the next month."""
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, W3C, k)
    num = lambda k: F.when(part(k) == "", 0).otherwise(part(k).cast("int"))
    days = F.datediff(F.make_date(num(1), num(2), F.lit(1)), F.lit("1970-01-01").cast("date")) + num(3) - 1
    zone = part(7)
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(F.concat(F.left(zone, F.lit(1)), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int")))
    good = t.rlike(W3C) & num(2).between(1, 12) & num(3).between(1, 31) & (num(4) <= 23) & (num(5) <= 59) & (num(6) <= 60)
    return F.when(good, days.cast("bigint") * 86400 + num(4) * 3600 + num(5) * 60 + num(6) - minutes * 60)


def index_children(entries: DataFrame, by, rank: Column, seconds: Column, cap: int = 3) -> DataFrame:
    """The sitemaps of an index to read: by rank, the newest first, those without a date last, then in file order."""
    d = entries.withColumns({"_rank": rank, "_t": seconds})
    return first_of(d, by, [F.col("_rank"), F.col("_t").desc_nulls_last(), F.col("pos")], cap, "place").drop("_rank", "_t")


def listing_order(links: DataFrame, by, cap: int) -> DataFrame:
    return first_of(links, by, [urls.depth(F.col("url")), F.char_length("url"), F.col("i")], cap, "place")


# Languages


def declares_other_country(url: Column, country: str, own_language: str | None = None) -> Column:
    """Whether an address names another country, or a language at home in another that is not the reader's."""
    tag = path_tag(url)
    by_language = (language(tag) != F.lit(own_language or "")) & (likely_region(language(tag)) != country.lower())
    return F.coalesce(F.when(region(tag).isNotNull(), region(tag) != country.lower()).otherwise(by_language), F.lit(False))


def other_language_links(links: DataFrame, by, own: str, asked: list[str] = ()) -> DataFrame:
    """(by, key) of links (url, hreflang) whose declared language is neither the reader's own nor asked for."""
    d = links.withColumn("_lang", language(canonical(F.col("hreflang")))).where(F.col("_lang").isNotNull() & ~F.col("_lang").isin(own.partition("-")[0], *asked))
    return d.select(*names(by), urls.key(F.col("url")).alias("key")).distinct()


def accepted(headers: DataFrame, col: str = "header", by="id") -> DataFrame:
    """(by, place, language): the languages that Accept-Language headers ask for, by weight and then as written, each once.

    A tag's weight is its first parameter q that is a number from 0 to 1, 1 without one; tags of weight 0 and tags that the
    registry does not list are left out.
    """
    keys = names(by)
    d = headers.select(*keys, F.posexplode(F.split(col, ",")).alias("pos", "part"))
    more = F.filter(F.split("part", ";"), lambda x, i: (i > 0) & (F.lower(F.trim(F.substring_index(x, "=", 1))) == "q") & x.contains("="))
    weights = F.filter(F.transform(more, lambda x: F.trim(F.regexp_replace(x, "^[^=]*=", "")).try_cast("double")), lambda q: q.between(0, 1))
    d = d.select(*keys, "pos", canonical(F.substring_index("part", ";", 1)).alias("tag"), F.coalesce(F.get(weights, F.lit(0)), F.lit(1.0)).alias("q"))
    d = d.where("tag IS NOT NULL AND q > 0").withColumn("language", language(F.col("tag")))
    one = first_of(d, [*keys, "language"], [F.col("q").desc(), F.col("pos")])
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("q").desc(), "pos"))).select(*keys, "place", "language")


def market_alternate(alternates: DataFrame, by, country: str, languages: list[str] = ()) -> DataFrame:
    """The version of a page (by, i, hreflang, url) for a country: in the first of the run's languages that it has one in, else in
    the country's likely language, else the country's first; none where no alternate is in the country. Adds ``tag``."""
    d = alternates.withColumn("tag", canonical(F.col("hreflang"))).where(region(F.col("tag")) == country.lower())
    order = F.lit(len(languages) + 1)
    for k, wanted in reversed([*enumerate(languages), (len(languages), None)]):
        hit = language(F.col("tag")) == (F.lit(wanted) if wanted else likely_language(F.lit(country)))
        order = F.when(hit, k).otherwise(order)
    return first_of(d.withColumn("_order", order), by, [F.col("_order"), F.col("i")]).drop("_order")
