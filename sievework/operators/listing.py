"""Listings behind a page: site files, declared searches, platform interfaces and their batches, redirects, reach."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.batch import by_batch
from ..sources.dom import parse
from .select import first_of, names
from .structured import minor_units

# Kinds of post that are no lists, how many kinds are tried, how many of a page's things an endpoint has to give, and
# a search's names in several languages.
NOT_LISTS = ("attachment", "page", "nav_menu_item", "wp_block", "wp_template", "wp_template_part", "wp_navigation", "wp_global_styles", "wp_font_family", "wp_font_face", "product", "tribe_events")
MOST_KINDS, LEAST_SHOWN, PER_PAGE, EVENTS_PER_PAGE = 8, 3, 100, 50
SEARCH_WORDS = ("search", "buscar", "buscador", "búsqueda", "busqueda", "cerca", "ricerca", "recherche", "rechercher", "suche", "suchen", "pesquisa", "pesquisar", "zoeken", "cercar", "bilatu")


def small_files(responses: DataFrame, most: int | None = 5_000_000) -> DataFrame:
    """Responses that can be a site's file: answered, small (of any size without ``most``), and no HTML page unless a sitemap was asked for."""
    page = F.lower(F.ltrim("body")).rlike("^<(!doctype html|html)")
    small = F.lit(True) if most is None else F.octet_length("body") <= most
    return responses.where((F.col("status") == 200) & small & (~page | F.col("url").rlike(r"(?i)sitemap")))


def site_listing(sources: list[DataFrame], by, cap: int = 300) -> DataFrame:
    """(by, url, place): the pages that a site's files list (sources of (by, i, url), the site's own list first), each key
    once, shallow and short addresses first."""
    from .links import union_distinct
    from .site import listing_order

    return listing_order(union_distinct(sources, by), by, cap)


def listed_in_markdown(files: DataFrame, by) -> DataFrame:
    """(by, i, url, text): the links of llms.txt files (by, url, body), in order; relative ones are resolved against the file's address."""
    from ..sources.documents import markdown_links

    keys = names(by)
    join = by_batch(lambda x: urls.join(*x.split("\n", 1)) if x and "\n" in x else None)
    d = files.select(*keys, F.col("url").alias("_file"), F.posexplode(markdown_links(F.col("body"))).alias("i", "x"))
    return d.select(*keys, "i", join(F.concat("_file", F.lit("\n"), "x.url")).alias("url"), "x.text").where("url IS NOT NULL")


def site_files(responses: DataFrame, by, rank=None, cap: int | None = 300, most: int | None = 5_000_000) -> DataFrame:
    """(by, url, text, hreflang, place): what the small files of sites list, of responses (by, url, status, body): llms.txt first, then the
    pages of sitemaps, shallow and short addresses first; an index is read through three of its children, which have to be among the
    responses, by ``rank`` (an expression over ``loc``), then the newest. A page key stands once. A site keeps ``cap`` pages, and files of
    more than ``most`` bytes are not read; None is no limit."""
    from .site import index_children, lastmod_seconds, sitemap_index, sitemap_urls

    keys = names(by)
    files = small_files(responses, most)
    llms = listed_in_markdown(files.where(urls.path(F.col("url")) == "/llms.txt"), keys)
    xml = files.where(F.col("body").rlike("<(urlset|sitemapindex)")).withColumn("sitemap", F.struct(*keys, "url")).withColumnRenamed("body", "xml")
    parts = sitemap_index(xml.where(F.col("xml").contains("<sitemapindex")))
    parts = index_children(parts, "sitemap", rank if rank is not None else F.lit(0), lastmod_seconds(F.col("lastmod"))).select(*[F.col(f"sitemap.{k}").alias(k) for k in keys], F.col("loc").alias("url"))
    named = parts.distinct().withColumn("_child", F.lit(True))
    lists = xml.where(F.col("xml").contains("<urlset")).join(named, [*keys, "url"], "left")
    # a list that an index names is read only if it is one of the chosen children
    every = sitemap_index(xml.where(F.col("xml").contains("<sitemapindex"))).select(*[F.col(f"sitemap.{k}").alias(k) for k in keys], F.col("loc").alias("url")).distinct().withColumn("_named", F.lit(True))
    lists = lists.join(every, [*keys, "url"], "left").where("_child OR _named IS NULL")
    pages = sitemap_urls(lists).select(*[F.col(f"sitemap.{k}").alias(k) for k in keys], F.col("loc").alias("url"), urls.path(F.col("loc")).alias("text"), F.nullif("hreflang", F.lit("")).alias("hreflang"), F.col("pos").alias("i"))
    all_ = llms.select(*keys, "url", "text", F.lit(None).cast("string").alias("hreflang"), "i", F.lit(0).alias("_source")).unionByName(pages.withColumn("_source", F.lit(1)))
    later = F.when(F.col("_source") == 0, 0).otherwise(1)
    order = [later, F.when(later == 1, urls.depth(F.col("url"))), F.when(later == 1, F.char_length("url")), F.col("i"), F.col("url")]
    one = first_of(all_.withColumn("_key", urls.key(F.col("url"))), [*keys, "_key"], order)
    return first_of(one, keys, order, cap, "place").select(*keys, "url", "text", "hreflang", "place")


def linked_site_files(links: DataFrame, responses: DataFrame, by, cap: int = 300) -> DataFrame:
    """(by, host, url, text, hreflang, place): what the files of a page's linked hosts list, of links (by, page_url, i, url) and responses (host, url,
    status, body): the hosts under the page's registrable domain that it names most, and of their lists what lies under that domain."""
    from .links import linked_hosts

    keys = names(by)
    hosts = linked_hosts(links, keys).select(*keys, "host")
    domain = links.groupBy(*keys).agg(urls.host(F.min("page_url")).alias("_own"))
    listed = site_files(responses.join(hosts.select("host").distinct(), "host", "left_semi"), "host", cap=cap)
    d = hosts.join(listed, "host").join(domain, keys)
    return d.where(urls.registrable(urls.host(F.col("url"))) == urls.registrable(F.col("_own"))).select(*keys, "host", "url", "text", "hreflang", "place")


def search_links(links: DataFrame, by, cap: int = 4) -> DataFrame:
    """Links of the page's own host to another path that a search word names, in its text or path."""
    word = r"(?iU)(^|[^\p{L}])(" + "|".join(SEARCH_WORDS) + r")($|[^\p{L}])"
    other = (urls.host(F.col("url")) == urls.host(F.col("page_url"))) & (urls.path(F.col("url")) != urls.path(F.col("page_url")))
    return first_of(links.where(other & (F.col("text").rlike(word) | urls.path(F.col("url")).rlike(word))), by, [F.col("i")], cap)


def declared_searches(pages: DataFrame) -> DataFrame:
    """(page_id, kind, template) of (page_id, url, html): a WordPress interface, an OpenSearch description, a SearchAction."""

    def run(batches):
        for b in batches:
            rows = []
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                root = parse(html or "")
                for n in root.find("link"):
                    rel = (n.get("rel") or "").strip()
                    to = urls.join(url or "", n.get("href"))
                    if rel == "https://api.w.org/" and to:
                        rows.append((page, "wordpress", to.rstrip("/") + "/wp/v2/search?search={searchTerms}&per_page=10"))
                    elif "search" in rel.split() and "opensearchdescription" in (n.get("type") or "") and to:
                        rows.append((page, "opensearch", to))
                for s in root.find("script"):
                    if s.get("type") == "application/ld+json" and (m := re.search(r'"urlTemplate"\s*:\s*"([^"]+)"|"target"\s*:\s*"([^"]+)"', s.text())):
                        rows.append((page, "action", (m[1] or m[2]).replace("\\/", "/")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "kind", "template"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, kind string, template string")


def filled(template: Column, question: Column) -> Column:
    """A search address: the question in place of the template's one name in braces."""
    return F.regexp_replace(template, F.lit(r"\{[A-Za-z_]+\??\}"), F.replace(F.url_encode(question), F.lit("$"), F.lit("\\$")))


def search_results(bodies: DataFrame, cap: int = 10) -> DataFrame:
    """(page_id, i, url, text) of a WordPress search's JSON (page_id, body)."""
    kind = "array<struct<url:string,title:string>>"
    d = bodies.select("page_id", F.posexplode(F.slice(F.from_json("body", kind), 1, cap)).alias("i", "x"))
    title = F.coalesce(F.get_json_object("x.title", "$.rendered"), F.col("x.title"), F.lit(""))
    return d.where("x.url IS NOT NULL").select("page_id", "i", "x.url", title.alias("text"))


def item_key(url: Column) -> Column:
    """A link as a thing's own page: site and path, or the query that names a post; null for others."""
    clean = F.regexp_replace(urls.path(url), "/+$", "")
    host = F.regexp_replace(urls.host(url), r"^www\.", "")
    post = F.array_sort(F.filter(F.split(urls.query(url), "&"), lambda p: p.rlike("^(p|page_id|post_type)=")))
    named = F.exists(post, lambda p: ~p.startswith("post_type="))
    return F.when((urls.query(url) == "") & clean.rlike("[^/]"), F.concat(host, clean)).when((clean == "") & named, F.concat(host, F.lit("?"), F.concat_ws("&", post)))


def post_kinds(types: DataFrame, taxonomies: DataFrame, by, cap: int = MOST_KINDS) -> DataFrame:
    """(by, slug, route, terms, place): lists that types (by, slug, rest_base, viewable, taxonomies) may give, a site's own
    kinds before its posts, with the parameters of their taxonomies (by, tax, rest_base)."""
    keys = names(by)
    plain = lambda c: F.col(c).rlike("^[A-Za-z0-9_-]+$")
    t = types.where(~F.col("slug").isin(*NOT_LISTS) & F.coalesce("viewable", F.lit(True)) & plain("rest_base"))
    each = t.select(*keys, "slug", F.explode("taxonomies").alias("tax"))
    terms = each.join(taxonomies.where(plain("rest_base")).withColumnRenamed("rest_base", "term"), [*keys, "tax"]).groupBy(*keys, "slug").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    d = t.join(terms, [*keys, "slug"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return first_of(d, keys, [(F.col("slug") == "post"), F.col("slug")], cap, "place").select(*keys, "slug", F.concat(F.lit("wp/v2/"), "rest_base").alias("route"), "terms", "place")


def endpoints(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """(page_id, place, api, route, per_page): the interfaces that may give a page's things (page_id, html), by marks in its HTML and its
    site's kinds (page_id, slug, route, place): events, products, then the site's kinds of post."""
    marks = kinds.groupBy("page_id").agg(F.max(F.col("slug") == "tribe_events").alias("_events"), F.max(F.col("slug") == "product").alias("_products"))
    p = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).join(marks, "page_id", "left")
    events = F.col("html").contains("tribe-events") | F.col("html").contains("the-events-calendar") | F.coalesce("_events", F.lit(False))
    products = F.col("html").contains("woocommerce") | F.coalesce("_products", F.lit(False))
    own = p.where(events).select("page_id", F.lit(-2).alias("place"), F.lit("events").alias("api"), F.lit("tribe/events/v1/events").alias("route"), F.lit(EVENTS_PER_PAGE).alias("per_page"))
    own = own.union(p.where(products).select("page_id", F.lit(-1).alias("place"), F.lit("products").alias("api"), F.lit("wc/store/v1/products").alias("route"), F.lit(PER_PAGE).alias("per_page")))
    posts = kinds.where(~F.col("slug").isin(*NOT_LISTS)).select("page_id", F.col("place").cast("int").alias("place"), F.lit("posts").alias("api"), "route", F.lit(PER_PAGE).alias("per_page"))
    return own.union(posts)


def chosen_endpoint(candidates: DataFrame, things: DataFrame, shown: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, api, route, place, n) of the candidates (page_id, place, api, route): the one whose things (page_id, route, url) are linked from the page
    (page_id, url) most, LEAST_SHOWN of them at least, the earlier one among equals; none where the page's own data lists as many (page_id, n)."""
    there = shown.select("page_id", item_key(F.col("url")).alias("_key")).where("_key IS NOT NULL").distinct()
    each = things.select("page_id", "route", item_key(F.col("url")).alias("_key")).join(there, ["page_id", "_key"], "left_semi")
    n = each.groupBy("page_id", "route").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SHOWN)
    best = first_of(candidates.join(n, ["page_id", "route"]), "page_id", [F.col("n").desc(), F.col("place")])
    if listed is not None:
        own = listed.groupBy("page_id").agg(F.max("n").alias("_own"))
        best = best.join(own, "page_id", "left").where("coalesce(_own, 0) < n").drop("_own")
    return best.select("page_id", "api", "route", "place", "n")


def shown_text(text: Column) -> Column:
    """HTML as its page shows it: entities read, tags dropped, blanks collapsed."""
    return by_batch(lambda t: None if t is None else " ".join(" ".join(parse(t).strings()).split()))(text)


def first_picture(x: str, path: str) -> Column:
    return F.nullif(F.get(F.col(x), F.lit(0))[path], F.lit(""))


def tidy_posts(bodies: DataFrame) -> DataFrame:
    """(url, i, name, link, published, summary, image, fields) of the posts in a body's JSON array; HTML in names is read as text, and of
    a post's own fields those that are one value are kept, as a map."""
    kind = "array<struct<title:struct<rendered:string>,link:string,date:string,excerpt:struct<rendered:string>,acf:map<string,string>,_embedded:struct<`wp:featuredmedia`:array<struct<source_url:string>>>>>"
    d = bodies.select("url", F.posexplode(F.from_json("body", kind)).alias("i", "x"))
    own = F.map_filter("x.acf", lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    out = d.select("url", "i", F.col("x.title.rendered").alias("name"), F.nullif("x.link", F.lit("")).alias("link"), F.nullif("x.date", F.lit("")).alias("published"),
                   F.col("x.excerpt.rendered").alias("summary"), first_picture("x._embedded.wp:featuredmedia", "source_url").alias("image"), F.when(F.size(own) > 0, own).alias("fields"))
    return with_shown(out)


def with_shown(d: DataFrame, *texts: str) -> DataFrame:
    """Things with a name, their name and texts as the page shows them."""
    out = d.withColumns({c: F.nullif(shown_text(F.col(c)), F.lit("")) for c in ("name", "summary", *texts)})
    return out.where("name IS NOT NULL")


def tidy_products(bodies: DataFrame) -> DataFrame:
    """(url, i, name, link, price, regular_price, currency, image, categories, summary, in_stock) of the products in a body's JSON array; prices are
    written out from the currency's smallest unit, the regular one where the product is on sale."""
    kind = "array<struct<name:string,permalink:string,on_sale:boolean,prices:struct<price:string,regular_price:string,currency_code:string,currency_minor_unit:int>,images:array<struct<src:string>>,short_description:string,is_in_stock:boolean,categories:array<struct<name:string>>>>"
    d = bodies.select("url", F.posexplode(F.from_json("body", kind)).alias("i", "x"))
    unit = F.coalesce("x.prices.currency_minor_unit", F.lit(0))

    def price(name: str) -> Column:
        digits = F.trim(F.col(f"x.prices.{name}"))
        return F.when(digits.rlike("^[0-9]+$"), minor_units(digits, unit))

    return with_shown(d.select(
        "url", "i", F.col("x.name").alias("name"), F.nullif("x.permalink", F.lit("")).alias("link"), price("price").alias("price"), F.when(F.col("x.on_sale"), price("regular_price")).alias("regular_price"),
        F.nullif("x.prices.currency_code", F.lit("")).alias("currency"), first_picture("x.images", "src").alias("image"), term_names("x.categories"), F.col("x.short_description").alias("summary"), F.col("x.is_in_stock").alias("in_stock")))


def term_names(terms: str) -> Column:
    return F.nullif(F.array_join(F.transform(terms, lambda c: c["name"]), ", "), F.lit("")).alias("categories")


def tidy_events(bodies: DataFrame) -> DataFrame:
    """(url, i, name, link, start_date, end_date, cost, image, venue, city, categories, summary, next) of the events in a body; ``next`` is the address
    of the next batch that the body names, on the body's own site."""
    kind = "struct<events:array<struct<title:string,url:string,start_date:string,end_date:string,cost:string,image:string,venue:string,categories:array<struct<name:string>>,excerpt:string>>,next_rest_url:string>"
    d = bodies.select("url", F.from_json("body", kind).alias("b"))
    next_ = F.when(F.col("b.next_rest_url").rlike("^https?://") & (urls.site(F.col("b.next_rest_url")) == urls.site(F.col("url"))) & (F.col("b.next_rest_url") != F.col("url")), F.col("b.next_rest_url"))
    d = d.select("url", next_.alias("next"), F.posexplode("b.events").alias("i", "x"))
    inner = lambda c, k: F.nullif(F.get_json_object(c, f"$.{k}"), F.lit(""))  # noqa: E731  an empty array stands for no venue
    return with_shown(d.select(
        "url", "i", F.col("x.title").alias("name"), F.nullif("x.url", F.lit("")).alias("link"), F.nullif("x.start_date", F.lit("")).alias("start_date"), F.nullif("x.end_date", F.lit("")).alias("end_date"), F.col("x.cost").alias("cost"),
        inner("x.image", "url").alias("image"), inner("x.venue", "venue").alias("venue"), inner("x.venue", "city").alias("city"), term_names("x.categories"), F.col("x.excerpt").alias("summary"), "next"), "cost", "venue", "city")


def next_batch(url: Column, items: Column) -> Column:
    """The next batch's address where this one is full: its page number one on."""
    per = F.regexp_extract(url, r"[?&]per_page=([0-9]+)", 1).try_cast("int")
    page = F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]page=([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])page=[0-9]+(&|$)", "$1"), "[?&]$", "")
    return F.when(items >= per, F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("page="), (page + 1).cast("string")))


def record_blocks(things: DataFrame, by, fields: list[str]) -> DataFrame:
    """(by, i, text, href, record): a block for each thing: its name, then ``field: value`` lines of what it has."""
    lines = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields]
    return things.select(*names(by), "i", F.concat_ws("\n", "name", *lines).alias("text"), F.col("link").alias("href"), (F.col("i") + 1).alias("record"))


def redirected(hops: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """(url, final, hops): where addresses end after redirects (src, dst); null after more than ``most``. Joins, one a hop."""
    at = start.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"))
    done = None
    for turn in range(most + 1):
        step = at.join(hops.select(F.col("src").alias("final"), "dst"), "final", "left")
        stopped = step.where("dst IS NULL").select("url", "final", "hops")
        done = stopped if done is None else done.unionByName(stopped)
        at = step.where("dst IS NOT NULL").select("url", F.col("dst").alias("final"), (F.col("hops") + 1).alias("hops"))
        at = at.checkpoint()
        if at.isEmpty():
            return done
    return done.unionByName(at.select("url", F.lit(None).cast("string").alias("final"), "hops"))


#: Networks whose addresses are not public, as (network, prefix length).
NOT_PUBLIC = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))


def ip_number(ip: Column) -> Column:
    part = lambda k: F.element_at(F.split(ip, r"\."), k).cast("bigint")
    good = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}$") & ~ip.endswith(".")
    return F.when(good, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def public_address(ip: Column) -> Column:
    """Whether an IPv4 address is public; null for what is none."""
    n = ip_number(ip)
    inside = None
    for net, prefix in NOT_PUBLIC:
        a, b, c, d = map(int, net.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        hit = n.between(low, low + (1 << (32 - prefix)) - 1)
        inside = hit if inside is None else inside | hit
    return ~inside


def public_address_v6(ip: str | None) -> bool | None:
    """The same for IPv6, embedded IPv4 addresses read as such."""
    import ipaddress

    try:
        a = ipaddress.IPv6Address(ip or "")
    except ValueError:
        return None
    v4 = a.ipv4_mapped or (ipaddress.IPv4Address(int(a) & 0xFFFFFFFF) if a in ipaddress.IPv6Network("64:ff9b::/96") else None)
    if v4 is not None:
        return not any(v4 in ipaddress.IPv4Network(f"{n}/{p}") for n, p in NOT_PUBLIC)
    closed = ("fe80::/10", "fec0::/10", "fc00::/7", "ff00::/8", "2001::/32", "2001:2::/48", "2001:10::/28", "2001:db8::/32", "2002::/16", "3fff::/20")
    return a in ipaddress.IPv6Network("2000::/3") and not any(a in ipaddress.IPv6Network(n) for n in closed)


def redacted(text: Column, secret: Column) -> Column:
    """A text without a secret that it may quote."""
    return F.when(F.coalesce(secret, F.lit("")) != "", F.replace(text, secret, F.lit("***"))).otherwise(text)


def settings(files: list[str], environment: dict[str, str]) -> dict[str, str]:
    """Values of ``key=value`` files, later ones over earlier ones, the environment over all."""
    out: dict[str, str] = {}
    for text in files:
        for line in text.splitlines():
            key, cut, value = line.strip().removeprefix("export ").partition("=")
            if cut and not key.startswith("#"):
                value = value.strip()
                out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].strip()
    return out | {k: v for k, v in environment.items() if v}


def next_links(data: list[tuple[str, object]], page: str, batch: bool = False) -> tuple[list[str], list[str]] | None:
    """(next addresses, the list's keys) of the page's data that names a next batch, the largest list's; addresses near the list first."""
    from ..sources.page import same_site
    from .structured import lists_in

    wanted = {"next", "nexturl", "nextpage", "nextpageurl", "nextlink", "nexthref"}
    best: tuple[int, list[str], list[str]] | None = None
    for _, root in data:
        found = [(len(o) * min(15, len(k := sorted({x for e in o[:5] for x in e}))), path, k) for path, o in lists_in(root, 1 if batch else 3)]
        if not found:
            continue
        score, list_path, keys = max(found, key=lambda f: f[0])
        near: list[tuple[int, int, str]] = []

        def visit(v, path: tuple[str, ...]) -> None:
            if isinstance(v, dict):
                for k in sorted(v):
                    here = (*path, k)
                    if re.sub(r"[^a-z0-9]", "", k.lower()) in wanted:
                        to = v[k] if isinstance(v[k], str) else next((v[k][n] for n in ("href", "url") if isinstance(v[k].get(n), str)), None) if isinstance(v[k], dict) else None
                        url = urls.join(page, to) if to and re.match(r"\s*(/|\?|https?://)", to) else None
                        if url and urls.bare(url) != urls.bare(page) and same_site(url, page):
                            common = next((i for i, (a, b) in enumerate(zip(here, list_path)) if a != b), min(len(here), len(list_path)))
                            near.append((-common, len(here), urls.bare(url)))
                    visit(v[k], here)
            elif isinstance(v, list):
                for i, x in enumerate(v[:50]):
                    visit(x, (*path, str(i)))

        visit(root, ())
        out = list(dict.fromkeys(u for *_, u in sorted(near, key=lambda n: n[:2])))[:3]
        if out and (best is None or score > best[0]):
            best = (score, out, keys)
    return best and (best[1], best[2])


def rows_by_shape(data: list[tuple[str, object]], recipe: dict) -> tuple[list[dict], bool, str | None]:
    """A recipe's rows from whichever list gives at least half of its fields: the most fields, then the longest."""
    from .structured import MOST_ROWS, lists_in, step_into, text_of

    best: tuple[int, int, list] | None = None
    for _, root in data:
        for _, o in lists_in(root, 1):
            given = sum(text_of(step_into(o[0], p)) is not None for p in recipe["fields"].values())
            if given and 2 * given >= len(recipe["fields"]) and (best is None or (given, len(o)) > best[:2]):
                best = (given, len(o), o)
    if best is None:
        return [], False, f"no list like {recipe['source']} {' '.join(recipe['path'])} in the page"
    rows = [{n: t for n, p in sorted(recipe["fields"].items()) if (t := text_of(step_into(e, p))) is not None} for e in best[2][:MOST_ROWS]]
    return rows, len(best[2]) > MOST_ROWS, None


def data_things(data: list[tuple[str, object]], page: str, most: int = 300) -> list[str]:
    """Texts of the things of a JSON page: of the list with the most keys, then the longest."""
    from ..sources.page import leaves, said
    from .structured import lists_in

    found = [((len({k for e in o[:5] for k in e}), len(o)), o) for _, root in data for _, o in lists_in(root, 1)]
    things = max(found, key=lambda f: f[0])[1] if found else []
    out = []
    for o in things:
        values = ((p, urls.join(page, v) or v) if re.fullmatch(r"/(?!/)(?:[^\s]*/[^\s]*[^/\s]|[^\s/]*\.[^\s/]*)/?", v) and not v.endswith("…") else (p, v) for k in sorted(o, key=lambda k: (k != "name", k)) for p, v in leaves(k, o[k]))
        if text := said("Thing (data): ", values):
            out.append(text)
    return out[:most]


def parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None
