"""Further queries: answers, renderings, listings, languages and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages, urls
from ..operators import answers, images, listing, render, site, structured, text
from ..operators.links import most_relevant
from ..sources import documents as bodies
from ..sources.page import child, extract_pages
from ..sources.tables import table
from .queries import ensure_checkpoints, query


# Answers


@query("""
WITH l AS (SELECT conv_id, turn AS line, turn // 4 AS win, length(text) * 7 % 100 / 100.0::DOUBLE AS p FROM conversations), w AS (SELECT conv_id, win, count(*) * 13 % 10 / 10.0::DOUBLE AS e FROM l GROUP BY ALL),
s AS (SELECT conv_id, win, e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY e DESC, win DESC) AS r FROM w) WHERE r = 1)
SELECT conv_id, line, p, e AS exists FROM (SELECT conv_id, line, p, e, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC, line) AS r FROM l JOIN s USING (conv_id, win)) WHERE r = 1""")
def best_line(spark, sf):
    l = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("line"), F.expr("turn div 4").alias("window"), "text", (F.char_length("text") * 7 % 100 / 100).alias("p"))
    w = l.groupBy("conv_id", "window").agg((F.count("*") * 13 % 10 / 10).alias("exists"))
    return answers.best_line(l, w, "conv_id").select("conv_id", "line", "p", "exists")


OPTIONS_SQL = "WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_id, event_id * 7 % 100 / 100.0::DOUBLE AS p FROM events)"


def options(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return e.select("user_id", "k", "event_id", (F.col("event_id") * 7 % 100 / 100).alias("p"))


@query(OPTIONS_SQL + """,
b AS (SELECT user_id, k, p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, k) AS r FROM o WHERE k BETWEEN 1 AND 3) WHERE r = 1),
w AS (SELECT o.user_id, CASE WHEN b.p >= 0.6 AND b.p >= o.p THEN b.k ELSE 0 END AS k FROM o LEFT JOIN b USING (user_id) WHERE o.k = 0)
SELECT user_id, event_id FROM o JOIN w USING (user_id, k)""")
def refined_pick(spark, sf):
    return answers.refined(options(spark, sf).where("k <= 3"), "user_id", 0.6).select("user_id", "event_id")


@query(OPTIONS_SQL + """,
c AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 5 < 3 THEN user_id % 4 ELSE 0 END AS k FROM events)
SELECT user_id, event_id FROM o JOIN c USING (user_id, k)""")
def tighter_pick(spark, sf):
    o = options(spark, sf)
    c = o.select("user_id").distinct().select("user_id", F.concat(F.lit("o"), F.col("user_id") % 4).alias("choice"), F.when(F.col("user_id") % 3 == 0, 0.2).when(F.col("user_id") % 5 < 3, 0.9).otherwise(0.49).alias("confidence"))
    return answers.tightened(o, c, "user_id").select("user_id", "event_id")


@query("""
WITH t AS (SELECT o_custkey, o_orderkey AS i FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT o_custkey, o_orderkey AS i, o_totalprice AS p FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, i, 'text' AS source FROM t UNION ALL
SELECT o_custkey, i, 'data' FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, i DESC) AS r FROM d WHERE o_custkey NOT IN (SELECT o_custkey FROM t)) WHERE r = 1""")
def structured_fallback(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("p"), "o_orderstatus")
    return answers.with_fallback(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), "o_custkey").select("o_custkey", "i", "source")


@query("SELECT p_partkey, coalesce(max(l_discount), 0.0) AS p FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY p_partkey")
def option_scores(spark, sf):
    a = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_discount").alias("p"))
    return answers.option_scores(table(spark, sf, "part").select("p_partkey"), a, ["p_partkey"])


@query("""SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations) WHERE used < 1000""")
def token_budget(spark, sf):
    c = table(spark, sf, "conversations").withColumn("tokens", F.char_length("text"))
    return answers.within_tokens(c, "conv_id", "turn", "tokens", 1000).select("conv_id", "turn", "used")


@query("""WITH g AS (SELECT user_id, event_type AS kind, count(*) / 1000.0::DOUBLE AS p FROM events GROUP BY ALL) SELECT user_id, kind, p AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, kind) AS r FROM g) WHERE r = 1""")
def page_kind(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg((F.count("*") / 1000).alias("p"))
    return answers.page_kind(e, "user_id")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'who is it (about the owner of ' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || ')' ELSE 'who is it' END AS question FROM pages")
def owner_notes(spark, sf):
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", "^[a-zA-Z]+://[^/]*", 0)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", answers.owner_note(F.lit("who is it"), u).alias("question"))


# Renderings


@query()
def block_documents(spark, sf):
    p = extract_pages(table(spark, sf, "pages"), ["title", "blocks"])
    b = child(p, "blocks").withColumn("p", F.lit(None).cast("double")).join(p.select("page_id", "title"), "page_id").withColumnRenamed("page_url", "url")
    return render.blocks_document(b, "page_id")


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ' ' ORDER BY n) AS pages FROM f GROUP BY user_id""")
def pages_log(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("n"), F.col("event_type").alias("url"), F.lit("direct").alias("route"), F.lit(0).alias("blocks"))
    log = render.pages_log(e, "user_id")
    return log.select("user_id", F.array_join(F.transform(F.from_json("pages", "array<struct<url:string>>"), lambda x: x["url"]), " ").alias("pages"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS status FROM events")
def run_status(spark, sf):
    error = F.when(F.col("event_id") % 5 == 0, "refused")
    return table(spark, sf, "events").select("event_id", render.run_status(F.col("event_id") % 3 == 0, error).alias("status"))


# Listings


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS path, contains(url, '?') AS q FROM pages)
SELECT page_id, CASE WHEN NOT q THEN regexp_replace(host, '^www\\.', '') || path END AS key FROM p""")
def item_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", listing.item_key(F.col("url")).alias("key"))


SLUGS = (*listing.NOT_LISTS, "post", "recipe", "book", "talk")


@query("""
WITH k AS (SELECT p_brand AS site, ['attachment', 'page', 'nav_menu_item', 'wp_block', 'wp_template', 'wp_template_part', 'wp_navigation', 'wp_global_styles', 'wp_font_family', 'wp_font_face', 'product', 'tribe_events',
  'post', 'recipe', 'book', 'talk'][1 + p_partkey % 16] AS slug, min(p_partkey) AS m FROM part GROUP BY ALL),
t AS (SELECT site, slug, CASE WHEN m % 5 = 0 THEN 'a/b' ELSE slug || 's' END AS base, CASE WHEN m % 3 > 0 THEN 'by-' || slug ELSE '' END AS terms FROM k WHERE m % 4 > 0 AND slug IN ('post', 'recipe', 'book', 'talk'))
SELECT site, slug, 'wp/v2/' || base AS route, terms, row_number() OVER (PARTITION BY site ORDER BY slug = 'post', slug)::INT AS place FROM t WHERE base <> 'a/b'""")
def post_kinds(spark, sf):
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("p_partkey") % 16 + 1).cast("int"))
    k = table(spark, sf, "part").groupBy(F.col("p_brand").alias("site"), slug.alias("slug")).agg(F.min("p_partkey").alias("m"))
    types = k.select("site", "slug", F.when(F.col("m") % 5 == 0, "a/b").otherwise(F.concat("slug", F.lit("s"))).alias("rest_base"), F.when(F.col("m") % 4 == 0, False).when(F.col("m") % 4 > 1, True).alias("viewable"), F.array(F.concat(F.lit("t-"), "slug"), F.lit("no")).alias("taxonomies"))
    taxonomies = k.select("site", F.concat(F.lit("t-"), "slug").alias("tax"), F.when(F.col("m") % 3 > 0, F.concat(F.lit("by-"), "slug")).otherwise("x/y").alias("rest_base"))
    return listing.post_kinds(types, taxonomies, "site").withColumn("terms", F.array_join("terms", " "))


def json_bodies(df, by, order, thing):
    """(by, body): a JSON array of each group's things, in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, thing.alias("thing"))))
    return df.groupBy(by).agg(rows.alias("r")).select(F.col(by).cast("string").alias("url"), F.to_json(F.transform("r", lambda x: x["thing"])).alias("body"))


@query("""
WITH c AS (SELECT c_nationkey::VARCHAR AS url, c_custkey, c_name, c_acctbal, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS i FROM customer)
SELECT url, i, c_name || ' & Co' AS name, 'http://h/' || c_custkey AS link, CASE WHEN c_custkey % 2 = 0 THEN '2027-01-02' END AS published, CASE WHEN c_custkey % 3 = 0 THEN 'http://h/' || c_custkey || '.jpg' END AS image, CASE WHEN c_custkey % 4 = 0 THEN 'k=1' END AS fields FROM c WHERE c_acctbal >= 0""")
def platform_posts(spark, sf):
    k = F.col("c_custkey")
    rendered = F.when(F.col("c_acctbal") < 0, " <i></i> ").otherwise(F.concat(F.lit("<b>"), "c_name", F.lit("</b>\n&amp; Co")))
    media = F.when(k % 3 == 0, F.struct(F.array(F.struct(F.concat(F.lit("http://h/"), k.cast("string"), F.lit(".jpg")).alias("source_url"))).alias("wp:featuredmedia")))
    acf = F.when(k % 4 == 0, F.struct(F.lit(1).alias("k"), F.array(F.lit("x")).alias("gallery")))
    thing = F.struct(F.struct(rendered.alias("rendered")).alias("title"), F.concat(F.lit("http://h/"), k.cast("string")).alias("link"), F.when(k % 2 == 0, "2027-01-02").alias("date"), acf.alias("acf"), media.alias("_embedded"))
    posts = listing.tidy_posts(json_bodies(table(spark, sf, "customer"), "c_nationkey", "c_custkey", thing))
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return posts.select("url", "i", "name", "link", "published", "image", fields.alias("fields"))


@query("""
WITH p AS (SELECT p_brand AS url, p_partkey, p_name, p_size, p_type, (p_partkey % 4)::INT AS unit, (p_size * 37)::VARCHAR AS digits, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS i FROM part),
d AS (SELECT *, lpad(digits, greatest(length(digits), unit + 1)::INT, '0') AS padded FROM p)
SELECT url, i, p_name AS name, 'http://h/' || p_partkey AS link, CASE WHEN p_size % 7 = 0 THEN NULL WHEN unit = 0 THEN digits ELSE left(padded, length(padded) - unit) || '.' || right(padded, unit) END AS price,
  CASE WHEN p_size % 2 = 0 THEN (p_size + 1)::VARCHAR || CASE WHEN unit = 0 THEN '' ELSE '.' || repeat('0', unit) END END AS regular_price, 'EUR' AS currency, p_size > 10 AS in_stock, p_type || ', all' AS categories FROM d""")
def platform_products(spark, sf):
    k, size, unit = F.col("p_partkey"), F.col("p_size"), (F.col("p_partkey") % 4).cast("int")
    price = F.when(size % 7 == 0, "free").otherwise((size * 37).cast("string"))
    regular = F.concat((size + 1).cast("string"), F.repeat(F.lit("0"), unit))
    prices = F.struct(price.alias("price"), regular.alias("regular_price"), F.lit("EUR").alias("currency_code"), F.when(unit > 0, unit).alias("currency_minor_unit"))
    thing = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("http://h/"), k.cast("string")).alias("permalink"), (size % 2 == 0).alias("on_sale"), prices.alias("prices"), (size > 10).alias("is_in_stock"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("all").alias("name"))).alias("categories"))
    return listing.tidy_products(json_bodies(table(spark, sf, "part"), "p_brand", "p_partkey", thing)).select("url", "i", "name", "link", "price", "regular_price", "currency", "in_stock", "categories")


@query("""
WITH s AS (SELECT s_nationkey AS n, s_suppkey, s_name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS i FROM supplier)
SELECT 'http://h/' || n AS url, i, s_name AS name, 'http://h/e/' || s_suppkey AS link, '2027-05-01' AS start_date, CASE WHEN s_suppkey % 2 = 0 THEN 'City ' || n END AS city, CASE WHEN n % 3 = 0 THEN 'http://h/' || n || '/2' END AS next FROM s""")
def platform_events(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    venue = F.when(k % 2 == 0, F.to_json(F.struct(F.lit("Hall").alias("venue"), F.concat(F.lit("City "), n).alias("city")))).otherwise("[]")
    thing = F.struct(F.col("s_name").alias("title"), F.concat(F.lit("http://h/e/"), k.cast("string")).alias("url"), F.lit("2027-05-01").alias("start_date"), F.lit("").alias("end_date"), F.lit("@").alias("venue"))
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.replace(F.to_json(thing), F.lit('"@"'), venue).alias("t")))).alias("r"))
    other = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("http://h/"), n, F.lit("/2"))).when(F.col("s_nationkey") % 3 == 1, "http://elsewhere/2").otherwise(F.concat(F.lit("http://h/"), n))
    body = F.concat(F.lit('{"events":['), F.array_join(F.transform("r", lambda x: x["t"]), ","), F.lit('],"next_rest_url":"'), other, F.lit('"}'))
    events = listing.tidy_events(rows.select(F.concat(F.lit("http://h/"), n).alias("url"), body.alias("body")))
    return events.select("url", "i", "name", "link", "start_date", "city", "next")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'http://h/p?per_page=' || 10 * (o_orderkey % 3) || '&page=' || (o_orderkey % 7 + 1) END AS next FROM orders")
def next_batch(spark, sf):
    k = F.col("o_orderkey")
    u = F.concat(F.lit("http://h/p?page="), k % 7, F.lit("&per_page="), F.when(k % 3 > 0, k % 3 * 10).otherwise(99))
    return table(spark, sf, "orders").select("o_orderkey", listing.next_batch(u, F.lit(20)).alias("next"))


@query("""
WITH RECURSIVE h AS (SELECT n_nationkey AS src, n_nationkey * 3 % 25 AS dst FROM nation WHERE n_nationkey % 4 > 0),
r AS (SELECT n_nationkey AS url, n_nationkey AS x, 0 AS hops FROM nation UNION ALL SELECT url, dst, hops + 1 FROM r JOIN h ON x = src WHERE hops < 11)
SELECT url::VARCHAR AS url, CASE WHEN hops < 11 THEN x::VARCHAR END AS final, hops FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hops DESC) AS k FROM r) WHERE k = 1""")
def redirect_ends(spark, sf):
    ensure_checkpoints(spark)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    hops = n.where("n % 4 > 0").select(F.col("n").cast("string").alias("src"), (F.col("n") * 3 % 25).cast("string").alias("dst"))
    return listing.redirected(hops, n.select(F.col("n").cast("string").alias("url")))


@query("""
WITH e AS (SELECT event_id, [event_id * 37 % 256, event_id * 11 % 256, event_id * 7 % 256, event_id % 256] AS b FROM events)
SELECT event_id, NOT (b[1] IN (0, 10, 127) OR b[1] >= 224 OR b[1] = 100 AND b[2] BETWEEN 64 AND 127 OR b[1] = 169 AND b[2] = 254 OR b[1] = 172 AND b[2] BETWEEN 16 AND 31
  OR b[1] = 192 AND (b[2] = 168 OR b[2] = 0 AND b[3] IN (0, 2) OR b[2] = 88 AND b[3] = 99) OR b[1] = 198 AND (b[2] IN (18, 19) OR b[2] = 51 AND b[3] = 100) OR b[1] = 203 AND b[2] = 0 AND b[3] = 113) AS public FROM e""")
def public_addresses(spark, sf):
    i = F.col("event_id")
    ip = F.concat_ws(".", *[(i * k % 256).cast("string") for k in (37, 11, 7, 1)])
    return table(spark, sf, "events").select("event_id", listing.public_address(ip).alias("public"))


@query("""
WITH p AS (SELECT page_id, url, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '.'), -2, -1), '.') AS site FROM pages),
u AS (SELECT site, min_by(url, page_id) AS url, min(page_id) AS i FROM p GROUP BY site, rtrim(regexp_replace(url, '#.*$', ''), '/'))
SELECT site, place, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY len(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')), length(url), i)::INT AS place FROM u) WHERE place <= 50""")
def site_listing(spark, sf):
    p = table(spark, sf, "pages").select(urls.registrable(urls.host(F.col("url"))).alias("site"), F.col("page_id").alias("i"), "url")
    return listing.site_listing([p], "site", 50).select("site", "place", "url")


HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"


def files_of_hosts(spark, sf, line, before="", after=""):
    """(host, body): a file for each host, a piece for each of its pages, in order."""
    p = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), "page_id", line.alias("line"))
    rows = F.sort_array(F.collect_list(F.struct("page_id", "line")))
    return p.groupBy("host").agg(rows.alias("r")).select("host", F.concat(F.lit(before), F.array_join(F.transform("r", lambda x: x["line"]), ""), F.lit(after)).alias("body"))


@query(f"""SELECT {HOST_SQL} AS host, (row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) - 1)::INT AS pos, url AS loc, CASE WHEN page_id % 2 = 0 THEN 'de-AT' END AS hreflang FROM pages""")
def sitemap_entries(spark, sf):
    u = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    alternate = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<xhtml:link rel="alternate" hreflang="x-default" href="'), u, F.lit('"/><xhtml:link href="'), u, F.lit('" hreflang="de-AT" rel="alternate"/>'))).otherwise('<xhtml:link rel="alternate" hreflang="fr" href="http://other/"/>')
    files = files_of_hosts(spark, sf, F.concat(F.lit("<url><loc> "), u, F.lit(" </loc>"), alternate, F.lit("</url>\n")), "<urlset>", "</urlset>")
    d = site.sitemap_urls(files.select(F.col("host").alias("sitemap"), F.col("body").alias("xml")))
    return d.select(F.col("sitemap").alias("host"), "pos", "loc", F.nullif("hreflang", F.lit("")).alias("hreflang"))


@query(f"""SELECT {HOST_SQL} AS host, (row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) - 1)::INT AS pos, url AS loc, CASE WHEN page_id % 3 > 0 THEN '2027-01-0' || page_id % 3 END AS lastmod FROM pages""")
def sitemap_indexes(spark, sf):
    u = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    date = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<lastmod>2027-01-0"), (F.col("page_id") % 3).cast("string"), F.lit("</lastmod>"))).otherwise("")
    files = files_of_hosts(spark, sf, F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc>"), date, F.lit("</sitemap>")), "<sitemapindex>", "</sitemapindex>")
    return site.sitemap_index(files.select(F.col("host").alias("sitemap"), F.col("body").alias("xml"))).withColumnRenamed("sitemap", "host")


@query(f"""
WITH l AS (SELECT {HOST_SQL} AS host, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id)::INT AS line_no, trim(regexp_replace(url, '#.*$', '')) AS url FROM pages),
o AS (SELECT host, url, min(line_no) AS line_no FROM l GROUP BY ALL)
SELECT host, line_no, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no) AS n FROM o) WHERE n <= 3""")
def robots_named_sitemaps(spark, sf):
    files = files_of_hosts(spark, sf, F.concat(F.when(F.col("page_id") % 2 == 0, "\nSITEMAP : ").otherwise("\nSitemap:"), "url"), "User-agent: *", "\n# Sitemap: http://h/no.xml\nSitemap: http://h/sitemap.xml\nSitemap:")
    return site.robots_sitemaps(files)


@query("""
WITH a AS (SELECT page_id % 40 AS page, page_id AS i, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS lang, ['AT', 'es', 'US', '419'][1 + page_id // 40 % 4] AS region, url FROM pages)
SELECT page, i, lang || '-at' AS tag, url FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, i) AS r FROM a WHERE region = 'AT') WHERE r = 1""")
def market_versions(spark, sf):
    region = F.element_at(F.array(*map(F.lit, ("AT", "es", "US", "419"))), F.expr("cast(page_id div 40 % 4 + 1 AS int)"))
    a = table(spark, sf, "pages").select((F.col("page_id") % 40).alias("page"), F.col("page_id").alias("i"), F.concat(languages.path_copy(F.col("url")), F.lit("_"), region).alias("hreflang"), "url")
    return site.market_alternate(a, "page", "AT", ["fr"]).select("page", "i", "tag", "url")  # German is likely there


@query("""
WITH t AS (SELECT doc_id, lang, doc_id % 8 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN lang || '-us' WHEN 1 THEN 'zh-hant-tw' WHEN 2 THEN lang WHEN 3 THEN lang || '-419' WHEN 6 THEN 'de-1996' END AS tag, CASE WHEN k = 1 THEN 'zh' WHEN k = 6 THEN 'de' WHEN k IN (0, 2, 3) THEN lang END AS lang,
  CASE k WHEN 1 THEN 'tw' WHEN 0 THEN CASE WHEN lang IS NOT NULL THEN 'us' END WHEN 3 THEN CASE WHEN lang IS NOT NULL THEN '419' END END AS region FROM t""")
def language_tags(spark, sf):
    l, k = F.col("lang"), F.col("doc_id") % 8
    t = F.when(k == 0, F.concat(l, F.lit("_US"))).when(k == 1, "zh-Hant-tw").when(k == 2, F.concat(F.lit(" "), F.upper(l), F.lit(" "))).when(k == 3, F.concat(l, F.lit("-419"))).when(k == 4, F.concat(l, F.lit("-xyz1"))).when(k == 5, "x-default").when(k == 6, "DE-1996").otherwise("english-GB")
    d = table(spark, sf, "documents").select("doc_id", languages.canonical(t).alias("tag"))
    return d.select("doc_id", "tag", languages.language(F.col("tag")).alias("lang"), languages.region(F.col("tag")).alias("region"))


# Texts and images


@query("""SELECT conv_id, turn, len(x)::INT AS n, len(regexp_extract_all(t, '!\\[[^\\]\\n]*\\]\\([^)\\s]+'))::INT AS images FROM (SELECT conv_id, turn, t, regexp_extract_all(t, '(^|[^!])\\[[^\\]\\n]*\\]\\([^)\\s]+\\)') AS x
  FROM (SELECT conv_id, turn, '![i](http://i/' || turn || '.png) [a](b) ' || text || ' and [c d](http://c/d?e) there' AS t FROM conversations))""")
def markdown_links(spark, sf):
    t = F.concat(F.lit("![i](http://i/"), "turn", F.lit(".png) [a](b) "), "text", F.lit(" and [c d](http://c/d?e) there"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(bodies.markdown_links(t)).alias("n"), F.size(bodies.markdown_images(t)).alias("images"))


@query("SELECT p_partkey, round(0.5 * (p_size % 3) / 3 + 0.25 * (p_size % 2), 9) AS p FROM part")
def content_probability(spark, sf):
    m = F.create_map(F.lit("photo"), 0.5 * (F.col("p_size") % 3) / 3, F.lit("logo"), F.lit(0.25), F.lit("chart"), 0.25 * (F.col("p_size") % 2))
    return table(spark, sf, "part").select("p_partkey", F.round(images.content_probability(m), 9).alias("p"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN p_size / 50.0 ELSE (p_size / 50.0 + (p_size % 7) / 7.0) / 2 END, 9) AS p FROM part")
def image_blend(spark, sf):
    pixels = F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 7) / 7)
    return table(spark, sf, "part").select("p_partkey", F.round(images.blend(F.col("p_size") / 50, pixels, False), 9).alias("p"))


@query("""SELECT page_id, i FROM (SELECT p_brand AS page_id, p_partkey AS i, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size >= 10) WHERE r <= 12""")
def image_keep(spark, sf):
    return images.keep(table(spark, sf, "part").select(F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("i"), F.col("p_size").alias("p")), "page_id", 10, 12).select("page_id", "i")


@query("""
WITH l AS (SELECT page_id AS line, 'http://i/' || page_id % 97 || '.jpg' AS image, CASE WHEN page_id % 3 > 0 THEN url END AS page FROM pages WHERE page_id % 5 > 0)
SELECT image, arg_min(coalesce(page, '-'), line) AS page, min(line) AS line FROM l GROUP BY image""")
def listed_images(spark, sf):
    i = F.col("page_id")
    line = F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" http://i/"), (i % 97).cast("string"), F.lit(".jpg"), F.when(i % 3 > 0, F.concat(F.lit("  "), "url")).otherwise("")))
    return images.listed(table(spark, sf, "pages").select(i.alias("line"), line.alias("value"))).withColumn("page", F.coalesce("page", F.lit("-")))


@query("SELECT event_id, (CASE WHEN event_id % 4 = 1 THEN 1 WHEN event_id % 4 = 2 THEN 3 WHEN event_id % 4 = 3 THEN 2 ELSE 0 END)::BIGINT AS n FROM events")
def path_nearness(spark, sf):
    paths = F.array(*[F.array(*map(F.lit, p)) for p in (("x", "b", "c"), ("a", "x", "c"), ("a", "b", "c"), ("a", "b", "x"))])
    p = F.element_at(paths, (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", structured.key_prefix_rank(p, F.array(*map(F.lit, ("a", "b", "c")))).cast("bigint").alias("n"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value >= 90)")
def unblocked_answers(spark, sf):
    from ..operators.scoring import unblocked

    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "blocked").otherwise("x").alias("id"), F.col("value").alias("noul"))
    return unblocked(e, "user_id", 90).select("event_id")


@query("""SELECT l_orderkey, l_linenumber AS i, l_quantity::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2""")
def shortlist(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"))
    return most_relevant(l, "l_orderkey", "q", 2).select("l_orderkey", "i", F.col("q").cast("int").alias("n"))


@query("""
WITH u AS (SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') || ['', '.pdf', '.mov', '.XML', '.avi', '.jpeg', '.woff', '.tar'][1 + page_id % 8] AS url FROM pages)
SELECT page_id, page_id % 8 IN (0, 2, 4, 6) AS reachable, regexp_extract(lower(url), '^([a-z]+://)', 1) || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS site FROM u""")
def reachable_pages(spark, sf):
    from ..operators.links import reachable

    end = F.element_at(F.array(*map(F.lit, ("", ".pdf", ".mov", ".XML", ".avi", ".jpeg", ".woff", ".tar"))), (F.col("page_id") % 8 + 1).cast("int"))
    p = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), end).alias("url"))
    return p.select("page_id", reachable(F.col("url")).alias("reachable"), urls.site(F.col("url")).alias("site"))


@query()
def block_excerpts(spark, sf):
    return text.excerpt(child(extract_pages(table(spark, sf, "pages"), ["blocks"]), "blocks"), "page_id")
