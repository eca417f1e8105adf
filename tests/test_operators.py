import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.operators import links, paging, search, select, site, spans, structured, text
from sievework.sources import documents
from sievework.streaming import state


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("base", "href", "out"), [
    ("http://E.com:80/a/b", "../c", "http://e.com/c"), ("http://e.com", "/ü,x", "http://e.com/%C3%BC,x"), ("http://e.com/a", "?q=1", "http://e.com/a?q=1"),
    ("http://e.com", "WWW.x.org", "https://www.x.org/"), ("http://e.com", "#f", None), ("http://e.com", "mailto:a@b", None), ("http://e.com", "//h/p", "http://h/p"), ("http://e.com/", "http://[bad", None)])
def test_join(base, href, out):
    assert urls.join(base, href) == out


def test_page_slot(spark):
    got = spark.createDataFrame([("http://a/x?b=2&page=3&a=1",), ("http://a/x/page/4/",), ("http://a/x?page=1&e_page=2",)], "u string").select(urls.page_slot(F.col("u")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("http://a/x?a=1&b=2", 3), ("http://a/x?", 4), ("http://a/x?", None)]


def test_top_k_prefers_earlier_among_equals(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)], "g int, i int, p double")
    assert rows(select.top_k(df, "g", 2, 0.2), "i") == [(0,), (1,)]


def test_robots_longest_match(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /p\nAllow: /p/ok$\nDisallow: /%62x # c\n\nUser-agent: z\nDisallow: /\nSitemap: http://h/s.xml"
    files = spark.createDataFrame([("h", body)], "host string, body string")
    pages = spark.createDataFrame([(1, "http://h/p/ok"), (2, "http://h/p/okay"), (3, "http://h/q"), (4, "http://h/bx"), (5, "http://other/p"), (6, "http://h/robots.txt")], "page_id int, url string")
    assert rows(site.allowed(pages, site.robots_rules(files)), "page_id", "allowed") == [(1, True), (2, False), (3, True), (4, False), (5, True), (6, True)]
    assert rows(site.robots_sitemaps(files), "url") == [("http://h/s.xml",)]


def test_sitemap_entries(spark):
    xml = '<urlset><url><loc>http://h/a?x=1&amp;y=2</loc><xhtml:link rel="alternate" hreflang="x-default" href="http://h/a?x=1&amp;y=2"/><xhtml:link rel="alternate" hreflang="de" href="http://h/a?x=1&amp;y=2"/></url><url><loc>http://h/b</loc></url></urlset>'
    got = site.sitemap_urls(spark.createDataFrame([("s", xml)], "sitemap string, xml string"))
    assert rows(got, "loc") == [("http://h/a?x=1&y=2",), ("http://h/b",)] and {r["hreflang"] for r in got.collect()} == {"de", None}


@pytest.mark.parametrize(("text_", "seconds"), [("1970-01-02", 86400), ("1970-01-01T01:00Z", 3600), ("1970-01-01T00:00:10.5+01:00", -3590), ("2024-02-31", 1709337600), ("2024-13-01", None), ("x", None), ("1970-01-01T00:00:60Z", 60)])
def test_lastmod(spark, text_, seconds):
    assert spark.createDataFrame([(text_,)], "t string").select(site.lastmod_seconds(F.col("t"))).first()[0] == seconds


def test_spread_takes_turns(spark):
    df = spark.createDataFrame([(1, i, u, 0) for i, u in enumerate(["http://h/a/1", "http://h/a/2", "http://h/b/1", "http://h/c"])], "g int, i int, url string, score int")
    assert [r["i"] for r in links.spread(df, "g", "score", 9).orderBy("place").collect()] == [3, 0, 2, 1]


def test_stepped_next_needs_three_numbers_a_step_apart(spark):
    def nxt(page, *others):
        df = spark.createDataFrame([(1, page, i, u) for i, u in enumerate(others)], "page_id int, page_url string, i int, url string")
        return [r["next"] for r in paging.stepped_next(df).collect()]

    assert nxt("http://h/l", "http://h/l?start=20", "http://h/l?start=40") == ["http://h/l?start=20"]
    assert nxt("http://h/l?start=20", "http://h/l?start=0", "http://h/l?start=40") == ["http://h/l?start=40"]
    assert nxt("http://h/l", "http://h/l?id=20", "http://h/l?id=40") == []
    assert nxt("http://h/l", "http://h/l?start=20", "http://h/l?start=44") == []
    assert nxt("http://h/l", "http://h/l?start=1", "http://h/l?start=2") == []


def test_read_list_stops_when_nothing_is_new(spark):
    df = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "y", 2), ("a", 1, "x", 2), ("a", 2, "x", 3), ("a", 3, "z", None)], "list string, page int, item string, next int")
    assert rows(paging.read_list(df, spark.createDataFrame([("a", 0)], "list string, page int")), "page", "item") == [(0, "x"), (1, "y")]


def test_follow_reads_the_best_leads(spark):
    edges = spark.createDataFrame([("s", "a", 0.9, 0), ("s", "b", 0.1, 1), ("a", "c", 0.9, 0)], "src string, dst string, p double, pos int")
    scores = spark.createDataFrame([("s", 0.0), ("a", 0.2), ("b", 0.1), ("c", 0.95)], "url string, p double")
    got = search.follow(edges, scores, "s", most=4, width=1)
    assert [r["url"] for r in got.orderBy("step").collect()] == ["s", "a", "c"] and search.concluded(got).first()["url"] == "c"


def test_recipe_errors_and_wildcards():
    assert structured.recipe_rows([("ld:0", {"q{1}": [{"a": {"b": 1.5}}, {"a": {"b": " "}}, 3]})], {"source": "ld:0", "path": ["q*"], "fields": {"x": ["a", "b"]}}) == ([{"x": "1.5"}, {}], False, None)
    assert structured.recipe_rows([], {"source": "ld:0", "path": [], "fields": {}})[2] == "the page has no ld:0"
    with pytest.raises(ValueError, match="empty"):
        structured.recipe_of('{"source":"a","path":[],"fields":{"x":[]}}')


def test_spans_are_pieces_of_their_block():
    t = "Teas: Assam, Keemun and Dian Hong. Tin€4 per person/week for regulars.\nMaja Lind\nOtto Berg\nsince 1987 [3]."
    found = spans.candidates([(0, "para", t)])
    said = [t[a:b] for _, a, b, _ in found]
    assert {"€4", "Maja Lind\nOtto Berg", "1987", "Assam, Keemun and Dian Hong"} <= set(said) and len(said) == len(set(said))
    assert ("3 min (Steep · Assam)") in {label for *_, label in spans.candidates([(0, "table", "| Tea | Assam |\n|---|---|\n| Steep | 3 min |")])}


def test_fragment_link():
    assert spans.fragment_link("http://a/b#c", "say it is so now", (7, 9)) == "http://a/b#:~:text=say%20it-,is,-so%20now"


def test_markdown_and_feed():
    title, blocks = documents.markdown_blocks("---\ntitle: X\n---\n# Hi **there**\n\na [b](c)\n\n- one\n\n````\n```\n````\n> q\n")
    assert title == "X" and [(b["kind"], b["text"]) for b in blocks] == [("heading", "Hi there"), ("para", "a b"), ("item", "one"), ("code", "```"), ("quote", "q")]
    atom = '<feed><title>F</title><entry><title>A &amp; B</title><link rel="alternate" href="http://x/1"/><updated>2027</updated><summary>s</summary></entry></feed>'
    assert documents.feed_entries(atom) == [{"title": "A & B", "url": "http://x/1", "date": "2027", "summary": "s", "image": ""}] and documents.feed_html("<html>") is None


def test_bytes():
    import gzip

    assert documents.inflated(gzip.compress(b"x" * 10)) == b"x" * 10 and documents.inflated(gzip.compress(b"x" * 10), 5) is None
    with pytest.raises(ValueError, match="gzip"):
        documents.inflated(b"\x1f\x8bzz")
    assert documents.decoded("é".encode("cp1252"), "text/html; charset=ISO-8859-1") == "é" and documents.decoded(b"\xef\xbb\xbfa", "text/html; charset=utf-16") == "a"


def test_fence_is_longer_than_those_inside(spark):
    df = spark.createDataFrame([("code", "a\n````\nb")], "k string, t string").select(text.markdown(F.col("k"), F.col("t")))
    assert df.first()[0].startswith("`````\n")


def test_stream_state_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2027, 1, 1)
    events = [(f"h{i % 3}", t0 + datetime.timedelta(seconds=97 * i)) for i in range(60)]
    df = spark.createDataFrame(events, "host string, ts timestamp")
    batch = rows(state.host_memo(df).where("news"), "host", "learned")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    q = state.host_memo_stream(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName("memo").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("memo"), "host", "learned") == batch


def test_escalation_stops_at_the_answer_that_stands(spark):
    df = spark.createDataFrame([("u", 1, "plain", 403, None), ("u", 2, "browser", 200, None), ("u", 3, "proxy", 200, None), ("v", 1, "plain", 503, "30")], "url string, attempt int, client string, status int, retry_after string")
    assert rows(state.escalated(df), "url", "client", "status", "attempts") == [("u", "browser", 200, 2), ("v", "plain", 503, 1)]


def test_numbers_too_large_are_no_numbers(spark):
    u = spark.createDataFrame([("http://h/l?page=99999999999999999999",), ("http://h/l?page=2",)], "u string")
    assert [r[0] for r in u.select(urls.page_slot(F.col("u"))["page"]).collect()] == [None, 2]
    h = spark.createDataFrame([(1, "en;q=0.8.1, fr")], "id int, header string")
    assert rows(site.accepted(h), "language") == [("en",), ("fr",)]  # what is no weight counts as none
    from sievework.sources.page import read_page

    r = read_page('<main><img src="/a.jpg" width="99999999999"><table><tr><td colspan="99999999999999">x</table></main>', "http://h/")
    assert r["images"][0]["width"] is None and r["blocks"][0]["text"] == "| x |"
