import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import answers, images, listing, metrics, render, scoring, select, structured, text
from sievework.plans import api
from sievework.plans.queries import ensure_checkpoints


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


PAGE = """<html lang=en><head><title>Tea</title></head><body><nav><a href="/brew/green-tea">brew green</a><a href="/about">about</a></nav><main><h1>Green tea</h1>
<p>To brew green tea, heat the water to 80 degrees for two minutes.<p>Black coffee is another drink with another temperature.
<pre><code class="language-py">brew(water=80)</code></pre><img src="/tea.jpg" alt="green tea in a cup"></main>
<script type="application/json" id="S">{"list":[{"name":"A","price":1.50},{"name":"B","price":2},{"name":"C"}]}</script></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://tea.org/green", PAGE), (2, "http://tea.org/none", "<p>nothing here"), (3, None, None)], "page_id bigint, url string, html string")


def test_ask_gives_blocks_with_their_headings(pages):
    got = [(r["kind"], r["p"] is not None) for r in api.ask(pages, "heat water green brew", k=1, threshold=0.5).orderBy("i").collect()]
    assert got == [("heading", False), ("para", True)]


def test_precise_gives_a_piece_and_its_link(pages):
    r = api.precise(pages, "degrees minutes water").first()
    assert r["answer"] in "To brew green tea, heat the water to 80 degrees for two minutes." and r["link"].startswith("http://tea.org/green#:~:text=") and 0 < r["p"] <= r["share"] <= 1


def test_code_links_images_and_rows(pages):
    assert rows(api.code(pages, "brew(water)"), "text") == [("brew(water=80)",)]
    assert rows(api.links(pages, "how to brew green"), "url") == [("http://tea.org/brew/green-tea",)]
    assert rows(api.images(pages, "green tea"), "url") == [("http://tea.org/tea.jpg",)]
    assert rows(api.sources(pages), "source", "count") == [("json:S", 3)]
    got = api.recipe(pages, json.dumps({"source": "json:S", "path": ["list"], "fields": {"n": ["name"], "p": ["price"]}})).where("error IS NULL").orderBy("row").collect()
    assert [r["fields"] for r in got] == [{"n": "A", "p": "1.5"}, {"n": "B", "p": "2"}, {"n": "C"}]


def test_a_table_of_answers_replays(spark, pages):
    answers_ = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.4)], "page_id bigint, i int, noul double")
    assert rows(api.gist(pages, scoring.TableScorer(answers_, ["page_id", "i"])).where("p IS NOT NULL"), "i", "p") == [(1, 0.9)]


def test_refined_prefers_a_piece_only_at_the_threshold(spark):
    o = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.5), (2, 0, 0.9), (2, 1, 0.6), (3, 0, 0.1), (3, 1, 0.3)], "g int, k int, p double")
    assert rows(answers.refined(o, "g", 0.4), "g", "k") == [(1, 1), (2, 0), (3, 0)]


def test_quote_and_context():
    t = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    assert answers.table_quote(t, t.index("3")) == "| a | b |\n| 3 | 4 |" and answers.table_quote(t, t.index("a")) == "| a | b |" and answers.table_quote("x", 0) is None
    assert answers.context("para", t, t.index("3")) == (t, False) and answers.context("code", t, 0) is None and answers.context("para", "x", 0) is None
    assert answers.kept_rows([10] * 100, 1, 50) == [0, *range(21, 80)] and answers.kept_rows([7000], 0, 0) is None
    assert answers.context("item", "b", 0, ["a", "b", "c"], 1) == ("a\nb\nc", False)


def test_best_with_vote_equals_nested_vote(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 10, 0.3, 10), (1, 1, 0, 2, 5, 0.4, 3), (1, 2, 1, 0, 9, 0.2, 9), (1, 3, 0, 6, 12, 0.1, 6)], "g int, i int, block int, start int, end int, p double, length int")
    best = select.best_with_vote(s, "g").first()
    assert best["i"] == 1 and best["share"] == pytest.approx(0.7) == select.nested_vote(s, ["g", "block"]).where("i = 1").first()["share"]


def test_documents_leave_out_what_is_absent(spark):
    b = spark.createDataFrame([(1, "http://a/", "T", 0, "heading", 2, None, "H", None, None), (1, "http://a/", "T", 1, "para", None, None, "x", 1, 0.5)], "page_id int, url string, title string, i int, kind string, level int, lang string, text string, record int, p double")
    r = render.blocks_document(b, "page_id").first()
    assert r["text"] == "# T\n\n<http://a/>\n\n## H\n\n[record 1]\nx\n\n" and json.loads(r["json"])["blocks"][1] == {"i": 1, "kind": "para", "text": "x", "record": 1, "p": 0.5}
    p = spark.createDataFrame([("u", "yes", 0.9, "q", 0, "para", "l"), ("u", "no", 0.1, "q", 0, "para", "l")], "url string, text string, p double, quote string, block int, kind string, link string")
    assert [(x["answer"], x["closest"]) for x in map(json.loads, (r["json"] for r in render.precise_document(p).orderBy("text").collect()))] == [(None, "no"), ("yes", None)]


def test_attach_matches_names_in_page_order(spark):
    blocks = spark.createDataFrame([(1, 0, "Red tea\n10 €"), (1, 1, "Other"), (1, 2, "Red tea\n12 €"), (1, 3, "More\nblue cup here")], "page_id int, i int, text string")
    pics = spark.createDataFrame([(1, 0, "", "red  TEA"), (1, 1, "", "Red tea"), (1, 2, "Blue cup here", "x"), (1, 3, "", "ab")], "page_id int, i int, caption string, alt string")
    assert rows(images.attach(pics, blocks), "i_image", "i_block") == [(0, 0), (1, 2), (2, 3)]


def test_variants_keep_the_largest_at_the_first_place(spark):
    df = spark.createDataFrame([(1, "http://h/a-300x200.jpg?x", 300, 0), (1, "http://h/b.jpg", 10, 1), (1, "http://h/a-900x600.webp", 900, 2)], "g int, url string, side int, i int").withColumn("key", images.photo_key(F.col("url")))
    assert rows(images.photo_variants(df, "g", "key", "side"), "first", "url") == [(0, "http://h/a-900x600.webp"), (1, "http://h/b.jpg")]


def test_redirects_end_or_run_out(spark):
    ensure_checkpoints(spark)
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = listing.redirected(hops, spark.createDataFrame([("a",), ("c",), ("x",)], "url string"), 3)
    assert {(r["url"], r["final"]) for r in got.collect()} == {("a", "c"), ("c", "c"), ("x", None)}


@pytest.mark.parametrize(("ip", "public"), [("8.8.8.8", True), ("10.1.2.3", False), ("100.64.0.1", False), ("100.128.0.1", True), ("172.32.0.1", True), ("192.0.2.7", False), ("255.255.255.255", False), ("256.1.1.1", None), ("1.2.3", None)])
def test_public_addresses(spark, ip, public):
    assert spark.createDataFrame([(ip,)], "a string").select(listing.public_address(F.col("a"))).first()[0] is public


def test_public_addresses_v6():
    assert [listing.public_address_v6(a) for a in ("2606:4700::1", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::7f00:1", "fe80::1", "2001:db8::1", "x")] == [True, False, False, True, False, False, False, None]


def test_next_links_and_shapes():
    data = [("json:fetch:/l", {"items": [{"id": i, "href": f"/p/{i}", "name": "n"} for i in range(4)], "paging": {"next": {"href": "/l?page=2"}}, "other": {"next_page_url": "http://elsewhere/"}})]
    assert listing.next_links(data, "http://h/l") == (["http://h/l?page=2"], ["href", "id", "name"])
    assert listing.rows_by_shape(data, {"source": "x", "path": [], "fields": {"n": ["name"], "z": ["zz"]}})[0] == [{"n": "n"}] * 4
    assert listing.rows_by_shape(data, {"source": "x", "path": ["y"], "fields": {"q": ["qq"]}})[2] == "no list like x y in the page"
    assert listing.data_things(data, "http://h/l")[0] == "Thing (data): name: n; href: http://h/p/0; id: 0"


def test_declared_searches(spark):
    html = '<head><link rel="https://api.w.org/" href="/wp-json/"><link rel=search type="application/opensearchdescription+xml" href="/os.xml"></head><script type="application/ld+json">{"potentialAction":{"target":{"urlTemplate":"http://h/?s={q}"}}}</script>'
    d = listing.declared_searches(spark.createDataFrame([(1, "http://h/", html)], "page_id bigint, url string, html string"))
    assert rows(d, "kind", "template") == [("action", "http://h/?s={q}"), ("opensearch", "http://h/os.xml"), ("wordpress", "http://h/wp-json/wp/v2/search?search={searchTerms}&per_page=10")]
    assert d.where("kind = 'action'").select(listing.filled(F.col("template"), F.lit("a b&c"))).first()[0] == "http://h/?s=a+b%26c"


def test_settings():
    assert listing.settings(["A=1\n# B=2\nexport C='x y'", "A=3 # new"], {"D": "4", "C": ""}) == {"A": "3", "C": "x y", "D": "4"}


def test_packing_starts_anew(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 5, 20, 1])], "g int, i int, s int")
    assert rows(text.packed(df, "g", "i", F.col("s"), 3, 12), "i", "pack") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (3, 1, 2, 4)] + [(1, None)], "g int, v double")
    assert rows(metrics.nearest_rank(df, "g", "v"), "n", "p50", "p90") == [(4, 2.0, 4.0)]


def test_minor_units(spark):
    df = spark.createDataFrame([(5,), (1350,), (0,)], "a int")
    assert [r[0] for r in df.select(structured.minor_units(F.col("a"))).collect()] == ["0.05", "13.50", "0.00"]


def test_query_names_have_matching_columns(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["page_id", "i", "kind", "level", "text", "p"]


def test_json_ld_values():
    from sievework.sources.page import json_ld_values

    v = {"@graph": [{"@type": "Event", "name": "Moor walk", "startDate": "2031-09-02", "endDate": " ", "offers": [{"@type": "Offer", "price": 7, "priceCurrency": "SEK"}]}, {"@type": ["Course"], "duration": "P3D"}]}
    assert json_ld_values(v) == ["Event Moor walk (JSON-LD): startDate 2031-09-02.", "Offer (JSON-LD, Moor walk): price 7 SEK.", "Course (JSON-LD): duration P3D."]


def test_variants_of_buying_forms():
    from sievework.sources.page import read_page

    form = "<form action='/cart/add'><label for=s>Size:</label><select id=s><option>Choose one<option>M<option selected>L</select><select name=qty><option>a<option>b</select></form>"
    assert [b["text"] for b in read_page(f"<main><p>{'word ' * 9}</p>{form}</main>", "http://h/")["blocks"]][-1] == "Size: L (other options: M)"
    assert len(read_page(f"<main><p>{'word ' * 9}</p>{form * 4}</main>", "http://h/")["blocks"]) == 1


def test_cards_of_images():
    from sievework.sources.page import read_page

    r = read_page('<main><a href="/x"><img src="/a.jpg" alt="a" title="T"><span>10 €</span><h3>Tea</h3></a><div><h2>Cup</h2><p><img src="/b.jpg"></p></div></main>', "http://h/")
    assert [x["card"] for x in r["images"]] == ["T\nTea\n10 €", "Cup"]


def test_next_page_declared_numbered_or_stepped(spark):
    page = lambda links, head="": f"<head>{head}</head><main>{''.join(f'<a href={x}>x</a>' for x in links)}</main>"
    rows_ = [(1, "http://h/l", page(["/l?page=2"], '<link rel=next href="/n">')), (2, "http://h/l?page=2", page(["/l?page=1", "/l?page=3"])), (3, "http://h/l", page(["/l?start=20", "/l?start=40"])), (4, "http://h/l", page(["/q"]))]
    got = api.next_pages(spark.createDataFrame(rows_, "page_id bigint, url string, html string"))
    assert rows(got, "page_id", "next") == [(1, "http://h/n"), (2, "http://h/l?page=3"), (3, "http://h/l?start=20")]


def test_decorations_may_be_missing(pages):
    base = api.ask(pages, "heat water green brew", k=1, threshold=0.5).where("p IS NOT NULL").select("page_id", "text")
    r = api.with_image(api.with_link(base, pages, "how to brew green"), pages, "cup").first()
    assert r["page_link"]["url"] == "http://tea.org/brew/green-tea" and r["image"]["alt"] == "green tea in a cup"
    assert api.with_link(base, pages, "zebra stripes").first()["page_link"] is None


def test_second_pass_only_when_nothing_was_found(spark):
    from sievework.operators import search

    ensure_checkpoints(spark)
    edges = spark.createDataFrame([("s", "a", 0.9, 0)], "src string, dst string, p double, pos int")
    scores = spark.createDataFrame([("s", 0.0), ("a", 0.1), ("z", 0.9)], "url string, p double")
    read = search.follow(edges, scores, "s", most=3)
    more = spark.createDataFrame([("z", 0.8, 0)], "dst string, p double, pos int")
    out = search.second_pass(read, edges, scores, more, "s").collect()
    assert {r["url"] for r in out} == {"s", "a", "z"} and max(r["step"] for r in out) > read.agg(F.max("step")).first()[0]
    assert search.second_pass(read.withColumn("found", F.lit(True)), edges, scores, more, "s").count() == 2
