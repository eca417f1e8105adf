from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.sources.page import PAGE, candidates, collapse, extract_pages, is_price, read_page


def page(body: str, head: str = "", url: str = "http://e.com/p"):
    return read_page(f"<html><head>{head}</head><body>{body}</body></html>", url)


def texts(body: str):
    return [(b["kind"], b["text"]) for b in page(body)["blocks"]]


def test_unclosed_paragraphs_and_formatting():
    assert texts("<main><p><b>The first paragraph is long<br><p>and here the second one is</p></main>") == [("para", "The first paragraph is long"), ("para", "and here the second one is")]


def test_lists_keep_nested_items_after_their_own():
    assert texts("<ul><li>a first item that is long enough<ul><li>a nested item that is long enough</ul><li>a second item that is long enough</ul>") == [
        ("item", "a first item that is long enough"), ("item", "a nested item that is long enough"), ("item", "a second item that is long enough")]


def test_table_spans_fill_their_slots():
    assert texts("<table><tr><th>a<th>b<tr><td rowspan=0>1<td>2<tr><td colspan=2>3</table>") == [("table", "| a | b |\n| 1 | 2 |\n| 1 | 3 | 3 |")]


def test_table_of_tables_is_layout():
    assert ("table", "| x |") in texts("<table><tr><td><table><tr><td>x</table></table>")


def test_hidden_chrome_and_forms_are_not_read():
    assert texts('<p hidden>one</p><p style="display: NONE !important">two</p><div class="sidebar">three</div><form>four</form><p aria-hidden=true>five is what a reader sees</p>') == [("para", "five is what a reader sees")]


def test_transparent_state_beside_an_opaque_one():
    assert texts('<p>the lake is <span class="opacity-0">8</span><span class="opacity-100">12</span> metres deep at its north end</p>') == [("para", "the lake is 12 metres deep at its north end")]


def test_three_cards_merge_and_two_do_not():
    card = "<div><h3>{}</h3><span>10 May</span></div>"
    three = page("<div>" + "".join(card.format(c) for c in "ABC") + "</div>")["blocks"]
    assert [b["record"] for b in three] == [1, 2, 3] and three[0]["text"] == "A\n10 May"
    assert all(not b.get("record") for b in page("<div>" + "".join(card.format(c) for c in "AB") + "</div>")["blocks"])


def test_short_blocks_join():
    assert texts("<div>Moor walk</div><div>£7</div><div>a seat/yr</div>") == [("para", "Moor walk\n£7\na seat/yr")]


def test_prices():
    assert all(map(is_price, PRICES))
    assert not any(map(is_price, NO_PRICES))


PRICES = ("£7", "¥ 1,200", "85 ₽", "₩900 a seat", "3 per seats/yr", "40₹ + porter", "  £ 2–3 ", "£ or 4 cups")
NO_PRICES = ("Room 4", "tea", "", "4 cups", "£", "porter + 40₹ x", "cup 3 £ + porter")


def test_prices_as_expressions(spark):
    from pyspark.sql import functions as F

    from sievework.operators import text

    every = [*PRICES, *NO_PRICES, "4\u00a0£", "a+4", "1+£2", "perper 3", "3 SEATS", "é 3", "3é", "\u2007£3"]
    got = spark.createDataFrame([(x,) for x in every], "t string").select(text.is_price(F.col("t"))).collect()
    assert [r[0] for r in got] == list(map(is_price, every))


def test_links_resolve_against_base_and_skip_the_page():
    r = page('<p><a href="x?a=1#f">one</a> <a href="#top">up</a> <a href="www.b.org">b</a> <a href="mailto:q">m</a></p>', '<base href="/d/">')
    assert [(x["url"], x["text"]) for x in r["links"]] == [("http://e.com/d/x?a=1", "one"), ("https://www.b.org/", "b")]


def test_first_link_wins_and_is_filled_in():
    r = page('<p><a href="/a"><img src=i.jpg></a> <a href="/a">text</a></p>')
    assert [(x["i"], x["url"], x["text"], x["marginal"]) for x in r["links"]] == [(0, "http://e.com/a", "text", False)]


def test_content_root_needs_a_fifth_of_the_text():
    assert page("<main>x</main><p>" + "long text " * 20 + "</p>")["root"] == "body"
    assert page("<article>" + "long text " * 20 + "</article><p>x</p>")["root"] == "article"


def test_srcset_addresses_may_hold_commas():
    assert candidates("/fit,h=90/tarn.png 320w, /moor.png 3x,/fell.png") == [("/fit,h=90/tarn.png", "320w"), ("/moor.png", "3x"), ("/fell.png", "")]


def test_same_picture_in_two_formats_is_one():
    r = page('<img src="/a.jpg"><img src="/a.webp" alt="A"><img src="/pixel.gif"><img src="/s.png" width=20>')
    assert [(x["url"], x["alt"]) for x in r["images"]] == [("http://e.com/a.jpg", "A")]


def test_json_ld_things_and_assigned_data():
    r = page("", '<script type="application/ld+json">{"@graph":[{"@type":"Event","startDate":"2027","name":"V","offers":{"@type":"Offer","price":25.0}}]}</script><script>window.S = {"a":[1]}; if (x=={}) {}</script>')
    assert r["things"] == ["Event (JSON-LD): name: V; offers.price: 25.0; startDate: 2027"]
    assert [d["name"] for d in r["data"]] == ["ld:0", "var:S"]


def test_chosen_option():
    r = page('<label><input type=radio name=Size checked>M</label><label><input type=radio name=Size>L</label>')
    assert r["chosen"] == ["Size: M (other options: L)"]


def test_placeholders_need_a_script():
    assert page("<p>{{ price }} and ${total}</p><script></script>")["placeholders"]
    assert not page("<p>{{ price }} and ${total}</p>")["placeholders"]


def test_null_and_empty_pages(spark):
    rows = extract_pages(spark.createDataFrame([(1, "http://a/", None), (2, None, ""), (None, "x", "<p>")], "page_id bigint, url string, html string")).collect()
    assert len(rows) == 3 and all(r["blocks"] == [] for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-lidvutr&;#{}", max_size=120))
def test_any_markup_is_read_and_text_is_verbatim(markup):
    r = read_page(markup, "http://e.com/")
    for b in r["blocks"]:
        assert b["text"].strip()


@given(st.text(alphabet="ab \n\t\x1f\u00a0", max_size=40))
def test_collapse_keeps_words_and_marks_breaks(s):
    out = collapse(s)
    assert out.split() == s.replace("\x1f", " ").split() and out == out.strip() and "  " not in out


def test_parts_are_read_alike_alone_and_together():
    html = """<html lang=de><head><title>T</title><link rel=next href="/n"><link rel=alternate hreflang=fr href="/fr"></head><body><nav><a href="/m">menu</a></nav><main><h1>Head</h1><p>a paragraph of some length here <a href="/x">link</a></p>
    <img src="/a.png" alt="a picture"><form action="/s"><input type=search name=q></form><label><input type=radio name=C checked>red</label><label><input type=radio name=C>blue</label></main><script>window.S = {"a":[1]}</script></body></html>"""
    whole = read_page(html, "http://e.com/p")
    assert set(whole) == {f.name for f in PAGE.fields}
    for k, v in whole.items():
        assert read_page(html, "http://e.com/p", [k]) == {k: v}, k


def test_references_without_a_semicolon_are_read_or_left():
    html = '<title>a&amp;&amp</title><p>b &copy c &copy; &amp &nosuch &nosuch; &notit; &#169 &#xa9;</p><a href="/x?a=1&b=2&amp;d=3">link</a><script>var u = "&amp";</script>'
    for open_, title, text in ((True, "a&&", "b © c © & &nosuch &nosuch; ¬it; © ©"), (False, "a&&amp", "b &copy c © &amp &nosuch &nosuch; &notit; &#169 ©")):
        r = read_page(html, "http://e.com/", open_references=open_)
        assert (r["title"], r["blocks"][0]["text"], r["links"][0]["url"]) == (title, text, "http://e.com/x?a=1&b=2&d=3")


def assert_same_as_sql(spark, folder, query, htmls):
    """The query's rows over pages of ``htmls`` are those of its SQL."""
    import duckdb

    from sievework.plans import derived_queries  # noqa: F401  it registers its queries
    from sievework.plans.queries import ORACLES, QUERIES

    pages = spark.createDataFrame([(i, f"http://e.com/{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(f"{folder}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    wanted = db.execute(ORACLES[query]).fetchall()
    assert sorted(map(str, map(tuple, QUERIES[query](spark, str(folder)).collect()))) == sorted(map(str, wanted)) and wanted


#: A page as the tables have them: its title and text, the title cut within a reference, and what its article holds.
CUT = """<!DOCTYPE html><html lang="en"><head><title>Tar %s</title></head><body><nav><ul><li><a href="/a">a menu of many words</a></li></ul></nav><!-- ad --><article><h1>Tar %s</h1>%s</article><footer>&copy; e &middot; end</footer></body></html>"""
REFERENCES = ("&amp;&amp", "&amp", "&quot;x&quot", "a &copy", "&amp;amp", "&am", "plain")
LONG = "<p>a text &amp; more of it, so that the article has its share<br><p>and &quot;here&quot; is &copy the rest"


def test_titles_cut_within_a_reference_are_those_of_the_sql(spark, tmp_path):
    assert_same_as_sql(spark, tmp_path, "page_title", [CUT % (t, t, LONG) for t in REFERENCES])


def test_root_bytes_with_open_references_are_those_of_the_sql(spark, tmp_path):
    assert_same_as_sql(spark, tmp_path, "content_root_share", [CUT % (t, t, more) for t in REFERENCES for more in ("", LONG)])


def test_paragraphs_of_small_and_empty_articles_are_those_of_the_sql(spark, tmp_path):
    assert_same_as_sql(spark, tmp_path, "blocks_paragraphs", [CUT % (t, t, more) for t in REFERENCES for more in ("", LONG)] + ["<body><nav>a menu</nav><article> <p> </p></article><footer>end</footer></body>"])
    assert page("<nav>a long menu that is no content</nav><div>and a card that is larger than the article</div><article>x</article>")["root"] == "body"


def test_responses_of_any_size_are_those_of_the_sql(spark, tmp_path):
    assert_same_as_sql(spark, tmp_path, "read_responses", [CUT % (t, t, "<p>" + "a large page " * (n * 1000)) for t in REFERENCES for n in (0, 7)])
