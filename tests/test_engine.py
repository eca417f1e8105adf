import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import languages, registry, urls
from sievework.operators import answers, fold, images, links, listing, metrics, paging, scoring, search, select, site, spans, text
from sievework.plans import api, derived_queries  # noqa: F401  it registers its queries
from sievework.plans.queries import QUERIES, ensure_checkpoints
from sievework.sources import responses


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_the_entry_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "True", out.stderr


# Languages


def test_registered_tags(spark):
    known = registry.subtags()
    good = {"sv_FI": "sv-fi", "SR-cyrl-rs": "sr-cyrl-rs", "haw": "haw", "pt-076": None, "es-019": "es-019", "sl-rozaj": "sl-rozaj", "en-x-own": "en-x-own", "de-1901": "de-1901"}
    assert {t: languages.registered(t, known) for t in good} == good
    assert not any(languages.registered(t, known) for t in ("", None, "x-own", "zzz", "svenska", "sv-", "-sv", "sv-qqqq", "sv-zq", "12", "en-nonsense", "i-default"))
    assert one(spark, " SV_fi ", languages.canonical) == "sv-fi" and one(spark, "klingon", languages.canonical) is None


@pytest.mark.parametrize(("path", "tag"), [("/nl-be/x", "nl-be"), ("/aw/nl/x", "nl-aw"), ("/nl/aw", "nl-aw"), ("/nl/be", None), ("/fi/fi/", "fi-fi"), ("/se/sv", None), ("/sv/tea", "sv"), ("/tea/sv/x", "sv"), ("/tea/x/sv", None), ("/us/", None), ("/", None), ("/PT_br", "pt-br"), ("/en-xz", None), ("/nl/150", "nl-150")])
def test_languages_of_paths(spark, path, tag):
    language, region = languages.locale_of_parts(languages.path_parts(f"http://h{path}"), registry.subtags())
    assert (f"{language}-{region}" if language and region else language) == tag


def test_locales_of_files(spark):
    d = spark.createDataFrame([("http://h/aw/map-aw-nl-1.xml",), ("http://h/nl/map-it.xml",), ("http://h/us/map.xml",), ("http://h/map_pt-mz.xml",)], "u string").select(languages.url_locale(F.col("u")).alias("l"))
    assert [tuple(r["l"]) for r in d.collect()] == [("nl", "aw"), ("nl", None), (None, "us"), ("pt", "mz")]
    assert [r[0] for r in d.select(languages.market_rank(F.col("l"), "AW", ["nl"])).collect()] == [0, 2, 2, 2]


def test_addresses_of_other_countries(spark):
    d = spark.createDataFrame([("http://h/en-gb/x",), ("http://h/fr/x",), ("http://h/sv/x",), ("http://h/x",), ("http://h/fr-fr/",), ("http://h/cd/fr/",)], "u string")
    assert [r[0] for r in d.select(site.declares_other_country(F.col("u"), "FR", "fr")).collect()] == [True, False, True, False, False, True]


def test_fields_that_are_remembered(spark):
    l = spark.createDataFrame([(1, "http://h/a/#x", 0.5), (1, "http://h/b", 0.5), (2, "http://h/a", 0.5)], "s int, url string, p double")
    m = spark.createDataFrame([(1, "http://h/a", 0.2), (1, "http://h/a", 0.8)], "s int, key string, f double")
    assert rows(links.field_scored(l, m, "s"), "s", "p") == [(1, 0.5), (1, pytest.approx(0.62)), (2, 0.5)]


def test_replies_of_the_service(spark):
    body = json.dumps({"answers": {"a": {"noul": 0.7}, "b": {"choice": "x", "confidence": 0.6, "probabilities": {"x": 0.6, "y": 0.4}}}, "usage": {"input_tokens": 12}})
    got = scoring.answers_of(spark.createDataFrame([(1, body), (2, "no"), (3, None), (4, "{}")], "req int, body string"), "req").orderBy("id").collect()
    assert [(x["req"], x["id"], x["noul"], x["choice"], x["probabilities"], x["tokens"]) for x in got] == [(1, "a", 0.7, None, None, 12), (1, "b", None, "x", {"x": 0.6, "y": 0.4}, 12)]


def test_relations_markets_and_places(spark):
    d = spark.createDataFrame([("nl-be",), ("nl",), ("nl-nl",), ("fr-be",), (None,)], "t string")
    t = F.col("t")
    got = d.select(languages.relation(t, F.lit("nl")), languages.market(t, "BE"), languages.place(t, F.lit("nl"), "BE"), languages.market(t, None), languages.region(t)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 1, "be"), (0, 1, 2, 1, None), (1, 2, 5, 1, "nl"), (3, 0, 7, 1, "be"), (2, 1, 6, 1, None)]
    likely = spark.createDataFrame([("pt", "BR"), ("sv", "FI"), ("qq", "GB")], "l string, r string").select(languages.likely_region(F.col("l")), languages.likely_language(F.col("r"))).collect()
    assert [tuple(r) for r in likely] == [("br", "pt"), ("se", "fi"), (None, None)]


@pytest.mark.parametrize(("header", "want"), [("sv-FI, sv;q=0.2, fi;q=0.7", ["sv", "fi"]), ("fi;q=0.5;q=1, nl;x=1;Q=0.6", ["nl", "fi"]), ("nl;q=0, *, suomi, fi;q=2", ["fi"]), ("", []), (" haw ;q= 0.1 ,sv;q=x", ["sv", "haw"])])
def test_accepted_languages(spark, header, want):
    d = site.accepted(spark.createDataFrame([(1, header)], "id int, header string"))
    assert [r["language"] for r in d.orderBy("place").collect()] == want


def test_market_alternates(spark):
    tags = ["nl-nl", "fr-be", "nl-be", "de-be", "x-default"]
    a = spark.createDataFrame([(1, i, t, f"http://h/{t}") for i, t in enumerate(tags)], "p int, i int, hreflang string, url string")
    pick = lambda country, spoken: [r["tag"] for r in site.market_alternate(a, "p", country, spoken).collect()]
    assert pick("BE", ["de", "nl"]) == ["de-be"] and pick("be", ["sv"]) == ["nl-be"] and pick("BE", []) == ["nl-be"] and pick("NL", ["fr"]) == ["nl-nl"] and pick("SE", ["sv"]) == []


def test_copies_in_other_languages(spark):
    rows_ = ["http://h/nl/a", "http://h/fr/a", "http://h/a", "http://h/nl/b", "http://h/b", "http://h/pl/c", "http://h/fr/c", "http://h/be/d"]
    d = spark.createDataFrame([(1, i, u) for i, u in enumerate(rows_)], "g int, i int, url string")
    kept = lambda own, *asked: [i for _, i in rows(links.without_language_copies(d, "g", languages.path_copy(F.col("url")), F.lit(own), list(asked)), "g", "i")]
    assert kept("fr") == [1, 4, 6, 7] and kept("fr", "nl") == [0, 1, 3, 4, 6, 7] and kept(None) == [2, 4, 5, 6, 7]


@pytest.mark.parametrize(("host", "own"), [("a.b.co.uk", "b.co.uk"), ("co.uk", None), ("x.github.io", "x.github.io"), ("shop.example.com.mx", "example.com.mx"), ("a.b.ck", "a.b.ck"), ("www.ck", "www.ck"), ("localhost", None), ("10.1.2.3", None), ("[::1]", None), ("h.unknowntop", "h.unknowntop"), ("h.example:8080", "h.example")])
def test_registrable_domains(spark, host, own):
    assert one(spark, host, urls.registrable) == own


def test_reachable_addresses(spark):
    ends = {"http://h/a.mov": True, "http://h/a.PDF": False, "http://h/a.woff2": True, "http://h/pdf": True, "ftp://h/": False, "http://h/a.jpeg?x": False, "http://h/xpdf": True}
    got = spark.createDataFrame([(u,) for u in ends], "u string").select("u", links.reachable(F.col("u"))).collect()
    assert dict(map(tuple, got)) == ends


# Votes, folds, measures


def test_spans_of_one_range_are_no_votes(spark):
    s = spark.createDataFrame([(1, 0, 0, 2, 5, 0.4, 3), (1, 1, 0, 2, 5, 0.3, 3), (1, 2, 0, 0, 9, 0.2, 9), (1, 3, 1, 2, 5, 0.1, 3)], "g int, i int, block int, start int, end int, p double, length int")
    assert select.best_with_vote(s, "g").first()["share"] == pytest.approx(0.6)
    assert rows(select.nested_vote(s, ["g", "block"]), "i", "share") == [(0, 0.6), (1, 0.5), (2, 0.9), (3, 0.1)]


def test_folds_start_anew_and_keep_columns(spark):
    r = random.Random(1)
    data = [(g, i, r.randrange(9) if r.random() < 0.9 else None) for g in (None, "a", "b") for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, n int").repartition(7)

    def step(state, n):
        total = (state or 0) + (n or 0)
        return (0 if total > 20 else total), (total,)

    want, state, last = {}, None, 0
    for g, i, n in sorted(data, key=lambda x: (x[0] or "", x[1])):
        state = None if g != last else state
        state, (t,) = step(state, n)
        want[g, i], last = t, g
    out = fold.folded(df, "g", ["i"], step, "total int", n=F.col("n"))
    assert out.columns == ["g", "i", "n", "total"] and {(x["g"], x["i"]): x["total"] for x in out.collect()} == want
    assert fold.folded(df.limit(0), "g", ["i"], step, "total int", n=F.col("n")).count() == 0


def test_excerpts_need_only_the_first_rows(spark):
    df = spark.createDataFrame([(g, i, "x" * (i % 7) if i % 5 else None) for g in (1, 2) for i in range(300)], "g int, i int, text string")
    full = "\n".join("x" * (i % 7) if i % 5 else "" for i in range(300))
    got = [r["excerpt"] for r in text.excerpt(df, "g", chars=50).collect()]
    assert len(got) == 2 and all(len(x) == 50 and x.replace("\n", "") == full.replace("\n", "")[: len(x.replace("\n", ""))] for x in got)


def test_an_excerpt_may_end_with_the_line_break_before_the_next_text(spark):
    texts = [(1, 1, "c" * 9), (1, 0, "ab"), (2, 0, "ab"), (2, 1, None), (3, 0, "ab"), (3, 1, ""), (3, None, "z"), (4, 0, None), (5, 0, "abc"), (5, 1, "d")]
    df = spark.createDataFrame([(g, i, t) for g, i, t in texts], "g int, i int, text string")
    assert rows(text.excerpt(df, "g", chars=3), "g", "excerpt") == [(1, "ab\n"), (2, "ab"), (3, "ab\n"), (4, None), (5, "abc")]


def test_spearman(spark):
    a = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([1, 2, 3, 3])] + [(2, 0, 1.0), (2, 1, 1.0)], "g int, k int, p double")
    b = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([4, 3, 2, 1, 9])] + [(2, 0, 1.0), (2, 1, 2.0)], "g int, k int, p double")
    got = {r["g"]: (r["n"], r["spearman"]) for r in metrics.spearman(a, b, "g", "k").collect()}
    assert got[1] == (4, pytest.approx(-0.948683, abs=1e-6)) and got[2] == (2, None)


def test_settled_requests(spark):
    d = spark.createDataFrame([(1, 1, 429, "9", None), (1, 2, 529, "b", "7"), (1, 3, 200, "c", None), (2, 1, 500, "x", None), (3, 1, 429, "x", None), (3, 2, 429, "x", None), (3, 3, 429, "last", None), (3, 4, 200, "never", None)], "r int, attempt int, status int, body string, retry_after string")
    assert rows(scoring.settled(d, "r"), "r", "status", "body", "attempts", "waited") == [(1, 200, "c", 3, pytest.approx(5.3)), (2, 500, "x", 1, 0.0), (3, 429, "last", 3, pytest.approx(0.9))]


# Searches


def plain_search(edges, scores, start, most, bar, width, blocked=(), hints=None, choices=None):
    """One search, step by step."""
    long = most >= 10
    leads = [(start, max(hints.get(start, 0), 0.3) if hints is not None else 1.0, 1.0, [])]
    read, seen, known = [], set(), set()
    while len(read) < most:
        kept, keys = [], set()
        for x in sorted(leads, key=lambda l: -l[1]):
            if x[0] not in seen and x[0] not in keys and x[0] not in blocked:
                keys.add(x[0])
                kept.append(x)
        best = max([r[4] for r in read if r[5]], default=None)
        if not kept or best is not None and kept[0][1] <= best + 0.15 or kept[0][1] < 0.02:
            break
        n, short = min(width, most - len(read)), kept[:10]
        if choices and not long and len(short) > n:
            short.sort(key=lambda x: -choices.get(x[0], -1))
        for url, worth, p, path in short[:n]:
            own, way = scores.get(url, 0.0), [*path, url]
            seen.add(url)
            read.append((url, way, worth, own, own * worth, own >= bar))
            out = [e for e in edges if e[0] == url and not (len(e) > 4 and e[4] and e[1] in known)]
            top = max([e[2] for e in out], default=0)
            heat = 1.0 if len(way) == 1 else 0.3 + 0.7 * max(own, top, min(1.0, top / max(p, 0.05)))
            leads += [(e[1], e[2] * 0.85 ** (len(way) - 1) * heat, e[2], way) for e in out]
        for r in read:
            known |= {e[1] for e in edges if e[0] == r[0] and len(e) > 4 and e[4]}
        if hints is not None and len(read) == 1:
            leads += [(u, p, p, [start]) for u, p in hints.items() if u != start]
    return read


@pytest.mark.parametrize("case", range(2))
def test_searches_side_by_side_equal_one_after_another(spark, case):
    ensure_checkpoints(spark)
    r = random.Random(case)
    names = [f"http://h/{i}" for i in range(30)]
    edges = [(a, b, round(r.random(), 6), i, False) for a in names for i, b in enumerate(r.sample(names, 4))]
    scores = {u: round(r.random() * 0.9, 6) for u in names if r.random() < 0.9}
    blocked = r.sample(names, 5) if case == 0 else []
    hints = {u: round(r.random(), 6) for u in r.sample(names, 6)} if case == 1 else None
    choices = {u: round(r.random(), 6) for u in names} if case == 0 else None
    starts = [u for u in names[:4] if u not in blocked]
    most, bar = (5, 0.8) if case == 0 else (11, 0.85)
    e = spark.createDataFrame(edges, "src string, dst string, p double, pos int, menu boolean")
    s = spark.createDataFrame(list(scores.items()), "url string, p double")
    each = lambda d: spark.createDataFrame([(k, u, p) for k in range(len(starts)) for u, p in d.items()], "search bigint, url string, p double")
    if hints:
        for k, st in enumerate(starts):
            hints.setdefault(st, 0.1)
    out = search.follow(e, s, spark.createDataFrame(list(enumerate(starts)), "search bigint, url string"), most, bar, hints=each(hints) if hints else None, blocked=spark.createDataFrame([(u,) for u in blocked], "url string") if blocked else None, choices=each(choices) if choices else None).collect()
    for k, st in enumerate(starts):
        want = plain_search(edges, scores, st, most, bar, 3 if most >= 10 else 2, blocked, hints, choices)
        got = [x for x in out if x["search"] == k]
        assert sorted((x["url"], tuple(x["path"]), round(x["lead"], 9), round(x["rank"], 9), x["found"]) for x in got) == sorted((u, tuple(w), round(l, 9), round(rk, 9), f) for u, w, l, _, rk, f in want)


def test_pages_that_fail_lead_nowhere_and_budgets_end(spark):
    ensure_checkpoints(spark)
    edges = spark.createDataFrame([("s", "a", 0.9, 0), ("s", "b", 0.8, 1), ("a", "c", 0.9, 0), ("b", "d", 0.9, 0), ("d", "x", 0.9, 0)], "src string, dst string, p double, pos int")
    scores = spark.createDataFrame([("s", 0.0, None, 5.0), ("a", 0.9, "status 500", 5.0), ("b", 0.1, None, 5.0), ("d", 0.2, None, 5.0)], "url string, p double, error string, tokens double")
    read = search.follow(edges, scores, "s", most=9)
    assert rows(read, "url", "p", "found") == [("a", 0.0, False), ("b", 0.1, False), ("d", 0.2, False), ("s", 0.0, False), ("x", 0.0, False)]
    end = search.concluded(read).first()
    assert end["url"] == "d" and end["miss"] == "nothing answers on the 5 pages read"
    assert rows(search.follow(edges, scores, "s", most=9, budget=12.0), "url") == [("a",), ("b",), ("s",)]


def test_api_follow(spark):
    ensure_checkpoints(spark)
    page = lambda body, links_: f"<main><p>{body} and some more words to read</p>{''.join(f'<p><a href={u}>{t}</a></p>' for u, t in links_)}</main>"
    pages = spark.createDataFrame([(1, "http://h/", page("welcome", [("/tea", "green tea brewing"), ("/about", "about")])), (2, "http://h/tea", page("green tea brewing takes water", [])), (3, "http://h/about", page("people", []))], "page_id bigint, url string, html string")
    end = search.concluded(api.follow(pages, "green brewing water", "http://h/")).first()
    assert end["url"] == "http://h/tea" and end["path"] == ["http://h/", "http://h/tea"] and end["found"]


# Lists


def test_steps_of_lists(spark):
    def nxt(page, *others, items=None):
        df = spark.createDataFrame([(1, page, i, u, items) for i, u in enumerate(others)], "page_id int, page_url string, i int, url string, n int")
        return [r["next"] for r in paging.stepped_next(df, items="n" if items is not None else None).collect()]

    assert nxt("http://h/cups/40", "http://h/cups/20", "http://h/cups/60") == ["http://h/cups/60"]
    assert nxt("http://h/cups", "http://h/cups/15", "http://h/cups/30") == ["http://h/cups/15"]
    assert nxt("http://h/l?from=30&a=1", "http://h/l?a=1", "http://h/l?a=1&from=60", "http://h/l?a=1&from=90") == ["http://h/l?a=1&from=60"]
    assert nxt("http://h/l?from=15", "http://h/l", "http://h/l?from=30") == ["http://h/l?from=30"]
    assert nxt("http://h/l", "http://h/l?from=12", items=12) == ["http://h/l?from=12"] and nxt("http://h/l", "http://h/l?from=12", items=13) == []
    assert nxt("http://h/cups", "http://h/cups/12", items=12) == []
    assert nxt("http://h/l", "http://h/l?from=12", "http://h/l?from=24", items=16) == ["http://h/l?from=12"] and nxt("http://h/l", "http://h/l?from=12", "http://h/l?from=24", items=40) == []
    assert nxt("http://h/l", "http://h/l?limit=12", "http://h/l?limit=24") == [] and nxt("http://h/l?from=5", "http://h/l?from=5&from=9", "http://h/l?from=20251001", "http://h/l?from=20251008") == []


def test_lists_are_read_on(spark):
    ensure_checkpoints(spark)
    items = spark.createDataFrame([(p, x) for p, xs in {"a1": "xy", "a2": "yz", "a3": "z", "a4": "w", "d1": "p", "d2": "q", "d3": "r", "api": "m", "n1": "k", "n2": "l", "g2": "v"}.items() for x in xs], "page string, item string")
    link = paging.LINKED
    nexts = spark.createDataFrame([
        ("a1", 0, "a2", link, None), ("a2", 0, "a3", link, None), ("a3", 0, "a4", link, None),  # a3 shows nothing new
        ("d1", 1, "d1", paging.DATA, ["k", "n"]), ("d1", 2, "odd", paging.DATA, ["k", "n"]), ("d1", 3, "d2", paging.DATA, ["k", "n"]), ("d2", 9, "g2", paging.GUESSED, None),
        ("n1", 0, "gone", paging.PLATFORM, None), ("n1", 1, "n2", link, None), ("n2", 0, "n1", link, None), ("m1", 0, "a1", link, None),
    ], "page string, place int, next string, kind string, keys array<string>")
    shapes = spark.createDataFrame([("odd", ["z"]), ("d2", ["k"])], "page string, keys array<string>")
    starts = spark.createDataFrame([("A", "a1"), ("D", "d1"), ("N", "n1")], "list string, page string")
    read = lambda most=9, **how: {k: [p for l, n, p in rows(paging.read_pages(items, nexts, starts, most, shapes=shapes, **how), "list", "n", "page") if l == k] for k in "ADN"}
    assert read() == {"A": ["a1", "a2"], "D": ["d1", "d2"], "N": ["n1", "n2"]}
    assert read(blocked=spark.createDataFrame([("a2",), ("d2",)], "page string")) == {"A": ["a1"], "D": ["d1"], "N": ["n1", "n2"]}
    out = paging.read_pages(items, nexts, starts, 1, shapes=shapes)
    assert rows(out.where("resume IS NOT NULL"), "list", "resume") == [("A", "a2"), ("N", "n2")] or rows(out.where("resume IS NOT NULL"), "list", "resume")[0] == ("A", "a2")


def test_api_read_list(spark):
    ensure_checkpoints(spark)
    page = lambda n, *more: f"<main><p>the first thing on page number {n} is here</p><p>the other thing of page number {n} is here</p>{''.join(f'<a href={u}>next</a>' for u in more)}</main>"
    pages = spark.createDataFrame([(1, "http://h/l", page(1, "/l?page=2")), (2, "http://h/l?page=2", page(2, "/l?page=1", "/l?page=3")), (3, "http://h/l?page=3", page(2))], "page_id bigint, url string, html string")
    got = api.read_list(pages, spark.createDataFrame([(7, "http://h/l")], "list int, page string"))
    assert rows(got, "n", "page", "resume") == [(1, "http://h/l", None), (2, "http://h/l?page=2", None)]


# Bodies


def test_bodies_of_all_kinds(spark):
    atom = "<?xml version='1.0'?><feed><title>News</title><entry><title>First</title><link href='http://h/1'/><summary>a summary of what there is</summary></entry></feed>"
    md = "---\ntitle: Tarn\n---\n# Head\n\nA line with [a link](/x) and ![a cup](/c.png) in it.\n\n```\n[no](/link)\n```\n"
    cases = [
        (1, 200, "text/html", b"<title>T</title><p>some text of a page that is long enough"), (2, 200, "application/atom+xml", atom.encode()), (3, 200, "text/markdown", md.encode()), (4, 200, None, b' {"list": [{"a": 1}]}'),
        (5, 200, "text/html", b"<html><body><pre>[1, 2]</pre></body></html>"), (6, 200, "text/html", gzip.compress(b"<title>Z</title>")), (7, 200, "text/plain", b"# Plain"), (8, 503, "text/html", b"x"),
        (9, 200, "text/html", b"y" * 2000), (10, 200, "text/html", gzip.compress(b"z" * 2000)), (11, 200, "text/html", b"\x1f\x8bno"), (12, 200, None, None), (13, 200, "text/html", b"<p>x</p><pre>[1]</pre>"),
    ]
    df = spark.createDataFrame([(i, f"http://h/p{i}", s, c, b) for i, s, c, b in cases], "page_id bigint, url string, status int, content_type string, body binary")
    out = {r["page_id"]: r for r in responses.extract_responses(df, ["title", "blocks", "links", "images", "data"], most=1500).collect()}
    assert {i: r["kind"] for i, r in out.items()} == {1: "html", 2: "feed", 3: "markdown", 4: "json", 5: "json", 6: "html", 7: "markdown", 8: None, 9: None, 10: None, 11: None, 12: "html", 13: "html"}
    assert {i: r["refused"] for i, r in out.items() if r["refused"]} == {8: "status 503", 9: "too large", 10: "too large", 11: "broken gzip"}
    assert [out[i]["title"] for i in (1, 2, 3, 6, 7)] == ["T", "News", "Tarn", "Z", "Plain"]
    assert [x["url"] for x in out[3]["links"]] == ["http://h/x"] and [(x["url"], x["alt"]) for x in out[3]["images"]] == [("http://h/c.png", "a cup")]
    assert [b["kind"] for b in out[3]["blocks"]] == ["heading", "para", "code"] and json.loads(out[4]["data"][0]["value"]) == {"list": [{"a": 1}]} and out[4]["data"][0]["name"] == "json:fetch:/p4"
    assert any("a summary" in b["text"] for b in out[2]["blocks"])
    assert responses.extract_responses(df.limit(0)).count() == 0


def test_each_response_has_its_own_limit(spark):
    big = b"<title>Big</title>" + b" " * (9 << 20)
    cases = [(1, big, None), (2, big, 9 << 20), (3, big, 10 << 20), (4, gzip.compress(big), None), (5, gzip.compress(big), 9 << 20), (6, b"<title>S</title>", 5), (7, None, 5)]
    df = spark.createDataFrame([(i, "http://h/", 200, None, b, m) for i, b, m in cases], "page_id bigint, url string, status int, content_type string, body binary, m int")
    big_one, refused = ("html", None, "Big"), (None, "too large", None)
    assert rows(responses.extract_responses(df, ["title"], F.col("m")), "page_id", "kind", "refused", "title") == [(1, *big_one), (2, *refused), (3, *big_one), (4, *big_one), (5, *refused), (6, *refused), (7, "html", None, "")]
    assert {r["refused"] for r in responses.extract_responses(df, ["title"]).collect()} == {None, "too large"} and {r["refused"] for r in responses.extract_responses(df, ["title"], None).collect()} == {None}


def test_events_of_a_platform(spark):
    body = json.dumps({"events": [{"title": "Moor &amp; <i>mist</i>", "url": "http://h/e/1", "start_date": "2031-09-02", "end_date": "", "cost": "£7", "image": {"url": "http://h/i.jpg"}, "venue": {"venue": "Hall", "city": "Leck"}, "categories": [{"name": "Out"}], "excerpt": "<p>walk</p>"}, {"title": "", "venue": []}, {"title": "Two", "venue": [], "image": False}], "next_rest_url": "http://h/e?page=2"})
    got = listing.tidy_events(spark.createDataFrame([("http://h/e", body)], "url string, body string")).orderBy("i").collect()
    assert [(r["i"], r["name"], r["end_date"], r["city"], r["image"], r["next"]) for r in got] == [(0, "Moor & mist", None, "Leck", "http://h/i.jpg", "http://h/e?page=2"), (2, "Two", None, None, None, "http://h/e?page=2")] and got[0]["summary"] == "walk"


def test_endpoints_and_their_choice(spark):
    pages = spark.createDataFrame([(1, "<p class=tribe-events>"), (2, "<b>woocommerce"), (3, "x")], "page_id bigint, html string")
    kinds = spark.createDataFrame([(1, "post", "wp/v2/posts", 2), (3, "product", "wp/v2/product", 1), (3, "walk", "wp/v2/walks", 1)], "page_id bigint, slug string, route string, place int")
    c = listing.endpoints(pages, kinds)
    assert rows(c, "page_id", "place", "api", "route") == [(1, -2, "events", "tribe/events/v1/events"), (1, 2, "posts", "wp/v2/posts"), (2, -1, "products", "wc/store/v1/products"), (3, -1, "products", "wc/store/v1/products"), (3, 1, "posts", "wp/v2/walks")]
    things = spark.createDataFrame([(p, r, f"http://h/{r}/{k}") for p, r, n in ((1, "wp/v2/posts", 4), (1, "tribe/events/v1/events", 4), (3, "wp/v2/walks", 2)) for k in range(n)], "page_id bigint, route string, url string")
    shown = things.select("page_id", F.concat("url", F.lit("/")).alias("url"))
    assert rows(listing.chosen_endpoint(c, things, shown), "page_id", "route", "n") == [(1, "tribe/events/v1/events", 4)]
    assert listing.chosen_endpoint(c, things, shown, spark.createDataFrame([(1, 4)], "page_id bigint, n int")).count() == 0


def test_files_of_a_site_and_of_linked_hosts(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>http://d.moor.co.uk/{k}.xml</loc><lastmod>203{k}-01-01</lastmod></sitemap>" for k in range(5)) + "</sitemapindex>"
    child = lambda k: f"<urlset><url><loc>http://d.moor.co.uk/page{k}</loc></url><url><loc>http://other.org/{k}</loc></url></urlset>"
    files = [("http://d.moor.co.uk/llms.txt", "# D\n- [Deep one](/a/b/c)\n- [Deep one](http://d.moor.co.uk/a/b/c#x)"), ("http://d.moor.co.uk/sitemap.xml", index), *((f"http://d.moor.co.uk/{k}.xml", child(k)) for k in range(5)), ("http://d.moor.co.uk/x", "<html>no")]
    r = spark.createDataFrame([("d.moor.co.uk", u, 200, b) for u, b in files] + [("gone.moor.co.uk", "http://gone.moor.co.uk/llms.txt", 404, "[a](/b)")], "host string, url string, status int, body string")
    own = listing.site_files(r, "host").orderBy("place").select("url").collect()
    assert [x[0] for x in own][0] == "http://d.moor.co.uk/a/b/c" and {x[0] for x in own[1:]} == {f"http://{h}" for k in (2, 3, 4) for h in (f"d.moor.co.uk/page{k}", f"other.org/{k}")}
    l = spark.createDataFrame([(1, "http://www.moor.co.uk/", i, u) for i, u in enumerate(["http://d.moor.co.uk/1", "http://d.moor.co.uk/2", "http://gone.moor.co.uk/", "http://fen.co.uk/"])], "page_id int, page_url string, i int, url string")
    got = listing.linked_site_files(l, r, "page_id")
    assert {x["url"] for x in got.collect()} == {"http://d.moor.co.uk/a/b/c", *(f"http://d.moor.co.uk/page{k}" for k in (2, 3, 4))}


def test_files_of_a_large_site_are_read_whole(spark, tmp_path):
    k = (F.col("id") % 2400).cast("string")
    spark.range(2500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/p"), k).alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(QUERIES["site_file_links"](spark, str(tmp_path)), "host", "n", "llms") == [("h.org", 2400, 1200)]
    long = "".join(f"- [a](http://h.org/{i})\n" for i in range(400))
    r = spark.createDataFrame([("h.org", "http://h.org/llms.txt", 200, long)], "host string, url string, status int, body string")
    assert [listing.site_files(r, "host", cap=c, most=m).count() for c, m in ((300, None), (None, None), (None, 1000))] == [300, 400, 0]


# Answers


def test_refined_options_and_context(spark):
    quote = "The old mill by the tarn was built in 1874 by Maja Lind, and burnt down in 1931."
    d = spark.createDataFrame([(1, quote, 0, len(quote), None), (2, "1874", 0, 4, None), (3, quote, 0, len(quote), "labelled")], "page_id int, quote string, start int, end int, label string")
    inside = spark.createDataFrame([(1, 0, 38, 42)], "page_id int, i int, start int, end int")
    o = spans.refine_options(d, inside).orderBy("k").collect()
    assert {r["page_id"] for r in o} == {1} and o[0]["text"] == quote and o[1]["text"] == "1874" and len(o) <= spans.MOST_PIECES + 1 and len({(r["start"], r["end"]) for r in o}) == len(o)
    assert all(quote[r["start"] : r["end"]] == r["text"] for r in o) and "Maja Lind" in {r["text"] for r in o}
    t = "| cup | price |\n|---|---|\n| red | 3 |\n| blue | 4 |"
    c = answers.in_context(spark.createDataFrame([(t, "table", t.index("4"), None, None), ("b", "item", 0, ["a", "b"], 1), (t, "code", 1, None, None)], "quote string, kind string, start int, items array<string>, hot int")).collect()
    assert [(r["context"], r["cut"], r["table_quote"]) for r in c] == [(t, False, "| cup | price |\n| blue | 4 |"), ("a\nb", False, None), (None, None, None)]


def test_answers_have_context_and_pieces(spark):
    table_ = "<table><tr><th>cup<th>price<tr><td>red<td>3 crowns<tr><td>blue<td>4 crowns</table>"
    pages = spark.createDataFrame([(1, "http://h/", f"<main><p>Cups of all colours are sold here daily.</p>{table_}</main>")], "page_id bigint, url string, html string")
    r = api.precise(pages, "blue crowns price").first()
    assert r["table_quote"].startswith("| cup | price |") and r["quote"].count("\n") == 2 and r["context"] == r["quote"] and r["link"].startswith("http://h/#:~:text=")
    long = spark.createDataFrame([(1, "http://h/", "<main><p>The mill that stands beside the tarn in the fells above the village was built by Maja Lind.</p></main>")], "page_id bigint, url string, html string")
    assert len(api.precise(long, "which mill stands beside the tarn", refine=True).first()["answer"]) <= len(api.precise(long, "which mill stands beside the tarn").first()["answer"])


def test_the_longest_line_names_its_image(spark):
    blocks = spark.createDataFrame([(1, 0, "para", "Cups\nthe large blue cup here\nsmall"), (1, 1, "heading", "small"), (1, 2, "para", "other")], "page_id int, i int, kind string, text string")
    pics = spark.createDataFrame([(1, 0, "", "small"), (1, 1, "", "The large blue cup here"), (1, 2, "", "other")], "page_id int, i int, caption string, alt string")
    assert rows(images.attach(pics, blocks), "i_image", "i_block") == [(0, 1), (1, 0), (2, 2)]


def test_modes_are_checked():
    assert api.checked(["ask"], "what") == "ask" and api.checked(["gist"]) == "gist"
    for modes, q in (([], None), (["ask", "gist"], "x"), (["nothing"], None), (["ask"], " "), (["gist"], "x")):
        with pytest.raises(ValueError, match="mode|question|go with"):
            api.checked(modes, q)


def test_lines_finds_and_dumps(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<title>T</title><main><p>Red cups are on the upper shelf here.</p><p>Blue cups stand on the lower shelf.</p></main>")], "page_id bigint, url string, html string")
    assert "lower" in api.with_line(pages, "blue lower").first()["text"] and [r["i"] for r in api.find(pages, "CUPS lower").collect()] == [1] and api.find(pages, "").count() == 0
    assert api.dump(pages).first()["text"].startswith("# T\n\n<http://h/>\n\nRed cups")
