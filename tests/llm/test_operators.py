import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, fm_index, graph, language_id, mixing, mpeg_audio, near_duplicates, quality_classifier, quality_rules, substring_dedup, token_counts, warc, word_hashes
from sievework.llm.common import shared_dir

from . import brute

ODD = [None, "", " ", "\t\n\x0b\x0c\r", "x", "x", "a b c", "A B C", "I'm   here\n\n  you'll x ​ ½ x² ١٢٣ 你好 😀  ", "a  <|endoftext|>  b", "\U0001fae8 new ͸ ", "#$% " * 60, "same line here\n" * 9, "z " * 3000, "\x1c\x1f\x85 end"]


def prose(seed, n=120, words=400):
    r = random.Random(seed)
    return " ".join(f"w{int(words * r.random() ** 2)}" for _ in range(n))


def corpus():
    base = prose(1)
    w = base.split()
    near = [" ".join(x if i != 7 * k else f"edit{k}" for i, x in enumerate(w)) for k in range(1, 9)]
    return [*ODD, base, base, *near, "lead " + " ".join(w[30:75]) + " tail", *(prose(s) for s in range(2, 12)), prose(2) + "\n" + prose(3), "Aé ÀÉ " + prose(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 4}" if i % 5 else None, ["en", "fr", None][i % 3], -1) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_words int").repartition(5)


def as_dict(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("operator", [token_counts.token_counts, bpe.digest_columns, near_duplicates.near_duplicates, substring_dedup.digests, quality_rules.judge, mixing.mix, lambda d: mpeg_audio.read_media(mpeg_audio.with_media(d)), quality_classifier.document_statistics])
def test_empty_tables_null_ids_and_repeated_rows(docs, operator):
    assert operator(docs.limit(0)).count() == 0
    odd = docs.where("doc_id < 16").withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert operator(odd.union(odd.where("doc_id = 5"))).count() == 17


def test_token_counts_equal_longest_match(docs):
    vocabulary = set(bpe.pieces(bpe.vocabulary_path()))
    most = max(map(len, vocabulary))
    got = as_dict(token_counts.token_counts(docs), "n_words", "n_tokens")
    for i, t in enumerate(corpus()):
        w = brute.WORD.findall(t or "")
        assert got[i] == (len(w), sum(brute.longest_match(b" " + x.encode(), vocabulary, most) for x in w))


def test_automaton_on_random_vocabularies():
    r = random.Random(1)
    for _ in range(300):
        voc = {bytes(r.choice(b"ab") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))}
        a = token_counts.Automaton(voc)
        for _ in range(30):
            w = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
            assert a.count(w) == brute.longest_match(w, voc)


def test_automaton_equals_the_library():
    from tokenizers.models import WordPiece

    voc = ["[UNK]", "un", "##aff", "##able", "##a", "##b", "##l", "##e", "##f", "##u", "##n", "u"]
    model = WordPiece({v: i for i, v in enumerate(voc)}, unk_token="[UNK]", max_input_chars_per_word=100)
    # a mark before the word tells first pieces from later ones
    a = token_counts.Automaton([b"^" + v.encode() for v in voc if v[0] not in "[#"] + [v[2:].encode() for v in voc if v[0] == "#"])
    for w in ("unaffable", "unable", "uun", "un", "unx", "unaffu"):
        pieces = [t.value for t in model.tokenize(w)]
        assert (a.count(b"^" + w.encode()) or 1) == len(pieces)


def test_counts_with_first_and_continuing_pieces(spark, tmp_path):
    from tokenizers.models import WordPiece

    voc = ["[UNK]", "the", "t", "##he", "##h", "##e", "ca", "##t", "##s", "é", "##é"]
    (tmp_path / "pieces.txt").write_text("\n".join(voc) + "\n", encoding="utf-8")
    model = WordPiece({v: i for i, v in enumerate(voc)}, unk_token="[UNK]", max_input_chars_per_word=100)
    texts = ["the cats the", "éé  theé\ncat", "dog the", "hes", "", None, "t" * 3000 + " the"]
    got = as_dict(token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path=str(tmp_path / "pieces.txt"), continuing="##"), "n_tokens")
    assert got == {i: (sum(len(model.tokenize(w)) if len(w) < 100 else len(w) for w in brute.WORD.findall(t or "")),) for i, t in enumerate(texts)}


def occurrences(text, p):
    return [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


@pytest.mark.parametrize("longest", [1, 6, 9])
def test_matching_statistics_equal_brute_force(longest):
    r = np.random.default_rng(longest)
    parts = [r.integers(2, 5, n) for n in (40, 1, 25, 60)] + [np.full(30, 3), np.tile([2, 3, 4], 12)]
    text = np.append(np.concatenate([np.append(p, 1) for p in parts]), 0)
    index, plain = fm_index.FMIndex(text, 6, longest), text.tolist()
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
    assert [plain[i:] for i in index.locate(np.arange(len(text)))] == sorted(plain[i:] for i in range(len(text)))
    stream = np.concatenate([r.integers(2, 6, 50), parts[3][5:30], r.integers(2, 5, 40), parts[5]])  # 5 occurs nowhere
    for other, cuts in ((stream, [(0, 50), (50, 90), (90, len(stream))]), (text, [(0, 40), (42, 67)])):
        first, after = (np.array(x) for x in zip(*cuts))
        length, lo, hi = index.statistics(other, first, after)
        for a, z in cuts:
            for i in range(a, z):
                n, p = int(length[i]), other[i : i + int(length[i])].tolist()
                found = occurrences(plain, p) if n else []
                assert n <= min(longest, z - i) and (not n or sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) == found and found)
                assert n == min(longest, z - i) or not occurrences(plain, other[i : i + n + 1].tolist())


def test_repeats_in_long_segments(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 7)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3)}"
    for _ in range(30):
        texts = [" ".join(word() for _ in range(r.randint(4, 60))) for _ in range(5)]
        ids, indexed = np.array([3, 1, 4, 1, 5]), np.array([r.random() < 0.7 for _ in range(5)])
        starts = np.array([0, 0, 0, 100, 0])
        first = {}
        for i, s, t, k in zip(ids, starts, texts, indexed):
            w = t.split()
            for j in range(len(w) - 3):
                if k:
                    first[tuple(w[j : j + 4])] = min(first.get(tuple(w[j : j + 4]), (9, 0)), (i, s + j))
        want = {(i, s + j) for i, s, t in zip(ids, starts, texts) for w in [t.split()] for j in range(len(w) - 3) if first.get(tuple(w[j : j + 4]), (9, 0)) < (i, s + j)}
        got = {(i, j) for i, a, b in substring_dedup.repeats(ids, starts, [t.encode() for t in texts], indexed, 4) for j in range(a, b - 3)}
        assert got == want


def test_wavelet_matrix_rank():
    x = np.random.default_rng(2).integers(0, 11, 500)
    m = fm_index.WaveletMatrix(x, 11)
    at = np.arange(501)
    for c in range(11):
        assert (m.rank(np.full(501, c), at) == np.concatenate(([0], np.cumsum(x == c)))).all()
    symbol, before = m.read(np.arange(500))
    assert (symbol == x).all() and all(before[i] == (x[:i] == x[i]).sum() for i in range(500))


@pytest.mark.parametrize(("shard", "hot"), [(1_000_000, 40_000), (40, 40_000), (1_000_000, 2), (30, 1)])
def test_substring_dedup_equals_brute_force(docs, monkeypatch, shard, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    got = as_dict(substring_dedup.digests(docs), "n_words", "n_removed", "kept_sha256")
    for i, (w, keep) in brute.without_repeats(enumerate(corpus())).items():
        assert got[i] == (len(w), keep.count(False), brute.sha(" ".join(x for x, k in zip(w, keep) if k).encode())), i


def test_repeats_inside_one_text(spark):
    rows = [(1, "a b " * 40), (2, "z " * 100), (3, "q " + "z " * 25), (4, prose(5) + " " + prose(5)), (5, " ".join(map(str, range(19)))), (6, " ".join(map(str, range(19))))]
    got = as_dict(substring_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_removed")
    assert {i: (k.count(False),) for i, (_, k) in brute.without_repeats(rows).items()} == got


def test_rows_without_id_are_documents_of_their_own(spark):
    text, other = prose(1, 60), prose(2, 30)
    rows = [(None, text), (None, text), (None, other + " " + prose(3, 30)), (5, "lead " + text), (6, other), (None, None)]
    out = substring_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in out) == [(0, 0, 0), (0, 60, 0), (0, 60, 0), (0, 60, 0), (5, 61, 60), (6, 30, 30)]


def test_texts_without_repeats_stay_as_they_are(docs):
    got = as_dict(substring_dedup.without_repeats(docs), "text", "n_words")
    for i, (w, keep) in brute.without_repeats(enumerate(corpus())).items():
        assert got[i] == (corpus()[i] if all(keep) else " ".join(x for x, k in zip(w, keep) if k), -1)


@pytest.mark.parametrize("how", [{}, {"leaf": 3, "block": 400}, {"trees": 12, "leaf": 2, "deepest": 9}])
def test_near_duplicates_equal_brute_force(docs, how):
    got = as_dict(near_duplicates.near_duplicates(docs, **how), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(enumerate(corpus()))


def test_large_groups_are_linked_through_hubs(spark):
    w = prose(9, 60).split()
    rows = [(i, " ".join(w[: 59 - i % 7] + [f"t{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_dict(near_duplicates.near_duplicates(df, block=300, leaf=8), "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)


@pytest.mark.parametrize("deepest", [2, 3])
def test_sparse_links_in_a_large_node(spark, deepest):
    passage, folder = prose(9, 38), shared_dir(spark)
    rows = [(i * 7 % 300, " ".join([passage, *(f"o{i // 2}x{k}" for k in range(21)), f"end{i}"])) for i in range(300)]
    classes = near_duplicates.sketch(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumnRenamed("doc_id", "cls").cache()
    label = dict(map(tuple, graph.components(near_duplicates.candidates(classes, folder, trees=2, leaf=8, deepest=deepest), folder).collect()))
    sig, nodes, pairs = {r["cls"]: np.frombuffer(r["sig"], np.uint16) for r in classes.collect()}, {}, 0
    for r in near_duplicates.roots(classes, 2, deepest).collect():
        nodes.setdefault(r["key"], set()).add(r["cls"])
    assert max(map(len, nodes.values())) > 60
    for own in nodes.values():
        for x in own:
            for y in own:
                if x > y and (sig[x] == sig[y]).mean() >= near_duplicates.BAR:
                    pairs += 1
                    assert label[x] == label[y]
    assert pairs > 50


def family(pairs, shared, own, seed=3):
    """Pairs of similarity 0.75 to 0.76 among texts that share a passage and are far less alike otherwise."""
    r, rows = random.Random(seed), []
    common = " ".join(f"c{i}" for i in range(shared))
    for p in range(pairs):
        words = [f"p{p}w{i}" for i in range(own)]
        n = shared + own - 4
        # k edits of one word near the end cost up to 5 shingles each: as many as leave 0.75
        for side in range(2):
            w = list(words)
            if side:
                for e in range(max(1, int(n * 0.135 / 5))):
                    w[own - 3 - 6 * e] = f"e{p}x{e}"
            rows.append((2 * p + side, f"{common} {' '.join(w)}"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf", [4, 4096])
def test_recall_does_not_depend_on_the_size_of_nodes(spark, leaf):
    rows = family(150, 60, 60)
    a, b = (set(brute.shingles(rows[[i for i, _ in rows].index(k)][1])) for k in (0, 1))
    assert 0.75 <= len(a & b) / len(a | b) < 0.8
    got = as_dict(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), leaf=leaf), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(rows)


def test_trees_follow_from_the_target_recall():
    assert near_duplicates.extinction() == pytest.approx(1 / 9) and near_duplicates.trees_for() == 4
    assert [near_duplicates.trees_for(t) for t in (0.5, 0.95, 0.999999)] == [1, 2, 7]
    r = np.random.default_rng(4)
    for depth in (2, 6):
        lost = 0
        for k in range(200):
            a = r.integers(0, 1 << 16, near_duplicates.COORDINATES, dtype=np.uint16)
            other = np.where(r.random(len(a)) < 0.75, a, r.integers(0, 1 << 16, len(a), dtype=np.uint16))
            nodes = [set(), set()]
            for own, sig in zip(nodes, (a, other)):
                row, node = np.zeros(1, int), near_duplicates.mixed(np.array([k + 1], np.uint64))
                for _ in range(depth):
                    up, node = near_duplicates.step(node, np.tile(sig, (len(node), 1)))
                own.update(node.tolist())
            lost += not nodes[0] & nodes[1]
        assert lost / 200 < 0.19  # 1 / 9 in the limit, for one tree


def test_rows_without_id_are_deduplicated(spark):
    text, near, other = prose(3, 60), prose(3, 60) + " end", prose(4, 60)
    rows = [(None, text, 1), (None, text, 2), (None, text.upper(), 3), (7, near, 4), (None, other, 6), (None, other, 5), (None, " ", 7), (None, None, 8), (None, None, 9), (3, other + " more", 10), (None, prose(8, 60), 12), (None, prose(8, 60), 11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k int")
    assert sorted(r["k"] for r in near_duplicates.deduplicated(df).collect()) == [4, 7, 8, 9, 10, 11]
    out = near_duplicates.near_duplicates(df).collect()
    assert {(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None} == {(7, False), (3, False), (None, True)}


def test_extra_columns_that_clash(docs):
    names = ["_id", "row", "seg", "segs", "full", "part", "new", "_raw", "size", "h", "k", "a", "name", "unnamed", "position", "fp", "cls", "n", "kept", "t", "m", "token_ids", "before", "target", "copies", "component_id", "id", "with space", "Rank"]
    odd = docs.where("doc_id > 3").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for operator in (substring_dedup.without_repeats, near_duplicates.deduplicated, quality_rules.keep, mixing.mixed_documents):
        out = operator(odd)
        assert out.columns == odd.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(names))
    assert set(bpe.encode(odd).columns) == set(odd.columns)
    for operator in (substring_dedup.digests, near_duplicates.near_duplicates, quality_rules.judge, mixing.mix, token_counts.token_counts, bpe.digest_columns, quality_classifier.document_statistics, mpeg_audio.with_media):
        assert operator(odd).count() == odd.count()


def test_deduplicated_keeps_columns(docs):
    kept = near_duplicates.deduplicated(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, x in brute.near_duplicates(enumerate(corpus())).items() if x[2]}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 8), (20, 21), (7, 7), (4, 5)], "a bigint, b bigint")
    assert sorted(map(tuple, graph.components(edges, shared_dir(spark)).collect())) == [(3, 3), (4, 3), (5, 3), (8, 3), (9, 3), (20, 20), (21, 20)]
    assert graph.components(edges.limit(0), shared_dir(spark)).count() == 0


def test_mixing(docs):
    m = mixing.mix(docs, range_rows=3).collect()
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in enumerate(corpus())}
    assert {r["doc_id"]: r["size"] for r in m} == sizes
    by = {}
    for r in m:
        by.setdefault(r["source"], []).append(r)
    total = sum(sizes.values())
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    cap = {s: 3 * sum(r["size"] for r in rs) for s, rs in by.items()}
    target, full = {}, set()
    while True:  # share out, hold the full ones at their ceiling, share the rest again
        left = total - sum(cap[s] for s in full)
        w = sum(weights[s] for s in by if s not in full)
        target = {s: cap[s] if s in full else left * weights[s] / w for s in by}
        more = {s for s in by if target[s] > cap[s]}
        if not more:
            break
        full |= more
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(target[s]) and abs(sum(r["taken"] for r in rs) - target[s]) <= 1
        assert all(r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0) for r in rs)
        assert all(0 <= r["position"] <= 1 for r in rs if r["position"] is not None)
        assert all((r["last_position"] is None) == (r["copies"] == 0) and (not r["taken"] or r["copies"] != 1 or r["last_position"] == r["position"]) and (not r["taken"] or r["copies"] < 2 or r["last_position"] > r["position"]) for r in rs)
    again = mixing.mix(docs.repartition(2), range_rows=1000).collect()
    assert {(r["doc_id"], r["taken"], r["position"]) for r in m} == {(r["doc_id"], r["taken"], r["position"]) for r in again}


def test_mixing_sources_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, "x y z", "c"), (4, " ", None)], "doc_id bigint, text string, source string")
    assert as_dict(mixing.mix(df), "target", "taken", "position") == {1: (0.0, 0, None), 2: (0.0, 0, None), 3: (3.0, 3, 0.0), 4: (0.0, 0, None)}
    assert [r["doc_id"] for r in mixing.mixed_documents(df).collect()] == [3] and mixing.mix(df.where("doc_id <> 3")).where("taken > 0").isEmpty()


def test_mixed_documents_are_in_order_and_whole(docs):
    m = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert dict(out.groupBy("doc_id").count().collect()) == {i: c for i, c in m.items() if c}


def test_positions_invert_the_schedules(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("x"))
    for k, knots in enumerate(mixing.SCHEDULES):
        t = np.linspace(0, 1, 20001)
        rate = np.interp(t, *zip(*knots))
        area = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(t))))
        got = np.array([r[0] for r in df.select(mixing.position(F.lit(k), F.col("x"))).collect()])
        assert np.abs(np.interp(got, t, area / area[-1]) - np.linspace(0, 1, 101)).max() < 1e-4


def test_quality_rules(docs):
    got = as_dict(quality_rules.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {i: brute.quality(t) for i, t in enumerate(corpus())}
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}


def test_verdicts_equal_brute_force(docs):
    import unicodedata

    def good(t):
        n, chars, symbols, dup, rep = brute.quality(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" ")]
        kinds = [unicodedata.category(c) for c in t or ""]
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or not 2 * n <= chars <= 14 * n or (dup >= 3 and 2 * dup > len(lines))
                    or 10 * sum(k[0] == "L" for k in kinds) < 6 * chars or 2 * sum(k == "Lu" for k in kinds) > chars)

    letters = str.maketrans("0123456789", "abcdefghij")
    plain = [prose(s).translate(letters) for s in range(20, 26)]
    texts = [*corpus(), *plain, plain[0].upper(), "# " * 40 + plain[1], "\n".join([plain[2][:90]] * 4 + [plain[3]]), " ".join(x * 9 for x in plain[4].split()), "AB CD EF " * 30 + prose(1).upper(), "1234 " * 10 + " ".join(str(i * 7919) for i in range(90)), ("one two " + prose(2, 8) + "\n") * 3 + prose(4, 9), "x" * 2000 + " " + prose(3, 60), prose(6, 60) + " #" * 30]
    d = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i for i, t in enumerate(texts) if good(t)}
    assert {r["doc_id"] for r in quality_rules.judge(d).where("kept").collect()} == want == {r["doc_id"] for r in quality_rules.keep(d).collect()}
    assert 0 < len(want) < len(texts) - 5


def test_rules_are_ordered_by_rejections_per_cost(spark):
    t = spark.createDataFrame([("x" * 40 + str(i),) for i in range(100)], "t string")
    dear = "length(regexp_replace(sha2(regexp_replace(repeat(t, 200), '[a-y]', 'bbb'), 512), '[0-9]', 'abc')) < 0"
    rules = [quality_rules.Rule("dear", dear), quality_rules.Rule("rare", "t LIKE '%77'"), quality_rules.Rule("frequent", "t LIKE '%1'"), quality_rules.Rule("dear_frequent", dear.replace("< 0", "> 0"))]
    for _ in range(2):
        assert [r.name for r in quality_rules.plan_cascade(t, rules, characters=100_000)][::3] == ["frequent", "dear"]
    assert [r.name for r in quality_rules.plan_cascade(t.limit(0), rules)] == ["dear", "rare", "frequent", "dear_frequent"]


def test_order_of_rules_changes_nothing_kept(docs):
    one, two = (quality_rules.judge(docs, r).where("kept").select("doc_id").collect() for r in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert sorted(one) == sorted(two)


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = as_dict(bpe.digest_columns(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text in enumerate(corpus()):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False).encode()))
    back = as_dict(bpe.decode(bpe.encode(docs)), "decoded", "n_words")
    assert back == {i: (x or "", -1) for i, x in enumerate(corpus())}


def test_decoding_is_a_join(spark, monkeypatch):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(2)
    rows = [(i, [r.randrange(50257) for _ in range(r.randint(1, 40))], "old", i) for i in range(200)] + [(200, [], "old", 1), (201, None, "old", 2), (202, [10**6, 262], "old", 3)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, token_ids array<int>, decoded string, pos int")
    want = {i: (t.decode(x, skip_special_tokens=False) if i < 202 and x is not None else None if x is None else "\ufffd the", k) for i, x, _, k in rows}
    for most in (500_000, 10):
        monkeypatch.setattr(bpe, "MOST_BROADCAST", most)
        out = bpe.decode(df)
        assert sorted(out.columns) == sorted(df.columns) and as_dict(out, "decoded", "pos") == want and out.count() == len(rows) + 3
    assert bpe.decode(df.limit(0)).count() == 0


def test_archives_are_read_in_parallel(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html")).repartition(8)
    manifest = warc.write(pages, shared_dir(spark))
    files = manifest.count()
    chunks = warc.read(manifest, payload=False)
    assert files > 2 and chunks.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == files and chunks.count() == 400


def test_long_payloads_are_dealt_out_in_chunks(spark):
    text = "é" * 50_000
    parts = warc.payload_chunks(spark.createDataFrame([(1, "u", text), (2, "u", text), (3, "u", "")], "page_id bigint, url string, html string"), size=1000).collect()
    own = [r for r in parts if r["page_id"] == 1]
    assert [r["chunk_no"] for r in own] == list(range(100)) and b"".join(r["chunk"] for r in own) == text.encode() and max(len(r["chunk"]) for r in own) == 1000
    assert [(r["page_id"], r["refers_to"], r["chunk"], r["length"]) for r in parts if r["page_id"] != 1] == [(2, 1, None, 100_000), (3, None, b"", 0)]


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_warc_round_trip(spark, chunk):
    rows = [(1, "u", "x" * 5000), (2, None, "x" * 5000), (3, "http://a b\n", None), (4, "u", ""), (None, "z", "x" * 5000), (1, "u", "x" * 5000), (5, "q", "WARC/1.1\r\n\r\né" * 900)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    manifest = warc.write(pages.withColumns({"sha": F.lit(1), "length": F.lit(2), "chunk": F.lit(3), "refers_to": F.lit(4)}), shared_dir(spark), chunk=chunk)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    chunks = warc.read(manifest, chunk=2000).collect()
    for page, _, html in rows:
        body = (html or "").encode()
        own = sorted((c for c in chunks if c["page_id"] == page and c["record_type"] == "response"), key=lambda c: c["chunk_no"])
        if page == 2 or page == 4:
            r = next(c for c in chunks if c["page_id"] == page)
            assert (r["record_type"], r["refers_to"], r["bytes_so_far"]) == ("revisit", 1 if page == 2 else 3, len(body))
        else:
            n = 2 if page == 1 else 1
            assert b"".join(c["chunk"] for c in own[::n]) == body and own[-1]["bytes_so_far"] == len(body)
            assert own[-1]["digest_so_far"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and own[-1]["is_last"]
    assert warc.read(warc.write(pages.limit(0), shared_dir(spark))).count() == 0


def test_warc_plain_files_and_damage(tmp_path):
    (tmp_path / "a").mkdir()
    a = warc.Archive(f"file://{tmp_path}/a")
    a.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<x>")], b"", memoryview(b"m" * 10))
    a.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{warc.ID}7>"), ("Content-Type", "text/html")], b"", memoryview(b"plain"))
    name, n, _ = a.close()
    path = name.removeprefix("file://")
    with open(path, "rb") as f:
        assert [(r[0], r[5]) for r in warc.chunks_of(warc.Stream(f))] == [(7, b"plain")]
    import gzip

    data = gzip.decompress(open(path, "rb").read())
    (tmp_path / "p").write_bytes(data[:-9])
    with open(tmp_path / "p", "rb") as f, pytest.raises(ValueError, match="cut off|no end"):
        list(warc.chunks_of(warc.Stream(f, packed=False)))


def test_mpeg_round_trip(docs):
    got = as_dict(mpeg_audio.read_media(mpeg_audio.with_media(docs)), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "seconds", "seek_offsets")
    for i, t in enumerate(corpus()):
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 192))
        body = raw.ljust(n * 192, b" ")
        x = got[i]
        assert x[:4] == (len(raw), len(body), brute.sha(body), zlib.crc32(body[-16:])) and x[4] == pytest.approx(n * 1152 / 48000)
        assert len(x[5]) == n and all(b - a == 240 for a, b in zip(x[5], x[5][1:]))
    more = as_dict(mpeg_audio.read_media(mpeg_audio.with_media(docs)), "media_bytes", "media_sha256", "feature")
    stored = {r["doc_id"]: bytes(r["media"]) for r in mpeg_audio.with_media(docs).collect()}
    for i, x in more.items():
        assert x == (len(stored[i]), brute.sha(stored[i]), mpeg_audio.feature(mpeg_audio.parse(stored[i])))
        assert x[2].startswith(f"frames={len(got[i][5])};samples={1152 * len(got[i][5])}/48000;kbps=80;crc={len(got[i][5]) + 1}/{len(got[i][5]) + 1};skipped=0;table=Info")


def test_mpeg_resynchronises_and_checks():
    s = mpeg_audio.store(b"x" * 1000)
    m = mpeg_audio.parse(s)
    o = m.offsets
    assert (len(o), m.table, m.table_frames, m.bad, m.skipped) == (6, "Info", 6, 0, 0)
    lost = mpeg_audio.parse(s[: o[2]] + b"\x00gap\xff\xfb" + s[o[3] :])
    assert (len(lost.offsets), lost.skipped, lost.bad) == (5, 6, 0)
    spoilt = mpeg_audio.parse(s[: o[1] + 4] + b"\0\0" + s[o[1] + 6 :] + b"TAG" + b"Name".ljust(125, b" "))
    assert (spoilt.bad, spoilt.checked, spoilt.tags["TIT2"]) == (1, 7, "Name")
    assert mpeg_audio.parse(b"").seconds is None and mpeg_audio.parse(b"\xff" * 50).offsets == []
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x64])).size == 417


def bits_crc(bits):
    """The checksum, a bit at a time."""
    reg = 0xFFFF
    for b in bits:
        reg = (reg << 1 & 0xFFFF) ^ (0x8005 if reg >> 15 ^ b else 0)
    return reg


@pytest.mark.parametrize(("head", "widths"), [
    ((0xFF, 0xFE, 0x44, 0x00), [4] * 64),  # layer I, stereo
    ((0xFF, 0xFE, 0x44, 0x50), [4] * (2 * 8 + 24)),  # layer I, joint from subband 8
    ((0xFF, 0xFC, 0x84, 0xC0), [4] * 11 + [3] * 12 + [2] * 4),  # layer II, mono, 48 kHz
    ((0xFF, 0xFC, 0x80, 0xC0), [4] * 11 + [3] * 12 + [2] * 7),  # layer II, mono, 44.1 kHz, 128 kbit/s
    ((0xFF, 0xFC, 0x28, 0xC0), [4] * 2 + [3] * 10),  # layer II, mono, 32 kHz, 48 kbit/s
    ((0xFF, 0xFC, 0x24, 0x00), [4] * 4 + [3] * 12),  # layer II, stereo, 48 kHz, 48 kbit/s
    ((0xFF, 0xF4, 0x84, 0xC0), [4] * 4 + [3] * 7 + [2] * 19),  # version 2, layer II, mono
])
def test_checksums_of_layers_one_and_two(head, widths):
    r, frame = random.Random(1), None
    h = mpeg_audio.header(bytes(head))
    assert h.protected and h.layer in (1, 2)
    frames = b""
    for _ in range(3):
        body = bytes(r.randrange(256) for _ in range(h.size - 6))
        bits = [b >> k & 1 for b in body for k in range(7, -1, -1)]
        n = sum(widths)
        if h.layer == 2:
            at = used = 0
            for w in widths:
                used += any(bits[at : at + w])
                at += w
            n += 2 * used
        lead = [b >> k & 1 for b in head[2:] for k in range(7, -1, -1)]
        frame = bytes(head) + bits_crc(lead + bits[:n]).to_bytes(2) + body
        frames += frame
    m = mpeg_audio.parse(frames)
    assert (len(m.offsets), m.checked, m.bad) == (3, 3, 0)
    m = mpeg_audio.parse(frames[: h.size] + frames[h.size : h.size + 6] + bytes([frames[h.size + 6] ^ 0x80]) + frames[h.size + 7 :])
    assert (m.checked, m.bad) == (3, 1)


@pytest.mark.parametrize("units", [1, 2, 5])
def test_mpeg_payload_that_looks_like_a_tag(units):
    raw = b"x" * (192 * units - 103) + b"TAG" + b"y" * 100
    stored = mpeg_audio.store(raw)
    assert len(raw) == 192 * units and stored[-128:-125] == b"TAG"
    m = mpeg_audio.parse(stored)
    assert mpeg_audio.payload(stored, m) == raw and (len(m.offsets), m.skipped, "TIT2" in m.tags) == (units, 0, False)
    tagged = stored + b"TAG" + b"Name".ljust(125, b" ")
    m = mpeg_audio.parse(tagged)
    assert mpeg_audio.payload(tagged, m) == raw and (len(m.offsets), m.skipped, m.tags["TIT2"]) == (units, 0, "Name")


def test_language_id(spark):
    words = {"en": "the with that which thing", "fr": "le avec que quelle chose é", "de": "der mit dass welche sache ü"}
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(words[k].split(), k=30)), k, None) for i in range(300) for k in [list(words)[i % 3]]]
    df = language_id.fold(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string"), 3)
    model = language_id.train(df.where("fold <> 1"))
    out = language_id.predict(df.withColumn("held_out", F.col("fold") == 1), model).collect()
    assert all(x["lang_pred"] == rows[x["doc_id"]][2] and 0 <= x["score"] <= 1 for x in out)
    odd = spark.createDataFrame([(None, "le avec"), (1, None), (2, "12 !?"), (3, "文字"), (4, "the " * 600_000)], "doc_id bigint, text string").withColumn("held_out", F.lit(False))
    assert [x["lang_pred"] for x in language_id.predict(odd.coalesce(1), model).collect()] == ["fr", "und", "und", model.commonest, "en"]
    assert {x["lang_pred"] for x in language_id.predict(odd, language_id.train(df.limit(0))).collect()} == {"und"}


def test_bloom_filters_hold_every_trigram(spark):
    df = spark.createDataFrame([("abc abd", f"l{i:02d}") for i in range(70)] + [("xyz", "l00")], "text string, lang string")
    model = language_id.train(df)
    h, _ = language_id.trigrams("xyz")
    votes = model.votes(h, np.array([0, len(h)]))[0]
    assert votes[0] == 3 * language_id.BANDS and not votes[1:].any() and len(model.words) == -(-70 // language_id.WORD)


def test_filters_return_all_languages_of_a_trigram(spark):
    """Against a brute-force table of trigrams: what a slot returns, and the votes that follow from it."""
    r = random.Random(6)
    texts = [("".join(r.choice("abcdeé ß") for _ in range(r.randint(1, 400))), f"l{r.randrange(20)}") for _ in range(60)]
    rows = texts * 2
    model = language_id.train(spark.createDataFrame(rows + [("zzz", None), (None, "l1"), ("", "l2")], "text string, lang string"))
    seen = {}
    for text, lang in rows:
        for g in language_id.trigrams(text)[0].tolist():
            seen.setdefault(lang, {}).setdefault(g, 0)
            seen[lang][g] += 1
    assert model.langs == sorted(seen)
    for text, _ in texts[:10]:
        h, _ = language_id.trigrams(text)
        got = model.votes(h, np.array([0, len(h)]))[0]
        least = [sum(1 + sum(seen[k][g] / sum(seen[k].values()) >= x for x in language_id.SHARES) for g in h.tolist() if g in seen[k]) for k in model.langs]
        assert (got >= least).all() and (got <= np.array(least) + 0.05 * len(h) * language_id.BANDS).all()  # a trigram that is found by mistake is so each time


def test_language_id_edge_cases(spark):
    rows = [(1, "the with that", "en"), (1, "the with that", "en"), (2, "le avec que", "fr"), (2, "le avec que", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df)
    odd = df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("score", "lang_pred", "fold", "lang", "n")], F.lit(False).alias("held_out"))
    assert sorted((x["doc_id"], x["lang_pred"]) for x in language_id.predict(odd, model).collect()) == [(1, "en"), (1, "en"), (2, "fr"), (2, "fr")]
    assert language_id.predict(odd.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="languages"):
        import sievework.llm.language_id as m
        old, m.MOST_LANGUAGES = m.MOST_LANGUAGES, 1
        try:
            m.train(df)
        finally:
            m.MOST_LANGUAGES = old


@pytest.mark.parametrize("size", [10, 64])
def test_votes_of_long_texts_add_up(spark, monkeypatch, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    texts = ["the with that " * 30, None, "", "le avec " * 3, "x" * 200]
    packs = list(language_id.packs(texts))
    joined = {}
    for owner, parts in packs:
        for i, x in zip(owner, parts):
            joined[i] = joined.get(i, "") + x
    assert joined == {i: t or "" for i, t in enumerate(texts)} and max(sum(map(len, p)) for _, p in packs) <= 5 * size

@pytest.mark.parametrize("most", [22, 19])
def test_rare_trigrams_of_a_large_script_vote(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "MOST_BITS", most, raising=False)
    r = random.Random(7)
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(200)) for _ in range(1000)]
    rows = [(x, "zh") for x in texts] + [("the with that which thing " * 20, "en")] * 1000
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.commonest == "en"
    short = spark.createDataFrame([(i, x[50:60], False) for i, x in enumerate(texts[:100])], "doc_id int, text string, held_out boolean")
    assert {x["lang_pred"] for x in language_id.predict(short, model).collect()} == {"zh"}


def test_quality_classifier_learns_and_never_sees_held_out_labels(spark):
    r = random.Random(5)
    rows = [(i, (" ".join("#$%" for _ in range(60)) if i % 4 == 0 else prose(i, r.randint(60, 200))), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    stats = quality_classifier.document_statistics(docs).cache()
    labels = docs.select("doc_id", F.col("quality").alias("y"))
    learn = stats.where("crc32(cast(doc_id AS string)) % 5 <> 0")
    model = quality_classifier.fit(learn, labels)
    out = quality_classifier.score(stats, model).collect()
    assert all((x["score"] >= 0.3) == bool(rows[x["doc_id"]][2]) == bool(x["predicted"]) and 0 <= x["score"] <= 1 for x in out)
    assert {x["doc_id"] for x in out if x["held_out"]} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    lies = labels.withColumn("y", F.when(F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), 1 - F.col("y")).otherwise(F.col("y")))
    other = {x["doc_id"]: x["score"] for x in quality_classifier.score(stats, quality_classifier.fit(learn, lies)).collect()}
    assert all(abs(other[x["doc_id"]] - x["score"]) < 1e-6 for x in out)
    assert quality_classifier.fit(stats, labels.limit(0)) is None
    assert {x["score"] for x in quality_classifier.score(stats, None).collect()} == {0.5}


def test_fit_equals_brute_force(spark):
    """Normal equations, ridge and pooling against plain matrices and a quadratic search for the best monotone fit."""
    r = random.Random(8)
    rows = [(i, prose(i, r.randint(20, 90)) + " #" * r.randint(0, 9), r.randint(0, 1)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int").repartition(3)
    stats = quality_classifier.document_statistics(docs)
    model = quality_classifier.fit(stats, docs.select("doc_id", "y"))
    x = np.array([quality_classifier.statistics(t) for _, t, _ in rows])
    y = np.array([k for *_, k in rows], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 20 % 4 for i in range(200)])
    to = quality_classifier.Map(x.mean(axis=0), x.std(axis=0))
    assert np.allclose(to.mean, model.to.mean) and np.allclose(to.spread, model.to.spread)
    z = np.array([[np.cos(np.clip((v - to.mean) / to.spread, -6, 6) @ to.w[:, j] + to.b[j]) * np.sqrt(2 / quality_classifier.FEATURES) for j in range(quality_classifier.FEATURES)] + [1.0] for v in x])
    fit = z[fold != 1]
    k = len(fit)
    weights = np.linalg.solve(fit.T @ fit + quality_classifier.RIDGE * k * np.eye(fit.shape[1]) / fit.shape[1], fit.T @ y[fold != 1])
    assert np.abs(z @ weights - model.raw(x)).max() < 1e-6
    got = {q["doc_id"]: q["score"] for q in quality_classifier.score(stats, model).collect()}
    s = np.clip(z @ weights, -0.5, 1.5)
    bins = np.round(s[fold == 1] * quality_classifier.BINS / 2).astype(int)
    kinds = np.unique(bins)
    n, total = np.array([(bins == b).sum() for b in kinds]), np.array([y[fold == 1][bins == b].sum() for b in kinds])
    best = [max(min(total[i : j + 1].sum() / n[i : j + 1].sum() for j in range(b, len(kinds))) for i in range(b + 1)) for b in range(len(kinds))]  # min-max formula of isotonic regression
    at, value = quality_classifier.pooled(kinds * 2 / quality_classifier.BINS, n, total)
    blocks = sorted(set(np.round(best, 12)))
    assert np.allclose(value, blocks)
    want = np.clip(np.interp(s, at, value), 0, 1)
    assert max(abs(got[i] - want[i]) for i in range(200)) < 1e-4


def test_quality_classifier_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    stats = quality_classifier.document_statistics(docs)
    assert quality_classifier.fit(stats, spark.createDataFrame([(1, 1)], "doc_id bigint, y int")) is None and quality_classifier.score(stats, None).count() == 0
    model = quality_classifier.Classifier(quality_classifier.Map(np.zeros(14), np.ones(14)), np.zeros(257))
    assert quality_classifier.score(stats, model).count() == 0


def test_pooling_is_monotone():
    at, value = quality_classifier.pooled(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all() and value[0] == 0


def test_written_tables_are_released(spark):
    import os

    from sievework.llm import common

    folder = common.shared_dir(spark)
    assert common.written(spark.range(3), folder, "t").count() == 3 and os.path.isdir(folder.removeprefix("file://"))
    common.discard(spark, f"{folder}/t")
    assert not os.path.exists(f"{folder}/t".removeprefix("file://"))
    own, common._folders[:] = common._folders[:-1], common._folders[-1:]
    common.release(spark)
    assert not os.path.exists(folder.removeprefix("file://")) and not common._folders
    common._folders[:] = own


def test_word_hashes():
    texts = [b" ab  cd\n", b"", b"ab", "é \x1c".encode(), b"AB"]
    h, first, after, at = word_hashes.words(texts)
    assert np.diff(at).tolist() == [2, 0, 1, 2, 1] and h[0] == h[2] and h[0] != h[5]
    assert word_hashes.words(texts, lower=True)[0][5] == word_hashes.words(texts, lower=True)[0][2]
    assert word_hashes.words([])[0].size == 0


def test_word_hashes_of_long_texts(monkeypatch):
    texts = [" ".join(prose(i, 40) for i in range(3)).encode(), b"  ", b"x" * 300, b"a b", b"\n" * 40, b"end"]
    whole = word_hashes.words(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(word_hashes, "PIECE", size)
        assert all((a == b).all() for a, b in zip(whole, word_hashes.words(texts), strict=True))
