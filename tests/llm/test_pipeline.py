import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import bpe, mixing, quality_rules
from sievework.llm.common import shared_dir, written

from . import brute
from .test_operators import corpus, prose


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None

    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    texts = {i: t for i, t, *_ in rows if i in kept}
    groups = brute.near_duplicates(texts.items())
    texts = {i: t for i, t in texts.items() if groups[i][2]}
    plain = brute.without_repeats(texts.items())
    texts = {i: t if all(plain[i][1]) else " ".join(w for w, k in zip(*plain[i]) if k) for i, t in texts.items()}

    at, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), shared_dir(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = written(stage(spark, at, str(tmp_path)), folder, name)
        assert at.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in at.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(at).collect() if r["copies"]}
    t = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {i: t.encode(texts[i], add_special_tokens=False).ids for i in copies}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert dict(out.groupBy("doc_id").agg(F.count("*")).collect()) == copies
    assert all(r["token_ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["token_ids"]) for r in out.collect())


def test_rows_sort_into_the_curriculum(spark, tmp_path):
    rows = [(i, prose(i, 30 + i % 50).translate(str.maketrans("0123456789", "abcdefghij")), "en", f"s{i % 4}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    places = {}
    for r in mixing.mix(docs).collect():
        places.setdefault(r["doc_id"], r["position"])
    mixed = corpus_pipeline.mix(spark, docs, "")
    mixed = written(mixed, shared_dir(spark), "mixed")
    out = sorted(corpus_pipeline.tokens(spark, mixed, "").collect(), key=lambda r: r["position"])
    assert len({r["position"] for r in out}) == len(out)
    seen, first = set(), []
    for r in out:
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            first.append(places[r["doc_id"]])
    assert first == sorted(first) and len(first) > 200
    sources = [r["source"] for r in out]
    early, late = sources[: len(out) // 3], sources[-len(out) // 3 :]
    assert early.count("s0") > late.count("s0") and late.count("s2") > early.count("s2")  # heavy sources come early
    assert corpus_pipeline.tokens(spark, docs, "").count() == 300  # no files: positions by partition


def test_pipeline_on_odd_tables(spark, tmp_path):
    plain = prose(7, 80).translate(str.maketrans("0123456789", "abcdefghij"))
    other = prose(8, 80).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(None, plain, None, None), (None, plain, "en", "a"), (1, other, "en", "a"), (1, other, "en", "a"), (2, None, "en", "b"), (None, None, None, None), (3, "", "fr", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "bigint(length(text)) AS n_chars", "1 AS position", "2 AS `row`", "3 AS key", "4 AS token_ids")
    for name, d in (("odd", docs), ("empty", docs.limit(0))):
        at, folder = written(d, shared_dir(spark), name), shared_dir(spark)
        for stage, f in corpus_pipeline.STAGES[:-1]:
            at = written(f(spark, at, ""), folder, stage)
            assert at.columns == d.columns
        out = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
        assert sorted({(r["doc_id"] or 0, r["n_tokens"] > 0) for r in out}) == ([(0, True), (1, True)] if name == "odd" else [])
