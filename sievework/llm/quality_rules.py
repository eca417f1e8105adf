"""Operator 9, quality rules: a short-circuit cascade ordered by rejections per cost. DataFrame functions only.

Every rule is a Boolean column over the text, its words and the statistics of :func:`statistics`; a document is rejected by the
first rule that holds. :func:`plan_cascade` measures each rule on a sample: what it rejects, and how long it takes beyond a
job that does nothing, over enough copies of the sample that the job's own cost does not count. Costs are rounded to powers of
four, so that only real differences count, and rules are ordered by rejection per cost: later, dearer rules then see fewer documents.
The order never changes which documents are kept, only what is computed and which rule is named as the reason.

:func:`judge` returns the counts of every document, so these come first and the cascade orders the other rules. :func:`keep` returns none:
there the base rules take part in the cascade, each count is worked out only where the cascade comes to it, and repeated words,
the dearest, are counted in no document that an earlier rule rejects.

Edge cases: a null text is an empty text and has no words; an empty table gives an empty result, with the rules in
their written order; null ids are kept as they are; repeated rows are judged each on its own; a very long text is one row and its
arrays of words and hashes are held by one task; extra columns are passed over by :func:`judge` and kept by :func:`keep`.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, documents, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: The sample on which rules are measured: this share of the rows, and so many at most. Only the rules' order depends on it.
SAMPLE_SHARE, SAMPLE_ROWS = 0.01, 1000
#: Characters that a rule is timed over, and the least cost in seconds a row that is told from none.
TIMED_CHARACTERS, LEAST_COST = 1_000_000, 2e-5


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the columns t (text), n_words and the four base counts; true means rejected."""

    name: str
    rejects: str


#: Each threshold is far from prose in an alphabetic script.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 2 * n_dup_lines > size(filter(split(t, '\\n'), x -> trim(x) <> ''))"),
    Rule("few_letters", "10 * length(regexp_replace(t, '[^\\\\p{L}]', '')) < 6 * word_chars"),
    Rule("capitals", "2 * length(regexp_replace(t, '[^\\\\p{Lu}]', '')) > word_chars"),
)


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a 3-word window whose words occur at two or more places of the array ``w``.

    Windows are compared by a 64-bit hash of their three words. The starts of repeated windows are only worked out
    for texts that have some: the sorted hashes show that first.
    """
    n = F.size(w)

    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda z: F.sort_array(F.transform(
            F.filter(z, lambda x, i: F.coalesce((x["h"] == F.get(z, i - 1)["h"]) | (x["h"] == F.get(z, i + 1)["h"]), x["h"] == F.get(z, i - 1)["h"], x["h"] == F.get(z, i + 1)["h"])), lambda x: x["i"])))

    def covered(r: Column) -> Column:
        gaps = F.zip_with(F.slice(r, 2, F.size(r)), F.slice(r, 1, F.size(r) - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)

    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 3, 0).otherwise(let(F.slice(hashes, F.lit(1), n - 2), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(starts(h), covered)))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, t (text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each row, and what ``carry`` names."""
    t, more = F.col("t"), carry or {}
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("t"), *[c.alias(k) for k, c in more.items()])
    d = d.withColumn("m", let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
    return d.select(
        "doc_id", "t", *more, F.col("m.n").alias("n_words"), F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.col("m.r").alias("n_repeat_words"))


ONCE = "__sievework_once"
#: The rules that the contract fixes, as rules of the cascade.
BASE = (Rule("few_words", "n_words < 50"), Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"))
BASE_FAILED = " OR ".join(r.rejects for r in BASE)


def with_counts(d: DataFrame) -> DataFrame:
    """Adds the counts to a table with t: the cheap ones and the words once for a row, repeated words where a CASE comes to them.

    ONCE is no deterministic column, so no filter above is pushed below the cheap counts, to make them anew for each rule.
    """
    t, w = F.col("t"), F.col("w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    d = d.select("*", words_of(t).alias("w")).select(
        "*", F.size(w).cast("long").alias("n_words"), F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.monotonically_increasing_id().alias(ONCE))
    return d.withColumn("n_repeat_words", repeated_words(w))


def plan_cascade(sample: DataFrame, rules=RULES, add=lambda d: d, characters: int = TIMED_CHARACTERS) -> list[Rule]:
    """The rules in order of rejections per second, as measured on the rows of ``sample``, which has t, and once ``add`` ran what the rules name."""
    sample = sample.persist()
    try:
        n, size = sample.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
        if not n:
            return list(rules)
        copies = max(1, min(characters // max(1, size), 100_000 // n))
        timed = add(sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))))

        def run(rule: str) -> tuple[int, float]:
            test, best = timed.agg(F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END"))), float("inf")
            for _ in range(2):
                began = time.perf_counter()
                found = test.first()[0]
                best = min(best, time.perf_counter() - began)
            return found // copies, best

        idle, rates = run("copy < 0")[1], {}
        for rule in rules:
            rejected, spent = run(rule.rejects)
            cost = max(LEAST_COST, (spent - idle) / (n * copies))
            rates[rule.name] = (rejected + 0.5) / (n + 1) / 4 ** round(math.log(cost, 4))
        return sorted(rules, key=lambda r: -rates[r.name])
    finally:
        sample.unpersist()


def cascade(rules) -> Column:
    """Name of the first rule that rejects, null if none does. CASE stops at the first that holds."""
    out = F.when(F.expr(rules[0].rejects), F.lit(rules[0].name)) if rules else F.lit(None).cast("string")
    for rule in rules[1:]:
        out = out.when(F.expr(rule.rejects), F.lit(rule.name))
    return out


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, rejected_by and kept for each row of ``docs``; the text is not carried."""
    sample = statistics(docs.sample(SAMPLE_SHARE, 7).limit(SAMPLE_ROWS), id_col, text_col).where(f"NOT ({BASE_FAILED})")
    ordered = plan_cascade(sample, rules)
    out = statistics(docs, id_col, text_col).withColumn("base_failed", F.expr(BASE_FAILED))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("t")


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    plain = docs.select(text_of().alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ordered = plan_cascade(plain.select("t").sample(SAMPLE_SHARE, 7).limit(SAMPLE_ROWS), (*BASE, *rules), with_counts)
    return with_counts(plain).where(cascade(ordered).isNull() & (F.col(ONCE) >= 0)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
