"""Scorers: where the probability of a candidate comes from. A scorer adds ``p`` to rows of (id columns, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import folded
from .links import overlap, words
from .select import names


class LexicalScorer:
    """The share of the question's words that share a stem with the text: pure, offline, the default."""

    def __init__(self, question: str):
        self.question = question

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        q = F.lit(self.question)
        n = F.size(words(q))
        return rows.withColumn("p", F.when(n > 0, overlap(q, F.col(text)) / n).otherwise(0.0).cast("double"))


class TableScorer:
    """Recorded answers (keys, noul): the same questions get the same answers again; a missing one is 0."""

    def __init__(self, answers: DataFrame, keys: Sequence[str]):
        self.answers, self.keys = answers, list(keys)

    def score(self, rows: DataFrame) -> DataFrame:
        a = self.answers.groupBy(*self.keys).agg(F.max("noul").alias("_p"))
        return rows.join(a, self.keys, "left").withColumn("p", F.coalesce("_p", F.lit(0.0))).drop("_p")


def noul_question(ident: Column, instructions: Column) -> Column:
    return F.to_json(F.struct(ident.alias("id"), F.lit("noul").alias("type"), instructions.alias("instructions")))


def choice_question(ident: Column, instructions: Column, options: Column) -> Column:
    return F.to_json(F.struct(ident.alias("id"), F.lit("choice").alias("type"), instructions.alias("instructions"), options.alias("options")))


ANSWER = "struct<noul:double,choice:string,confidence:double,probabilities:map<string,double>>"


def answers_of(replies: DataFrame, by) -> DataFrame:
    """(by, id, noul, choice, confidence, probabilities, tokens) of replies (by, body) as the model's service writes them; a reply that is no JSON gives no rows."""
    reply = F.from_json("body", f"struct<answers:map<string,{ANSWER}>,usage:struct<input_tokens:bigint>>")
    d = replies.select(*names(by), reply.alias("_reply")).select(*names(by), F.col("_reply.usage.input_tokens").alias("tokens"), F.explode("_reply.answers").alias("id", "_a"))
    return d.select(*names(by), "id", "_a.noul", "_a.choice", "_a.confidence", "_a.probabilities", "tokens")


#: Answers of the model's service that are asked for again, how often at most, and the wait before it in seconds:
#: the first, doubled each time, and the longest.
AGAIN, RETRIES, FIRST_WAIT, LONGEST_WAIT = (429, 529), 2, 0.3, 5.0


def settled(replies: DataFrame, by) -> DataFrame:
    """(by, status, body, attempts, waited): what each request came to, of its attempts (by, attempt from 1, status, body, retry_after in
    seconds): the first answer that is no reason to ask again, else that of the last retry; and the seconds waited before it."""
    keys = names(by)
    w = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    stands = ~F.col("status").isin(*AGAIN)
    wait = F.least(F.coalesce(F.col("retry_after").try_cast("double"), F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), F.col("attempt") - 1)), F.lit(LONGEST_WAIT))
    d = replies.where(F.col("attempt") <= RETRIES + 1).withColumns({"_done": F.coalesce(F.max(stands).over(w), F.lit(False)), "_waited": F.coalesce(F.sum(wait).over(w), F.lit(0.0))})
    last = d.where("NOT _done").groupBy(*keys)
    return last.agg(F.max_by("status", "attempt").alias("status"), F.max_by("body", "attempt").alias("body"), F.max("attempt").alias("attempts"), F.max("_waited").alias("waited"))


def requests(items: DataFrame, by, order: str = "i", questions: str = "questions", state: str = "state", most_questions: int = 120, most_state: int = 60_000) -> DataFrame:
    """Adds ``request``: consecutive items of a group go into one as long as its questions and states fit."""

    def step(at, q, n):
        request, asked, size = at or (0, 0, 0)
        if q > 0 and asked > 0 and (asked + q > most_questions or size + n > most_state):
            request, asked, size = request + 1, 0, 0
        return (request, asked + q, size + n), (request,)

    return folded(items, by, [order], step, "request int", q=F.coalesce(F.col(questions).cast("bigint"), F.lit(0)), n=F.coalesce(F.col(state).cast("bigint"), F.lit(0)))


def unblocked(answers: DataFrame, by, bar: float = 0.8) -> DataFrame:
    """Answers of the groups in which no ``blocked`` answer reaches the bar."""
    keys = names(by)
    bad = answers.where((F.col("id") == "blocked") & (F.col("noul") >= bar)).select(*keys).distinct()
    return answers.join(bad, keys, "left_anti")
