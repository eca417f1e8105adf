"""State that a long-lived reader keeps, as batch folds and as streaming queries that give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: seconds for which a host is remembered.
TTL = 600


def host_memo(events: DataFrame, key: str = "host", ts: str = "ts", order: str | None = None, ttl: int = TTL) -> DataFrame:
    """Adds ``learned`` and ``news``: an event is news if its key was not learned in the ``ttl`` seconds before; a window
    counts from the news that opened it and is not extended by what comes in between."""
    from ..operators.fold import folded

    def step(last, us):
        if last is None or us - last >= ttl * 1_000_000:
            return us, (us, True)
        return last, (last, us == last)

    rows = events.where(F.col(ts).isNotNull()).select(key, ts, *([order] if order and order != ts else []))
    out = folded(rows, key, [ts, *([order] if order else [])], step, "_us bigint, news boolean", us=F.unix_micros(F.col(ts).cast("timestamp")))
    return out.withColumn("learned", F.timestamp_micros("_us").cast(events.schema[ts].dataType)).drop("_us")


def host_memo_stream(events: DataFrame, key: str = "host", ts: str = "ts", ttl: int = TTL) -> DataFrame:
    """The news of :func:`host_memo` from a stream of events that come in order of time for each key: (key, learned)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def learn(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(x for f in frames for x in f[ts]):
            us = int(t.value // 1000)
            if last is None or us - last >= ttl * 1_000_000:
                last = us
                out.append(t)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "learned": out})

    return events.groupBy(key).applyInPandasWithState(learn, f"{key} {kind}, learned timestamp", "last bigint", "append", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, first): a set that keeps what it saw once; on a stream use ``dropDuplicates`` with a watermark."""
    return events.groupBy(key).agg(F.min(ts).alias("first"))


def within_budget(calls: DataFrame, by: str, ts: str, order: str, budget: int) -> DataFrame:
    """The calls that were let through: the first ``budget`` of each key in time."""
    return calls.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(ts, order))).where(F.col("n") <= budget)


#: Answers that send a page on from a plain request, and from a browser-like one.
TO_BROWSER, TO_PROXY = (202, 403, 503), (202, 401, 403, 429)


def next_client(client, status, retry_after):
    """Which client a page is asked with after this answer; null when the answer stands."""
    again = retry_after.isNull()
    return (
        F.when((client == "plain") & (status.isNull() | status.isin(*TO_BROWSER) & again), "browser")
        .when((client == "browser") & (status.isNull() | status.isin(*TO_PROXY)), "proxy")
        .when((client == "proxy") & (status.isNull() | status.isin(*TO_PROXY)), "sidecar")
    )


def escalated(responses: DataFrame, by: str = "url") -> DataFrame:
    """(by, client, status, attempts): each page's last attempt on its way up, the first that stands."""
    w = Window.partitionBy(by).orderBy("attempt")
    d = responses.withColumn("_next", next_client(F.col("client"), F.col("status"), F.col("retry_after"))).withColumn("_before", F.sum(F.col("_next").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    reached = d.where(F.coalesce("_before", F.lit(0)) == 0)
    return reached.groupBy(by).agg(F.max_by("client", "attempt").alias("client"), F.max_by("status", "attempt").alias("status"), F.count("*").alias("attempts"))


def traffic(responses: DataFrame) -> DataFrame:
    """Bytes by route and over all."""
    return responses.rollup("route").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
