"""Operator 5, quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

A document becomes a few statistics of its whole text (lengths, shares of character classes, repetition). Standardised,
they go through FEATURES random cosines, whose inner products approximate a Gaussian kernel. Each partition of
training rows sums its part of the normal equations; the sums meet row by row in Spark, and a matrix of fixed size reaches the
driver, which solves the ridge system. Scores of other training rows, by bins of equal width, are made monotone by
pooling adjacent violators; a score is interpolated between the pooled blocks.

Inputs of a score are the text's statistics only. Edge cases: a null text is an empty text and is scored; null ids are scored,
never learnt from and held_out false; labels that are null are ignored, of several for one id the greatest holds;
without training rows every score is 0.5; repeated rows are scored each; an empty table of documents trains nothing and gives an empty
result; a very long text is one row, read whole by its task; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, shared_dir, text_of, written

FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 2.5, 1e-3, 1000, 5
THRESHOLD = 0.3
STATISTICS = ("log_bytes", "log_words", "word_bytes", "blank", "newline", "digit", "capital", "point", "symbol_per_word", "other_bytes", "distinct_words", "distinct_pairs", "distinct_lines", "longest_line")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def class_table() -> np.ndarray:
    """Byte -> character classes: blanks, newline, digits, capitals, points, symbols, beyond ASCII."""
    members = (b" \t\v\f\r", b"\n", b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-", b"#*$%&|<>", bytes(range(128, 256)))
    out = np.zeros((256, len(members)))
    for i, m in enumerate(members):
        out[list(m), i] = 1
    return out


CLASSES = class_table()


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw)
    blank, newline, digit, capital, point, symbol, other = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES
    words, lines = WORD.findall(text), [x for x in text.split("\n") if x.strip()]
    k, size = max(1, len(words)), max(1, n)
    return [
        np.log1p(n), np.log1p(len(words)), (n - blank - newline) / k, blank / size, newline / k, digit / size, capital / size, point / size, min(symbol / k, 3.0),
        other / size, len(set(words)) / k, len(set(zip(words, words[1:], strict=False))) / max(1, k - 1), len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, lines), default=0)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the STATISTICS of each row's text."""
    d = docs.select("doc_id", text_of().alias("text"))

    def run(batches):
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Map:
    """Statistics -> cosines and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.spread, -6, 6) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def normal_equations(rows: DataFrame, to: Map) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum of z z' and z y over rows (x, y), and their number. Partitions are summed in two steps."""
    d = len(to.b) + 1

    def part(batches):
        total = np.zeros((d, d + 2))
        for b in batches:
            x = matrix(b.column("x"))
            for at in range(0, len(x), 4096):
                z = to(x[at : at + 4096])
                total += z.T @ np.hstack([z, np.array(b.column("y").to_numpy(), float)[at : at + 4096, None], np.ones((len(z), 1))])
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    parts = rows.select("x", "y").mapInArrow(part, "i int, v array<double>").withColumn("p", F.spark_partition_id() % 64)
    sums = parts.groupBy("i", "p").applyInPandas(add, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").toPandas()
    total = np.zeros((d, d + 2))
    for i, v in zip(sums["i"], sums["v"], strict=True):
        total[i] = v
    return total[:, :d], total[:, d], total[-1, -1]


def pooled(bins: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: (mean bin, mean label) of blocks with rising means."""
    blocks: list[list[float]] = []
    for b, k, s in zip(bins, n, y, strict=True):
        blocks.append([b * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b / k for b, k, _ in blocks]), np.array([s / k for _, k, s in blocks])


class Classifier:
    def __init__(self, to: Map, weights: np.ndarray, at=(), value=()):
        self.to, self.weights, self.at, self.value = to, weights, np.array(at), np.array(value)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.to(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.clip(self.raw(x), -0.5, 1.5)
        return np.clip(np.interp(s, self.at, self.value) if len(self.at) else s, 0, 1)


def fit(stats: DataFrame, labels: DataFrame) -> Classifier | None:
    """Learns from (doc_id, x) and (doc_id, y); of each five ids four thirds fit the weights and the rest calibrates."""
    y = labels.where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("y").cast("double")).alias("y"))
    rows = stats.join(y, "doc_id").select("doc_id", "x", "y").withColumn("fold", F.expr("crc32(cast(doc_id AS string)) % 20")).persist()
    try:
        n = len(STATISTICS)
        m = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]) for i in range(n)], *[F.stddev_pop(F.col("x")[i]) for i in range(n)]).first()
        if not m["n"]:
            return None
        to = Map(np.array(m[1 : n + 1]), np.array(m[n + 1 :]))
        apart = F.col("fold") % 4 == 1  # calibrates
        a, b, k = normal_equations(rows.where(~apart), to)
        model = Classifier(to, np.linalg.solve(a + RIDGE * max(k, 1.0) * np.eye(len(a)) / len(a), b))

        def binned(batches):
            for t in batches:
                s = np.clip(model.raw(matrix(t.column("x"))), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(s * BINS / 2).astype(np.int32)), t.column("y")], names=["bin", "y"])

        hist = rows.where(apart).select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").toPandas()
        if len(hist):
            model.at, model.value = pooled(hist["bin"].to_numpy() * 2 / BINS, hist["n"].to_numpy(float), hist["s"].to_numpy(float))
        return model
    finally:
        rows.unpersist()


def score(stats: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of (doc_id, x)."""
    out = stats.withColumn("held_out", F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), F.lit(False)))

    def run(batches):
        for b in batches:
            s = model.scores(matrix(b.column("x"))) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return out.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    stats = written(document_statistics(documents(spark, sf_dir)), shared_dir(spark), "statistics")
    learn = stats.where("crc32(cast(doc_id AS string)) % 5 <> 0")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    return score(stats, fit(learn, labels))
