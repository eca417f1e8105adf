"""A corpus from raw documents to token ids, in five stages; each takes what the one before it kept.

Edge cases, alike in all stages: an empty table gives an empty one; rows with null ids, null or blank texts, null sources, repeated rows
and very long texts are rows like others, as each stage says; columns beyond those of documents are kept, whatever their
names, up to the last stage, which returns its own columns only. Ids are integers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, mixing, near_duplicates, quality_rules, substring_dedup
from sievework.llm.common import documents, shared_dir, written
from sievework.session import share_code


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and blank texts have too few words and go; a null id is no reason; repeated
    rows are judged each on its own."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; rows that repeat that id all stay. A row without id goes if
    a document with an id is a near copy of it, and of such rows one stays where there is none; texts without words stay."""
    return near_duplicates.deduplicated(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that stand earlier in the corpus, null ids first; n_chars follows the text. Texts
    without such passages, null ones among them, stay as they are, and no row goes, though a text may become empty."""
    out = substring_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each copy that their source's target asks for. Texts without words add nothing to it
    and stand as often as all their source does; rows without a source are one source."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, position, n_tokens and token_ids of each row. Rows sorted by position are in training order: it is
    the row's place in the files of the stage before, which that stage wrote in order. Null and empty texts have no tokens."""
    out = bpe.encode(in_order(docs), carry=("doc_id", "lang", "source", POSITION))
    return out.select("doc_id", "lang", "source", POSITION, F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids").withColumnRenamed(POSITION, "position")


#: The place of a row while it is encoded, by a name that no table has.
POSITION = "__sievework_position"


def in_order(docs: DataFrame) -> DataFrame:
    """Adds POSITION, which rises from file to file and from row to row of a Parquet table; else from partition to partition."""
    try:
        part, cut = (F.regexp_extract("_metadata.file_name", p, 1).cast("bigint") for p in (r"part-(\d+)", r"-c(\d+)"))
        out = docs.select("*", (part * (1 << 40) + cut * (1 << 32) + F.col("_metadata.row_index")).alias(POSITION))
        out.schema  # resolved here: only a table that is read from files says where its rows stand
        return out
    except AnalysisException:
        return docs.withColumn(POSITION, F.monotonically_increasing_id())


def reachable(stage):
    """The stage, run with this code within reach of the workers."""
    return lambda spark, docs, sf_dir: stage(share_code(spark), docs, sf_dir)


STAGES = [(name, reachable(stage)) for name, stage in (("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substrings), ("mixing", mix), ("bpe", tokens))]
#: SQL can't express the tokenizer; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; what each stage gives is written and read again."""
    docs, folder = documents(spark, sf_dir), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
