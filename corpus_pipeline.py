"""A training corpus from `documents`: quality rules, one of each group of near copies, no benchmark passages, mixed to weights, as token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet in the shared folder and read again.

Null and empty texts have no words: the quality rules reject them. Texts of any length are read whole. Repeated rows (one id)
are one document: they stay together in near_copies and count each in the mixture. Of copies with different ids the least id
stays, so ties do not arise. Null ids, languages and sources are values like any other. An empty table gives an empty
result at each stage; an empty benchmark contaminates nothing. Columns that documents has more, whatever their names,
stay as they are up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, mixing, ngram_join, repetition, token_files
from marginalia.llm.queries import END_ID, PRODUCTION_MIX, tokenizer_path
from marginalia.sources.tables import table
from marginalia.workspace import written


#: Rows of texts that go to a Python worker at once; ten thousand, the default, of some kilobytes each fill its memory for nothing.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    _small_batches(spark)
    return repetition.keep_by_repetition(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shared word shingles the one with the least id stays."""
    _small_batches(spark)
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by target weights; a row for each epoch that takes it."""
    _small_batches(spark)
    return mixing.mix_documents(docs, mixing.source_domain(F.col("source")), PRODUCTION_MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: per row its place, length and checksum."""
    _small_batches(spark)
    return token_files.tokenise_to_files(docs, tokenizer_path(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: Tokens and links are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
