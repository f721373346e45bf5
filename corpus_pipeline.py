"""A corpus pipeline: five stages, each written as Parquet and reread by the next.

Documents that the quality classifier rejects go; of equal texts the one of largest id stays; of
near-duplicates the one of smallest id; contaminated documents go; the rest is encoded. All but the last stage
return all columns of documents, whatever their names.

Defined cases: a null text counts as empty everywhere and is scored, compared and encoded as such, while the stages hand the null on; of
equal texts a null id gives way to any other, and rows of a null id are never near-duplicates of others; rows that repeat an id with
different texts are told apart by their texts; repeated rows are one after exact_dedup; without labels nothing is rejected, without a benchmark nothing is contaminated, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import decontaminate, exact_dedup, quality, sentencepiece, simhash
from cohortloom.llm.common import dropped, read, ship, written
from cohortloom.llm.queries import tokenizer_file


#: Rows of an Arrow batch, and words that a Python worker remembers: workers live through all stages, so each stage stays small.
BATCH_ROWS, MAX_WORDS = 2000, 20_000


def lean(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs, keep_columns=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return sentencepiece.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), max_words=MAX_WORDS)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("tokens", token_stage),
]

#: SQL can't express the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs, f"pipeline-{name}", codec="snappy")
            if before:
                dropped(spark, before)
            before = path
    return docs
