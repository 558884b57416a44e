"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and works on all of them:

1. quality classifier: documents that score below 0.3 go;
2. n-gram Jaccard join: of each group of linked documents the one with the least doc_id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. PII: spans of personal data are replaced by their kind;
5. packing: the texts are packed into sequences of 2048 tokens.

Defined results, as chained: a null text counts as empty in every stage and keeps its row unless the classifier rejects it; texts
without words are copies of nothing; repeated rows and rows of one doc_id are scored and searched each by itself, and of linked
rows those of the group's least doc_id stay; an empty ``documents`` gives no rows; other columns, whatever their names, go along
to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.llm import jaccard, leaks, packing, pii, quality
from fixwave.llm.common import Scratch
from fixwave.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), accept=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs, percent=80, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path(), 2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]
#: Tokenising and the fitted classifier have no form in SQL; the stages are tested one by one and as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
