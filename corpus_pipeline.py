"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of documents. Between stages the rows are written as
Parquet to the shared folder and read again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltascope.llm import crf, decontaminate, packing, secretscan, simhash
from deltascope.llm.common import cut
from deltascope.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secretscan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 4096."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("best-fit packing", sequences),
]

#: No SQL for the classifier, BM25 and the tokenizer: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other.

    A null text is an empty one, which the classifier judges like any other; rows that share a
    doc_id are told apart by their texts; of copies the smallest doc_id stays; texts are worked
    on whole; columns besides doc_id, text and n_chars pass through untouched up to the last
    stage, whatever their names; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
