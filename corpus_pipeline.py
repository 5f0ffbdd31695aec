"""A training-data pipeline over the documents table, each stage one corpus operator.

The order is that of STAGES: toxic documents go, then exact copies, near copies
and documents with benchmark passages; what remains is packed. Each stage's
result is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import common, decontam, exacthash, queries, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the scorer learns from the labels of this stage's documents."""
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal but for white space: the longest, then the smallest identifier."""
    return exacthash.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group of documents whose sets of five-word shingles are alike by 0.8 or more, by Jaccard."""
    return simhash.without_near_duplicates(docs, simhash.similar_documents(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in windows of 2048 ids, sources mixed in proportion."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage's model, fingerprint or tokenizer has a SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; returns the last one's rows. What a stage leaves in the shared folder goes once its result is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.mark()
    *stages, (_, last) = STAGES
    for name, stage in stages:
        path = f"{common.shared_root(spark)}/pipeline-{common.unique()}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        common.release(spark, since)
        common.own(path)
        docs = spark.read.parquet(path)
    return last(spark, docs, sf_dir)
