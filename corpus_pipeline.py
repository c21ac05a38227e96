"""The corpus pipeline: toxicity, near-duplicates, mixing, packing.

Each stage reads what its predecessor wrote; all but the last return documents with their
columns as they came.  Filtering stages judge each document on its own text (or its group)
and keep every other one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.llm.mixing import mix
from larder.llm.packing import pack
from larder.llm.queries import tokenizer_file
from larder.llm.simhash import drop_near_duplicates
from larder.llm.toxicity import drop_toxic, train

#: No stage but mixing can be said in SQL (learned model, fingerprints, tokenizer).
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from all labelled documents, does not find toxic."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of five-word-shingle similarity 0.8 or more."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture; its place is a document's place in the files."""
    mixed = mix(docs, carry=True)
    return mixed.orderBy("slot", "source", "offset").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens with the mixture's weights, each source in the mixture's order."""
    size = F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)))
    targets = docs.groupBy(F.coalesce("source", F.lit("")).alias("queue")).agg(F.floor(F.sqrt(size)).alias("weight"))
    return pack(docs, tokenizer_file(), end=2, window=4096, targets=targets, order=written_order(docs), with_ids=False)


def written_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """(file number, row number) of rows read from files that a sorted write made; else None.

    Spark numbers the files of a sorted write in order and keeps the order inside each.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None  # not read from files: the packer's own order
    number = F.concat(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.lpad(F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1), 6, "0"))
    return F.coalesce(number.try_cast("long"), F.lit(0)), F.col("_metadata.row_index")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
