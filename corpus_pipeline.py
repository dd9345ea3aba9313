"""A corpus cleaned and packed: quality classifier, quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and reads it
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlight.llm import bin_packing, jaccard_join, quality_classifier, quality_rules, secret_scan
from loomlight.llm.common import shared_folder


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; null texts count as empty, null ids and repeated rows are judged each."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail them, repeated rows are judged each."""
    return quality_rules.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (of equal ids with words, one row).

    Links as the stage's defaults have them: five words, a similarity of 0.8 or more.
    Documents without a word or an id link with nothing and stay.
    """
    found = jaccard_join.link_components(docs, percent=80, width=5).filter("n_shingles > 0 and doc_id is not null")
    by_id = found.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("first"), F.count("*").alias("rows"))
    told = by_id.filter("first != id or rows > 1").select("id", (F.col("first") != F.col("id")).alias("gone"))
    row, words = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words")
    named = docs.filter(F.col("doc_id").isNotNull()).select(row, F.col("doc_id").cast("long").alias("id"), words)
    left = named.join(told, "id", "left").filter("gone is null or not gone or not words")
    # told ids that stay have several rows: the first of those with words
    turn = F.row_number().over(Window.partitionBy("id", "words").orderBy(F.xxhash64("row.text"), "row.text"))
    kept = left.filter("gone is null").select("row.*").union(left.filter("gone is not null").withColumn("turn", turn).filter("turn = 1 or not words").select("row.*"))
    return kept.union(docs.filter(F.col("doc_id").isNull()))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets taken out of their texts; null texts stay null."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null texts are their end mark alone."""
    return bin_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("jaccard_join", without_near_duplicates),
    ("secret_scan", redacted),
    ("bin_packing", packed),
]

#: The first stages train models, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's folder goes when the next one is written, the last one's with the session."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(path(f"{folder}/{before}"), True)
        before = name
    return docs
