"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, written as Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annalist.llm import minhash, packing, secret_scan, toxicity
from annalist.llm.common import shared_folder
from annalist.llm.queries import FINDINGS, LABELLED, severity_grades, vocabulary
from annalist.session import cut_lineage
from annalist.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, does not reject."""
    model = toxicity.fit(docs, severity_grades(load(spark, sf_dir, "labels")), LABELLED)
    return toxicity.score(docs, model).where(~F.col("toxic")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; rows without an id stay."""
    verdicts = cut_lineage(minhash.near_duplicates(docs, percent=80).select("doc_id", "kept"))
    removed = verdicts.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(removed, "doc_id", "left_anti")
    if verdicts.where("kept").groupBy("doc_id").count().where("count > 1").head(1):
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    findings = cut_lineage(secret_scan.scan(docs))
    model = secret_scan.fit(secret_scan.audited(findings), FINDINGS)
    clean = secret_scan.redact(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_copies), ("secrets", mask_secrets), ("packing", pack)]

#: The stages learn models and cut by hashes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = load(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
