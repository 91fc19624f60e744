"""Incremental index maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.chunking import paragraph_chunks


def manifest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: str = "") -> DataFrame:
    """``(doc_id, fingerprint)``: digest of the whole text and of the chunk settings."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(settings), F.col(text)), 256)
    return df.select(doc_id, digest.alias("fingerprint"))


def manifest_diff(old: DataFrame, new: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Status of every document: added, changed, deleted or unchanged."""
    joined = old.select(doc_id, F.col("fingerprint").alias("_old")).join(
        new.select(doc_id, F.col("fingerprint").alias("_new")), doc_id, "full_outer"
    )
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") != F.col("_new"), "changed")
        .otherwise("unchanged")
    )
    return joined.select(doc_id, status.alias("status"))


def update_chunks(chunks: DataFrame, documents: DataFrame, diff: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """New chunk table: only added and changed documents are cut again."""
    stale = diff.where(F.col("status") != "unchanged").select(doc_id)
    fresh = diff.where(F.col("status").isin("added", "changed")).select(doc_id)
    kept = chunks.join(stale, doc_id, "left_anti")
    return kept.unionByName(paragraph_chunks(documents.join(fresh, doc_id, "left_semi"), doc_id, **options))


def file_manifest(files: DataFrame, settings: Column) -> DataFrame:
    """Manifest of files by name, size and time, with the build settings."""
    return files.select(
        "path",
        F.sha2(F.concat_ws("\u0001", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"), settings), 256).alias("fingerprint"),
    )
