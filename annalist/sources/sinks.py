"""Renderings and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import text_array
from ..operators.running import running_index


def event_to_text(title: Column, date: Column, location: Column, content: Column, keywords: Column | None = None) -> Column:
    """Labelled rendering of an event; the keyword line only with keywords."""
    labels = lx.EVENT_LABELS
    parts = [
        F.concat(F.lit(labels["title"]), title), F.concat(F.lit(labels["date"]), date),
        F.concat(F.lit(labels["location"]), location), F.lit(""), content,
    ]
    text = F.array_join(F.array(*parts), "\n")
    if keywords is None:
        return text
    words = F.coalesce(keywords, text_array([]))
    return F.when(F.size(words) > 0, F.concat(text, F.lit("\n\n关键词："), F.array_join(words, ", "))).otherwise(text)


def event_texts(events: DataFrame, order_col: str) -> DataFrame:
    """Numbered renderings, one row per event: ``(name, text)``."""
    numbered = running_index(events, [order_col], "_no")
    keywords = F.col("keywords") if "keywords" in events.columns else None
    return numbered.select(
        F.format_string("event_%04d", F.col("_no")).alias("name"),
        event_to_text(F.col("title"), F.col("date"), F.col("location"), F.col("content"), keywords).alias("text"),
    )


def write_event_texts(events: DataFrame, order_col: str, path: str) -> None:
    event_texts(events, order_col).write.mode("overwrite").parquet(path)


def separated(events: DataFrame, source: str, order_col: str, text: str) -> DataFrame:
    """Rows ready to be written in order with a separator line before all but the first of a source.

    The joined file never exists as one string, so a source of any size stays distributed.
    """
    first = events.groupBy(source).agg(F.min(order_col).alias("_first"))
    lead = F.when(F.col(order_col) == F.col("_first"), F.col(text)).otherwise(F.concat(F.lit("---\n\n"), F.col(text)))
    return events.join(first, source).select(source, order_col, lead.alias("text"))


def write_separated(events: DataFrame, source: str, order_col: str, text: str, path: str) -> None:
    """One folder per source; part files follow the order column."""
    rows = separated(events, source, order_col, text).repartitionByRange(source, order_col)
    rows.sortWithinPartitions(source, order_col).select(source, "text").write.mode("overwrite").partitionBy(source).text(path)


def write_chunks_and_vectors(chunks: DataFrame, vectors: DataFrame, manifest: DataFrame, path: str, key: Sequence[str] = ("chunk_index",)) -> None:
    """One table of chunks with their vectors, and the manifest it was built from."""
    chunks.join(vectors, list(key)).write.mode("overwrite").parquet(f"{path}/chunks")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def export_benchmark(summary: DataFrame, details: DataFrame, best: DataFrame, path: str, by: str = "strategy") -> None:
    """Summary CSV, details per strategy, and the winners."""
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    details.write.mode("overwrite").option("header", True).partitionBy(by).csv(f"{path}/details")
    best.write.mode("overwrite").json(f"{path}/best")


def batch_rows(details: DataFrame, label: str, metrics: Sequence[str], keys: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Flat detail rows and the AVERAGE trailer, with ``section`` to keep the trailer last."""
    flat = details.select(
        F.lit(0).alias("section"), *[F.col(k).cast("string").alias(k) for k in keys], label,
        *[F.array_join(a, "|").alias(a) for a in arrays], *metrics,
    )
    trailer = details.agg(*[F.avg(m).alias(m) for m in metrics]).select(
        F.lit(1).alias("section"),
        *[F.lit("AVERAGE" if i == 0 else "").alias(k) for i, k in enumerate(keys)], F.lit("").alias(label),
        *[F.lit("").alias(a) for a in arrays], *metrics,
    )
    return flat.unionByName(trailer)


def export_batch(details: DataFrame, averages: DataFrame, settings: DataFrame, label: str, metrics: Sequence[str],
                 keys: Sequence[str], path: str, arrays: Sequence[str] = ()) -> None:
    """Results as JSON lines, settings and averages beside them, and a CSV with its trailer."""
    details.write.mode("overwrite").json(f"{path}/results")
    averages.write.mode("overwrite").json(f"{path}/averages")
    settings.write.mode("overwrite").json(f"{path}/settings")
    rows = batch_rows(details, label, metrics, keys, arrays)
    rows.repartitionByRange("section", keys[0]).sortWithinPartitions("section", *keys).write.mode("overwrite").option("header", True).csv(f"{path}/table")


def quality_report(segments: DataFrame, metrics: DataFrame, document: DataFrame, doc_id: str, idx: str) -> DataFrame:
    """One row per segment with its metric map and the document's scores, for nested readers.

    Reports stay one row per segment: a document of any length never becomes one row.
    """
    mapped = metrics.groupBy(doc_id, idx).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics")
    )
    return segments.join(mapped, [doc_id, idx], "left").join(document, doc_id, "left")


#: Segments that one row of a nested report holds.
REPORT_SEGMENTS = 1000


def nested_report(
    segments: DataFrame, metrics: DataFrame, entities: DataFrame, document: DataFrame, cross: DataFrame, gate: DataFrame, doc_id: str, idx: str,
    part_segments: int = REPORT_SEGMENTS,
) -> DataFrame:
    """Nested documents ``(doc_id, part, segment_count, segments, document, cross_chapter, quality_gate)``.

    ``segments(doc, idx, overall, fact_score)``, ``metrics(doc, idx, name, value, max_value)``, ``entities(doc, idx, name)``: names in
    a segment, ``document`` and ``cross(doc, name, value, max_value)``, ``gate(doc, passed, overall_score, chapters)``. A document of
    more segments than ``part_segments`` has several rows, each with its own run of segments by number and all of the rest,
    so no row grows with a document; an ordinary one has a single row.
    """
    entry = F.struct("name", F.struct("value", F.col("max_value").alias("max")).alias("entry"))
    by_name = lambda rows, keys, name: rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))
    listed = entities.groupBy(doc_id, idx).agg(F.array_sort(F.collect_set("name")).alias("entities"))
    joined = segments.join(by_name(metrics, [doc_id, idx], "metrics"), [doc_id, idx], "left").join(listed, [doc_id, idx], "left")
    segment = F.struct(
        F.col(idx).alias("segment_index"), "overall", "fact_score", "metrics", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))
    parts = joined.groupBy(doc_id, F.floor(F.col(idx) / part_segments).cast("int").alias("part")).agg(F.collect_list(segment).alias("segments"))
    # Segments are put in order by their numbers; maps cannot be compared.
    parts = parts.withColumn("segments", F.array_sort("segments", lambda a, b: F.signum(a["segment_index"] - b["segment_index"]).cast("int")))
    counts = segments.groupBy(doc_id).agg(F.count("*").alias("segment_count"))
    verdict = gate.select(doc_id, F.struct("passed", "overall_score", F.col("chapters").alias("chapters_to_regenerate")).alias("quality_gate"))
    whole = counts.join(by_name(document, [doc_id], "document"), doc_id, "left").join(by_name(cross, [doc_id], "cross_chapter"), doc_id, "left").join(verdict, doc_id, "left")
    return parts.join(whole, doc_id).select(doc_id, "part", "segment_count", "segments", "document", "cross_chapter", "quality_gate")


def write_quality_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
