"""Structured Streaming: directory ingest and live averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import paragraph_chunks


def stream_documents(spark: SparkSession, directory: str, schema: str, format: str = "json", max_files: int = 1000) -> DataFrame:
    """Documents of a growing directory, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(format).load(directory)


def first_arrivals(rows: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of a stream whose keys were not seen before, from state that each batch reads only for its own keys.

    With an event time, a key is remembered until ``late`` after its row and rows later than that are dropped, so
    the state stays bounded; without one, every key is remembered.
    """
    if ts is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ingest_chunks(
    documents: DataFrame, out: str, checkpoint: str, doc_id: str = "doc_id", ts: str | None = None, late: str = "1 day",
    once: bool = True, cut: Callable[..., DataFrame] = paragraph_chunks, **options,
) -> StreamingQuery:
    """Chunk each new document once and append to a parquet table.

    Which documents are new is kept as state of the stream; no batch reads the table it appends to. The batch number is a
    partition that is overwritten whole: a batch repeated after a failure gets the same rows from the same version of
    the state and replaces its own earlier output. Without ``once`` every row is a document of its own, be its id null or
    known; the source's log alone sees to it that no file is read twice, and no text is shuffled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        cut(batch, doc_id, **options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    fresh = first_arrivals(documents, [doc_id], ts, late) if once else documents
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_averages(details: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """Running averages per label over a stream of benchmark records (update mode)."""
    return details.groupBy(label).agg(F.count("*").alias("n_rows"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])


def _watermarked(rows: DataFrame, ts: str, late: str | None) -> DataFrame:
    return rows if late is None else rows.withWatermark(ts, late)


def windowed_averages(details: DataFrame, ts: str, label: str, metric: str, window: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Averages per event-time window; late records are taken up to the watermark, which is given if ``late`` is None."""
    bucket = F.window(ts, window, slide) if slide else F.window(ts, window)
    return _watermarked(details, ts, late).groupBy(bucket.alias("window"), label).agg(
        F.count("*").alias("n_rows"), F.avg(metric).alias(f"avg_{metric}")
    )


def session_averages(details: DataFrame, ts: str, key: str, metric: str, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Averages per session of a key, sessions ending after a gap."""
    return _watermarked(details, ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(
        F.count("*").alias("n_rows"), F.avg(metric).alias(f"avg_{metric}")
    )


def append_results(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each result row of a stream once, when the watermark has passed it; one partition per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return result.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
