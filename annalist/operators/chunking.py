"""Documents to chunks: windows, packed paragraphs, token units, running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_col, let, trimmed
from .running import running_sums


def window_bounds(size: int, overlap: int) -> tuple[int, int]:
    """Valid window size and step: at least 200 wide, overlap below the size."""
    size = max(200, int(size))
    return size, size - max(0, min(int(overlap), size - 1))


def window_starts(length: Column, size: int, step: int) -> Column:
    """Zero-based starts; the first window reaching the end is the last. Null without a length."""
    last = F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int") * step
    return F.when(length.isNotNull(), F.sequence(F.lit(0), last, F.lit(step)))


def window_texts(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Trimmed windows of one text as an array."""
    size, step = window_bounds(size, overlap)
    return F.transform(
        window_starts(F.length(text), size, step),
        lambda start: trimmed(F.substring(text, start + 1, F.lit(size))),
    )


def window_chunks(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 900, overlap: int = 150
) -> DataFrame:
    """One row per window: ``(doc_id, chunk_index, text)``."""
    return df.select(doc_id, F.posexplode(window_texts(F.col(text), size, overlap)).alias("chunk_index", "text"))


def pack(lengths: Column, limit: int, joiner: int) -> Column:
    """Greedy packing: start positions (zero-based) of the groups.

    Only integers travel through the fold; the texts are sliced afterwards, so packing
    stays linear in the document. An item longer than the limit stands alone.
    """
    empty = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("pos")
    )

    def step(acc: Column, n: Column) -> Column:
        used = acc["used"]
        joined = (used > 0) & (n <= limit) & (used + joiner + n <= limit)
        return F.struct(
            F.when(joined, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["pos"])).alias("starts"),
            F.when(joined, used + joiner + n).when(n > limit, F.lit(0)).otherwise(n).alias("used"),
            (acc["pos"] + 1).alias("pos"),
        )

    return F.aggregate(lengths, empty, step, lambda acc: acc["starts"])


def slices(items: Column, starts: Column) -> Column:
    """Cut an array at the given zero-based starts."""

    def cut(both: Column) -> Column:
        return F.transform(
            both["at"],
            lambda start, i: F.slice(
                both["all"], start + 1, F.coalesce(F.get(both["at"], i + 1), F.size(both["all"])) - start
            ),
        )

    return let(F.struct(items.alias("all"), starts.alias("at")), cut)


def paragraph_texts(
    text: Column | str,
    size: int = 900,
    overlap: int = 150,
    paragraph_pattern: str = r"\n\s*\n+",
    joiner: str = "\n\n",
    minimum: int = 20,
) -> Column:
    """Paragraphs packed up to ``size``; longer ones are windowed; short rests dropped."""
    size, step = window_bounds(size, overlap)
    clean = trimmed(F.regexp_replace(as_col(text), r"\r\n?", "\n"))
    paragraphs = F.filter(F.transform(F.split(clean, paragraph_pattern), trimmed), lambda p: p != "")

    def packed_texts(items: Column) -> Column:
        starts = pack(F.transform(items, F.length), size, len(joiner))
        return F.transform(slices(items, starts), lambda group: F.array_join(group, joiner))

    packed = let(paragraphs, packed_texts)
    chunks = F.flatten(F.transform(packed, lambda chunk: window_texts(chunk, size, overlap)))
    return F.filter(chunks, lambda c: F.length(c) >= minimum)


def paragraph_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per packed chunk: ``(doc_id, chunk_index, text)``."""
    return df.select(
        doc_id, F.posexplode(paragraph_texts(F.col(text), **options)).alias("chunk_index", "text")
    )


def chunk_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Chunks with an index running over the whole corpus in document order.

    Offsets come from the per-document counts, one narrow row each; the chunks
    themselves are never sorted.
    """
    listed = df.select(doc_id, *carry, paragraph_texts(F.col(text), **options).alias("_chunks"))
    counts = listed.select(doc_id, F.size("_chunks").cast("long").alias("_n"))
    offsets = running_sums(counts, [], [doc_id], {"_before": "_n"}, inclusive=False)
    return (
        listed.join(offsets.select(doc_id, "_before"), doc_id)
        .select(doc_id, *carry, "_before", F.posexplode_outer("_chunks").alias("_pos", "text"))
        .where(F.col("text").isNotNull())
        .select(doc_id, (F.col("_before") + F.col("_pos")).alias("chunk_index"), "text", *carry)
    )


def token_texts(text: Column | str, size: int = 1200, overlap: int = 100) -> Column:
    """Windows of white-space tokens, joined by single blanks."""
    tokens = F.filter(F.split(as_col(text), r"\s+"), lambda t: t != "")
    step = size - overlap
    return let(
        tokens,
        lambda ts: F.transform(
            window_starts(F.size(ts), size, step),
            lambda start: F.array_join(F.slice(ts, start + 1, F.lit(size)), " "),
        ),
    )


def token_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 100) -> DataFrame:
    """One row per token window: ``(doc_id, unit_index, text)``; blank texts give none."""
    units = F.filter(token_texts(F.col(text), size, overlap), lambda u: u != "")
    return df.select(doc_id, F.posexplode(units).alias("unit_index", "text"))
