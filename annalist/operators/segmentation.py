"""Dated segments of long texts, their metadata and their validation.

Everything happens inside one row per document, as folds over integers and slices;
no shuffle is needed before the final explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import as_col, let, text_array, trimmed
from ..functions.dates import extract_years, split_reason, temporal_label, year_span
from ..functions.text import lexicon_hits, regex_mentions, split_sentences
from .chunking import slices
from .running import running_index


def structural_blocks(
    text: Column | str, block_pattern: str = r"\n\s*\n+", heading: str = lx.HEADING_PATTERN
) -> Column:
    """Blank-line blocks, cut again before every heading line inside a block.

    A heading only starts a new block if a line precedes it, hence the look-behind.
    """
    blocks = F.filter(F.transform(F.split(trimmed(as_col(text)), block_pattern), trimmed), lambda b: b != "")
    before_heading = "(?<=\n)(?=" + heading[1:].replace("^", "") + ")"
    parts = F.flatten(F.transform(blocks, lambda b: F.split(b, before_heading)))
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def split_oversized(block: Column, limit: int) -> Column:
    """Sentences packed to the limit; one unbroken sentence is cut hard.

    The running length counts one character per joint although none is inserted.
    """
    sentences = split_sentences(block, "。！？\n", keep=True)
    empty = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("pos")
    )

    def step(acc: Column, n: Column) -> Column:
        joined = (acc["pos"] > 0) & (acc["used"] + n + 1 <= limit)
        return F.struct(
            F.when(joined, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["pos"])).alias("starts"),
            F.when(joined, acc["used"] + n + 1).otherwise(n).alias("used"),
            (acc["pos"] + 1).alias("pos"),
        )

    def packed(items: Column) -> Column:
        starts = F.aggregate(F.transform(items, F.length), empty, step, lambda acc: acc["starts"])
        return F.transform(slices(items, starts), lambda group: F.array_join(group, ""))

    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(block) - 1)), F.lit(limit)),
        lambda i: F.substring(block, i + 1, F.lit(limit)),
    )
    return (
        F.when(F.length(block) <= limit, F.array(block)).otherwise(
            let(sentences, lambda items: F.when(F.size(items) <= 1, pieces).otherwise(packed(items)))
        )
    )


def merge_short(blocks: Column, minimum: int, limit: int, respect_years: bool = True, bounded: bool = True) -> Column:
    """Join short blocks with their successor unless it opens with a year."""

    def flags(items: Column) -> Column:
        return F.transform(
            items,
            lambda b: F.struct(
                F.length(b).alias("n"),
                (b.rlike(lx.LEADING_YEAR_PATTERN) if respect_years else F.lit(False)).alias("year"),
            ),
        )

    empty = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("pos")
    )

    def step(acc: Column, item: Column) -> Column:
        room = (acc["used"] + item["n"] + 1 <= 2 * limit) if bounded else F.lit(True)
        joined = (acc["pos"] > 0) & (acc["used"] < minimum) & ~item["year"] & room
        return F.struct(
            F.when(joined, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["pos"])).alias("starts"),
            F.when(joined, acc["used"] + item["n"] + 2).otherwise(item["n"]).alias("used"),
            (acc["pos"] + 1).alias("pos"),
        )

    def merged(items: Column) -> Column:
        starts = F.aggregate(flags(items), empty, step, lambda acc: acc["starts"])
        return F.transform(slices(items, starts), lambda group: F.array_join(group, "\n\n"))

    return let(blocks, merged)


def segment_texts(text: Column | str, minimum: int = 300, maximum: int = 800, block_pattern: str = r"\n\s*\n+") -> Column:
    """Final segment texts of one document, trimmed and non-empty."""
    text = trimmed(F.coalesce(as_col(text), F.lit("")))
    expanded = F.flatten(
        F.transform(structural_blocks(text, block_pattern), lambda b: split_oversized(b, maximum))
    )
    merged = merge_short(expanded, minimum, maximum)
    final = F.flatten(
        F.transform(
            merged,
            lambda m: F.when(F.length(m) > 2 * maximum, split_oversized(m, maximum)).otherwise(F.array(m)),
        )
    )
    final = F.filter(F.transform(final, trimmed), lambda s: s != "")
    return (
        F.when(text == "", text_array([]))
        .when(F.length(text) < minimum, F.array(text))
        .otherwise(final)
    )


def describe_segments(df: DataFrame, reason: Column) -> DataFrame:
    """Attach years, places, titles, time label and split reason to segment rows."""
    return df.select(
        "*",
        extract_years("text").alias("years"),
        lexicon_hits("text", lx.SEGMENT_PLACES).alias("locations"),
        regex_mentions("text", lx.FIGURE_TITLE_PATTERN).alias("figures"),
        temporal_label(extract_years("text")).alias("temporal_label"),
        reason.alias("split_reason"),
    )


def segment_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", minimum: int = 300, maximum: int = 800,
    block_pattern: str = r"\n\s*\n+",
) -> DataFrame:
    """Segments with metadata: one row per segment, numbered from zero."""
    short = F.length(trimmed(F.col(text))) < minimum
    exploded = df.select(
        doc_id,
        short.alias("_short"),
        F.posexplode(segment_texts(F.col(text), minimum, maximum, block_pattern)).alias("segment_index", "text"),
    )
    reason = F.when(F.col("_short"), "single_short").otherwise(split_reason("text", "segment_index"))
    return describe_segments(exploded, reason).drop("_short")


def validate_segments(
    segments: DataFrame, doc_id: str = "doc_id", minimum: int = 300, maximum: int = 800, max_span: int = 15
) -> DataFrame:
    """Issue rows ``(doc_id, segment_index, severity, issue)``.

    The year check uses the whole span, so texts told backwards are covered too.
    """
    ranked = running_index(
        segments.select(doc_id, "segment_index", F.length("text").alias("n"), year_span("years").alias("span")),
        ["segment_index"],
        "_expected",
        [doc_id],
    )

    def issue(condition: Column, severity: str, name: str, at: str = "segment_index") -> Column:
        return F.when(
            condition,
            F.struct(F.col(at).cast("long").alias("segment_index"), F.lit(severity).alias("severity"), F.lit(name).alias("issue")),
        )

    issues = F.array_compact(
        F.array(
            issue(F.col("n") < minimum * 0.5, "warning", "too_short"),
            issue(F.col("n") > maximum * 3, "error", "too_long"),
            issue(F.col("span") > max_span, "warning", "wide_year_span"),
            issue(F.col("segment_index") != F.col("_expected"), "error", "index_gap", "_expected"),
        )
    )
    return ranked.select(doc_id, F.inline(issues))


def segmentation_passed(segments: DataFrame, issues: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: segment count, characters, and whether no error was found."""
    errors = issues.where("severity = 'error'").groupBy(doc_id).agg(F.count("*").alias("_errors"))
    totals = segments.groupBy(doc_id).agg(
        F.count("*").alias("segment_count"), F.sum(F.length("text")).alias("total_chars")
    )
    return totals.join(errors, doc_id, "left").select(
        doc_id, "segment_count", "total_chars", F.col("_errors").isNull().alias("passed")
    )
