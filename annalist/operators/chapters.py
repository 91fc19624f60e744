"""What earlier chapters tell the next one: briefs, phrases, repeats, roles.

Chapter numbers must be consecutive within a document. Look-back is done by sending
each row to the keys that need it, never by a window over one whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import text_array
from .running import running_sums


def previous_values(chapters: DataFrame, doc_id: str, idx: str, value: str, depth: int = 3, name: str = "previous") -> DataFrame:
    """The values of the ``depth`` preceding chapters, oldest first, as an array."""
    sent = chapters.select(
        doc_id, F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_back"), F.col(idx).alias("_i"), F.col(value).alias("_v")
    )
    met = sent.groupBy(doc_id, (F.col("_i") + F.col("_back")).alias(idx)).agg(
        F.max(F.col("_back") == 0).alias("_own"),
        F.array_sort(F.collect_list(F.when(F.col("_back") > 0, F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))))).alias("_p"),
    )
    return met.where("_own").select(doc_id, idx, F.col("_p.v").alias(name))


def previous_phrases(chapters: DataFrame, phrases: DataFrame, doc_id: str, idx: str, depth: int = 12) -> DataFrame:
    """Distinct phrases among the last ``depth`` recorded before each chapter.

    Phrases are numbered through the document; a chapter then asks for the ``depth``
    numbers before its own, which makes the look-back a bounded equi-join.
    """
    counts = phrases.groupBy(doc_id, idx).agg(F.count("*").alias("_n"))
    numbered = chapters.select(doc_id, idx).join(counts, [doc_id, idx], "left").fillna(0, ["_n"])
    before = running_sums(numbered, [doc_id], [idx], {"_before": "_n"}, inclusive=False)
    before = before.select(doc_id, idx, "_before")
    placed = phrases.join(before, [doc_id, idx]).select(
        doc_id, (F.col("_before") + F.col("rank") - 1).alias("_at"), "phrase"
    )
    wanted = before.select(
        doc_id, idx, F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_back"), "_before"
    ).select(doc_id, idx, (F.col("_before") - F.col("_back")).alias("_at"))
    found = wanted.where(F.col("_at") >= 0).join(placed, [doc_id, "_at"]).groupBy(doc_id, idx).agg(
        F.array_distinct(F.array_sort(F.collect_list(F.struct("_at", "phrase")))["phrase"]).alias("_p")
    )
    return chapters.select(doc_id, idx).join(found, [doc_id, idx], "left").select(
        doc_id, idx, F.coalesce("_p", text_array([])).alias("previous_phrases")
    )


def repeat_previous(chapters: DataFrame, phrases: DataFrame, doc_id: str, idx: str, threshold: float = 0.15) -> DataFrame:
    """Share of a chapter's phrases already used in any earlier chapter, and the warning.

    A phrase was used before exactly if its first chapter lies earlier, so one minimum
    per phrase replaces a growing set per chapter.
    """
    first = phrases.groupBy(doc_id, "phrase").agg(F.min(idx).alias("_first"))
    shares = phrases.join(first, [doc_id, "phrase"]).groupBy(doc_id, idx).agg(
        F.count("*").alias("n_phrases"), F.count_if(F.col("_first") < F.col(idx)).alias("n_repeated")
    )
    ratio = F.col("n_repeated") / F.col("n_phrases")
    return (
        chapters.select(doc_id, idx).join(shares, [doc_id, idx], "left").fillna(0, ["n_phrases", "n_repeated"])
        .select(
            doc_id, idx, "n_phrases", "n_repeated",
            F.when(F.col("n_phrases") > 0, ratio).otherwise(0.0).alias("repeat_ratio"),
            F.when(F.col("n_phrases") > 0, ratio >= threshold).otherwise(False).alias("warn"),
        )
    )


def chapter_roles(chapters: DataFrame, doc_id: str, idx: str) -> DataFrame:
    """Opening, body or closing, by position in the document."""
    ends = chapters.groupBy(doc_id).agg(F.min(idx).alias("_a"), F.max(idx).alias("_z"), F.count("*").alias("n_chapters"))
    role = F.when(F.col(idx) == F.col("_a"), "opening").when(F.col(idx) == F.col("_z"), "closing").otherwise("body")
    return chapters.join(ends, doc_id).select(*chapters.columns, "n_chapters", role.alias("role"))


def context_lines(index: Column, period: Column, text: Column) -> Column:
    """A line of the running synopsis."""
    return F.concat(F.lit("- "), (index + 1).cast("string"), F.lit(" ("), period, F.lit("): "), text)
