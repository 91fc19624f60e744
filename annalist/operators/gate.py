"""Quality gate: issues per chapter and pair, verdict per document, repair list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from .quality import adjacent_overlaps, boilerplate_count, epilogue_sentence, summary_share

#: Optional chapter columns; missing ones count as unknown and raise no issue.
OPTIONAL = ("target_chars", "score", "fact_score", "rag_utilization", "hallucination", "temporal_coherence")

SUGGESTIONS = {
    "length_short": "raise the length hint or lower the temperature",
    "length_long": "lower the token limit or stress the length limit",
    "score": "check the retrieved evidence or change the provider",
    "fact": "retrieve more evidence or change the retrieval mode",
    "rag_utilization": "retrieve more entities and ask for their use",
    "hallucination": "check entities outside the evidence and tighten the prompt",
    "temporal_coherence": "use only years of the source text",
    "summary": "describe, do not summarise",
    "style": "avoid stock transitions",
    "epilogue": "end where the narrative pauses, without reflection",
    "repetition": "give the previous chapter's summary and ask for new content",
}


def chapter_issues(
    chapters: DataFrame, doc_id: str = "doc_id", idx: str = "idx", text: str = "text",
    thresholds: dict[str, float] | None = None, summary: str = lx.SUMMARY_GATE_PATTERN,
    boilerplate: str = lx.BOILERPLATE_PATTERN, epilogue: str = lx.EPILOGUE_PATTERN, terminators: str = "。！？",
) -> DataFrame:
    """One row per failed rule: ``(doc_id, idx, dimension, severity, message, suggestion)``."""
    limit = {**lx.GATE_THRESHOLDS, **(thresholds or {})}
    for name in OPTIONAL:
        if name not in chapters.columns:
            chapters = chapters.withColumn(name, F.lit(None).cast("double"))
    last = chapters.groupBy(doc_id).agg(F.max(idx).alias("_last"))
    target = F.col("target_chars")
    ratio = F.when(target.isNotNull(), F.length(text) / F.greatest(target, F.lit(1)))
    checked = chapters.join(last, doc_id).select(
        doc_id, idx, *OPTIONAL,
        ratio.alias("_ratio"),
        summary_share(text, summary, terminators).alias("_summary"),
        boilerplate_count(text, boilerplate).alias("_boilerplate"),
        F.when(F.col(idx) < F.col("_last"), epilogue_sentence(text, epilogue, 3, terminators)).alias("_epilogue"),
    )

    def issue(condition: Column, dimension: str, severity: str, value: Column, advice: str | None = None) -> Column:
        message = F.concat(F.lit(f"{dimension}="), F.coalesce(value.cast("string"), F.lit("")))
        return F.when(
            condition,
            F.struct(
                F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), message.alias("message"),
                F.lit(SUGGESTIONS[advice or dimension]).alias("suggestion"),
            ),
        )

    c = F.col
    rules = F.array(
        issue(c("_ratio") < limit["min_length_ratio"], "length", "error", F.round("_ratio", 3), "length_short"),
        issue(c("_ratio") > limit["max_length_ratio"], "length", "warning", F.round("_ratio", 3), "length_long"),
        issue(c("score") < limit["min_segment_score"], "score", "error", F.round("score", 3)),
        issue(c("fact_score") < limit["min_fact_score"], "fact", "error", F.round("fact_score", 3)),
        issue(c("rag_utilization") < limit["min_rag_utilization"], "rag_utilization", "error", F.round("rag_utilization", 3)),
        issue(c("hallucination") < limit["min_hallucination_score"], "hallucination", "error", F.round("hallucination", 3)),
        issue(c("temporal_coherence") < limit["min_temporal_coherence"], "temporal_coherence", "error", F.round("temporal_coherence", 3)),
        issue(c("_summary") > limit["max_summary_sentence_ratio"], "summary", "warning", F.round("_summary", 3)),
        issue(c("_boilerplate") >= 2, "style", "warning", c("_boilerplate")),
        issue(c("_epilogue").isNotNull(), "epilogue", "warning", c("_epilogue")),
    )
    return checked.select(doc_id, idx, F.inline(F.array_compact(rules)))


def cross_issues(
    chapters: DataFrame, doc_id: str = "doc_id", idx: str = "idx", text: str = "text",
    max_overlap: float = lx.GATE_THRESHOLDS["max_cross_repetition"], n: int = 6, samples: int = 5,
) -> DataFrame:
    """Adjacent chapters that repeat each other, with sample grams in lexical order."""
    pairs = adjacent_overlaps(chapters, doc_id, idx, text, n, samples)
    return pairs.where(F.col("ratio") > max_overlap).select(
        doc_id, idx, (F.col(idx) + 1).alias("next_idx"), F.lit("repetition").alias("dimension"),
        F.lit("error").alias("severity"), "ratio", "samples",
    )


def gate(chapters: DataFrame, issues: DataFrame, cross: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: chapter count, errors, mean of known scores (0 if none), passed or not."""
    if "score" not in chapters.columns:
        chapters = chapters.withColumn("score", F.lit(None).cast("double"))
    base = chapters.groupBy(doc_id).agg(
        F.count("*").alias("n_chapters"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall_score")
    )
    errors = (
        issues.select(doc_id, "severity").unionByName(cross.select(doc_id, "severity"))
        .where(F.col("severity") == "error").groupBy(doc_id).agg(F.count("*").alias("n_errors"))
    )
    return base.join(errors, doc_id, "left").select(
        doc_id, "n_chapters", "overall_score", F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.col("n_errors").isNull().alias("passed"),
    )


def remediation(issues: DataFrame, cross: DataFrame, doc_id: str = "doc_id", idx: str = "idx", joiner: str = "；") -> DataFrame:
    """Chapters to redo: own errors plus the later chapter of each repeating pair.

    A chapter has at most one row per rule, so the gathered lists are short.
    """
    own = issues.where(F.col("severity") == "error").select(
        doc_id, idx, F.lit(0).alias("_o"), "dimension", "message", "suggestion"
    )
    later = cross.where(F.col("severity") == "error").select(
        doc_id, F.col("next_idx").alias(idx), F.lit(1).alias("_o"), "dimension",
        F.concat(F.lit("repetition="), F.round("ratio", 3).cast("string")).alias("message"),
        F.lit(SUGGESTIONS["repetition"]).alias("suggestion"),
    )
    gathered = own.unionByName(later).groupBy(doc_id, idx).agg(
        F.array_sort(F.collect_list(F.struct("_o", "dimension", "message", "suggestion"))).alias("_i")
    )
    return gathered.select(
        doc_id, idx, F.array_join(F.col("_i.message"), joiner).alias("reasons"),
        F.array_join(F.col("_i.suggestion"), joiner).alias("adjustments"),
    )
