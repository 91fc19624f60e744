"""Ranking metrics and benchmark summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import share
from ..functions.records import judge_scores, judged_score
from .terms import canonical_name

CUTS = (3, 5, 10)


def ideal_dcg(n: Column, k: int, grade: float = 3.0) -> Column:
    """Discounted gain of ``min(k, n)`` results of the top grade."""
    sums = [0.0]
    for i in range(k):
        sums.append(sums[-1] + grade / math.log2(i + 2))
    table = F.array(*[F.lit(s) for s in sums])
    return F.get(table, F.least(F.lit(k), F.greatest(F.lit(0), n)).cast("int"))


def dcg(grade: Column, rank: Column, k: int) -> Column:
    """Aggregate: discounted gain over the first k ranks."""
    return F.coalesce(F.sum(F.when(rank <= k, grade / F.log2(rank + 1))), F.lit(0.0))


def ndcg(gain: Column, n_relevant: Column, k: int) -> Column:
    """Gain over the best possible list of graded results; 0 without relevant ones."""
    ideal = ideal_dcg(n_relevant, k)
    return F.when(ideal > 0, gain / ideal).otherwise(F.lit(0.0))


def judged_metrics(results: DataFrame, judgements: DataFrame, relevant: DataFrame, key: str = "name", cuts: Sequence[int] = CUTS) -> DataFrame:
    """nDCG at the cuts and reciprocal rank of the first grade of two or more.

    ``results(query_id, rank, key)``, ``judgements(query_id, key, grade)`` where missing
    means 0, ``relevant(query_id, n_relevant)`` names every query to report.
    """
    graded = results.join(judgements.select("query_id", key, "grade"), ["query_id", key], "left")
    grade, rank = F.coalesce("grade", F.lit(0.0)), F.col("rank")
    gains = graded.groupBy("query_id").agg(
        *[dcg(grade, rank, k).alias(f"_g{k}") for k in cuts],
        F.min(F.when(grade >= 2, rank)).alias("_first"),
    )
    return relevant.join(gains, "query_id", "left").select(
        "query_id",
        *[ndcg(F.coalesce(f"_g{k}", F.lit(0.0)), F.col("n_relevant"), k).alias(f"ndcg_{k}") for k in cuts],
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
    )


def judged_results(results: DataFrame, answers: DataFrame, key: str = "name") -> DataFrame:
    """Grades of results from judges' free-form answers ``(query_id, answer)``."""
    parsed = answers.select("query_id", judge_scores("answer").alias("_scores"))
    return results.join(parsed, "query_id", "left").select(
        *results.columns, judged_score(F.col("_scores"), F.col(key)).alias("grade")
    )


def ranking_metrics(results: DataFrame, truth: DataFrame, key: str = "name", cuts: Sequence[int] = CUTS,
                    variants: dict[str, list[str]] | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Precision, recall, F1, hit@k and MRR per query.

    ``queries(query_id)`` names the queries to report, so that those without truth count as zero; without it, the
    queries of either table are reported. Names are compared by one canonical id each, in rank order.
    """
    expected = truth.select("query_id", canonical_name(key, variants).alias("_id")).distinct()
    ranked = (
        results.select("query_id", canonical_name(key, variants).alias("_id"), "rank")
        .groupBy("query_id", "_id")
        .agg(F.min("rank").alias("rank"))
    )
    matched = ranked.join(expected.withColumn("_hit", F.lit(True)), ["query_id", "_id"], "left")
    found = matched.groupBy("query_id").agg(
        F.count("*").alias("n_retrieved"),
        F.count_if("_hit").alias("n_hits"),
        F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_first"),
    )
    sizes = expected.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    if queries is None:
        queries = truth.select("query_id").unionByName(results.select("query_id"))
    asked = queries.select("query_id").distinct()
    joined = asked.join(sizes, "query_id", "left").join(found, "query_id", "left").fillna(0, ["n_truth", "n_retrieved", "n_hits"])
    precision = share(F.col("n_hits"), F.col("n_retrieved"), 0.0)
    recall = share(F.col("n_hits"), F.col("n_truth"), 0.0)
    scored = joined.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return scored.select(
        "query_id", "n_retrieved", "n_truth", "n_hits", "precision", "recall",
        F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"),
        *[F.coalesce(F.col("_first") <= k, F.lit(False)).alias(f"hit_{k}") for k in cuts],
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
    )


def benchmark_summary(details: DataFrame, by: Sequence[str] = ("strategy",), means: Sequence[str] = (), rates: Sequence[str] = (),
                      latency: str | None = "latency_ms") -> DataFrame:
    """Per strategy: query count, mean metrics to 4 digits, hit rates, mean latency to 2."""
    columns = [F.count("*").alias("total_queries")]
    columns += [F.round(F.avg(m), 4).alias(f"avg_{m}") for m in means]
    columns += [F.round(F.avg(F.col(r).cast("int")), 4).alias(r) for r in rates]
    if latency:
        columns.append(F.round(F.avg(latency), 2).alias(f"avg_{latency}"))
    return details.groupBy(*by).agg(*columns)


def best_strategies(summary: DataFrame, metrics: Sequence[str], by: str = "strategy") -> DataFrame:
    """The winner of each summary metric; equal values go to the first name."""
    columns = []
    for m in metrics:
        # max over (value, reversed order of names) is expressed as min over negatives.
        columns.append(F.min_by(F.col(by), F.struct(-F.col(m), F.col(by))).alias(f"best_{m}"))
    return summary.agg(*columns)


def grouped_averages(details: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Overall and per-label means; ``n_rows`` counts rows, not values."""
    return details.rollup(label).agg(
        F.grouping(label).cast("int").alias("is_total"),
        F.count("*").alias("n_rows"),
        *[F.avg(m).alias(f"avg_{m}") for m in metrics],
    )


def weighted_score(metrics: DataFrame, weights: DataFrame, unit: str = "unit_id") -> DataFrame:
    """``10 * sum(normalised * weight) / sum(weight)`` per unit over long metric rows."""
    weight = F.coalesce("weight", F.lit(1.0))
    normalised = F.when(F.col("max_value") == 0, 0.0).otherwise(F.col("value") / F.col("max_value"))
    joined = metrics.join(weights.select("name", "weight"), "name", "left")
    return joined.groupBy(unit).agg((F.sum(normalised * weight) / F.sum(weight) * 10).alias("score"))


def document_score(segments: DataFrame, doc_id: str = "doc_id", score: str = "score", length: str = "n_chars", judge: str | None = None) -> DataFrame:
    """Length-weighted mean of segment scores; a judge's score enters one part in ten."""
    value = F.col(score)
    if judge:
        value = F.when(F.col(judge).isNotNull(), (F.col(score) * 9.0 + F.col(judge)) / 10.0).otherwise(value)
    total = F.sum(length)
    return segments.groupBy(doc_id).agg(
        (F.sum(value * F.col(length)) / F.when(total == 0, F.lit(1)).otherwise(total)).alias("document_score")
    )


def provider_pivot(scores: DataFrame, provider: str, dimension: str, value: str, dimensions: Sequence[str]) -> DataFrame:
    """One row per provider with its mean in each dimension and overall."""
    pivoted = scores.groupBy(provider).pivot(dimension, list(dimensions)).agg(F.avg(value))
    overall = scores.groupBy(provider).agg(F.avg(value).alias("overall"))
    return pivoted.join(overall, provider)


def best_providers(pivoted: DataFrame, provider: str, dimensions: Sequence[str]) -> DataFrame:
    """``(dimension, best, value)``: the provider with the highest mean in each dimension and overall; ties to the smaller name."""
    named = [*dimensions, "overall"]
    long = pivoted.select(provider, F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in named])))
    best = F.min(F.struct((-F.col("value")).alias("loss"), F.col(provider).alias("best"), "value"))
    return long.where("value IS NOT NULL").groupBy("dimension").agg(best.alias("_b")).select("dimension", "_b.best", "_b.value")


def verdict_summary(verdicts: DataFrame, keys: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """Supported, refuted and unsure facts per key with the supported share (null without facts)."""
    n = F.count("*")
    return verdicts.groupBy(*keys).agg(
        n.alias("total"),
        F.count_if(F.col(verdict) == "SUPPORTED").alias("supported"),
        F.count_if(F.col(verdict) == "NOT_SUPPORTED").alias("not_supported"),
        F.count_if(F.col(verdict) == "UNSURE").alias("unsure"),
        (F.count_if(F.col(verdict) == "SUPPORTED") / n).alias("safe_score"),
    )


def compare_with_kb(scores: DataFrame, own: str = "safe_score", kb: str = "kb_score", margin: float = 0.15) -> DataFrame:
    """Difference to the knowledge-base score and what it says about coverage."""
    diff = F.col(own) - F.col(kb)
    return scores.withColumn("score_diff", F.round(diff, 4)).withColumn(
        "assessment",
        F.when(diff > margin, "kb_coverage_low").when(diff < -margin, "kb_supports_well").otherwise("consistent"),
    )


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n_documents"))


def index_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the tables of an index as ``(name, n_rows)``."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
