"""Evaluation of produced texts against what was retrieved for them, over tables of pairs.

A unit is a source text and the text produced from it. Retrieved names that the produced text mentions are grouped by
fuzzy match, facts of the produced text are looked up among the names and in the evidence, and both feed the metrics on
novel content. All seven weighted metrics of a unit come from the same analysis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.text import grounded, mention_match, names_match
from ..session import table_cutter
from .quality import evaluate_pairs, expansion_grounding, information_gain
from .ranking import weighted_score


def fuzzy_group_rows(names: DataFrame, unit: str, rank: str, name: str, spellings: dict[str, list[str]] | None = None) -> DataFrame:
    """Greedy grouping of each unit's names in the order of their ranks: ``(unit, rank, name, leader, representative)``.

    A name joins the first group with a member that it matches, else it leads a new one. So the leader of a name's group
    is the smallest leader among the earlier names that it matches; ranks are handed down along these until nothing
    changes. ``leader`` is that rank, ``representative`` the group's first Chinese name, else its first. Ranks are unique
    within a unit, and units are short lists such as retrieval returns.
    """
    cut = table_cutter(names.sparkSession, "fuzzy-groups")
    rows = cut(names.select(unit, rank, name))
    later = rows.select(F.col(unit), F.col(rank).alias("_later"), F.col(name).alias("_n"))
    earlier = rows.select(F.col(unit), F.col(rank).alias("_earlier"), F.col(name).alias("_m"))
    ties = cut(later.join(earlier, unit).where((F.col("_earlier") < F.col("_later")) & names_match("_n", "_m", spellings)).select(unit, "_later", "_earlier"))
    labels, seen = cut(rows.select(unit, rank, F.col(rank).alias("leader"))), None
    while True:
        state = labels.agg(F.sum(F.col("leader").cast("decimal(38,0)"))).first()[0]
        if state == seen:
            break
        seen = state
        handed = ties.join(labels.withColumnRenamed(rank, "_earlier"), [unit, "_earlier"]).groupBy(unit, F.col("_later").alias(rank)).agg(F.min("leader").alias("_handed"))
        labels = cut(labels.join(handed, [unit, rank], "left").select(unit, rank, F.coalesce("_handed", "leader").alias("leader")))
    grouped = rows.join(labels, [unit, rank])
    shown = grouped.groupBy(unit, "leader").agg(
        F.min_by(name, F.struct(F.when(F.col(name).rlike("[一-鿿]"), 0).otherwise(1), F.col(rank))).alias("representative"))
    return grouped.join(shown, [unit, "leader"]).select(unit, rank, name, "leader", "representative")


def novel_analysis(
    pairs: DataFrame, available: DataFrame, facts: DataFrame, unit: str = "unit", source: str = "source", produced: str = "produced",
    evidence: str = "evidence", spellings: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``(unit, n_available, n_used, used, n_facts, n_grounded, n_unsupported)`` of every pair.

    ``pairs(unit, source, produced, evidence)``, ``available(unit, rank, name)``: names retrieved for the unit that its source
    lacks, ``facts(unit, position, fact)``: what the produced text states. A fact is grounded if it matches an available
    name or stands in the evidence; it is unsupported if it is neither grounded nor in the source.
    """
    texts = pairs.select(unit, source, produced, evidence)
    offered = available.where(F.coalesce(F.col("name") != "", F.lit(False)))
    mentioned = offered.join(texts.select(unit, produced), unit).where(mention_match("name", produced, spellings, True))
    groups = fuzzy_group_rows(mentioned, unit, "rank", "name", spellings)
    used = groups.groupBy(unit).agg(
        F.count_distinct("leader").alias("n_used"), F.array_distinct(F.array_sort(F.collect_list(F.struct("leader", "representative")))["representative"]).alias("used"))
    stated = facts.where(F.coalesce(F.col("fact") != "", F.lit(False))).select(unit, "position", "fact")
    named = stated.join(offered.select(unit, "name"), unit).where(names_match("fact", "name", spellings)).select(unit, "position").distinct()
    judged = stated.join(named.withColumn("_named", F.lit(True)), [unit, "position"], "left").join(texts.select(unit, source, evidence), unit)
    is_grounded = F.coalesce("_named", F.lit(False)) | grounded(F.col("fact"), F.coalesce(evidence, F.lit("")))
    judged = judged.select(unit, is_grounded.alias("_grounded"), F.coalesce(F.contains(source, "fact"), F.lit(False)).alias("_known"))
    counted = judged.groupBy(unit).agg(
        F.count("*").alias("n_facts"), F.count_if("_grounded").alias("n_grounded"), F.count_if(~F.col("_grounded") & ~F.col("_known")).alias("n_unsupported"))
    offers = offered.groupBy(unit).agg(F.count("*").alias("n_available"))
    joined = pairs.select(unit).join(offers, unit, "left").join(used, unit, "left").join(counted, unit, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        unit, zero("n_available"), zero("n_used"), F.coalesce("used", F.array().cast("array<string>")).alias("used"),
        zero("n_facts"), zero("n_grounded"), zero("n_unsupported"))


def evaluate(
    pairs: DataFrame, available: DataFrame, facts: DataFrame, concepts: Column, weights: DataFrame, unit: str = "unit",
    spellings: dict[str, list[str]] | None = None, transitions: Sequence[str] = tuple(lx.TRANSITION_WORDS),
    richness: Sequence[str] = tuple(lx.RICHNESS_PATTERNS),
) -> tuple[DataFrame, DataFrame]:
    """All metrics of every pair as long rows ``(unit, name, value, max_value)``, and the weighted score of each.

    Beside the seven weighted metrics there are information gain and expansion grounding, which carry no weight.
    """
    analysis = table_cutter(pairs.sparkSession, "evaluation")(novel_analysis(pairs, available, facts, unit, spellings=spellings))
    rows = pairs.join(analysis, unit)
    metrics = evaluate_pairs(
        rows, unit, "source", "produced", concepts, n_used=F.col("n_used"), n_unsupported=F.col("n_unsupported"), n_facts=F.col("n_facts"),
        transitions=transitions, richness=richness)
    score = weighted_score(metrics, weights, unit)
    beside = F.array(
        F.struct(F.lit("information_gain").alias("name"), information_gain("n_used").alias("value"), F.lit(1.0).alias("max_value")),
        F.struct(F.lit("expansion_grounding").alias("name"), expansion_grounding("n_grounded", "n_facts").alias("value"), F.lit(1.0).alias("max_value")))
    return metrics.unionByName(analysis.select(unit, F.inline(beside))), score
