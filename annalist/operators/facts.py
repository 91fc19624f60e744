"""Facts of produced texts: splitting, rule checks, verdicts and support scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import as_col, share
from ..functions.records import batch_verdicts, normalize_verdict, verifiable_sentence
from ..functions.text import decompose_facts, rule_supported


def fact_rows(
    df: DataFrame, unit_id: str, produced: str, source: str, cap: int | None = None, terminators: str = "。！？.!?\n;；",
    facts: str = lx.VERIFIABLE_PATTERN, narrative: str = lx.PURE_NARRATIVE_PATTERN,
    stop_words: Sequence[str] = tuple(lx.FACT_STOP_WORDS),
) -> DataFrame:
    """Checkable facts ``(unit_id, position, fact, rule_supported)`` of each text; the first ``cap`` if it is given.

    A cap bounds what a judge is asked; facts the source already supports need no judge.
    """
    listed = decompose_facts(F.col(produced), terminators)
    if cap is not None:
        listed = F.slice(listed, 1, cap)
    checked = F.filter(listed, lambda f: verifiable_sentence(f, facts, narrative))
    exploded = df.select(unit_id, F.col(source).alias("_source"), F.posexplode(checked).alias("position", "fact"))
    return exploded.select(
        unit_id, "position", "fact", rule_supported(F.col("fact"), F.col("_source"), stop_words).alias("rule_supported")
    )


def verdict_rows(answers: DataFrame, unit_id: str, answer: str) -> DataFrame:
    """``(unit_id, position, content, verdict)`` of answers that judge all facts of a unit at once."""
    return answers.select(unit_id, F.inline(batch_verdicts(answer)))


def attach_verdicts(facts: DataFrame, verdicts: DataFrame, unit_id: str) -> DataFrame:
    """Verdict of each fact: the first whose text contains it or lies in it, else by position.

    ``verdicts(unit_id, position, content, verdict)`` is one judge answer per unit, a list
    as short as the facts it was asked about.
    """
    answers = verdicts.groupBy(unit_id).agg(
        F.array_sort(F.collect_list(F.struct("position", "content", "verdict"))).alias("_answers")
    )
    joined = facts.join(answers, unit_id, "left")
    nested = F.filter(
        "_answers", lambda a: (a["content"] != "") & (a["content"].contains(F.col("fact")) | F.col("fact").contains(a["content"]))
    )
    by_place = F.filter("_answers", lambda a: a["position"] == F.col("position"))
    chosen = F.coalesce(F.get(nested, F.lit(0))["verdict"], F.get(by_place, F.lit(0))["verdict"])
    return joined.select(*facts.columns, F.when(chosen.isNotNull(), normalize_verdict(chosen)).alias("verdict"))


def fact_support(facts: DataFrame, units: DataFrame, unit_id: str, coverage: str | None = None, support: str | None = None,
                 severity: float = 0.4) -> DataFrame:
    """Supported share (null without facts) and confidence per unit.

    A fact counts as supported by rule, by verdict, or when no verdict was given.
    """
    good = F.col("rule_supported") | F.col("verdict").isNull() | (F.col("verdict") == "SUPPORTED")
    totals = facts.groupBy(unit_id).agg(F.count("*").alias("total_facts"), F.count_if(good).alias("supported_facts"))
    extra = (F.col(coverage) if coverage else F.lit(0.0)) + (F.col(support) if support else F.lit(0.0))
    joined = units.join(totals, unit_id, "left").fillna(0, ["total_facts", "supported_facts"])
    refuted = F.col("total_facts") - F.col("supported_facts")
    raw = F.lit(0.8) - refuted * severity * 0.2 + extra * 0.1
    return joined.select(
        unit_id, "total_facts", "supported_facts",
        share(F.col("supported_facts"), F.col("total_facts")).alias("fact_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("confidence"),
    )


def evidence_support(n_entities: Column | str, n_units: Column | str, n_communities: Column | str, retrieved: Column | bool = True) -> Column:
    """How well the retrieved evidence can carry a text, from its counts."""
    e, u, c = as_col(n_entities), as_col(n_units), as_col(n_communities)
    retrieved = F.lit(retrieved) if isinstance(retrieved, bool) else retrieved
    return (
        F.when(~retrieved, 0.0).when(e > 3, 0.8).when(u > 0, 0.7).when((e > 0) | (c > 0), 0.5).otherwise(0.3)
    )


def cached_answers(requests: DataFrame, cache: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Split requests into answered and open ones, keyed by a digest of the whole text."""
    keyed = requests.withColumn("text_hash", F.sha2(text, 256))
    return keyed.join(cache, "text_hash"), keyed.join(cache, "text_hash", "left_anti")
