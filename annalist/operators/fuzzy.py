"""Fuzzy matching of names between two tables.

Two names match if one holds the other after cleaning, if both have four characters or more and begin with the same
four, or if one holds a known spelling of a place whose local name the other holds or lies in. Nothing of this is an
equality, so candidates come from three blocking keys: the first four characters, the rarest gram of the shorter name
(looked for at all places of the longer ones, in both directions), and the local names that spellings stand for. Only
distinct names meet; rows with equal names are joined to the result afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.text import local_names, normalize_text
from ..session import cut_lineage
from .matching import contains_join


def fuzzy_pairs(
    left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "name", spellings: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Distinct pairs ``(left_name, right_name)`` of matching names.

    Null and empty names match nothing, and neither do names without a letter or digit.
    """
    spellings = lx.PLACE_SPELLINGS if spellings is None else spellings
    a, b = _cleaned(left, left_name, "left"), _cleaned(right, right_name, "right")
    start = lambda side: F.when(F.length(f"_{side}") >= 4, F.left(f"_{side}", F.lit(4)))
    same_start = a.withColumn("_start", start("left")).join(b.withColumn("_start", start("right")), "_start").select("left_name", "right_name")
    inside = _holding(a, b, "left", "right").unionByName(_holding(b, a, "right", "left"))
    found = same_start.unionByName(inside)
    if spellings:
        found = found.unionByName(_spelled(a, b, "left", "right", spellings)).unionByName(_spelled(b, a, "right", "left", spellings))
    return found.distinct()


def _cleaned(names: DataFrame, name: str, side: str) -> DataFrame:
    """Distinct names with what is left of them without punctuation."""
    rows = names.select(F.col(name).alias(f"{side}_name")).distinct().withColumn(f"_{side}", F.lower(normalize_text(f"{side}_name")))
    return cut_lineage(rows.where(F.col(f"_{side}") != ""))


def _holding(outer: DataFrame, inner: DataFrame, outer_side: str, inner_side: str) -> DataFrame:
    """Pairs whose outer cleaned name holds the inner one."""
    texts = outer.select(F.col(f"_{outer_side}").alias("_key"), F.col(f"_{outer_side}").alias("_t")).distinct()
    hits = contains_join(texts, inner, "_key", "_t", f"_{inner_side}")
    return hits.join(outer.withColumnRenamed(f"_{outer_side}", "_key"), "_key").join(inner, f"_{inner_side}").select("left_name", "right_name")


def _spelled(one: DataFrame, other: DataFrame, side: str, other_side: str, spellings: dict[str, list[str]]) -> DataFrame:
    """Pairs where one side spells a place whose local name the other side's name holds or lies in."""
    local = cut_lineage(one.select(f"{side}_name", F.explode(local_names(F.col(f"_{side}"), spellings)).alias("_local")))
    places, names = local.select("_local").distinct(), other.select(f"{other_side}_name")
    holds = contains_join(names.withColumn("_t", F.col(f"{other_side}_name")), places, f"{other_side}_name", "_t", "_local")
    within = contains_join(places.withColumn("_t", F.col("_local")), names, "_local", "_t", f"{other_side}_name")
    return holds.unionByName(within).join(local, "_local").select("left_name", "right_name")


def fuzzy_join(
    left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "name", spellings: dict[str, list[str]] | None = None,
) -> DataFrame:
    """All pairs of rows with matching names; columns of both sides, which must not share names."""
    pairs = fuzzy_pairs(left, right, left_name, right_name, spellings)
    pairs = pairs.select(F.col("left_name").alias("_left_name"), F.col("right_name").alias("_right_name"))
    joined = left.join(pairs, F.col(left_name) == F.col("_left_name")).drop("_left_name")
    return joined.join(right, F.col("_right_name") == F.col(right_name)).drop("_right_name")


def first_match(
    facts: DataFrame, names: DataFrame, fact: str, name: str, order: str, spellings: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``(fact, match)``: for each fact the first matching name in the given order, null if there is none."""
    pairs = fuzzy_pairs(facts, names, fact, name, spellings)
    ordered = names.select(F.col(name).alias("right_name"), F.col(order).alias("_order"))
    best = pairs.join(ordered, "right_name").groupBy("left_name").agg(F.min(F.struct("_order", "right_name"))["right_name"].alias("match"))
    return facts.select(F.col(fact)).distinct().join(best.withColumnRenamed("left_name", fact), fact, "left")
