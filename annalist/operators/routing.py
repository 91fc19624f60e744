"""Retrieval by mode and by strategy, many queries with different ones in one plan.

Queries name their mode in a column. Each branch reads only its queries, and a branch that no query asks for is not part
of the plan at all. Strategies share one table of keyword candidates, scored once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import table_cutter
from . import retrieval
from .cells import CellStore, search_cells

KEYWORD, VECTOR, HYBRID = "keyword", "vector", "hybrid"
KINDS = {"entity": 10, "relationship": 8, "text_unit": 8, "community": 3}


def _long(rows: DataFrame, kind: str, row_id: str) -> DataFrame:
    return rows.select("query_id", F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"), F.col(row_id).cast("string").alias("id"),
                       F.col("score").cast("double").alias("score"))


def keyword_hits(queries: DataFrame, tables: dict[str, DataFrame], k: dict[str, int] = KINDS, options: dict[str, dict] | None = None) -> DataFrame:
    """Scored search in each table that is given: ``(query_id, kind, rank, id, score)``."""
    searches = {"entity": (retrieval.search_entities, "id"), "relationship": (retrieval.search_relationships, "id"),
                "text_unit": (retrieval.search_text_units, "id"), "community": (retrieval.search_communities, "community")}
    parts = [_long(search(queries, tables[kind], k[kind], **(options or {}).get(kind, {})), kind, row_id)
             for kind, (search, row_id) in searches.items() if kind in tables]
    return _union(parts)


def vector_hits(queries: DataFrame, stores: dict[str, CellStore], k: dict[str, int] = KINDS) -> DataFrame:
    """Nearest rows of each stored table; the score is one minus the distance."""
    parts = [_long(search_cells(queries, store, k[kind]).withColumn("score", 1 - F.col("distance")), kind, "id") for kind, store in stores.items()]
    return _union(parts)


def hybrid_hits(keyword: DataFrame, vector: DataFrame, k: dict[str, int] = KINDS) -> DataFrame:
    """Half the keyword score plus half the vector score per row; what only one side has keeps its half."""
    half = lambda c: F.coalesce(F.col(c) * 0.5, F.lit(0.0))
    merged = keyword.select("query_id", "kind", "id", F.col("score").alias("_kw")).join(
        vector.select("query_id", "kind", "id", F.col("score").alias("_vec")), ["query_id", "kind", "id"], "full_outer")
    scored = merged.select("query_id", "kind", "id", (half("_kw") + half("_vec")).alias("score"))
    ranked = retrieval.top_k(scored, ["query_id", "kind"], [F.desc(F.round("score", 9)), F.col("id")], max(k.values()))
    limit = F.lit(0)
    for kind, n in k.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    return ranked.where(F.col("rank") <= limit).select("query_id", "kind", F.col("rank").cast("int").alias("rank"), "id", "score")


def retrieve_by_mode(
    queries: DataFrame, tables: dict[str, DataFrame], stores: dict[str, CellStore], k: dict[str, int] = KINDS, options: dict[str, dict] | None = None,
) -> DataFrame:
    """``(query_id, mode, kind, rank, id, score)`` for queries with a ``mode``; a null or unknown one is hybrid.

    ``queries(query_id, mode, year, location, keywords, text, query_vector)``; ``tables`` and ``stores`` by kind of row.
    """
    known = F.when(F.col("mode").isin(KEYWORD, VECTOR), F.col("mode")).otherwise(HYBRID)
    asked = table_cutter(queries.sparkSession, "modes")(queries.withColumn("mode", known))
    # Three modes at most: which of them occur decides which branches are built.
    present = {r["mode"] for r in asked.select("mode").distinct().collect()}
    parts = []
    for mode in (m for m in (KEYWORD, VECTOR, HYBRID) if m in present):
        own = asked.where(F.col("mode") == mode)
        if mode == KEYWORD:
            rows = keyword_hits(own, tables, k, options)
        elif mode == VECTOR:
            rows = vector_hits(own, stores, k)
        else:
            rows = hybrid_hits(keyword_hits(own, tables, k, options), vector_hits(own, stores, k), k)
        parts.append(rows.select("query_id", F.lit(mode).alias("mode"), "kind", "rank", "id", "score"))
    if not parts:
        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, mode string, kind string, rank int, id string, score double")
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- strategies ----------------------------------------------------------------------------

#: A strategy ranks entities: a function of (queries, entities, k, **shared) with the tables that all strategies share.
Strategy = Callable[..., DataFrame]


def vector_only(queries: DataFrame, entities: DataFrame, k: int = 10, nearest: DataFrame | None = None, **_) -> DataFrame:
    """Entities by their distance: ``nearest(query_id, title, distance)``."""
    ranked = retrieval.top_k(nearest, ["query_id"], [F.col("distance"), F.col("title")], k)
    return ranked.select("query_id", "rank", "title", (1 - F.col("distance")).alias("score"))


STRATEGIES: dict[str, Strategy] = {
    "keyword_only": lambda q, e, k=10, base=None, **_: base.where(F.col("rank") <= k),
    "entity_first": lambda q, e, k=10, base=None, **_: retrieval.entity_first(q, e, k, base=base),
    "community_first": lambda q, e, k=10, base=None, communities=None, **_: retrieval.community_first(q, e, communities, k, base=base),
    "hybrid_keyword": lambda q, e, k=10, base=None, communities=None, **_: retrieval.hybrid_keyword(q, e, communities, k, base=base),
    "vector_only": vector_only,
    "hybrid_vector": lambda q, e, k=10, base=None, nearest=None, **_: retrieval.hybrid_merge(base.where(F.col("rank") <= k), nearest, k),
}
NEEDS = {"community_first": "communities", "hybrid_keyword": "communities", "vector_only": "nearest", "hybrid_vector": "nearest"}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Make a strategy available to benchmark runs."""
    STRATEGIES[name] = strategy


def run_strategies(
    queries: DataFrame, entities: DataFrame, names: Sequence[str] | None = None, k: int = 10, communities: DataFrame | None = None,
    nearest: DataFrame | None = None, aliases: dict[str, str] | None = None,
) -> DataFrame:
    """``(strategy, query_id, rank, title, score)`` of several strategies, by default of all whose tables are given."""
    given = {"communities": communities, "nearest": nearest}
    if names is None:
        names = [n for n in STRATEGIES if n not in NEEDS or given[NEEDS[n]] is not None]
    missing = [n for n in names if n in NEEDS and given[NEEDS[n]] is None]
    if missing:
        raise ValueError(f"{missing[0]} needs {NEEDS[missing[0]]}")
    base = table_cutter(queries.sparkSession, "strategies")(retrieval.keyword_only(queries, entities, 2 * k, aliases=aliases))
    parts = [STRATEGIES[n](queries, entities, k, base=base, **given).select(
        F.lit(n).alias("strategy"), "query_id", F.col("rank").cast("int").alias("rank"), "title", F.col("score").cast("double").alias("score")) for n in names]
    return _union(parts)
