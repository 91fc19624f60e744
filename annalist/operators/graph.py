"""Entity, co-occurrence and community tables built from text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.columns import let
from ..functions.records import extraction_records
from ..session import cut_lineage
from .chunking import token_chunks
from .retrieval import top_k
from .running import leading_rows, within_budget

#: Edges of a block that a task reduces to a forest.
BLOCK_EDGES = 500_000


def text_units(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 100) -> DataFrame:
    """Token windows with a stable id and their document: ``(id, document_id, unit_index, text)``."""
    units = token_chunks(df, doc_id, text, size, overlap)
    return units.select(
        F.sha2(F.concat_ws("\u0001", F.col(doc_id).cast("string"), F.col("unit_index").cast("string"), "text"), 256).alias("id"),
        F.col(doc_id).alias("document_id"), "unit_index", "text",
    )


def mentions(units: DataFrame, unit_keys: list[str], names: Column, kind: Column | str = "term") -> DataFrame:
    """One row per unit and distinct name: ``(*unit_keys, name, type)``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return units.select(*unit_keys, F.explode(F.array_distinct(names)).alias("name")).withColumn("type", kind)


def name_pairs(names: Column) -> Column:
    """All unordered pairs of one unit's distinct names, smaller name first.

    A unit is a window of bounded length, so this list is bounded as well; building it
    in the row avoids joining the mention table with itself.
    """

    def pairs(ordered: Column) -> Column:
        rest = lambda i: F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0)))
        return F.flatten(
            F.transform(
                ordered,
                lambda a, i: F.transform(rest(i), lambda b: F.struct(a.alias("source"), b.alias("target"))),
            )
        )

    return let(F.array_sort(F.array_distinct(names)), pairs)


def cooccurrence(units: DataFrame, names: Column) -> DataFrame:
    """Edges ``(source, target, weight)``: number of units that hold both names."""
    return (
        units.select(F.inline(name_pairs(names)))
        .groupBy("source", "target")
        .agg(F.count("*").alias("weight"))
    )


def name_links(units: DataFrame, names: Column) -> DataFrame:
    """Links ``(source, target)`` between neighbours in the order of one unit's distinct names.

    They hold together what all pairs of the unit hold together, in a number that grows with the names, not with their square.
    """
    linked = let(F.array_sort(F.array_distinct(names)), lambda ordered: F.transform(
        F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda b, i: F.struct(F.get(ordered, i).alias("source"), b.alias("target"))))
    return units.select(F.inline(linked))


def spanning_links(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Fewer links ``(source, target)`` with the same nodes and components: of every block of edges that a task reads, one for
    each node, to the smallest node that the block connects it with."""
    kind = edges.schema[source].dataType.simpleString()

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK_EDGES:
                yield _block_links(pd.concat(held))
                held, rows = [], 0
        if rows:
            yield _block_links(pd.concat(held))

    whole = edges.select(F.col(source).alias("source"), F.col(target).alias("target"))
    known = F.col("source").isNotNull() & F.col("target").isNotNull()
    return whole.where(known).mapInPandas(span, f"source {kind}, target {kind}").unionByName(whole.where(~known))


def _block_links(edges: pd.DataFrame) -> pd.DataFrame:
    codes, nodes = pd.factorize(pd.concat([edges["source"], edges["target"]], ignore_index=True), sort=True)
    a, b = np.split(codes, 2)
    lowest = np.arange(len(nodes))
    while True:
        low = np.minimum(lowest[a], lowest[b])
        now = lowest.copy()
        for ends in (lowest[a], lowest[b], a, b):
            np.minimum.at(now, ends, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == lowest).all():
            return pd.DataFrame({"source": nodes, "target": nodes[lowest]})
        lowest = now


def merge_entities(rows: DataFrame, max_chars: int = 500) -> DataFrame:
    """One row per (title, type): mention count and distinct descriptions within a length.

    Descriptions are deduplicated by an aggregate and cut by a running length, so a
    frequent entity never collects all its mentions.
    """
    counts = rows.groupBy("title", "type").agg(F.count("*").alias("n_mentions"))
    distinct = rows.where(F.col("description") != "").groupBy("title", "type", "description").agg(F.count("*").alias("_n"))
    within = within_budget(
        distinct, ["title", "type"], [F.desc("_n"), F.col("description")], F.length("description"), max_chars, "_used"
    )
    gathered = within.groupBy("title", "type").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_used", "description")))["description"], "\n").alias("description")
    )
    return counts.join(gathered, ["title", "type"], "left").select(
        "title", "type", "n_mentions", F.coalesce("description", F.lit("")).alias("description")
    )


def merge_relationships(rows: DataFrame) -> DataFrame:
    """Edges with summed strength and the number of statements."""
    return rows.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_statements"))


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Number of distinct neighbours of each node; an edge counts once in either direction."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col(source).alias("node"), F.col(target).alias("other")),
        F.struct(F.col(target).alias("node"), F.col(source).alias("other")),
    )).alias("e")).select("e.node", "e.other").where(F.col("node") != F.col("other"))
    return ends.distinct().groupBy("node").agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``(node, component)`` with the smallest node as the component's name.

    Alternating large and small stars: every round links nodes to the smallest node
    known nearby, so long chains shrink geometrically. Each round is cut by a reliable
    checkpoint; the loop ends when the edge set no longer changes.
    """
    given = cut_lineage(
        edges.select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v")).distinct()
    )
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = given.where(F.col("u") != F.col("v"))
    seen = None
    while True:
        links = cut_lineage(_small_star(_large_star(links)))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return (
        both.join(lowest, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def inner_relationships(members: DataFrame, relationships: DataFrame, community: str = "community", node: str = "node") -> DataFrame:
    """Relationships with both ends in one community, with that community."""
    of = lambda side: members.select(F.col(node).alias(side), F.col(community).alias(f"_of_{side}"))
    joined = relationships.join(of("source"), "source").join(of("target"), "target").where("_of_source = _of_target")
    return joined.withColumnRenamed("_of_source", community).drop("_of_target")


def community_pack(
    members: DataFrame, entities: DataFrame, relationships: DataFrame | None = None, community: str = "community", node: str = "node",
    max_chars: int = 8000,
) -> DataFrame:
    """Per community, lines on its entities by falling degree and on its inner relationships by falling weight.

    ``entities(node, degree, line)``, ``relationships(source, target, weight, line)``. Both kinds take turns, rank by rank,
    until the one length budget is used; the pack then lists entities first. A line costs one character more for its end.
    """
    entity_lines = members.select(community, node).join(entities, node).select(
        community, "line", F.lit(0).alias("kind"), F.col("degree").cast("double").alias("_w"), F.col(node).alias("_node"))
    ranked = leading_rows(entity_lines, [community], [F.desc("_w"), F.col("_node")], max_chars + 1).select(community, "line", "kind", "rank")
    if relationships is not None:
        inner = inner_relationships(members, relationships, community, node)
        rows = leading_rows(inner, [community], [F.desc("weight"), F.col("source"), F.col("target")], max_chars + 1)
        ranked = ranked.unionByName(rows.select(community, "line", F.lit(1).alias("kind"), "rank"))
    within = within_budget(ranked, [community], [F.col("rank"), F.col("kind")], F.length("line"), max_chars, "_used")
    return within.groupBy(community).agg(
        F.count_if(F.col("kind") == 0).alias("n_entities"), F.count_if(F.col("kind") == 1).alias("n_relationships"),
        F.count("*").alias("n_lines"), F.max("_used").alias("n_chars"),
        F.array_join(F.array_sort(F.collect_list(F.struct("kind", "_used", "line")))["line"], "\n").alias("pack"),
    )


def points_reduce(points: DataFrame, max_chars: int = 8000) -> DataFrame:
    """Answer points ``(query_id, point_id, score, text)`` by score, zeros dropped, packed to a budget."""
    kept = points.where(F.col("score") > 0)
    packed = within_budget(kept, ["query_id"], [F.desc("score"), F.col("point_id")], F.length("text"), max_chars)
    return packed.select("query_id", "point_id", "score", "used_chars")


def parse_extraction(answers: DataFrame, unit_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship rows of extraction answers."""
    rows = answers.select(unit_id, F.explode(extraction_records(text)).alias("_r"))
    field = lambda i: F.coalesce(F.get("_r", F.lit(i)), F.lit(""))
    entities = rows.where((field(0) == "entity") & (F.size("_r") >= 4)).select(
        unit_id, F.upper(field(1)).alias("title"), F.upper(field(2)).alias("type"), field(3).alias("description")
    )
    relationships = rows.where((field(0) == "relationship") & (F.size("_r") >= 5)).select(
        unit_id, F.upper(field(1)).alias("source"), F.upper(field(2)).alias("target"), field(3).alias("description"),
        F.coalesce(F.expr("try_cast(element_at(_r, -1) AS DOUBLE)"), F.lit(1.0)).alias("weight"),
    )
    return entities, relationships


def parse_claims(answers: DataFrame, unit_id: str, text: str) -> DataFrame:
    """Claim rows of eight fields from extraction answers without a leading kind."""
    rows = answers.select(unit_id, F.explode(extraction_records(text)).alias("_r")).where(F.size("_r") == 8)
    names = ("subject", "object", "claim_type", "status", "start_date", "end_date", "description", "source_text")
    return rows.select(unit_id, *[F.get("_r", F.lit(i)).alias(n) for i, n in enumerate(names)])


def build_progress(n_done: DataFrame, n_total: DataFrame) -> DataFrame:
    """Share of documents already processed, from the two tables' row counts."""
    done = n_done.agg(F.count("*").alias("n"))
    total = n_total.agg(F.count("*").alias("n"))
    both = done.select(F.lit("done").alias("k"), "n").unionByName(total.select(F.lit("total").alias("k"), "n"))
    return both.agg(
        F.sum(F.when(F.col("k") == "done", F.col("n"))).alias("n_done"), F.sum(F.when(F.col("k") == "total", F.col("n"))).alias("n_total")
    ).withColumn("ratio", F.when(F.col("n_total") > 0, F.col("n_done") / F.col("n_total")))


#: Numbers of generated cases per entity type and their sentence templates.
CASE_TEMPLATES = {
    "GEO": (3, "geo", "是我人生中重要的地方。"),
    "PERSON": (2, "person", "的事迹深深影响了我。"),
    "EVENT": (2, "event", "是那个时代的重要事件。"),
}


def generate_cases(entities: DataFrame, row_id: str = "id", templates: dict = CASE_TEMPLATES, facts: dict[str, tuple[str, str]] = lx.CASE_FACTS) -> DataFrame:
    """Test queries with truth from the first entities of each type."""
    typed = entities.where(F.col("type").isin(list(templates)))
    first = top_k(typed.select(row_id, "title", "type"), ["type"], [F.col(row_id)], max(t[0] for t in templates.values()))
    local, year = F.lit(None).cast("string"), F.lit(None).cast("string")
    for title, (name, when) in facts.items():
        local = F.when(F.col("title") == title, name).otherwise(local)
        year = F.when(F.col("title") == title, when).otherwise(year)
    limit, prefix, sentence = F.lit(0), F.lit(""), F.lit("")
    for kind, (n, short, tail) in templates.items():
        is_kind = F.col("type") == kind
        limit, prefix, sentence = F.when(is_kind, n).otherwise(limit), F.when(is_kind, short).otherwise(prefix), F.when(is_kind, tail).otherwise(sentence)
    named = F.when(F.col("type") == "EVENT", F.col("title")).otherwise(F.coalesce(local, F.col("title")))
    return first.where(F.col("rank") <= limit).select(
        F.concat(prefix, F.lit("_"), F.left("title", F.lit(10))).alias("query_id"),
        F.concat(named, sentence).alias("text"), F.col("title").alias("truth"),
        F.when(F.col("type") != "EVENT", year).alias("truth_time"),
        F.when(F.col("type") == "GEO", named).alias("truth_location"),
    )
