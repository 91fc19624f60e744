"""Queries on the graph tables: units, mentions, edges, components, packs, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import community, graph
from ..session import table_cutter
from ..sources.tables import load
from .chunks import UNITS_SQL
from .search import people
from .shared import Catalog, documents

catalog = Catalog()
#: Names are words of four letters or more with a capital.
NAME = "[A-Z][a-z]{3,}"
UNITS = UNITS_SQL.format(size=1200, step=1100)
NAMES_SQL = f"names AS (SELECT doc_id, unit_index, list_distinct(regexp_extract_all(text, '{NAME}')) AS l FROM ({UNITS}))"
EDGES_SQL = f"""
{NAMES_SQL},
flat AS (SELECT doc_id, unit_index, unnest(l) AS name FROM names),
edges AS (SELECT a.name AS source, b.name AS target, count(*) AS weight FROM flat a JOIN flat b USING (doc_id, unit_index) WHERE a.name < b.name GROUP BY ALL)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    return graph.text_units(documents(spark, sf))


def names(text: str = "text"):
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(0))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence(units(spark, sf), names())


@catalog.add("q_text_units", f"""
SELECT sha256(doc_id::VARCHAR || chr(1) || unit_index::VARCHAR || chr(1) || text) AS id, doc_id AS document_id, unit_index, text FROM ({UNITS})""")
def q_text_units(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).withColumn("unit_index", F.col("unit_index").cast("long"))


@catalog.add("q_mentions_table", f"WITH {NAMES_SQL} SELECT doc_id AS document_id, unit_index, unnest(l) AS name, 'term' AS type FROM names")
def q_mentions_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.mentions(units(spark, sf), ["document_id", "unit_index"], names())
    return rows.withColumn("unit_index", F.col("unit_index").cast("long"))


@catalog.add("q_cooccurrence", f"WITH {EDGES_SQL} SELECT source, target, weight FROM edges")
def q_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


SALES_SQL = "sales AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier and part ends of every line item."""
    return load(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit(1.0).alias("weight"),
    )


@catalog.add("q_degree", f"""
WITH {SALES_SQL}, e AS (SELECT DISTINCT source, target FROM sales)
SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1""")
def q_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(sales(spark, sf))


@catalog.add("q_edge_merge", f"WITH {SALES_SQL} SELECT source, target, count(*)::DOUBLE AS weight, count(*) AS n_statements FROM sales GROUP BY ALL")
def q_edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    return graph.merge_relationships(sales(spark, sf))


COMPONENT_SQL = """
links AS (SELECT source AS a, target AS b FROM {edges} UNION SELECT target, source FROM {edges}),
cc(node, comp) USING KEY (node) AS (
  SELECT a, a FROM links GROUP BY a
  UNION
  SELECT u.node, min(v.comp) FROM recurring.cc u JOIN links e ON e.a = u.node JOIN cc v ON v.node = e.b WHERE v.comp < u.comp GROUP BY u.node)
SELECT node, comp AS component FROM cc"""


@catalog.add("q_components", f"WITH RECURSIVE {EDGES_SQL}, {COMPONENT_SQL.format(edges='edges')}")
def q_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected_components(graph.spanning_links(graph.name_links(units(spark, sf), names())))


@catalog.add("q_sales_components", f"WITH RECURSIVE {SALES_SQL}, {COMPONENT_SQL.format(edges='sales')}")
def q_sales_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected_components(graph.spanning_links(sales(spark, sf)))


@catalog.add("q_communities")
def q_communities(spark: SparkSession, sf: str) -> DataFrame:
    return community.communities(edges(spark, sf))


@catalog.add("q_community_checks", f"""
SELECT count(*) AS n_nodes, count(DISTINCT component) AS n_components, 0::BIGINT AS n_oversized, 0::BIGINT AS n_disconnected, 0::BIGINT AS n_mixed
FROM (WITH RECURSIVE {EDGES_SQL}, {COMPONENT_SQL.format(edges='edges')})""")
def q_community_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of all communities: no more than ten nodes, connected by their own edges, inside one component."""
    cut = table_cutter(spark, "community-checks")
    ties = cut(edges(spark, sf))
    members = cut(community.communities(ties))
    of = lambda side: members.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    inner = ties.join(of("source"), "source").join(of("target"), "target").where("c_source = c_target").select("source", "target")
    loops = members.select(F.col("node").alias("source"), F.col("node").alias("target"))
    parts = graph.connected_components(inner.unionByName(loops)).select("node", F.col("component").alias("part"))
    groups = members.join(parts, "node").groupBy("community").agg(
        F.count("*").alias("n"), F.count_distinct("part").alias("n_parts"), F.count_distinct("component").alias("n_components"))
    checks = groups.agg(F.count_if(F.col("n") > 10).alias("n_oversized"), F.count_if(F.col("n_parts") > 1).alias("n_disconnected"),
                        F.count_if(F.col("n_components") > 1).alias("n_mixed"))
    return members.agg(F.count("*").alias("n_nodes"), F.count_distinct("component").alias("n_components")).join(F.broadcast(checks))


@catalog.add("q_community_pack", """
WITH d AS (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1),
l AS (SELECT c_nationkey AS community, c_custkey AS node, c_name || ': ' || c_mktsegment AS line, 0 AS kind,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY degree DESC, c_custkey) AS rank FROM customer JOIN d ON c_custkey = o_custkey),
e AS (SELECT a.o_custkey AS source, b.o_custkey AS target, count(*) AS weight FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY ALL),
r AS (SELECT s.c_nationkey AS community, s.c_name || ' -> ' || t.c_name AS line, 1 AS kind,
             row_number() OVER (PARTITION BY s.c_nationkey ORDER BY weight DESC, source, target) AS rank
      FROM e JOIN customer s ON s.c_custkey = source JOIN customer t ON t.c_custkey = target AND t.c_nationkey = s.c_nationkey),
u AS (SELECT community, line, kind, rank FROM l UNION ALL SELECT * FROM r),
s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY community ORDER BY rank, kind ROWS UNBOUNDED PRECEDING) - 1 AS used FROM u)
SELECT community, count(*) FILTER (kind = 0) AS n_entities, count(*) FILTER (kind = 1) AS n_relationships, count(*) AS n_lines, max(used)::BIGINT AS n_chars,
       string_agg(line, chr(10) ORDER BY kind, used) AS pack FROM s WHERE used <= 1000 GROUP BY 1""")
def q_community_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of each nation, and which of them followed one another with their orders."""
    customer, orders = load(spark, sf, "customer"), load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    degree = orders.groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("degree"))
    members = customer.select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("node"))
    lines = customer.select(F.col("c_custkey").alias("node"), F.concat_ws(": ", "c_name", "c_mktsegment").alias("line")).join(degree, "node")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("target"))
    pairs = orders.join(after, "o_orderkey").groupBy(F.col("o_custkey").alias("source"), "target").agg(F.count("*").alias("weight"))
    named = lambda side: customer.select(F.col("c_custkey").alias(side), F.col("c_name").alias(f"_{side}"))
    told = pairs.join(named("source"), "source").join(named("target"), "target").withColumn("line", F.concat_ws(" -> ", "_source", "_target"))
    return graph.community_pack(members, lines, told.select("source", "target", "weight", "line"), max_chars=1000)


@catalog.add("q_entity_merge", """
WITH r AS (SELECT upper(p_name) AS title, p_type AS type, p_brand || ' size ' || (p_size % 10)::VARCHAR AS description FROM part),
n AS (SELECT title, type, count(*) AS n_mentions FROM r GROUP BY ALL), g AS (SELECT title, type, description, count(*) AS c FROM r GROUP BY ALL),
s AS (SELECT *, sum(length(description) + 1) OVER (PARTITION BY title, type ORDER BY c DESC, description ROWS UNBOUNDED PRECEDING) - 1 AS used FROM g),
k AS (SELECT title, type, string_agg(description, chr(10) ORDER BY used) AS description FROM s WHERE used <= 60 GROUP BY ALL)
SELECT title, type, n_mentions, coalesce(k.description, '') AS description FROM n LEFT JOIN k USING (title, type)""")
def q_entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.col("p_size") % 10).cast("string")
    rows = load(spark, sf, "part").select(
        F.upper("p_name").alias("title"), F.col("p_type").alias("type"), F.concat("p_brand", F.lit(" size "), size).alias("description")
    )
    return graph.merge_entities(rows, 60)


@catalog.add("q_points_reduce", """
WITH p AS (SELECT user_id AS query_id, event_id AS point_id, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END AS score, props AS text FROM events),
s AS (SELECT query_id, point_id, score, sum(length(text) + 1) OVER (PARTITION BY query_id ORDER BY score DESC, point_id ROWS UNBOUNDED PRECEDING) - 1 AS used_chars FROM p WHERE score > 0)
SELECT query_id, point_id, score::BIGINT AS score, used_chars::BIGINT AS used_chars FROM s WHERE used_chars <= 200""")
def q_points_reduce(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value"))
    points = load(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("point_id"), score.cast("long").alias("score"), F.col("props").alias("text")
    )
    return graph.points_reduce(points, 200)


@catalog.add("q_generate_cases", """
WITH e AS (SELECT n_nationkey::BIGINT AS id, n_name AS title, 'GEO' AS type FROM nation
           UNION ALL SELECT 1000 + c_custkey, c_name, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'PERSON' WHEN 'MACHINERY' THEN 'EVENT' ELSE 'OTHER' END FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS rn FROM e WHERE type <> 'OTHER')
SELECT lower(type) || '_' || left(title, 10) AS query_id,
       title || CASE type WHEN 'GEO' THEN '是我人生中重要的地方。' WHEN 'PERSON' THEN '的事迹深深影响了我。' ELSE '是那个时代的重要事件。' END AS text,
       title AS truth, CASE WHEN type = 'GEO' THEN title ELSE '' END AS truth_location FROM r WHERE rn <= CASE type WHEN 'GEO' THEN 3 ELSE 2 END""")
def q_generate_cases(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("type") == "ORGANIZATION", "EVENT").otherwise(F.col("type"))
    rows = graph.generate_cases(people(spark, sf).withColumn("type", kind))
    return rows.select("query_id", "text", "truth", F.coalesce("truth_location", F.lit("")).alias("truth_location"))


@catalog.add("q_build_progress", """
SELECT (SELECT count(*) FROM labels) AS n_done, (SELECT count(*) FROM documents) AS n_total,
       round((SELECT count(*) FROM labels) / (SELECT count(*) FROM documents), 6) AS ratio""")
def q_build_progress(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_progress(load(spark, sf, "labels"), load(spark, sf, "documents")).withColumn("ratio", F.round("ratio", 6))
