"""Queries on vectors, ranking and quality metrics, facts, the gate and benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.columns import text_array
from ..operators import benchmark, cells, evaluation, facts, fuzzy, gate, novelty, quality, ranking, retrieval, terms, vectors
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.tables import load
from .shared import ENDS, Catalog, conversations, documents
from .text import SENTENCES_SQL, decomposed_sql

catalog = Catalog()


def sql_sentences(text: str) -> str:
    return SENTENCES_SQL.replace("(text,", f"({text},")


# --- vectors -----------------------------------------------------------------

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings")


def queries_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


COSINE_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, label FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS ql, b.label AS vl, list_dot_product(a.e, b.e) / (a.n * b.n) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank, vec_id, ql, vl, score FROM s QUALIFY rank <= 10)"""


@catalog.add("q_vector_topk", f"WITH {COSINE_SQL} SELECT query_id, rank, vec_id, round(score, 5) AS score FROM k")
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(spark, sf).withColumn("score", F.round("score", 5))


@catalog.add("q_vector_l2_of_names", """
WITH v AS (SELECT 'v' || vec_id::VARCHAR AS name, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.name AS query, b.name, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d
      FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY d, name) AS rank, name, round(d, 5) AS score FROM s QUALIFY rank <= 5""")
def q_vector_l2_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors named by strings, as text units are."""
    table = load(spark, sf, "embeddings").withColumn("name", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    queries = table.select(F.col("name").alias("query"), F.col("embedding").alias("query_vector"))
    rows = vectors.vector_topk(queries, table, 5, "l2", query_id="query", vector_id="name", skip_same_id=True)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 5))


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    table = embeddings(spark, sf)
    rows = vectors.vector_topk(queries_of(table), table, 10, skip_same_id=True, digits=6)
    return rows.withColumn("rank", F.col("rank").cast("long"))


@catalog.add("q_vector_l2", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d FROM v a JOIN v b ON true)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) AS rank, vec_id, round(d, 5) AS score FROM s QUALIFY rank <= 5""")
def q_vector_l2(spark: SparkSession, sf: str) -> DataFrame:
    table = embeddings(spark, sf)
    rows = vectors.vector_topk(queries_of(table), table, 5, metric="l2", digits=6)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 5))


@catalog.add("q_vector_tables", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE vec_id % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'community' ELSE 'text_unit' END AS kind FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.kind, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d
      FROM v a JOIN v b ON a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY d, id) AS rank FROM s)
SELECT query_id, kind, rank, id, round(d, 5) AS distance, round(1 - d, 5) AS similarity, coalesce(source, '') AS title,
       CASE kind WHEN 'community' THEN left(coalesce(text, ''), 1000) ELSE coalesce(text, '') END AS text
FROM k LEFT JOIN documents ON doc_id = id WHERE rank <= CASE kind WHEN 'community' THEN 5 ELSE 10 END""")
def q_vector_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector against three stored tables: entities, communities and text units with their texts."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cells-{uuid.uuid4().hex}"
    table = load(spark, sf, "embeddings").select("vec_id", "embedding")
    texts = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    stores, shown = {}, {}
    for number, kind in enumerate(("entity", "community", "text_unit")):
        stores[kind] = cells.store_cells(table.where(F.col("vec_id") % 3 == number), f"{folder}/{kind}", "vec_id", "embedding")
        shown[kind] = texts
    queries = table.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = cells.search_tables(queries, stores, shown)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("distance", F.round("distance", 5)).withColumn("similarity", F.round("similarity", 5))


@catalog.add("q_hits_lookup", """
SELECT l_orderkey, l_partkey + 1 AS id, coalesce(p_name, '未知实体') AS title, coalesce(p_type, 'unknown') AS type, coalesce(p_brand, '') AS description,
       round(l_discount, 6) AS distance, round(1 - l_discount, 6) AS similarity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 1""")
def q_hits_lookup(spark: SparkSession, sf: str) -> DataFrame:
    hits = load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") + 1).alias("id"), F.col("l_discount").alias("distance"))
    entities = load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_brand").alias("description")
    )
    rows = vectors.with_similarity(vectors.hits_lookup(hits, entities))
    return rows.withColumn("distance", F.round("distance", 6)).withColumn("similarity", F.round("similarity", 6))


@catalog.add("q_vector_profile", "SELECT label, count(*) AS n_rows, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim FROM embeddings GROUP BY label")
def q_vector_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.vector_profile(embeddings(spark, sf), keys=["label"])
    return rows.withColumn("min_dim", F.col("min_dim").cast("long")).withColumn("max_dim", F.col("max_dim").cast("long"))


@catalog.add("q_normalized_vectors", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS norm2 FROM v""")
def q_normalized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    unit = vectors.normalize_vector(F.col("embedding"))
    rows = embeddings(spark, sf).select("vec_id", unit.alias("u"))
    return rows.select(
        "vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"),
    )


@catalog.add("q_hashed_embedding", """
SELECT doc_id, 128 AS dim, (CASE WHEN length(regexp_replace(text, '\\s+', ' ', 'g')) >= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS norm2 FROM documents""")
def q_hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.hashed_embedding(documents(spark, sf), "text", 128)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm2"))


# --- ranking -----------------------------------------------------------------

IDEAL = [sum(3.0 / __import__("math").log2(i + 2) for i in range(n)) for n in range(11)]
IDEAL_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in IDEAL) + "]"


@catalog.add("q_ndcg", f"""
WITH {COSINE_SQL},
g AS (SELECT query_id, rank, CASE WHEN ql = vl THEN 3.0 WHEN abs(ql - vl) = 1 THEN 1.0 ELSE 0.0 END AS grade FROM k),
t AS (SELECT a.vec_id AS query_id, count(*) - 1 AS n FROM embeddings a JOIN embeddings b USING (label) GROUP BY 1)
SELECT t.query_id, {', '.join(f"round(CASE WHEN n > 0 THEN sum(CASE WHEN rank <= {c} THEN grade / log2(rank + 1) ELSE 0 END) / ({IDEAL_SQL})[least({c}, n) + 1] ELSE 0.0 END, 6) AS ndcg_{c}" for c in (3, 5, 10))},
       round(coalesce(1 / min(CASE WHEN grade >= 2 THEN rank END), 0.0), 6) AS mrr
FROM t JOIN g USING (query_id) GROUP BY t.query_id, n""")
def q_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    labels = embeddings(spark, sf).select("vec_id", "label")
    results = nearest(spark, sf)
    pairs = results.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels, "vec_id")
    gap = F.abs(F.col("ql") - F.col("label"))
    judgements = pairs.select("query_id", "vec_id", F.when(gap == 0, 3.0).when(gap == 1, 1.0).otherwise(0.0).alias("grade"))
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = labels.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    rows = ranking.judged_metrics(results, judgements, relevant, "vec_id")
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg_3", "ndcg_5", "ndcg_10", "mrr")])


@catalog.add("q_benchmark_summary", """
SELECT event_type AS strategy, count(*) AS total_queries, round(avg(v / 100.0)::DOUBLE, 4) AS avg_f1, round(avg((v > 50)::INT), 4) AS hit_5,
       round(avg(v)::DOUBLE, 2) AS avg_latency_ms FROM (SELECT event_type, value::DECIMAL(18, 4)::DOUBLE AS v FROM events) GROUP BY 1""")
def q_benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    details = load(spark, sf, "events").select(
        F.col("event_type").alias("strategy"), (F.col("value") / 100.0).alias("f1"), (F.col("value") > 50).alias("hit_5"), F.col("value").alias("latency_ms")
    )
    return ranking.benchmark_summary(details, ["strategy"], ["f1"], ["hit_5"])


@catalog.add("q_best_strategies", """
WITH s AS (SELECT event_type AS strategy, round(avg(value), 4) AS a, round(avg(value) FILTER (value < 50), 4) AS b FROM events GROUP BY 1)
SELECT (SELECT strategy FROM s ORDER BY a DESC, strategy LIMIT 1) AS best_a, (SELECT strategy FROM s ORDER BY b DESC, strategy LIMIT 1) AS best_b""")
def q_best_strategies(spark: SparkSession, sf: str) -> DataFrame:
    summary = load(spark, sf, "events").groupBy(F.col("event_type").alias("strategy")).agg(
        F.round(F.avg("value"), 4).alias("a"), F.round(F.avg(F.when(F.col("value") < 50, F.col("value"))), 4).alias("b")
    )
    return ranking.best_strategies(summary, ["a", "b"])


@catalog.add("q_grouped_averages", """
SELECT coalesce(event_type, 'ALL') AS label, grouping(event_type)::INT AS is_total, count(*) AS n_rows, round(avg(value), 4) AS avg_value,
       round(avg(CASE WHEN value > 20 THEN k END), 4) AS avg_k
FROM (SELECT event_type, value, (props->>'k')::DOUBLE AS k FROM events) GROUP BY ROLLUP(event_type)""")
def q_grouped_averages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    details = load(spark, sf, "events").select(F.col("event_type").alias("label"), "value", F.when(F.col("value") > 20, k).alias("k"))
    rows = ranking.grouped_averages(details, "label", ["value", "k"])
    return rows.select(
        F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("label")).alias("label"), "is_total", "n_rows",
        F.round("avg_value", 4).alias("avg_value"), F.round("avg_k", 4).alias("avg_k"),
    )


@catalog.add("q_weighted_score", """
WITH w(name, weight) AS (VALUES ('click', 1.5), ('view', 0.8), ('error', 2.0)),
m AS (SELECT user_id, event_type AS name, value, CASE WHEN value > 90 THEN 0.0 ELSE 100.0 END AS mx FROM events)
SELECT user_id, round(sum((CASE WHEN mx = 0 THEN 0.0 ELSE value / mx END) * coalesce(weight, 1.0)::DOUBLE) / sum(coalesce(weight, 1.0)::DOUBLE) * 10, 5) AS score
FROM m LEFT JOIN w USING (name) GROUP BY 1""")
def q_weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    metrics = load(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("name"), "value", F.when(F.col("value") > 90, 0.0).otherwise(100.0).alias("max_value")
    )
    weights = spark.createDataFrame([("click", 1.5), ("view", 0.8), ("error", 2.0)], "name string, weight double")
    return ranking.weighted_score(metrics, weights, "user_id").withColumn("score", F.round("score", 5))


@catalog.add("q_doc_score", """
WITH s AS (SELECT conv_id, length(text) AS n, (length(text) % 100) / 10.0::DOUBLE AS s, CASE role WHEN 'user' THEN 5.0::DOUBLE END AS j FROM conversations)
SELECT conv_id, round(sum((CASE WHEN j IS NULL THEN s ELSE (s * 9 + j) / 10 END) * n) / CASE WHEN sum(n) = 0 THEN 1 ELSE sum(n) END, 6) AS document_score FROM s GROUP BY 1""")
def q_doc_score(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    segments = load(spark, sf, "conversations").select(
        F.col("conv_id"), n.alias("n_chars"), ((n % 100) / 10.0).alias("score"), F.when(F.col("role") == "user", 5.0).alias("judge")
    )
    rows = ranking.document_score(segments, "conv_id", judge="judge")
    return rows.withColumn("document_score", F.round("document_score", 6))


@catalog.add("q_provider_pivot", """
SELECT user_id, round(avg(sqrt(value)) FILTER (event_type = 'click'), 6) AS click, round(avg(sqrt(value)) FILTER (event_type = 'view'), 6) AS view,
       round(avg(sqrt(value)), 6) AS overall FROM events GROUP BY 1""")
def q_provider_pivot(spark: SparkSession, sf: str) -> DataFrame:
    scores = load(spark, sf, "events").withColumn("score", F.sqrt("value"))
    rows = ranking.provider_pivot(scores, "user_id", "event_type", "score", ["click", "view"])
    return rows.select("user_id", *[F.round(c, 6).alias(c) for c in ("click", "view", "overall")])


VERDICTS_SQL = """
v AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'SUPPORTED' WHEN 'click' THEN 'SUPPORTED' WHEN 'error' THEN 'NOT_SUPPORTED' ELSE 'UNSURE' END AS verdict FROM events),
s AS (SELECT user_id, count(*) AS total, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'NOT_SUPPORTED') AS not_supported,
      count(*) FILTER (verdict = 'UNSURE') AS unsure, count(*) FILTER (verdict = 'SUPPORTED') / count(*) AS safe_score FROM v GROUP BY 1)"""


@catalog.add("q_best_providers", """
WITH p AS (SELECT user_id, event_type AS dimension, avg(sqrt(value)) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL
           UNION ALL SELECT user_id, 'overall', avg(sqrt(value)) FROM events GROUP BY 1)
SELECT dimension, user_id AS best, round(v, 6) AS value FROM p QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY v DESC, user_id) = 1""")
def q_best_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Which user has the highest mean in each kind of event and overall."""
    scores = load(spark, sf, "events").select("user_id", "event_type", F.sqrt("value").alias("value"))
    wide = ranking.provider_pivot(scores, "user_id", "event_type", "value", ["click", "view"])
    return ranking.best_providers(wide, "user_id", ["click", "view"]).withColumn("value", F.round("value", 6))


@catalog.add("q_verdict_summary", f"""
WITH {VERDICTS_SQL}
SELECT user_id, total, supported, not_supported, unsure, round(safe_score, 6) AS safe_score, round(safe_score - 0.375, 4) AS score_diff,
       CASE WHEN safe_score - 0.375 > 0.15 THEN 'kb_coverage_low' WHEN safe_score - 0.375 < -0.15 THEN 'kb_supports_well' ELSE 'consistent' END AS assessment FROM s""")
def q_verdict_summary(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.when(kind.isin("purchase", "click"), "SUPPORTED").when(kind == "error", "NOT_SUPPORTED").otherwise("UNSURE")
    rows = ranking.verdict_summary(load(spark, sf, "events").select("user_id", verdict.alias("verdict")), ["user_id"])
    rows = ranking.compare_with_kb(rows.withColumn("kb_score", F.lit(0.375)))
    return rows.drop("kb_score").withColumn("safe_score", F.round("safe_score", 6))


# --- pair metrics: a turn as produced text, the turn before it as source -----

PAIRS_SQL = """
pairs AS (SELECT b.conv_id, b.turn, a.text AS source, b.text AS produced FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = conversations(spark, sf)
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return before.join(turns.select("conv_id", "turn", F.col("text").alias("produced")), ["conv_id", "turn"])


@catalog.add("q_temporal_coherence", """
WITH y AS (SELECT d.doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9]{4}'), lambda x: x::INT), lambda x: x BETWEEN 1000 AND 2100)) AS mine FROM documents d),
s AS (SELECT doc_id, mine, [1994, 2022, 1567, 1890, 2012] AS src FROM y)
SELECT doc_id, round(CASE WHEN len(mine) = 0 THEN 1.0 ELSE len(list_intersect(mine, src)) / len(mine) END, 6) AS coherence FROM s""")
def q_temporal_coherence(spark: SparkSession, sf: str) -> DataFrame:
    source = F.lit("in 1994, 2022, 1567, 1890 and 2012")
    return documents(spark, sf).select("doc_id", F.round(quality.temporal_coherence("text", source), 6).alias("coherence"))


CONCEPT = "[A-Za-z]{6,}"
NORM = "upper(regexp_replace({0}, '[^一-龥a-zA-Z0-9]', '', 'g'))"
TOPIC_SQL = f"""
x AS (SELECT conv_id, turn, source, produced, {NORM.format('produced')} AS flat,
      list_filter(regexp_extract_all(source, '{CONCEPT}'), lambda c, i: list_position(regexp_extract_all(source, '{CONCEPT}'), c) = i)[1:20] AS concepts FROM pairs),
topic AS (SELECT conv_id, turn, len(concepts) AS n_concepts, CASE WHEN len(concepts) = 0 THEN 0.5 ELSE len(list_filter(concepts, lambda c: contains(flat, upper(c)) OR
      len(list_filter(range(1, length(c)), lambda i: contains(produced, substr(c, i::INT, 2)))) > 0)) / len(concepts) END AS topic FROM x)"""


@catalog.add("q_topic_coherence", f"WITH {PAIRS_SQL}, {TOPIC_SQL} SELECT conv_id, turn, round(topic, 6) AS topic FROM topic")
def q_topic_coherence(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).withColumn("concepts", quality.fallback_concepts("source", CONCEPT))
    return rows.select("conv_id", "turn", F.round(quality.topic_coherence("produced", "concepts"), 6).alias("topic"))


LENGTH_SQL = "CASE WHEN {n} BETWEEN {c} AND {d} THEN 1.0 WHEN {n} BETWEEN {a} AND {b} THEN CASE WHEN {n} < {c} THEN 0.7 + 0.3 * ({n} - {a}) / ({c} - {a}) ELSE 0.7 + 0.3 * ({b} - {n}) / ({b} - {d}) END ELSE 0.3 END"


@catalog.add("q_length_score", f"""
SELECT doc_id, round(({LENGTH_SQL.format(n='length(text)', a=150, b=600, c=200, d=500)})::DOUBLE, 6) AS chapter_score,
       round(({LENGTH_SQL.format(n='length(text)', a=400, b=50000, c=800, d='greatest(800, least(length(text), 12000))')})::DOUBLE, 6) AS document_score FROM documents""")
def q_length_score(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.round(quality.length_score(n), 6).alias("chapter_score"), F.round(quality.document_length_score(n), 6).alias("document_score")
    )


@catalog.add("q_adaptive_bounds", f"""
WITH {PAIRS_SQL}, l AS (SELECT conv_id, turn, length(source)::INT AS m FROM pairs)
SELECT conv_id, turn, greatest(50, m)::BIGINT AS low, greatest(800 * 3, m * 8)::BIGINT AS high, greatest(m * 2, 400)::BIGINT AS best_low, greatest(m * 5, 800)::BIGINT AS best_high FROM l""")
def q_adaptive_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).select("conv_id", "turn", quality.adaptive_bounds(F.length("source"), F.lit(400), F.lit(800)).alias("b"))
    return rows.select("conv_id", "turn", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("low", "high", "best_low", "best_high")])


TRANSITIONS = ["und", "and the", "que", "for", "der"]
PATTERNS = ["[0-9]", "tion|keit", "[A-Z][a-z]{9,}", "ß|ç|ñ"]


def transition_sql(text: str) -> str:
    return " + ".join(f"contains({text}, '{w}')::INT" for w in TRANSITIONS)


def richness_sql(text: str) -> str:
    return " + ".join(f"regexp_matches({text}, '{p}')::INT" for p in PATTERNS)



@catalog.add("q_transition", f"""
WITH t AS (SELECT doc_id, {transition_sql('text')} AS n FROM documents)
SELECT doc_id, (CASE WHEN n >= 2 THEN 1.0 WHEN n = 1 THEN 0.7 ELSE 0.4 END)::DOUBLE AS score FROM t""")
def q_transition(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", quality.transition_usage("text", TRANSITIONS).alias("score"))


@catalog.add("q_richness", f"SELECT doc_id, (({richness_sql('text')}) / 4.0)::DOUBLE AS score FROM documents")
def q_richness(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", quality.descriptive_richness("text", PATTERNS).alias("score"))


@catalog.add("q_utilization", """
SELECT vec_id, (CASE WHEN label >= 4 THEN 1.0 WHEN label = 3 THEN 0.8 WHEN label = 2 THEN 0.7 WHEN label = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS utilization,
       (CASE WHEN label >= 3 THEN 1.0 WHEN label = 2 THEN 0.7 WHEN label = 1 THEN 0.4 ELSE 0.0 END)::DOUBLE AS gain,
       round(CASE WHEN label = 0 THEN 1.0 ELSE (label // 2) / label END, 6) AS grounding, round(1 - CASE WHEN label = 0 THEN 0.0 ELSE (label // 3) / label END, 6) AS hallucination
FROM embeddings""")
def q_utilization(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("label")
    return embeddings(spark, sf).select(
        "vec_id", quality.utilization(n).alias("utilization"), quality.information_gain(n).alias("gain"),
        F.round(quality.expansion_grounding(F.floor(n / 2), n), 6).alias("grounding"),
        F.round(quality.hallucination_score(F.floor(n / 3), n), 6).alias("hallucination"),
    )


GRAMS_SQL = """
c AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\\s+', '', 'g'), '') AS c FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN len(c) < 6 THEN [] ELSE list_distinct(list_transform(range(1, len(c) - 4),
      lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4] || c[i+5])) END AS g FROM c),
o AS (SELECT a.conv_id, a.turn, list_intersect(a.g, b.g) AS common,
      CASE WHEN least(len(a.g), len(b.g)) > 0 THEN len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) END AS ratio
      FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@catalog.add("q_repetition", f"""
WITH {GRAMS_SQL}, m AS (SELECT conv_id, avg(ratio) AS m FROM o GROUP BY 1)
SELECT c.conv_id, round(greatest(0.0, 1 - coalesce(m, 0.0)), 6) AS repetition_score FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id)""")
def q_repetition(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.repetition(conversations(spark, sf), "conv_id", "turn", "text")
    return rows.withColumn("repetition_score", F.round("repetition_score", 6))


@catalog.add("q_style", f"""
WITH s AS (SELECT conv_id, list_transform({SENTENCES_SQL}, lambda x: length(x)) AS l FROM conversations),
m AS (SELECT conv_id, count(*) AS n, avg(a) AS a, stddev_pop(a) AS sd FROM (SELECT conv_id, list_sum(l) / len(l) AS a FROM s WHERE len(l) > 0) GROUP BY 1),
v AS (SELECT c.conv_id, coalesce(n, 0) AS n, CASE WHEN a > 0 THEN sd / a ELSE 0 END AS cv FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id))
SELECT conv_id, round((CASE WHEN n < 2 OR cv <= 0.2 THEN 1.0 WHEN cv >= 0.6 THEN 0.3 ELSE 1.0 - (cv - 0.2) / 0.4 * 0.7 END)::DOUBLE, 6) AS style_score FROM v""")
def q_style(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.style_consistency(conversations(spark, sf), "conv_id", "text", ENDS)
    return rows.withColumn("style_score", F.round("style_score", 6))


SUMMARY = "^(The|Die|Les|Los|And|Der|En|La)"


@catalog.add("q_summary_ratio", f"""
WITH s AS (SELECT conv_id, {SENTENCES_SQL} AS l FROM conversations),
n AS (SELECT conv_id, sum(len(l))::BIGINT AS n_sentences, sum(len(list_filter(l, lambda x: regexp_matches(x, '{SUMMARY}'))))::BIGINT AS n_summary FROM s GROUP BY 1)
SELECT conv_id, n_sentences, n_summary, round(greatest(0.0, 1 - 5 * CASE WHEN n_sentences = 0 THEN 0 ELSE n_summary / n_sentences END), 6) AS summary_score FROM n""")
def q_summary_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.summary_ratio(conversations(spark, sf), "conv_id", "text", SUMMARY, ENDS)
    return rows.withColumn("summary_score", F.round("summary_score", 6))


BOILERPLATE, EPILOGUE = "tion|keit", "(?:and|und).*?(?:the|die)"


@catalog.add("q_detectors", f"""
WITH s AS (SELECT conv_id, turn, text, {SENTENCES_SQL} AS l FROM conversations),
t AS (SELECT *, list_filter(l[greatest(1, len(l) - 2):], lambda x: regexp_matches(x, '{EPILOGUE}')) AS e FROM s)
SELECT conv_id, turn, len(regexp_extract_all(text, '{BOILERPLATE}'))::BIGINT AS n_boilerplate, coalesce(left(e[1], 60), '') AS epilogue,
       round(CASE WHEN len(l) = 0 THEN 0.0 ELSE len(list_filter(l, lambda x: regexp_matches(x, '{SUMMARY}'))) / len(l) END, 6) AS summary_share FROM t""")
def q_detectors(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).select(
        "conv_id", "turn", quality.boilerplate_count("text", BOILERPLATE).cast("long").alias("n_boilerplate"),
        F.coalesce(quality.epilogue_sentence("text", EPILOGUE, 3, ENDS), F.lit("")).alias("epilogue"),
        F.round(quality.summary_share("text", SUMMARY, ENDS), 6).alias("summary_share"),
    )


@catalog.add("q_bigram_cosine", f"""
WITH {PAIRS_SQL},
w AS (SELECT conv_id * 1000 + turn AS id, string_split(array_to_string(regexp_extract_all(source, '[a-z]'), ''), '') AS a, string_split(array_to_string(regexp_extract_all(produced, '[a-z]'), ''), '') AS b FROM pairs),
e AS (SELECT id, 0 AS side, unnest(list_transform(range(1, len(a)), lambda i: a[i] || a[i+1])) AS g FROM w
      UNION ALL SELECT id, 1, unnest(list_transform(range(1, len(b)), lambda i: b[i] || b[i+1])) FROM w),
n AS (SELECT id, g, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM e GROUP BY ALL),
s AS (SELECT id, sum(x * y) AS d, sum(x * x) AS xx, sum(y * y) AS yy FROM n GROUP BY 1)
SELECT w.id, round(coalesce(CASE WHEN xx > 0 AND yy > 0 THEN d / (sqrt(xx) * sqrt(yy)) END, 0.0), 6) AS cosine FROM w LEFT JOIN s USING (id)""")
def q_bigram_cosine(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return quality.bigram_cosine(rows, "id", "source", "produced", "[a-z]").withColumn("cosine", F.round("cosine", 6))


@catalog.add("q_simple_eval", f"""
WITH {PAIRS_SQL},
x AS (SELECT *, length(produced) AS n, len(list_intersect(list_distinct(string_split(source, '')), list_distinct(string_split(produced, '')))) AS shared,
      list_filter(regexp_extract_all(source, '[A-Z][a-z]{{2,}}'), lambda c, i: true) AS kw,
      len(list_filter(string_split(produced, chr(10)), lambda p: trim(p) <> '')) AS np, {transition_sql('produced')} AS nt FROM pairs),
s AS (SELECT conv_id, turn,
  least(5.0 + least(len(list_filter(kw[1:5], lambda e: contains(produced, e))), 3) + contains(produced, 'ung')::INT + contains(produced, 'tion')::INT, 10.0) AS accuracy,
  least(5.0 + CASE WHEN shared > 10 THEN 2 WHEN shared > 5 THEN 1 ELSE 0 END + least(len(list_filter(kw, lambda e: contains(produced, e))), 3), 10.0) AS relevance,
  least(5.0 + CASE WHEN n BETWEEN 200 AND 500 THEN 2 WHEN n BETWEEN 100 AND 800 THEN 1 ELSE 0 END + (np BETWEEN 1 AND 3)::INT + least(nt, 2), 10.0) AS literary FROM x)
SELECT conv_id, turn, accuracy::DOUBLE AS accuracy, relevance::DOUBLE AS relevance, literary::DOUBLE AS literary, round(accuracy::DOUBLE * 0.4 + relevance::DOUBLE * 0.3 + literary::DOUBLE * 0.3, 2) AS overall,
  array_to_string(list_filter([CASE WHEN accuracy < 7 THEN 'accuracy' END, CASE WHEN relevance < 7 THEN 'relevance' END, CASE WHEN literary < 7 THEN 'literary' END], lambda v: v IS NOT NULL), '|') AS advice FROM s""")
def q_simple_eval(spark: SparkSession, sf: str) -> DataFrame:
    names = F.regexp_extract_all("source", F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    produced, source = F.col("produced"), F.col("source")
    rows = pairs(spark, sf).withColumn("names", names).select(
        "conv_id", "turn",
        quality.simple_accuracy(produced, F.col("names"), F.lit("ung"), F.lit("tion")).alias("accuracy"),
        quality.simple_relevance(produced, source, F.col("names")).alias("relevance"),
        quality.simple_literary(produced, TRANSITIONS).alias("literary"),
    )
    parts = (F.col("accuracy"), F.col("relevance"), F.col("literary"))
    return rows.select(
        "*", quality.simple_overall(*parts).alias("overall"), F.array_join(quality.suggestions(*parts), "|").alias("advice")
    )


@catalog.add("q_older_metrics", f"""
WITH {PAIRS_SQL},
x AS (SELECT conv_id, turn, source, produced, regexp_extract_all(source, '[A-Z][a-z]{{3,}}') AS kw, list_distinct(string_split(source, '')) AS a,
      list_distinct(string_split(produced, '')) AS b, len(list_filter(string_split(produced, chr(10)), lambda p: trim(p) <> '')) AS np FROM pairs)
SELECT conv_id, turn,
  round(CASE WHEN len(kw) = 0 THEN 0.0 ELSE least(len(list_filter(kw, lambda e: contains(produced, e))) / least(2, len(kw)), 1.0) END, 6) AS coverage,
  round(CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda e: contains(produced, e))) / len(kw)
        ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap,
  (CASE WHEN np = 0 THEN 0.0 WHEN np <= 3 THEN 1.0 ELSE 0.6 END)::DOUBLE AS paragraphs FROM x""")
def q_older_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).withColumn("kw", F.regexp_extract_all("source", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    produced, source, kw = F.col("produced"), F.col("source"), F.col("kw")
    return rows.select(
        "conv_id", "turn", F.round(quality.entity_coverage(produced, kw), 6).alias("coverage"),
        F.round(quality.keyword_overlap(produced, source, kw), 6).alias("overlap"), quality.paragraph_structure(produced).alias("paragraphs"),
    )


@catalog.add("q_coverage", f"""
WITH {PAIRS_SQL},
x AS (SELECT conv_id, turn, produced, regexp_extract_all(source, '[A-Z][a-z]{{3,}}')[1:15] AS r, list_distinct(regexp_extract_all(produced, '[A-Z][a-z]{{3,}}')) AS t,
      list_distinct(regexp_extract_all(lower(produced), '[a-z]{{2,}}')) AS pt, list_distinct(regexp_extract_all(lower(source), '[a-z]{{2,}}')) AS st FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(r) = 0 THEN 0.0 ELSE len(list_filter(r, lambda e: contains(produced, e))) / len(r) END, 6) AS rag_coverage,
  len(list_filter(t, lambda e: NOT list_contains(r, e)))::BIGINT AS n_text_only, round(CASE WHEN len(pt) = 0 THEN 0.0 ELSE len(list_intersect(pt, st)) / len(pt) END, 6) AS token_coverage FROM x""")
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    rows = pairs(spark, sf).select(
        "conv_id", "turn", "produced", found("source", "[A-Z][a-z]{3,}").alias("r"), found("produced", "[A-Z][a-z]{3,}").alias("t"),
        found(F.lower("produced"), "[a-z]{2,}").alias("pt"), found(F.lower("source"), "[a-z]{2,}").alias("st"),
    )
    rag = quality.rag_coverage(F.col("produced"), F.col("r"), F.col("t"))
    return rows.select("conv_id", "turn", rag.alias("c"), F.round(quality.token_coverage(F.col("pt"), F.col("st")), 6).alias("token_coverage")).select(
        "conv_id", "turn", F.round("c.coverage", 6).alias("rag_coverage"), F.size("c.text_only").cast("long").alias("n_text_only"), "token_coverage"
    )


# What is retrieved for a turn is the turn after it: up to 15 of its names that the source lacks.
NOVEL_NAMES_SQL = f"""
{PAIRS_SQL},
ev AS (SELECT p.conv_id, p.turn, source, produced, coalesce(c.text, '') AS evidence FROM pairs p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1),
ordered AS (SELECT *, regexp_extract_all(evidence, '[A-Z][a-z]{{3,}}') AS al, regexp_extract_all(produced, '[A-Z][a-z]{{4,}}') AS fl FROM ev),
listed AS (SELECT *, list_filter(list_filter(al, lambda x, i: list_position(al, x) = i), lambda x: NOT contains(source, x))[1:15] AS names,
           list_filter(fl, lambda x, i: list_position(fl, x) = i)[1:30] AS facts, upper(regexp_replace(produced, '[^一-龥a-zA-Z0-9]', '', 'g')) AS flat,
           upper(regexp_replace(evidence, '[^一-龥a-zA-Z0-9]', '', 'g')) AS evflat FROM ordered),
av AS (SELECT conv_id, turn, flat, unnest(range(1, len(names) + 1)) AS rank, unnest(names) AS name FROM listed),
mn AS (SELECT conv_id, turn, rank, lower(name) AS name, name AS shown FROM av
       WHERE len(list_filter(range(1, length(name) - 1), lambda i: contains(flat, upper(substr(name, i::INT, 3))))) > 0),
tie AS (SELECT a.conv_id, a.turn, a.rank AS later, b.rank AS earlier FROM mn a JOIN mn b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.rank < a.rank
        WHERE contains(a.name, b.name) OR contains(b.name, a.name) OR left(a.name, 4) = left(b.name, 4)),
roots AS (SELECT conv_id, turn, rank FROM mn WHERE NOT EXISTS (SELECT 1 FROM tie WHERE tie.conv_id = mn.conv_id AND tie.turn = mn.turn AND later = mn.rank)),
reach AS (SELECT conv_id, turn, rank, rank AS root FROM roots UNION SELECT t.conv_id, t.turn, t.later, r.root FROM reach r JOIN tie t ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.earlier = r.rank),
leaders AS (SELECT conv_id, turn, rank, min(root) AS leader FROM reach GROUP BY ALL),
us AS (SELECT conv_id, turn, count(DISTINCT leader) AS n_used, string_agg(CASE WHEN leader = rank THEN shown END, ',' ORDER BY rank) AS used FROM leaders JOIN mn USING (conv_id, turn, rank) GROUP BY 1, 2),
fc AS (SELECT conv_id, turn, source, evflat, unnest(range(1, len(facts) + 1)) AS position, unnest(facts) AS fact FROM listed),
fg AS (SELECT *, EXISTS (SELECT 1 FROM av WHERE av.conv_id = fc.conv_id AND av.turn = fc.turn AND (contains(lower(name), lower(fact)) OR contains(lower(fact), lower(name)) OR left(lower(name), 4) = left(lower(fact), 4)))
       OR contains(evflat, upper(fact)) OR len(list_filter(list_distinct(list_transform(range(1, length(fact) - 1), lambda i: upper(substr(fact, i::INT, 3)))), lambda g: contains(evflat, g)))
          / len(list_distinct(list_transform(range(1, length(fact) - 1), lambda i: upper(substr(fact, i::INT, 3))))) >= 0.6 AS g FROM fc),
fs AS (SELECT conv_id, turn, count(*) AS n_facts, count(*) FILTER (g) AS n_grounded, count(*) FILTER (NOT g AND NOT contains(source, fact)) AS n_unsupported FROM fg GROUP BY 1, 2),
analysis AS (SELECT conv_id, turn, len(names) AS n_available, coalesce(n_used, 0) AS n_used, coalesce(used, '') AS used, coalesce(n_facts, 0) AS n_facts,
             coalesce(n_grounded, 0) AS n_grounded, coalesce(n_unsupported, 0) AS n_unsupported FROM listed LEFT JOIN us USING (conv_id, turn) LEFT JOIN fs USING (conv_id, turn))"""


def novel_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with evidence, names offered to them, and facts they state."""
    unit = F.struct("conv_id", "turn").alias("unit")
    after = load(spark, sf, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("evidence"))
    rows = pairs(spark, sf).join(after, ["conv_id", "turn"], "left").select(unit, "source", "produced", F.coalesce("evidence", F.lit("")).alias("evidence"))
    distinct = lambda text, pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    names = F.slice(F.filter(distinct("evidence", "[A-Z][a-z]{3,}"), lambda n: ~F.col("source").contains(n)), 1, 15)
    available = rows.select("unit", F.posexplode(names).alias("rank", "name")).withColumn("rank", F.col("rank") + 1)
    return rows, available, rows.select("unit", F.posexplode(F.slice(distinct("produced", "[A-Z][a-z]{4,}"), 1, 30)).alias("position", "fact"))


@catalog.add("q_novel_analysis", f"""
WITH RECURSIVE {NOVEL_NAMES_SQL}
SELECT conv_id, turn, n_available, n_used, used, n_facts, n_grounded, n_unsupported FROM analysis""")
def q_novel_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """How each turn uses the names of what was retrieved for it, and how far its own are supported."""
    rows = evaluation.novel_analysis(*novel_tables(spark, sf), spellings={})
    return rows.select("unit.conv_id", "unit.turn", "n_available", "n_used", F.array_join("used", ",").alias("used"), "n_facts", "n_grounded", "n_unsupported")


@catalog.add("q_evaluate_pairs", f"""
WITH RECURSIVE {NOVEL_NAMES_SQL}, {TOPIC_SQL},
y AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(produced, '[0-9]{{4}}'), lambda v: v::INT), lambda v: v BETWEEN 1000 AND 2100)) AS py,
      list_distinct(list_filter(list_transform(regexp_extract_all(source, '[0-9]{{4}}'), lambda v: v::INT), lambda v: v BETWEEN 1000 AND 2100)) AS sy,
      length(produced) AS n, {transition_sql('produced')} AS nt FROM pairs),
m AS (SELECT y.conv_id, y.turn, CASE WHEN len(py) = 0 THEN 1.0 ELSE len(list_intersect(py, sy)) / len(py) END AS a, topic AS b,
      ({LENGTH_SQL.format(n='n', a=150, b=600, c=200, d=500)})::DOUBLE AS c, (CASE WHEN nt >= 2 THEN 1.0 WHEN nt = 1 THEN 0.7 ELSE 0.4 END)::DOUBLE AS d,
      ({richness_sql('produced')}) / 4.0::DOUBLE AS e, (CASE WHEN n_used >= 4 THEN 1.0 WHEN n_used = 3 THEN 0.8 WHEN n_used = 2 THEN 0.7 WHEN n_used = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS f,
      1 - CASE WHEN n_facts = 0 THEN 0.0 ELSE n_unsupported / n_facts END AS g, (CASE WHEN n_used >= 3 THEN 1.0 WHEN n_used = 2 THEN 0.7 WHEN n_used = 1 THEN 0.4 ELSE 0.0 END)::DOUBLE AS h,
      CASE WHEN n_facts = 0 THEN 1.0 ELSE n_grounded / n_facts END AS i FROM y JOIN topic USING (conv_id, turn) JOIN analysis USING (conv_id, turn))
SELECT conv_id, turn, round(f, 6) AS utilization, round(g, 6) AS hallucination, round(h, 6) AS information_gain, round(i, 6) AS grounding, 9::BIGINT AS n_metrics,
       round((a * 1.0 + b * 1.5 + c * 0.8 + d * 0.8 + e * 0.8 + f * 2.0 + g * 2.0) / 8.9 * 10, 5) AS score FROM m""")
def q_evaluate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.lexicons import METRIC_WEIGHTS

    rows, available, stated = novel_tables(spark, sf)
    rows = rows.withColumn("concepts", quality.fallback_concepts("source", CONCEPT))
    weights = spark.createDataFrame(list(METRIC_WEIGHTS.items()), "name string, weight double")
    metrics, score = evaluation.evaluate(rows, available, stated, F.col("concepts"), weights, spellings={}, transitions=TRANSITIONS, richness=PATTERNS)
    of = lambda name: F.round(F.max(F.when(F.col("name") == name, F.col("value"))), 6)
    wide = metrics.groupBy("unit").agg(
        of("rag_utilization").alias("utilization"), of("hallucination").alias("hallucination"), of("information_gain").alias("information_gain"),
        of("expansion_grounding").alias("grounding"), F.count("*").alias("n_metrics"))
    return wide.join(score, "unit").select(
        "unit.conv_id", "unit.turn", "utilization", "hallucination", "information_gain", "grounding", "n_metrics", F.round("score", 5).alias("score"))


# --- facts -------------------------------------------------------------------

@catalog.add("q_rule_match", f"""
WITH {PAIRS_SQL},
s AS (SELECT conv_id, turn, source, unnest({sql_sentences('produced')}) AS s FROM pairs),
t AS (SELECT *, list_filter(regexp_extract_all(s, '[一-鿿]{{2,}}|[A-Za-z]+[0-9]+|[0-9]+'), lambda x: x <> '12') AS t FROM s)
SELECT conv_id, turn, count(*) AS n_facts, count(*) FILTER (len(t) > 0 AND len(list_filter(t, lambda x: contains(source, x))) / len(t) >= 0.5) AS n_supported FROM t GROUP BY ALL""")
def q_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).select("conv_id", "turn", "source", F.explode(tx.split_sentences("produced", ENDS)).alias("s"))
    return rows.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_facts"), F.count_if(tx.rule_supported(F.col("s"), F.col("source"), ["12"])).alias("n_supported")
    )


@catalog.add("q_fact_support", """
WITH f AS (SELECT user_id, event_type = 'click' AS rule, CASE event_type WHEN 'purchase' THEN 'SUPPORTED' WHEN 'error' THEN 'NOT_SUPPORTED' WHEN 'view' THEN 'UNSURE' END AS v FROM events),
t AS (SELECT user_id, count(*) AS total_facts, count(*) FILTER (rule OR v IS NULL OR v = 'SUPPORTED') AS supported_facts FROM f GROUP BY 1)
SELECT c_custkey, coalesce(total_facts, 0) AS total_facts, coalesce(supported_facts, 0) AS supported_facts, round(supported_facts / total_facts, 6) AS fact_score,
  round(greatest(0.0, least(1.0, 0.8::DOUBLE - (coalesce(total_facts, 0) - coalesce(supported_facts, 0)) * 0.4::DOUBLE * 0.2::DOUBLE + 0.08::DOUBLE)), 6) AS confidence
FROM customer LEFT JOIN t ON c_custkey = user_id""")
def q_fact_support(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.when(kind == "purchase", "SUPPORTED").when(kind == "error", "NOT_SUPPORTED").when(kind == "view", "UNSURE")
    rows = load(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), (kind == "click").alias("rule_supported"), verdict.alias("verdict"))
    units = load(spark, sf, "customer").select("c_custkey", F.lit(0.8).alias("support"))
    scored = facts.fact_support(rows, units, "c_custkey", support="support")
    return scored.withColumn("fact_score", F.round("fact_score", 6)).withColumn("confidence", F.round("confidence", 6))


@catalog.add("q_fact_pipeline", f"""
WITH {PAIRS_SQL}, u AS (SELECT conv_id * 1000 + turn AS unit_id, source, produced FROM pairs), {decomposed_sql('u', 'produced', 'unit_id, source')},
f AS (SELECT unit_id, source, unnest(list_filter(facts[1:12], lambda x: length(x) >= 6 AND regexp_matches(x, '[0-9]|tion|ung|en') AND NOT regexp_matches(x, '^[^.]*hath[^.]*$'))) AS fact FROM decomposed),
t AS (SELECT *, regexp_extract_all(fact, '[A-Za-z]+[0-9]+|[0-9]+') AS tokens FROM f),
g AS (SELECT unit_id, count(*) AS total, count(*) FILTER ((len(tokens) > 0 AND len(list_filter(tokens, lambda w: contains(source, w))) / len(tokens) >= 0.5)
             OR length(fact) <= 30 OR length(fact) % 3 <> 0) AS good FROM t GROUP BY 1)
SELECT unit_id, coalesce(total, 0) AS total_facts, coalesce(good, 0) AS supported_facts, CASE WHEN total > 0 THEN round(good / total, 6) END AS fact_score,
       round(greatest(0.0, 0.8 - (coalesce(total, 0) - coalesce(good, 0)) * 0.08)::DOUBLE, 6) AS confidence FROM u LEFT JOIN g USING (unit_id)""")
def q_fact_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of each turn, with verdicts on the longer ones, every third length refuted."""
    rows = pairs(spark, sf).withColumn("unit_id", F.col("conv_id") * 1000 + F.col("turn"))
    listed = facts.fact_rows(rows, "unit_id", "produced", "source", 12, ".!?\n", "[0-9]|tion|ung|en", "^[^.]*hath[^.]*$")
    verdict = F.when(F.length("fact") % 3 == 0, "not supported").otherwise("supported")
    verdicts = listed.where("length(fact) > 30").select("unit_id", "position", F.col("fact").alias("content"), verdict.alias("verdict"))
    out = facts.fact_support(facts.attach_verdicts(listed, verdicts, "unit_id"), rows, "unit_id")
    return out.withColumn("fact_score", F.round("fact_score", 6)).withColumn("confidence", F.round("confidence", 6))


@catalog.add("q_remove_verified", """
WITH a AS (SELECT p_type, p_name AS finding FROM part GROUP BY ALL), b AS (SELECT p_type, p_brand, split_part(min(p_name), ' ', 1) AS fact FROM part WHERE p_size > 25 GROUP BY ALL),
v AS (SELECT DISTINCT p_type, fact FROM b WHERE p_brand < 'Brand#13')
SELECT p_type, finding FROM a WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.p_type = a.p_type AND (contains(finding, fact) OR contains(fact, finding)))""")
def q_remove_verified(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.filters import remove_verified

    part = load(spark, sf, "part")
    findings = part.select("p_type", F.col("p_name").alias("finding")).distinct()
    verified = (
        part.where("p_size > 25").groupBy("p_type", "p_brand").agg(F.min("p_name").alias("n"))
        .where("p_brand < 'Brand#13'").select("p_type", F.element_at(F.split("n", " "), 1).alias("fact"))
    )
    return remove_verified(findings, verified, ["p_type"], "finding", "fact")


@catalog.add("q_fuzzy_match", """
WITH p AS (SELECT DISTINCT p_name AS a, p_brand || ' ' || p_name AS b, p_type FROM part)
SELECT a, b, p_type, contains(lower(regexp_replace(b, '[^一-龥a-zA-Z0-9]', '', 'g')), lower(regexp_replace(a, '[^一-龥a-zA-Z0-9]', '', 'g'))) AS is_match,
  left(lower(regexp_replace(a, '[^a-zA-Z0-9]', '', 'g')), 4) = left(lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g')), 4) AS type_match FROM p""")
def q_fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", "p_brand", "p_name").alias("b"), "p_type").distinct()
    return rows.select("a", "b", "p_type", tx.names_match("a", "b", {}).alias("is_match"), tx.names_match("a", "p_type", {}).alias("type_match"))


NAMES_SQL = """
l AS (SELECT DISTINCT CASE n_name WHEN 'CHINA' THEN '中国' ELSE n_name END AS a FROM nation UNION SELECT r_name FROM region UNION SELECT p_name FROM part WHERE p_size = 7),
r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS b FROM documents UNION SELECT n_name || ' market' FROM nation UNION SELECT p_type || '!' FROM part)"""


@catalog.add("q_fuzzy_join", f"""
WITH {NAMES_SQL}, x AS (SELECT a, b, lower(regexp_replace(a, '[^一-龥a-zA-Z0-9]', '', 'g')) AS fa, lower(regexp_replace(b, '[^一-龥a-zA-Z0-9]', '', 'g')) AS fb FROM l, r)
SELECT a AS left_name, b AS right_name FROM x WHERE contains(fa, fb) OR contains(fb, fa) OR (length(fa) >= 4 AND length(fb) >= 4 AND left(fa, 4) = left(fb, 4))
   OR (a = '中国' AND (fb = 'china' OR fb = 'prc'  OR fb LIKE 'chinamarket%'))""")
def q_fuzzy_join(spark: SparkSession, sf: str) -> DataFrame:
    """Names of nations, regions and parts against capitalised words, markets and part types."""
    nation, part = load(spark, sf, "nation"), load(spark, sf, "part")
    left = nation.select(F.when(F.col("n_name") == "CHINA", "中国").otherwise(F.col("n_name")).alias("name"))
    left = left.unionByName(load(spark, sf, "region").select(F.col("r_name").alias("name"))).unionByName(part.where("p_size = 7").select(F.col("p_name").alias("name")))
    right = documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("name"))
    right = right.unionByName(nation.select(F.concat("n_name", F.lit(" market")).alias("name"))).unionByName(part.select(F.concat("p_type", F.lit("!")).alias("name")))
    return fuzzy.fuzzy_pairs(left, right, spellings={"中国": ["china", "prc", "chinamarket"]})


# --- gate --------------------------------------------------------------------

CHAPTERS_SQL = "ch AS (SELECT conv_id, turn, text, 300 AS target_chars, (length(text) % 100) / 10.0::DOUBLE AS score, CASE role WHEN 'user' THEN (length(text) % 10) / 10.0::DOUBLE END AS fact_score FROM conversations)"
ISSUES_SQL = f"""
{CHAPTERS_SQL},
gs AS (SELECT *, {SENTENCES_SQL} AS l, length(text) / greatest(target_chars, 1) AS ratio, max(turn) OVER (PARTITION BY conv_id) AS z FROM ch),
issues AS (
  SELECT conv_id, turn, 'length' AS dimension, 'error' AS severity FROM gs WHERE ratio < 0.4
  UNION ALL SELECT conv_id, turn, 'length', 'warning' FROM gs WHERE ratio > 2.5
  UNION ALL SELECT conv_id, turn, 'score', 'error' FROM gs WHERE score < 5
  UNION ALL SELECT conv_id, turn, 'fact', 'error' FROM gs WHERE fact_score < 0.6
  UNION ALL SELECT conv_id, turn, 'summary', 'warning' FROM gs WHERE len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '{SUMMARY}'))) / len(l) > 0.3
  UNION ALL SELECT conv_id, turn, 'style', 'warning' FROM gs WHERE len(regexp_extract_all(text, '{BOILERPLATE}')) >= 2
  UNION ALL SELECT conv_id, turn, 'epilogue', 'warning' FROM gs WHERE turn < z AND len(list_filter(l[greatest(1, len(l) - 2):], lambda x: regexp_matches(x, '{EPILOGUE}'))) > 0)"""


def gate_chapters(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return conversations(spark, sf).select(
        "conv_id", "turn", "text", F.lit(300).alias("target_chars"), ((n % 100) / 10.0).alias("score"),
        F.when(F.col("role") == "user", (n % 10) / 10.0).alias("fact_score"),
    )


def gate_issues(spark: SparkSession, sf: str) -> DataFrame:
    return gate.chapter_issues(gate_chapters(spark, sf), "conv_id", "turn", "text", None, SUMMARY, BOILERPLATE, EPILOGUE, ENDS)


def gate_cross(spark: SparkSession, sf: str) -> DataFrame:
    return gate.cross_issues(gate_chapters(spark, sf), "conv_id", "turn", "text")


@catalog.add("q_gate_issues", f"WITH {ISSUES_SQL} SELECT conv_id, turn, dimension, severity FROM issues")
def q_gate_issues(spark: SparkSession, sf: str) -> DataFrame:
    return gate_issues(spark, sf).select("conv_id", "turn", "dimension", "severity")


@catalog.add("q_gate_cross", f"""
WITH {GRAMS_SQL}
SELECT conv_id, turn, turn + 1 AS next_turn, round(ratio, 6) AS ratio, array_to_string(list_sort(common)[1:5], '|') AS samples FROM o WHERE ratio > 0.2""")
def q_gate_cross(spark: SparkSession, sf: str) -> DataFrame:
    return gate_cross(spark, sf).select(
        "conv_id", "turn", F.col("next_idx").alias("next_turn"), F.round("ratio", 6).alias("ratio"), F.array_join("samples", "|").alias("samples")
    )


@catalog.add("q_gate", f"""
WITH {ISSUES_SQL}, {GRAMS_SQL},
e AS (SELECT conv_id, count(*) AS n FROM (SELECT conv_id FROM issues WHERE severity = 'error' UNION ALL SELECT conv_id FROM o WHERE ratio > 0.2) GROUP BY 1)
SELECT ch.conv_id, count(*) AS n_chapters, round(avg(score), 6) AS overall_score, coalesce(max(e.n), 0) AS n_errors, max(e.n) IS NULL AS passed
FROM ch LEFT JOIN e USING (conv_id) GROUP BY 1""")
def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = gate.gate(gate_chapters(spark, sf), gate_issues(spark, sf), gate_cross(spark, sf), "conv_id")
    return rows.withColumn("overall_score", F.round("overall_score", 6))


@catalog.add("q_remediation", f"""
WITH {ISSUES_SQL}, {GRAMS_SQL},
r AS (SELECT conv_id, turn, 0 AS k, dimension FROM issues WHERE severity = 'error' UNION ALL SELECT conv_id, turn + 1, 1, 'repetition' FROM o WHERE ratio > 0.2)
SELECT conv_id, turn, count(*) AS n_reasons, string_agg(dimension, '；' ORDER BY k, dimension) AS dimensions FROM r GROUP BY ALL""")
def q_remediation(spark: SparkSession, sf: str) -> DataFrame:
    rows = gate.remediation(gate_issues(spark, sf), gate_cross(spark, sf), "conv_id", "turn")
    reasons = F.transform(F.split("reasons", "；"), lambda r: F.substring_index(r, "=", 1))
    return rows.select("conv_id", "turn", F.size(reasons).cast("long").alias("n_reasons"), F.array_join(reasons, "；").alias("dimensions"))


@catalog.add("q_batch_rows", """
SELECT 0::BIGINT AS section, event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR || '|' || event_type AS tags, round(value, 3) AS value FROM events
UNION ALL SELECT 1, 'AVERAGE', '', '', round(avg(value), 3) FROM events""")
def q_batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    details = load(spark, sf, "events").select("event_id", "event_type", F.array(F.col("user_id").cast("string"), "event_type").alias("tags"), "value")
    rows = sinks.batch_rows(details, "event_type", ["value"], ["event_id"], ["tags"])
    return rows.withColumn("value", F.round("value", 3)).withColumn("section", F.col("section").cast("long"))
