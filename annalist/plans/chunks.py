"""Queries on chunking, segmentation, chapter context, running values and the index manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sql, text as tx
from ..operators import benchmark, chapters, chunking, dedup, quality, running, segmentation, terms
from ..sources.tables import load
from ..streaming import incremental
from .shared import ENDS, Catalog, conversations, documents
from .text import SENTENCES_SQL, trim_sql

catalog = Catalog()

WINDOWS_SQL = f"""
SELECT doc_id, i::BIGINT AS chunk_index, {trim_sql('substr(text, (i * 750 + 1)::INT, 900)')} AS text
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 900 THEN 1 ELSE 1 + ceil((length(text) - 900) / 750.0)::BIGINT END)) AS i FROM documents)"""


@catalog.add("q_window_chunks", WINDOWS_SQL)
def q_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.window_chunks(documents(spark, sf)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


# Greedy packing of lines, restated as recursion over the lines of a document. Lines over
# the limit stand alone and are windowed afterwards.
PACKED_SQL = f"""
l AS (SELECT doc_id, list_filter(list_transform(string_split_regex({trim_sql('text')}, '\\n'), lambda s: {trim_sql('s')}), lambda s: s <> '') AS x FROM documents),
p AS (SELECT doc_id, x, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS grp FROM l
  UNION ALL
  SELECT doc_id, x, i + 1,
         CASE WHEN used > 0 AND length(x[i+1]) <= 900 AND used + 1 + length(x[i+1]) <= 900 THEN used + 1 + length(x[i+1])
              WHEN length(x[i+1]) > 900 THEN 0 ELSE length(x[i+1]) END,
         CASE WHEN used > 0 AND length(x[i+1]) <= 900 AND used + 1 + length(x[i+1]) <= 900 THEN grp ELSE grp + 1 END
  FROM p WHERE i < len(x)),
g AS (SELECT doc_id, grp, string_agg(x[i], chr(10) ORDER BY i) AS t FROM p WHERE i > 0 GROUP BY doc_id, grp),
w AS (SELECT doc_id, grp, i, {trim_sql('substr(t, (i * 750 + 1)::INT, 900)')} AS text FROM
  (SELECT doc_id, grp, t, unnest(range(CASE WHEN length(t) <= 900 THEN 1 ELSE 1 + ceil((length(t) - 900) / 750.0)::BIGINT END)) AS i FROM g)),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, i) - 1 AS chunk_index, text FROM w WHERE length(text) >= 20)"""


@catalog.add("q_paragraph_chunks", f"WITH RECURSIVE {PACKED_SQL} SELECT doc_id, chunk_index, text FROM k")
def q_paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.paragraph_chunks(documents(spark, sf), paragraph_pattern="\n", joiner="\n")
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@catalog.add("q_chunk_index", f"""WITH RECURSIVE {PACKED_SQL}
SELECT doc_id, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS chunk_index, length(text)::BIGINT AS n FROM k""")
def q_chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.chunk_corpus(documents(spark, sf), paragraph_pattern="\n", joiner="\n")
    return rows.select("doc_id", "chunk_index", F.length("text").cast("long").alias("n"))


@catalog.add("q_chunk_index_of_names", f"""WITH RECURSIVE {PACKED_SQL}
SELECT 'doc ' || doc_id::VARCHAR AS doc_id, row_number() OVER (ORDER BY 'doc ' || doc_id::VARCHAR, chunk_index) - 1 AS chunk_index, length(text)::BIGINT AS n FROM k""")
def q_chunk_index_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Documents named by strings, as files are."""
    named = documents(spark, sf).withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    rows = chunking.chunk_corpus(named, paragraph_pattern="\n", joiner="\n")
    return rows.select("doc_id", "chunk_index", F.length("text").cast("long").alias("n"))


TOKENS_SQL = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"
UNITS_SQL = f"""
SELECT doc_id, i AS unit_index, array_to_string(t[(i * {{step}} + 1):(i * {{step}} + {{size}})], ' ') AS text FROM
  (SELECT doc_id, t, unnest(range(CASE WHEN len(t) <= {{size}} THEN 1 ELSE 1 + ceil((len(t) - {{size}}) / {{step}}::DOUBLE)::BIGINT END)) AS i
   FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents) WHERE len(t) > 0)"""


@catalog.add("q_token_chunks", UNITS_SQL.format(size=120, step=100))
def q_token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.token_chunks(documents(spark, sf), size=120, overlap=20).withColumn("unit_index", F.col("unit_index").cast("long"))


@catalog.add("q_chunk_functions", f"""
SELECT 'window' AS kind, doc_id, chunk_index, text FROM ({WINDOWS_SQL})
UNION ALL SELECT 'token', doc_id, unit_index, text FROM ({UNITS_SQL.format(size=120, step=100)})""")
def q_chunk_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Both chunkers as table functions of SQL."""
    sql.register(spark)
    documents(spark, sf).createOrReplaceTempView("_chunked_documents")
    return spark.sql("""
        SELECT 'window' AS kind, d.doc_id, CAST(c.chunk_index AS LONG) AS chunk_index, c.text FROM _chunked_documents d, LATERAL window_chunks(d.text, 900, 150) c
        UNION ALL SELECT 'token', d.doc_id, CAST(c.unit_index AS LONG), c.text FROM _chunked_documents d, LATERAL token_chunks(d.text, 120, 20) c""")


@catalog.add("q_segments")
def q_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = segmentation.segment_documents(documents(spark, sf), block_pattern="\n")
    return rows.select(
        "doc_id", "segment_index", "text", F.array_join("years", ",").alias("years"), "temporal_label", "split_reason"
    )


@catalog.add("q_segment_validation", """
WITH t AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '(?:19|20)[0-9]{2}'), lambda y: y::INT) AS ys FROM conversations)
SELECT conv_id, turn AS segment_index, 'warning' AS severity, 'too_short' AS issue FROM t WHERE length(text) < 150
UNION ALL SELECT conv_id, turn, 'error', 'too_long' FROM t WHERE length(text) > 1200
UNION ALL SELECT conv_id, turn, 'warning', 'wide_year_span' FROM t WHERE list_max(ys) - list_min(ys) > 15
UNION ALL SELECT conv_id, e, 'error', 'index_gap' FROM
  (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM t) WHERE turn <> e""")
def q_segment_validation(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.dates import extract_years

    turns = conversations(spark, sf).select("conv_id", F.col("turn").alias("segment_index"), "text", extract_years("text").alias("years"))
    return segmentation.validate_segments(turns, "conv_id", 300, 400)


@catalog.add("q_context_window", f"""
WITH s AS (SELECT conv_id, turn, {trim_sql('text')} AS t, {SENTENCES_SQL} AS l FROM conversations),
j AS (SELECT *, CASE WHEN length(l[1]) < 20 AND len(l) > 1 THEN l[1] || '. ' || l[2] ELSE l[1] END AS j FROM s),
b AS (SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN left(t, 60) WHEN length(j) > 60 THEN left(j, 60) || '…' ELSE j END AS b FROM j)
SELECT conv_id, turn, coalesce(array_to_string(list(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS previous
FROM b""")
def q_context_window(spark: SparkSession, sf: str) -> DataFrame:
    """Briefs of the whole texts of up to three turns before each turn."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn", tx.brief("text", 60, ENDS, ". ").alias("brief"))
    rows = chapters.previous_values(turns, "conv_id", "turn", "brief", 3)
    return rows.select("conv_id", "turn", F.array_join("previous", "|").alias("previous"))


WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
# Phrases: words of two letters or more without stop words, and adjacent pairs, at least twice.
STOPS = ["the", "und", "die", "der", "que", "los", "les", "and", "that", "for"]
STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"
PHRASES_SQL = f"""
w AS (SELECT {{key}}, list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda x: length(x) >= 2 AND NOT list_contains({STOPS_SQL}, x)) AS w FROM {{table}}),
c AS (SELECT {{key}}, CASE WHEN len(w) >= 2 THEN list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) ELSE [] END AS c FROM w),
e AS (SELECT {{key}}, unnest(c) AS phrase, unnest(range(len(c))) AS pos FROM c),
n AS (SELECT {{key}}, phrase, count(*) AS n, min(pos) AS f FROM e GROUP BY ALL),
phrases AS (SELECT {{key}}, phrase, n AS count, row_number() OVER (PARTITION BY {{key}} ORDER BY n DESC, f) AS rank FROM n WHERE n >= 2
            QUALIFY rank <= 8)"""


def turn_phrases(spark: SparkSession, sf: str) -> DataFrame:
    words = terms.tokens("text", WORD, 2, STOPS)
    return terms.key_phrases(conversations(spark, sf), ["conv_id", "turn"], terms.phrase_candidates(words, " "))


@catalog.add("q_key_phrases", f"""
WITH {PHRASES_SQL.format(key='doc_id', table='documents')}
SELECT doc_id, rank, phrase, count FROM phrases""")
def q_key_phrases(spark: SparkSession, sf: str) -> DataFrame:
    words = terms.tokens("text", WORD, 2, STOPS)
    rows = terms.key_phrases(documents(spark, sf), ["doc_id"], terms.phrase_candidates(words, " "))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@catalog.add("q_previous_phrases", f"""
WITH {PHRASES_SQL.format(key='conv_id, turn', table='conversations')},
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, rank) AS at FROM phrases),
b AS (SELECT c.conv_id, c.turn, count(s.phrase) AS before FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn < c.turn GROUP BY ALL),
l AS (SELECT b.conv_id, b.turn, list(s.phrase ORDER BY s.at) FILTER (s.phrase IS NOT NULL) AS l
      FROM b LEFT JOIN s ON s.conv_id = b.conv_id AND s.at <= b.before AND s.at > b.before - 12 GROUP BY ALL)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') AS previous FROM l""")
def q_previous_phrases(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations").select("conv_id", "turn")
    rows = chapters.previous_phrases(turns, turn_phrases(spark, sf), "conv_id", "turn", 12)
    return rows.select("conv_id", "turn", F.array_join("previous_phrases", "|").alias("previous"))


@catalog.add("q_repeat_previous", f"""
WITH {PHRASES_SQL.format(key='conv_id, turn', table='conversations')},
r AS (SELECT p.conv_id, p.turn, count(*) AS n_phrases,
             count(*) FILTER (EXISTS (SELECT 1 FROM phrases q WHERE q.conv_id = p.conv_id AND q.turn < p.turn AND q.phrase = p.phrase)) AS n_repeated
      FROM phrases p GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(n_phrases, 0) AS n_phrases, coalesce(n_repeated, 0) AS n_repeated,
       coalesce(round(n_repeated / n_phrases, 6), 0.0) AS repeat_ratio, coalesce(n_repeated / n_phrases >= 0.15, false) AS warn
FROM conversations c LEFT JOIN r USING (conv_id, turn)""")
def q_repeat_previous(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations").select("conv_id", "turn")
    rows = chapters.repeat_previous(turns, turn_phrases(spark, sf), "conv_id", "turn")
    return rows.withColumn("repeat_ratio", F.round("repeat_ratio", 6))


@catalog.add("q_chapter_roles", """
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_chapters,
       CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'opening' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'closing'
       ELSE 'body' END AS role FROM conversations""")
def q_chapter_roles(spark: SparkSession, sf: str) -> DataFrame:
    return chapters.chapter_roles(load(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@catalog.add("q_running_avg", """
SELECT event_id, event_type, round((sum(value::DECIMAL(18, 2)) OVER w)::DOUBLE / count(value) OVER w / 7, 6) AS scaled_avg FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q_running_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Running averages, scaled so that none lies on a rounding tie."""
    rows = running.running_averages(load(spark, sf, "events").select("event_id", "event_type", "ts", F.col("value").cast("decimal(18,2)").alias("value")), ["event_type"], ["ts", "event_id"], "value")
    return rows.select("event_id", "event_type", F.round(F.col("running_avg") / 7, 6).alias("scaled_avg"))


@catalog.add("q_running_avg_null_labels", """
WITH e AS (SELECT event_id, nullif(event_type, (SELECT min(event_type) FROM events)) AS label, value, event_id::VARCHAR AS name FROM events)
SELECT event_id, coalesce(label, 'none') AS label, round((sum(value::DECIMAL(18, 2)) OVER w)::DOUBLE / count(value) OVER w / 7, 6) AS scaled_avg FROM e
WINDOW w AS (PARTITION BY label ORDER BY name ROWS UNBOUNDED PRECEDING)""")
def q_running_avg_null_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a label have averages of their own; the order is that of a string."""
    events = load(spark, sf, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("name"), F.col("value").cast("decimal(18,2)").alias("value"))
    least = events.agg(F.min("event_type").alias("least"))
    labelled = events.join(F.broadcast(least)).select("event_id", F.expr("nullif(event_type, least)").alias("label"), "name", "value")
    rows = running.running_averages(labelled, ["label"], ["name"], "value")
    return rows.select("event_id", F.coalesce("label", F.lit("none")).alias("label"), F.round(F.col("running_avg") / 7, 6).alias("scaled_avg"))


@catalog.add("q_progress", """
WITH p AS (SELECT o_orderkey, count(*) OVER w AS completed, (sum(o_totalprice::DECIMAL(18, 2)) OVER w)::DOUBLE AS elapsed, count(*) OVER () AS total
           FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, completed, round(elapsed, 2) AS elapsed_total, round(elapsed / completed * (total - completed) / 1000000, 4) AS eta FROM p""")
def q_progress(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", F.lit(1).cast("long").alias("one"), F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    total = orders.count()
    rows = running.progress(orders, ["o_orderkey"], "one", "t", F.lit(total))
    return rows.select(
        "o_orderkey", "completed", F.round(F.col("elapsed_total").cast("double"), 2).alias("elapsed_total"),
        F.round(F.col("elapsed_total").cast("double") / F.col("completed") * (total - F.col("completed")) / 1000000, 4).alias("eta"),
    )


@catalog.add("q_dedup_key", """
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity, l_shipdate) = 1""")
def q_dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    kept = dedup.dedup_key(rows, ["l_suppkey", "l_partkey"], [-F.col("l_extendedprice"), "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
    return kept.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@catalog.add("q_greedy_dedup", """
WITH RECURSIVE b AS (SELECT p_type, lower(p_brand) AS name, max(p_retailprice) AS price FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY price DESC, name) AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM b),
f AS (SELECT p_type, 0::BIGINT AS rn, []::VARCHAR[] AS kept FROM r GROUP BY p_type
      UNION ALL
      SELECT f.p_type, f.rn + 1, CASE WHEN len(list_filter(f.kept, lambda x: contains(x, r.name) OR contains(r.name, x))) > 0 OR len(f.kept) >= 10
             THEN f.kept ELSE list_append(f.kept, r.name) END
      FROM f JOIN r ON r.p_type = f.p_type AND r.rn = f.rn + 1)
SELECT p_type, unnest(range(1, len(kept) + 1))::BIGINT AS rank, unnest(kept) AS name FROM (SELECT p_type, arg_max(kept, rn) AS kept FROM f GROUP BY p_type)""")
def q_greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    brands = load(spark, sf, "part").groupBy("p_type", F.lower("p_brand").alias("name")).agg(F.max("p_retailprice").alias("price"))
    best = dedup.greedy_dedup(brands.withColumn("tie", F.col("name")), "p_type", "name", "price", "tie", 10, batch=8)
    return best.select("p_type", F.col("rank").cast("long").alias("rank"), "name")


@catalog.add("q_manifest_diff", """
WITH old AS (SELECT p_partkey AS doc_id, p_name AS t FROM part WHERE p_size <> 7),
new AS (SELECT p_partkey AS doc_id, CASE WHEN p_type = 'PROMO' THEN p_name || '!' ELSE p_name END AS t FROM part WHERE p_size <> 9)
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'deleted'
       WHEN old.t <> new.t THEN 'changed' ELSE 'unchanged' END AS status FROM old FULL JOIN new ON old.doc_id = new.doc_id""")
def q_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    old = part.where("p_size <> 7").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    changed = F.when(F.col("p_type") == "PROMO", F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    new = part.where("p_size <> 9").select(F.col("p_partkey").alias("doc_id"), changed.alias("text"))
    return incremental.manifest_diff(incremental.manifest(old), incremental.manifest(new))


@catalog.add("q_incremental_chunks", WINDOWS_SQL.replace("FROM documents)", "FROM documents WHERE lang <> 'es')").replace(
    "length(text)", "length(text)"))
def q_incremental_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """An old index (no French, Spanish in it) brought to the new corpus (no Spanish)."""
    docs = documents_with_language(spark, sf)
    old, new = docs.where("lang <> 'fr'"), docs.where("lang <> 'es'")
    window = chunking.window_chunks
    diff = incremental.manifest_diff(incremental.manifest(old), incremental.manifest(new))
    stale = diff.where(F.col("status") != "unchanged").select("doc_id")
    fresh = diff.where(F.col("status").isin("added", "changed")).select("doc_id")
    kept = window(old).join(stale, "doc_id", "left_anti")
    rows = kept.unionByName(window(new.join(fresh, "doc_id", "left_semi")))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def documents_with_language(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "text", "lang")


@catalog.add("q_jobs", """
SELECT doc_id, m.mode, m.label FROM documents, (VALUES ('hybrid', 'graph:hybrid'), ('plain_vector_rag', 'plain_vector')) m(mode, label)""")
def q_jobs(spark: SparkSession, sf: str) -> DataFrame:
    modes = benchmark.retrieval_modes("plain_vector_rag", True)
    return benchmark.jobs(load(spark, sf, "documents").select("doc_id"), modes)


@catalog.add("q_resume_jobs", """
SELECT d.doc_id, m.mode FROM documents d, (VALUES ('hybrid'), ('plain_vector_rag')) m(mode)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND m.mode = CASE WHEN l.quality = 1 THEN 'hybrid' ELSE 'plain_vector_rag' END)""")
def q_resume_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = benchmark.jobs(load(spark, sf, "documents").select("doc_id"), benchmark.retrieval_modes("hybrid", True)).select("doc_id", "mode")
    done = load(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "hybrid").otherwise("plain_vector_rag").alias("mode"))
    return benchmark.resume_jobs(jobs, done, ["doc_id", "mode"])
