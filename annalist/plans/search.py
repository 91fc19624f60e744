"""Queries on term tables, scored retrieval, fusion, packing and novelty."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import text_array
from ..operators import cells, matching, novelty, ranking, retrieval, routing, terms
from ..session import ensure_checkpoint_dir
from ..sources.tables import load, spread
from .shared import CHRONICLE_SQL, EXPANDED_SQL, NATION_QUERIES_SQL, Catalog, chronicle, documents, nation_queries, union_all

catalog = Catalog()


def _from(name: str) -> str:
    return f"({catalog.sql[name]})"

WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


# --- term weights and the flagship -------------------------------------------

def words():
    return terms.tokens("text", WORD, 4)


TFIDF_SQL = f"""
t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda w: length(w) >= 4) AS w FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term)"""


@catalog.add("q_tfidf", f"""
WITH {TFIDF_SQL},
x AS (SELECT c.doc_id, c.term, c.tf, f.df, c.tf / len(t.w) * ln(((SELECT count(*) FROM documents) + 1) / (f.df + 1)) AS weight
      FROM c JOIN f USING (term) JOIN t ON t.doc_id = c.doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank, term, tf, df, round(weight, 6) AS weight FROM x
QUALIFY rank <= 15""")
def q_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    rows = terms.tfidf(docs, "doc_id", words(), load(spark, sf, "documents").count())
    return rows.withColumn("weight", F.round("weight", 6)).withColumn("rank", F.col("rank").cast("long"))


EVENT_WORDS = ["the th", "tion", "ung"]


@catalog.add("q_keywords", f"""
WITH {TFIDF_SQL},
x AS (SELECT c.doc_id, c.term, row_number() OVER (PARTITION BY c.doc_id ORDER BY round(c.tf / len(t.w) * ln(((SELECT count(*) FROM documents) + 1) / (f.df + 1)), 9) DESC, c.term) AS rank
      FROM c JOIN f USING (term) JOIN t ON t.doc_id = c.doc_id QUALIFY rank <= 8),
r AS (SELECT doc_id, list(term ORDER BY rank) AS l FROM x WHERE term NOT IN ('that', 'with') GROUP BY doc_id),
m AS (SELECT d.doc_id, list_concat(coalesce(r.l, []), list_filter(['the th', 'tion', 'ung'], lambda e: contains(d.text, e))) AS l
      FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT doc_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:10], '|') AS keywords FROM m""")
def q_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    top = terms.tfidf(docs, "doc_id", words(), load(spark, sf, "documents").count(), 8)
    rows = terms.keywords(docs, top, "doc_id", "text", ["that", "with"], EVENT_WORDS)
    return rows.select("doc_id", F.array_join("keywords", "|").alias("keywords"))


ITEM_TERMS_SQL = f"""
{TFIDF_SQL},
b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda w: length(w) >= 4) AS w FROM benchmark),
bc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
bt AS (SELECT bc.item_id, bc.term FROM bc LEFT JOIN f USING (term) JOIN b ON b.item_id = bc.item_id
       QUALIFY row_number() OVER (PARTITION BY bc.item_id ORDER BY round(bc.tf / len(b.w) * ln(((SELECT count(*) FROM documents) + 1) / (coalesce(f.df, 0) + 1)), 9) DESC, bc.term) <= 10),
s AS (SELECT bt.item_id, d.doc_id, count(*) AS score FROM bt JOIN documents d ON contains(lower(d.text), bt.term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10),
truth AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def item_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as queries with their ten most specific terms."""
    docs, items = documents(spark, sf), load(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    frequencies = terms.document_frequencies(docs, words(), items.select(F.explode(words()).alias("term")))
    top = terms.tfidf(items, "query_id", words(), load(spark, sf, "documents").count(), 10, frequencies)
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("keywords"))
    return items.join(listed, "query_id").withColumn("location", F.lit(None).cast("string"))


def item_results(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    corpus = documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit("").alias("title"), F.lit("").alias("type"), F.col("text").alias("description")
    )
    return retrieval.keyword_only(item_queries(spark, sf), corpus, k, aliases={})


def item_truth(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "benchmark").withColumnRenamed("text", "passage")
    pairs = matching.contains_join(documents(spark, sf), items, "doc_id", "text", "passage")
    return pairs.join(items, "passage").select(F.col("item_id").alias("query_id"), "doc_id")


@catalog.add("q_flagship", f"""
WITH {ITEM_TERMS_SQL}
SELECT r.item_id, r.rank, r.doc_id, r.score, t.doc_id IS NOT NULL AS is_match FROM ranked r LEFT JOIN truth t USING (item_id, doc_id)""")
def q_flagship(spark: SparkSession, sf: str) -> DataFrame:
    truth = item_truth(spark, sf).withColumn("is_match", F.lit(True)).withColumnRenamed("doc_id", "id")
    ranked = item_results(spark, sf).join(truth, ["query_id", "id"], "left")
    return ranked.select(
        F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score",
        F.coalesce("is_match", F.lit(False)).alias("is_match"),
    )


@catalog.add("q_lexicon_join", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_lexicon_join(spark: SparkSession, sf: str) -> DataFrame:
    return item_truth(spark, sf).select(F.col("query_id").alias("item_id"), "doc_id")


@catalog.add("q_ranking_metrics", f"""
WITH {ITEM_TERMS_SQL},
g AS (SELECT item_id, count(*) AS n_truth FROM truth GROUP BY 1),
m AS (SELECT r.item_id, count(*) AS n_retrieved, count(t.doc_id) AS n_hits, min(CASE WHEN t.doc_id IS NOT NULL THEN r.rank END) AS first
      FROM ranked r LEFT JOIN truth t USING (item_id, doc_id) GROUP BY 1),
j AS (SELECT b.item_id, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_truth, 0) AS n_truth, coalesce(n_hits, 0) AS n_hits, first
      FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN g USING (item_id) LEFT JOIN m USING (item_id)),
p AS (SELECT *, CASE WHEN n_retrieved > 0 THEN n_hits / n_retrieved ELSE 0.0 END AS p, CASE WHEN n_truth > 0 THEN n_hits / n_truth ELSE 0.0 END AS r FROM j)
SELECT item_id, n_retrieved, n_truth, n_hits, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1,
       coalesce(first <= 3, false) AS hit_3, coalesce(first <= 5, false) AS hit_5, coalesce(first <= 10, false) AS hit_10,
       round(coalesce(1 / first, 0.0), 6) AS mrr FROM p""")
def q_ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    results = item_results(spark, sf).select("query_id", "rank", F.col("id").cast("string").alias("name"))
    truth = item_truth(spark, sf).select("query_id", F.col("doc_id").cast("string").alias("name"))
    rows = ranking.ranking_metrics(results, truth, variants={}, queries=load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))
    return rows.select(
        F.col("query_id").alias("item_id"), "n_retrieved", "n_truth", "n_hits",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "hit_3", "hit_5", "hit_10", F.round("mrr", 6).alias("mrr"),
    )


# --- graph-table searches ----------------------------------------------------

@catalog.add("q_expand_terms", f"""
WITH {NATION_QUERIES_SQL}, {EXPANDED_SQL.format(place=20, same_place='upper(k) = upper(location)')}
SELECT query_id, term, weight::BIGINT AS weight, kind FROM expanded""")
def q_expand_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = terms.expand_terms(nation_queries(spark, sf), 20)
    return rows.withColumn("weight", F.col("weight").cast("long"))


SCORED_SQL = """
hits AS (SELECT e.query_id, r.id, sum(e.weight) AS s, bool_or(kind = 'year') AS y, bool_or(kind = 'place') AS p, bool_or(kind = 'topic') AS t
         FROM expanded e JOIN rows r ON contains(upper(r.txt), upper(e.term)) GROUP BY ALL),
scored AS (SELECT query_id, id, s + 15 + CASE WHEN p AND t THEN 25 WHEN p THEN 15 WHEN t THEN 10 ELSE 0 END AS score FROM hits WHERE y)"""


@catalog.add("q_search_entities", f"""
WITH {NATION_QUERIES_SQL}, {CHRONICLE_SQL}, {EXPANDED_SQL.format(place=20, same_place='upper(k) = upper(location)')},
rows AS (SELECT event_id AS id, title, title || ' ' || content AS txt FROM chronicle), {SCORED_SQL},
d AS (SELECT query_id, id, title, score FROM scored JOIN rows USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, title ORDER BY score DESC, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, title, score::BIGINT AS score FROM d QUALIFY rank <= 10""")
def q_search_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.search_entities(nation_queries(spark, sf), chronicle_entities(spark, sf))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "title", F.col("score").cast("long").alias("score"))


def chronicle_entities(spark: SparkSession, sf: str) -> DataFrame:
    return chronicle(spark, sf).select(
        F.col("event_id").alias("id"), "title", F.col("segment").alias("type"), F.col("content").alias("description")
    )


def chronicle_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return chronicle(spark, sf).select(
        F.col("event_id").alias("id"), F.col("c_name").alias("source"), F.col("n_name").alias("target"),
        F.concat_ws(" ", "date", "segment", "r_name").alias("description"), F.lit(1.0).alias("weight"),
    )


@catalog.add("q_search_relationships", f"""
WITH {NATION_QUERIES_SQL}, {CHRONICLE_SQL}, {EXPANDED_SQL.format(place=20, same_place='k = location')},
rows AS (SELECT event_id AS id, c_name AS source, n_name AS target, c_name || ' ' || n_name || ' ' || date || ' ' || segment || ' ' || r_name AS txt
         FROM chronicle WHERE NOT contains(upper(date || segment), 'FURNITURE')), {SCORED_SQL},
d AS (SELECT query_id, id, source, target, score FROM scored JOIN rows USING (id)
      QUALIFY row_number() OVER (PARTITION BY query_id, source, target ORDER BY score DESC, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, source, target, score::BIGINT AS score FROM d QUALIFY rank <= 8""")
def q_search_relationships(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.search_relationships(nation_queries(spark, sf), chronicle_relationships(spark, sf), blocklist=["furniture"])
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "source", "target", F.col("score").cast("long").alias("score"))


#: A keyword is a topic in text search, even if it names the place or the year.
TOPICS_SQL = EXPANDED_SQL.format(place=35, same_place="k = location").replace(
    "CASE WHEN k = year THEN 'year' WHEN k = location THEN 'place' ELSE 'topic' END", "'topic'")
SEARCH_UNITS_SQL = """
rows AS (SELECT event_id AS id, content AS txt FROM chronicle WHERE length(content) >= 50 AND NOT contains(content, '1-URGENT')),
hits AS (SELECT e.query_id, r.id, sum(e.weight) AS s, bool_or(kind = 'topic') AS t FROM expanded e JOIN rows r ON contains(r.txt, e.term) GROUP BY ALL),
c AS (SELECT h.query_id, h.id, h.t, regexp_matches(left(r.txt, 300), q.year || '[\\s年]') AS exact, contains(r.txt, q.location) AS here, h.s
      FROM hits h JOIN rows r USING (id) JOIN queries q USING (query_id)
      WHERE (regexp_matches(left(r.txt, 300), q.year || '[\\s年]') OR regexp_matches(left(r.txt, 300), (q.year::INT - 1)::VARCHAR || '[\\s年]')
             OR regexp_matches(left(r.txt, 300), (q.year::INT + 1)::VARCHAR || '[\\s年]'))
        AND (contains(r.txt, q.location) OR contains(r.txt, 'NATION_3') OR contains(r.txt, 'ASIA'))),
k AS (SELECT query_id, id, exact, t, s + CASE WHEN exact THEN 30 ELSE 0 END + CASE WHEN here THEN 20 ELSE 0 END + CASE WHEN t THEN 30 ELSE 15 END AS score FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, exact ORDER BY score DESC, t DESC, id) AS i FROM k)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, i) AS rank, id, exact, score::BIGINT AS score
FROM n WHERE i <= CASE WHEN exact THEN {exact} ELSE {near} END"""


@catalog.add("q_search_text_units", f"WITH {NATION_QUERIES_SQL}, {CHRONICLE_SQL}, {TOPICS_SQL}, {SEARCH_UNITS_SQL.format(exact=5, near=3)}")
def q_search_text_units(spark: SparkSession, sf: str) -> DataFrame:
    return found_units(spark, sf, nation_queries(spark, sf))


@catalog.add("q_search_many_text_units", f"""WITH {NATION_QUERIES_SQL.replace('queries AS', 'plain AS')},
queries AS (SELECT query_id, year, location, [location, year, keywords[2]] AS keywords, text FROM plain),
{CHRONICLE_SQL}, {TOPICS_SQL}, {SEARCH_UNITS_SQL.format(exact=15, near=10)}""")
def q_search_many_text_units(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords that repeat the place and the year, and more rows than by default."""
    keywords = F.array("location", "year", F.get("keywords", F.lit(1)))
    return found_units(spark, sf, nation_queries(spark, sf).withColumn("keywords", keywords), k=25, n_exact=15, n_near=10)


def found_units(spark: SparkSession, sf: str, queries: DataFrame, **limits: int) -> DataFrame:
    units = chronicle(spark, sf).select(F.col("event_id").alias("id"), F.col("content").alias("text"))
    rows = retrieval.search_text_units(queries, units, blocklist=["1-URGENT"], nearby=["NATION_3"], regions=["ASIA"], **limits)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.col("score").cast("long"))


COMMUNITIES_SQL = """
communities AS (SELECT c_custkey AS community, c_name AS title, n_name || ' ' || r_name || ' ' || c_mktsegment AS summary,
       c_name || ' of ' || n_name || ' in ' || r_name || ' buys for ' || c_mktsegment AS full_content
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def communities(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation, region = spread(load(spark, sf, "customer")), load(spark, sf, "nation"), load(spark, sf, "region")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.col("c_custkey").alias("community"), F.col("c_name").alias("title"),
        F.concat_ws(" ", "n_name", "r_name", "c_mktsegment").alias("summary"),
        F.concat("c_name", F.lit(" of "), "n_name", F.lit(" in "), "r_name", F.lit(" buys for "), "c_mktsegment").alias("full_content"),
    )


@catalog.add("q_search_communities", f"""
WITH {NATION_QUERIES_SQL}, {COMMUNITIES_SQL},
terms AS (SELECT query_id, unnest(list_concat([year, location], keywords)) AS term FROM queries),
s AS (SELECT query_id, community, count(*) AS score FROM terms JOIN communities ON contains(title, term) OR contains(summary, term) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank, community, score FROM s QUALIFY rank <= 3""")
def q_search_communities(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.search_communities(nation_queries(spark, sf), communities(spark, sf))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "community", F.col("score").cast("long").alias("score"))


PEOPLE_SQL = """
entities AS (
  SELECT n_nationkey::BIGINT AS id, n_name AS title, 'GEO' AS type, 'country in ' || r_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 1000 + c_custkey, c_name, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'PERSON' WHEN 'MACHINERY' THEN 'ORGANIZATION' ELSE 'OTHER' END,
         c_mktsegment || ' buyer of ' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
KEYWORD_SQL = """
kt AS (SELECT query_id, lower(unnest(keywords)) AS term FROM queries),
ks AS (SELECT query_id, id, count(*) AS score FROM kt JOIN entities ON contains(lower(title), term) OR contains(lower(description), term) GROUP BY ALL
       UNION ALL SELECT query_id, id, 2 FROM queries JOIN entities ON contains(lower(title), lower(location))),
kw AS (SELECT query_id, id, sum(score)::BIGINT AS score FROM ks GROUP BY ALL),
base AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kw)"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation, region = spread(load(spark, sf, "customer")), load(spark, sf, "nation"), load(spark, sf, "region")
    kind = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "PERSON").when(F.col("c_mktsegment") == "MACHINERY", "ORGANIZATION").otherwise("OTHER")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.lit("GEO").alias("type"),
        F.concat(F.lit("country in "), "r_name").alias("description"),
    )
    buyers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        (F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("title"), kind.alias("type"),
        F.concat("c_mktsegment", F.lit(" buyer of "), "n_name").alias("description"),
    )
    return places.unionByName(buyers)


def ranked_ids(df: DataFrame, score: str = "long") -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("score").cast(score).alias("score"))


@catalog.add("q_keyword_only", f"WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL} SELECT query_id, rank, id, score FROM base WHERE rank <= 10")
def q_keyword_only(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_ids(retrieval.keyword_only(nation_queries(spark, sf), people(spark, sf)))


@catalog.add("q_entity_first", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE type WHEN 'PERSON' THEN 0 WHEN 'ORGANIZATION' THEN 1 ELSE 2 END, base.rank) AS rank, id, score
FROM base JOIN entities USING (id) WHERE base.rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE type WHEN 'PERSON' THEN 0 WHEN 'ORGANIZATION' THEN 1 ELSE 2 END, base.rank) <= 10""")
def q_entity_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_ids(retrieval.entity_first(nation_queries(spark, sf), people(spark, sf)))


IN_COMMUNITY_SQL = """
cq AS (SELECT query_id, community, full_content, count(*) AS h FROM kt JOIN communities ON contains(lower(full_content), term) GROUP BY ALL),
ce AS (SELECT community, id, title FROM communities JOIN entities ON contains(full_content, entities.title))"""


@catalog.add("q_community_first", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {COMMUNITIES_SQL.replace('c_name AS title', 'c_name AS ctitle')}, {KEYWORD_SQL}, {IN_COMMUNITY_SQL},
l AS (SELECT query_id, title, 0 AS st, community::BIGINT AS a, id::BIGINT AS b, 1.0::DOUBLE AS score, 'community' AS origin FROM cq JOIN ce USING (community)
      QUALIFY row_number() OVER (PARTITION BY query_id, title ORDER BY community, id) = 1),
u AS (SELECT * FROM l UNION ALL
      SELECT query_id, title, 1, base.rank, 0, base.score::DOUBLE, 'keyword' FROM base JOIN entities USING (id)
      WHERE base.rank <= 10 AND NOT EXISTS (SELECT 1 FROM l WHERE l.query_id = base.query_id AND l.title = entities.title))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY st, a, b) AS rank, title, score, origin FROM u QUALIFY rank <= 10""")
def q_community_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.community_first(nation_queries(spark, sf), people(spark, sf), communities(spark, sf))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "title", "score", "origin")


@catalog.add("q_hybrid_keyword", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL},
{COMMUNITIES_SQL.replace('c_name AS title', 'c_name AS ctitle').replace('r_regionkey)', 'r_regionkey QUALIFY row_number() OVER (ORDER BY c_custkey) <= 3)')},
{KEYWORD_SQL}, {IN_COMMUNITY_SQL},
p AS (SELECT query_id, title, base.score + (10 - base.rank + 1) * 0.1::DOUBLE AS points, base.rank AS b, id FROM base JOIN entities USING (id) WHERE base.rank <= 10
      UNION ALL SELECT query_id, title, sum(h * 0.5::DOUBLE), NULL, min(id) FROM cq JOIN ce USING (community) GROUP BY query_id, title),
f AS (SELECT query_id, title, sum(points) AS score, min(b) AS b, min(id) AS id FROM p GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, b NULLS LAST, id, title) AS rank, title, round(score, 6) AS score
FROM f QUALIFY rank <= 10""")
def q_hybrid_keyword(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.hybrid_keyword(nation_queries(spark, sf), people(spark, sf), communities(spark, sf))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "title", F.round("score", 6).alias("score"))


DISTANCE_SQL = "SELECT n_nationkey::BIGINT AS query_id, c_name AS title, c_acctbal / 16384 AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey"


def near_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in vector hits: each nation's customers with a distance."""
    customer, nation = load(spark, sf, "customer"), load(spark, sf, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("n_nationkey").cast("long").alias("query_id"), F.col("c_name").alias("title"), (F.col("c_acctbal") / 16384).alias("distance")
    )


@catalog.add("q_hybrid_merge", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL}, v AS ({DISTANCE_SQL}),
k AS (SELECT query_id, title, base.score::DOUBLE AS kw FROM base JOIN entities USING (id) WHERE base.rank <= 10),
m AS (SELECT query_id, title, coalesce(kw * 0.5::DOUBLE, 0) + coalesce((1 - distance) * 0.5::DOUBLE, 0) AS score,
             CASE WHEN distance IS NULL THEN 'keyword' WHEN kw IS NULL THEN 'vector' ELSE 'hybrid' END AS origin FROM k FULL JOIN v USING (query_id, title))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS rank, title, round(score, 6) AS score, origin FROM m QUALIFY rank <= 10""")
def q_hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    keyword = retrieval.keyword_only(nation_queries(spark, sf), people(spark, sf))
    rows = retrieval.hybrid_merge(keyword, near_customers(spark, sf))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "title", F.round("score", 6).alias("score"), "origin")


@catalog.add("q_rerank", """
WITH r AS (SELECT user_id AS query_id, event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 50 END AS score, value / 10 - 3 AS m FROM events),
b AS (SELECT query_id, id, 1 / (1 + exp(-m)) AS rr, 0.6::DOUBLE * least(coalesce(score, 0.5), 1.0) + 0.4::DOUBLE * (1 / (1 + exp(-m))) AS h FROM r)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(h, 9) DESC, id) AS rank, id, round(rr, 6) AS rerank_score, round(h, 6) AS hybrid_score
FROM b QUALIFY rank <= 10""")
def q_rerank(spark: SparkSession, sf: str) -> DataFrame:
    results = load(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.col("value") / 50).alias("score"), (F.col("value") / 10 - 3).alias("model_score"),
    )
    rows = retrieval.rerank(results, 10)
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id",
        F.round("rerank_score", 6).alias("rerank_score"), F.round("hybrid_score", 6).alias("hybrid_score"),
    )


@catalog.add("q_strategies", f"""
WITH {PEOPLE_SQL}, near AS ({DISTANCE_SQL}),
v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, title) AS rank, title, 1 - distance AS score FROM near QUALIFY rank <= 10)
SELECT 'keyword_only' AS strategy, query_id, rank, title, round(score::DOUBLE, 6) AS score FROM {_from('q_keyword_only')} JOIN entities USING (id)
UNION ALL SELECT 'entity_first', query_id, rank, title, round(score::DOUBLE, 6) FROM {_from('q_entity_first')} JOIN entities USING (id)
UNION ALL SELECT 'community_first', query_id, rank, title, round(score, 6) FROM {_from('q_community_first')}
UNION ALL SELECT 'hybrid_keyword', query_id, rank, title, score FROM {_from('q_hybrid_keyword')}
UNION ALL SELECT 'vector_only', query_id, rank, title, round(score, 6) FROM v
UNION ALL SELECT 'hybrid_vector', query_id, rank, title, score FROM {_from('q_hybrid_merge')}""")
def q_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """All six strategies over one table of candidates."""
    rows = routing.run_strategies(nation_queries(spark, sf), people(spark, sf), None, 10, communities(spark, sf), near_customers(spark, sf))
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 6))


@catalog.add("q_retrieve_modes", f"""
WITH kw AS (
  SELECT query_id, 'entity' AS kind, rank, id::VARCHAR AS id, score::DOUBLE AS score FROM {_from('q_search_entities')}
  UNION ALL SELECT query_id, 'relationship', rank, id::VARCHAR, score::DOUBLE FROM {_from('q_search_relationships')}
  UNION ALL SELECT query_id, 'text_unit', rank, id::VARCHAR, score::DOUBLE FROM {_from('q_search_text_units')}
  UNION ALL SELECT query_id, 'community', rank, community::VARCHAR, score::DOUBLE FROM {_from('q_search_communities')}),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS n, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d FROM e a JOIN e b ON a.vec_id < 25),
ve AS (SELECT query_id, 'entity' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY d, n) AS rank, (n + 1)::VARCHAR AS id, 1 - d AS score FROM d QUALIFY rank <= 10
       UNION ALL SELECT query_id, 'community', row_number() OVER (PARTITION BY query_id ORDER BY d, n) AS r, n::VARCHAR, 1 - d FROM d WHERE n % 2 = 0 QUALIFY r <= 3),
m AS (SELECT query_id, kind, id, coalesce(kw.score * 0.5::DOUBLE, 0) + coalesce(ve.score * 0.5::DOUBLE, 0) AS score
      FROM kw FULL JOIN ve USING (query_id, kind, id)),
h AS (SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM m)
SELECT query_id, 'keyword' AS mode, kind, rank, id, round(score, 5) AS score FROM kw WHERE query_id % 3 = 0
UNION ALL SELECT query_id, 'vector', kind, rank, id, round(score, 5) FROM ve WHERE query_id % 3 = 1
UNION ALL SELECT query_id, 'hybrid', kind, rank, id, round(score, 5) FROM h
          WHERE query_id % 3 = 2 AND rank <= CASE kind WHEN 'entity' THEN 10 WHEN 'community' THEN 3 ELSE 8 END""")
def q_retrieve_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Nations ask by keyword, by vector or, where they name no mode, by both."""
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    key = F.col("query_id") % 3
    queries = nation_queries(spark, sf).join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    queries = queries.withColumn("mode", F.when(key == 0, "keyword").when(key == 1, "vector"))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/modes-{uuid.uuid4().hex}"
    stores = {
        "entity": cells.store_cells(vectors.withColumn("id", F.col("vec_id") + 1), f"{folder}/entity", "id", "embedding"),
        "community": cells.store_cells(vectors.where("vec_id % 2 = 0"), f"{folder}/community", "vec_id", "embedding"),
    }
    units = chronicle(spark, sf).select(F.col("event_id").alias("id"), F.col("content").alias("text"))
    tables = {"entity": chronicle_entities(spark, sf), "relationship": chronicle_relationships(spark, sf), "text_unit": units, "community": communities(spark, sf)}
    options = {"relationship": {"blocklist": ["furniture"]}, "text_unit": {"blocklist": ["1-URGENT"], "nearby": ["NATION_3"], "regions": ["ASIA"]}}
    rows = routing.retrieve_by_mode(queries, tables, stores, options=options)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 5))


# --- packing and novelty -----------------------------------------------------

@catalog.add("q_context_pack", f"""
WITH {CHRONICLE_SQL}, {PEOPLE_SQL}, {COMMUNITIES_SQL},
b AS (SELECT query_id, 0 AS o, 'UNITS' || chr(10) || string_agg(u.rank::VARCHAR || '. ' || content, chr(10) ORDER BY u.rank) AS t
      FROM {_from('q_search_text_units')} u JOIN chronicle ON event_id = id WHERE u.rank <= 8 GROUP BY 1
      UNION ALL SELECT query_id, 1, 'ENTITIES' || chr(10) || string_agg(k.rank::VARCHAR || '. ' || title || ': ' || left(description, 100), chr(10) ORDER BY k.rank)
      FROM {_from('q_keyword_only')} k JOIN entities USING (id) GROUP BY 1
      UNION ALL SELECT query_id, 2, 'RELATIONS' || chr(10) || string_agg(r.rank::VARCHAR || '. ' || source || ' -> ' || target || ': ' || date || ' ' || segment || ' ' || r_name, chr(10) ORDER BY r.rank)
      FROM {_from('q_search_relationships')} r JOIN chronicle ON event_id = id GROUP BY 1
      UNION ALL SELECT query_id, 3, 'COMMUNITIES' || chr(10) || string_agg(c.rank::VARCHAR || '. ' || title || ': ' || summary, chr(10) ORDER BY c.rank)
      FROM {_from('q_search_communities')} c JOIN communities USING (community) GROUP BY 1)
SELECT query_id, left(string_agg(t, chr(10) ORDER BY o), 3000) AS context FROM b GROUP BY 1""")
def q_context_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Units, entities, relationships and communities found for each nation, as one numbered text."""
    queries = nation_queries(spark, sf)
    texts = chronicle(spark, sf).select(F.col("event_id").alias("id"), F.col("content").alias("text"))
    units = found_units(spark, sf, queries).join(texts, "id")
    entities = retrieval.keyword_only(queries, people(spark, sf))
    relationships = retrieval.search_relationships(queries, chronicle_relationships(spark, sf), blocklist=["furniture"])
    found = retrieval.search_communities(queries, communities(spark, sf))
    return retrieval.context_pack(units, entities, relationships, found, 3000, headers=("UNITS", "ENTITIES", "RELATIONS", "COMMUNITIES"))


@catalog.add("q_retrieval_meta", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL}
SELECT query_id, string_agg(base.rank::VARCHAR || ':' || id::VARCHAR || ':' || score::VARCHAR, '|' ORDER BY base.rank) AS hits, count(*) AS n_hits
FROM base WHERE base.rank <= 10 GROUP BY query_id""")
def q_retrieval_meta(spark: SparkSession, sf: str) -> DataFrame:
    meta = retrieval.retrieval_meta(retrieval.keyword_only(nation_queries(spark, sf), people(spark, sf)), ["id", "score"])
    line = lambda h: F.concat_ws(":", h["rank"].cast("string"), h["id"].cast("string"), h["score"].cast("string"))
    return meta.select("query_id", F.array_join(F.transform("hits", line), "|").alias("hits"), "n_hits")


@catalog.add("q_has_results", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL}, v AS ({DISTANCE_SQL}),
a AS (SELECT query_id, count(*) AS n FROM base WHERE base.rank <= 10 GROUP BY 1), c AS (SELECT query_id, count(*) AS n FROM v WHERE distance < 0.05 GROUP BY 1)
SELECT query_id, coalesce(a.n, 0) AS n_entities, coalesce(c.n, 0) AS n_vectors, coalesce(a.n, 0) + coalesce(c.n, 0) > 0 AS has_results
FROM queries LEFT JOIN a USING (query_id) LEFT JOIN c USING (query_id)""")
def q_has_results(spark: SparkSession, sf: str) -> DataFrame:
    queries = nation_queries(spark, sf)
    results = {"entities": retrieval.keyword_only(queries, people(spark, sf)), "vectors": near_customers(spark, sf).where("distance < 0.05")}
    return retrieval.has_results(queries, results)


NOVEL_SQL = f"""
qn AS (SELECT query_id, upper(regexp_replace(text, '[^一-龥a-zA-Z0-9]', '', 'g')) AS flat,
              list_concat(list_transform(regexp_extract_all(text, '[A-Za-z]{{3,}}'), lambda w: upper(w)),
                          list_filter(regexp_extract_all(text, '[0-9]+'), lambda y: regexp_full_match(y, '(19|20)[0-9]{{2}}'))) AS words FROM queries),
e AS (SELECT base.query_id, base.rank, base.id, title, description, upper(regexp_replace(title, '[^一-龥a-zA-Z0-9]', '', 'g')) AS ft,
             list_transform(regexp_extract_all(title, '[A-Za-z]{{3,}}'), lambda w: upper(w)) AS tw
      FROM base JOIN entities USING (id) WHERE base.rank <= 10),
n AS (SELECT e.query_id, e.rank, e.id, title, description, NOT (contains(flat, ft) OR list_has_any(tw, words) OR (length(ft) >= 4 AND contains(flat, left(ft, 4)))) AS is_novel
      FROM e JOIN qn USING (query_id))"""


@catalog.add("q_novel_split", f"WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL}, {NOVEL_SQL} SELECT query_id, rank, id, is_novel FROM n")
def q_novel_split(spark: SparkSession, sf: str) -> DataFrame:
    queries = nation_queries(spark, sf)
    rows = novelty.split_entities(queries, retrieval.keyword_only(queries, people(spark, sf)))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "is_novel")


@catalog.add("q_novel_counts", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {KEYWORD_SQL}, {NOVEL_SQL}
SELECT query_id, count(*) FILTER (is_novel) AS n_novel, count(*) FILTER (NOT is_novel) AS n_aligned FROM n GROUP BY 1""")
def q_novel_counts(spark: SparkSession, sf: str) -> DataFrame:
    queries = nation_queries(spark, sf)
    rows = novelty.split_entities(queries, retrieval.keyword_only(queries, people(spark, sf)))
    return novelty.novel_counts(rows.withColumn("kind", F.when(F.col("is_novel"), "novel").otherwise("aligned")), ["novel", "aligned"])


def mentioned_sql(name: str) -> str:
    """The mention test of the novelty split on a row with ``flat`` and ``words`` of its query."""
    flat = f"upper(regexp_replace({name}, '[^一-龥a-zA-Z0-9]', '', 'g'))"
    words = f"list_transform(regexp_extract_all({name}, '[A-Za-z]{{3,}}'), lambda w: upper(w))"
    return f"({name} <> '' AND (contains(flat, {flat}) OR list_has_any({words}, words) OR (length({flat}) >= 4 AND contains(flat, left({flat}, 4)))))"


@catalog.add("q_evidence_text", f"""
WITH {NATION_QUERIES_SQL}, {PEOPLE_SQL}, {COMMUNITIES_SQL.replace('c_name AS title', 'c_name AS ctitle')}, {KEYWORD_SQL}, {NOVEL_SQL},
b AS (SELECT c_nationkey::BIGINT AS query_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank, c_name AS source,
             CASE WHEN c_custkey % 3 = 0 THEN r_name ELSE c_mktsegment END AS target, 'balance ' || c_acctbal::VARCHAR AS description
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey QUALIFY rank <= 8),
r AS (SELECT b.* FROM b JOIN qn USING (query_id) WHERE NOT ({mentioned_sql('source')} OR {mentioned_sql('target')} OR len(list_filter(words, lambda w: contains(description, w))) > 0)),
s AS (SELECT c.query_id, c.rank, left(full_content, 400) AS t FROM {_from('q_search_communities')} c JOIN communities USING (community) JOIN qn USING (query_id)
      WHERE length(full_content) > 50 AND NOT len(list_filter(list_distinct(list_transform(regexp_extract_all(full_content, '[A-Za-z]{{3,}}'), lambda w: upper(w))), lambda w: contains(flat, w)))
            / len(list_distinct(list_transform(regexp_extract_all(full_content, '[A-Za-z]{{3,}}'), lambda w: upper(w)))) > 0.8),
u AS (SELECT query_id, 0 AS o, rank, title || ' ' || left(description, 100) AS t FROM n WHERE is_novel
      UNION ALL SELECT query_id, 1, rank, source || ' ' || target || ' ' || description FROM r UNION ALL SELECT query_id, 2, rank, t FROM s)
SELECT query_id, string_agg(t, ' ' ORDER BY o, rank) AS evidence FROM u GROUP BY 1""")
def q_evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    """What entities, customers' relationships and communities add to each nation's query."""
    queries = nation_queries(spark, sf)
    entities = novelty.split_entities(queries, retrieval.keyword_only(queries, people(spark, sf)))
    customer, nation, region = load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region")
    buyers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("query_id"), "c_custkey", F.col("c_name").alias("source"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).otherwise(F.col("c_mktsegment")).alias("target"),
        F.concat(F.lit("balance "), F.col("c_acctbal").cast("string")).alias("description"))
    relationships = novelty.split_relationships(queries, retrieval.top_k(buyers, ["query_id"], [F.col("c_custkey")], 8))
    told = communities(spark, sf).select("community", F.col("full_content").alias("content"))
    found = retrieval.search_communities(queries, communities(spark, sf)).join(told, "community").select("query_id", "rank", F.col("content").alias("summary"))
    return novelty.evidence_text(entities, relationships, novelty.novel_snippets(queries, found))


@catalog.add("q_grounded", """
WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS fact, p_brand || ' sells the ' || split_part(p_name, ' ', 2) || ' in ' || p_type AS source FROM part),
f AS (SELECT *, upper(regexp_replace(fact, '[^一-龥a-zA-Z0-9]', '', 'g')) AS ff, upper(regexp_replace(source, '[^一-龥a-zA-Z0-9]', '', 'g')) AS fs FROM p),
g AS (SELECT *, list_distinct(list_transform(range(1, length(ff) - 1), lambda i: substr(ff, i::INT, 3))) AS a,
             list_distinct(list_transform(range(1, length(fs) - 1), lambda i: substr(fs, i::INT, 3))) AS b FROM f)
SELECT p_partkey, contains(fs, ff) OR len(list_intersect(a, b)) / len(a) >= 0.6 AS is_grounded FROM g""")
def q_grounded(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import grounded

    fact = F.concat_ws(" ", "p_name", "p_type")
    source = F.concat("p_brand", F.lit(" sells the "), F.element_at(F.split("p_name", " "), 2), F.lit(" in "), "p_type")
    return load(spark, sf, "part").select("p_partkey", grounded(fact, source).alias("is_grounded"))


@catalog.add("q_mentions", """
WITH p AS (SELECT p_partkey, p_name AS name, p_brand || ' ' || p_type || ' ' || split_part(p_name, ' ', 2) AS txt FROM part),
f AS (SELECT *, upper(regexp_replace(name, '[^一-龥a-zA-Z0-9]', '', 'g')) AS fn, upper(regexp_replace(txt, '[^一-龥a-zA-Z0-9]', '', 'g')) AS ft FROM p)
SELECT p_partkey, contains(ft, fn) OR (length(fn) >= 4 AND contains(ft, left(fn, 4))) AS strict_mention,
       contains(ft, fn) OR (length(fn) >= 4 AND contains(ft, left(fn, 4))) OR
       len(list_filter(list_transform(range(1, length(fn) - 1), lambda i: substr(fn, i::INT, 3)), lambda g: contains(ft, g))) > 0 AS loose_mention FROM f""")
def q_mentions(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import mention_match

    text = F.concat_ws(" ", "p_brand", "p_type", F.element_at(F.split("p_name", " "), 2))
    return load(spark, sf, "part").select(
        "p_partkey", mention_match("p_name", text, {}).alias("strict_mention"), mention_match("p_name", text, {}, True).alias("loose_mention")
    )


@catalog.add("q_unused_terms", """
WITH u AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS l FROM conversations),
a AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS l FROM conversations),
f AS (SELECT conv_id, turn, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: NOT contains(x, 'tion')) AS rest,
      list_filter(l, lambda x, i: true)[1:8] AS lead FROM a)
SELECT conv_id, turn, array_to_string(CASE WHEN len(rest) > 0 THEN rest[1:8] ELSE lead END, '|') AS picks FROM f""")
def q_unused_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)).alias("available"))
    used = F.filter("available", lambda a: a.contains("tion"))
    return rows.select("conv_id", "turn", F.array_join(retrieval.unused_terms(F.col("available"), used), "|").alias("picks"))
