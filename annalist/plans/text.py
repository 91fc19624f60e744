"""Queries on scalar text, date and record functions, and on the text splitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates, records, text as tx
from ..operators import filters, ranking, terms
from ..sources import events as ev, sinks
from ..sources.tables import load, spread
from .shared import CHRONICLE_SQL, ENDS, Catalog, chronicle, documents

catalog = Catalog()
TRIM = "regexp_replace({0}, '^[\\s]+|[\\s]+$', '', 'g')"


def trim_sql(x: str) -> str:
    return TRIM.format(x)


YEARS_SQL = "regexp_extract_all(text, '(?:19|20)[0-9]{2}')"


@catalog.add("q_extract_year", """
SELECT doc_id, coalesce(nullif(regexp_extract(text, '([0-9]{4})', 1), ''), '') AS year FROM documents""")
def q_extract_year(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.coalesce(dates.extract_year("text"), F.lit("")).alias("year"))


@catalog.add("q_event_dates", f"""
WITH {CHRONICLE_SQL}
SELECT event_id, regexp_extract(content, '([0-9]{{4}})\\s*年', 1) AS year,
       regexp_extract(content, '([0-9]{{1,2}})\\s*月', 1) AS month,
       substr(regexp_extract(content, '在(.*?)（', 1), 1, 6) AS place
FROM chronicle""")
def q_event_dates(spark: SparkSession, sf: str) -> DataFrame:
    return chronicle(spark, sf).select(
        "event_id", dates.extract_year("content").alias("year"), dates.extract_month("content").alias("month"),
        dates.extract_location("content").alias("place"),
    )


@catalog.add("q_extract_years", f"""
WITH y AS (SELECT doc_id, {YEARS_SQL} AS l FROM documents)
SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS years FROM y""")
def q_extract_years(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(dates.extract_years("text"), ",").alias("years"))


@catalog.add("q_years_in_range", """
WITH y AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9]{4}'), lambda x: x::INT),
                  lambda x: x BETWEEN 1000 AND 2100)) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_years, coalesce(list_sum(l), 0)::BIGINT AS year_sum FROM y""")
def q_years_in_range(spark: SparkSession, sf: str) -> DataFrame:
    years = dates.years_in_range("text")
    return documents(spark, sf).select(
        "doc_id", F.size(years).cast("long").alias("n_years"),
        F.aggregate(years, F.lit(0).cast("long"), lambda a, y: a + y).alias("year_sum"),
    )


@catalog.add("q_temporal_label", f"""
WITH y AS (SELECT doc_id, list_transform({YEARS_SQL}, lambda x: x::INT) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN '' WHEN list_min(l) = list_max(l) THEN list_min(l)::VARCHAR
       ELSE list_min(l)::VARCHAR || '-' || list_max(l)::VARCHAR END AS label FROM y""")
def q_temporal_label(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", dates.temporal_label(dates.extract_years("text")).alias("label"))


@catalog.add("q_normalize", """
WITH n AS (SELECT doc_id, upper(regexp_replace(text, '[^一-龥a-zA-Z0-9]', '', 'g')) AS t FROM documents)
SELECT doc_id, t AS flat, length(t)::BIGINT AS n_flat FROM n""")
def q_normalize(spark: SparkSession, sf: str) -> DataFrame:
    flat = tx.normalize_text("text")
    return documents(spark, sf).select("doc_id", flat.alias("flat"), F.length(flat).cast("long").alias("n_flat"))


@catalog.add("q_keyword_set", """
WITH k AS (SELECT doc_id, list_distinct(list_concat(
    regexp_extract_all(text, '[一-龥]{2,10}'),
    list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda w: upper(w)),
    list_filter(regexp_extract_all(text, '[0-9]+'), lambda y: regexp_full_match(y, '(19|20)[0-9]{2}')))) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_keywords, coalesce(list_min(l), '') AS first_keyword, coalesce(list_max(l), '') AS last_keyword FROM k""")
def q_keyword_set(spark: SparkSession, sf: str) -> DataFrame:
    words = tx.keyword_set("text")
    return documents(spark, sf).select(
        "doc_id", F.size(words).cast("long").alias("n_keywords"),
        F.coalesce(F.array_min(words), F.lit("")).alias("first_keyword"), F.coalesce(F.array_max(words), F.lit("")).alias("last_keyword"),
    )


SENTENCES_SQL = f"list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: {trim_sql('s')}), lambda s: s <> '')"


@catalog.add("q_sentences", f"""
WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS l FROM documents)
SELECT doc_id, unnest(range(len(l)))::BIGINT AS position, unnest(l) AS sentence FROM s""")
def q_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", F.posexplode(tx.split_sentences("text", ENDS)).alias("position", "sentence")
    ).withColumn("position", F.col("position").cast("long"))


@catalog.add("q_char_ngrams", """
WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '\\s+', '', 'g'), '') AS c FROM documents)
SELECT doc_id, CASE WHEN len(c) < 6 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(c) - 4),
       lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4] || c[i+5]))) END::BIGINT AS n_grams FROM c""")
def q_char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(tx.char_ngrams("text", 6)).cast("long").alias("n_grams"))


@catalog.add("q_brief", f"""
WITH s AS (SELECT doc_id, {trim_sql('text')} AS t, {SENTENCES_SQL} AS l FROM documents),
b AS (SELECT doc_id, t, l, CASE WHEN length(l[1]) < 20 AND len(l) > 1 THEN l[1] || '. ' || l[2] ELSE l[1] END AS b FROM s)
SELECT doc_id, CASE WHEN len(l) = 0 THEN left(t, 60) WHEN length(b) > 60 THEN left(b, 60) || '…' ELSE b END AS brief FROM b""")
def q_brief(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.brief("text", 60, ENDS, ". ").alias("brief"))


WORDS = ["the", "und", "que", "los", "tion", "the th", "zzz"]
WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


@catalog.add("q_lexicon_hits", f"""
SELECT doc_id, array_to_string(list_filter({WORDS_SQL}, lambda w: contains(text, w)), '|') AS hits FROM documents""")
def q_lexicon_hits(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(tx.lexicon_hits("text", WORDS), "|").alias("hits"))


@catalog.add("q_first_gazetteer_hit", f"""
SELECT doc_id, coalesce(list_filter({WORDS_SQL}, lambda w: contains(text, w) AND NOT regexp_matches(text, '从' || w || '(?:来|出发|离开)'))[1],
       '') AS hit FROM documents""")
def q_first_gazetteer_hit(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.coalesce(dates.extract_location("text", WORDS), F.lit("")).alias("hit"))


MENTION = "[A-Z][a-z]{7,}"


@catalog.add("q_regex_mentions", f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{MENTION}') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS mentions FROM m""")
def q_regex_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(tx.regex_mentions("text", MENTION), "|").alias("mentions"))


def last_end_sql(sep: str, kept: int) -> str:
    n = len(sep)
    rev = sep[::-1].replace("\n", "' || chr(10) || '")
    return (
        f"(CASE WHEN strpos(reverse(w), '{rev}') > 0 AND length(w) - strpos(reverse(w), '{rev}') - {n} + 1 >= 40 "
        f"THEN length(w) - strpos(reverse(w), '{rev}') - {n} + 1 + {kept} ELSE 0 END)"
    )


BOUNDARY_SQL = ", ".join(
    last_end_sql(s, 1 if s == ". " else len(s)) for s in ("。", "！", "？", ". ", ".\n", "\n\n", "\n")
)


@catalog.add("q_truncate_boundary", f"""
WITH w AS (SELECT doc_id, text, left(text, 200) AS w FROM documents),
e AS (SELECT doc_id, text, w, greatest({BOUNDARY_SQL}) AS best FROM w)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN best > 0 THEN regexp_replace(left(text, best::INT), '\\s+$', '')
       ELSE regexp_replace(w, '\\s+$', '') || '…' END AS cut,
       CASE WHEN length(text) <= 100 THEN text ELSE left(text, 99) || '…' END AS short FROM e""")
def q_truncate_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", tx.truncate_at_boundary("text", 200).alias("cut"), tx.truncate("text", 100).alias("short")
    )


@catalog.add("q_verdict", """
WITH a AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN ' supported ' WHEN 'error' THEN 'Not supported'
    WHEN 'signup' THEN 'NOT_SUPPORTED' WHEN 'click' THEN 'Supported.' ELSE 'maybe' END AS answer FROM events)
SELECT event_id, CASE WHEN contains(upper(trim(answer)), 'SUPPORTED') AND NOT contains(upper(answer), 'NOT') THEN 'SUPPORTED'
    WHEN contains(upper(answer), 'NOT') THEN 'NOT_SUPPORTED' ELSE 'UNSURE' END AS verdict FROM a""")
def q_verdict(spark: SparkSession, sf: str) -> DataFrame:
    answer = (
        F.when(F.col("event_type") == "purchase", " supported ").when(F.col("event_type") == "error", "Not supported")
        .when(F.col("event_type") == "signup", "NOT_SUPPORTED").when(F.col("event_type") == "click", "Supported.").otherwise("maybe")
    )
    return load(spark, sf, "events").select("event_id", records.normalize_verdict(answer).alias("verdict"))


RULES = [("homes", ["HOUSEHOLD", "FURNITURE"]), ("works", ["MACHINERY", "BUILDING"]), ("urgent", ["1-URGENT"])]


@catalog.add("q_categorize", f"""
WITH {CHRONICLE_SQL}
SELECT CASE WHEN contains(content, 'HOUSEHOLD') OR contains(content, 'FURNITURE') THEN 'homes'
            WHEN contains(content, 'MACHINERY') OR contains(content, 'BUILDING') THEN 'works'
            WHEN contains(content, '1-URGENT') THEN 'urgent' ELSE '其他' END AS category, count(*) AS n
FROM chronicle WHERE contains(date, '1996') OR contains(date, '1997') OR contains(date, '1998') GROUP BY 1""")
def q_categorize(spark: SparkSession, sf: str) -> DataFrame:
    dated = chronicle(spark, sf).where(F.col("date").rlike("1996|1997|1998"))
    return dated.groupBy(records.categorize("content", RULES).alias("category")).agg(F.count("*").alias("n"))


@catalog.add("q_parse_records", """
SELECT p_partkey AS unit_id, upper(p_name) AS title, upper(p_type) AS type, p_brand || ' of size ' || p_size::VARCHAR AS description FROM part
UNION ALL SELECT p_partkey, upper(p_brand), 'ORGANIZATION', 'maker of ' || p_name FROM part""")
def q_parse_records(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graph import parse_extraction

    return parse_extraction(extraction_answers(spark, sf), "unit_id", "answer")[0]


@catalog.add("q_parse_edges", """
SELECT p_partkey AS unit_id, upper(p_brand) AS source, upper(p_name) AS target, 'makes ' || p_type AS description,
       p_size::DOUBLE AS weight FROM part""")
def q_parse_edges(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graph import parse_extraction

    return parse_extraction(extraction_answers(spark, sf), "unit_id", "answer")[1]


def extraction_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in the extraction format, built from parts."""
    mark = "<|>"
    entity = lambda *fields: F.concat(F.lit('("entity"<|>'), F.concat_ws(mark, *fields), F.lit(")"))
    size = F.col("p_size").cast("string")
    answer = F.concat(
        entity("p_name", "p_type", F.concat("p_brand", F.lit(" of size "), size)), F.lit("\n##\n"),
        entity("p_brand", F.lit("organization"), F.concat(F.lit("maker of "), "p_name")), F.lit("\n##\n"),
        F.lit('("relationship"<|>'), F.concat_ws(mark, "p_brand", "p_name", F.concat(F.lit("makes "), "p_type"), size), F.lit(")"),
        F.lit("\n<|COMPLETE|>"),
    )
    return load(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), answer.alias("answer"))


@catalog.add("q_length_budget", """
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
c AS (SELECT c.conv_id, c.turn, n.n, length(c.text) AS len, CASE c.role WHEN 'user' THEN '200-400' WHEN 'system' THEN '1200+' ELSE 'none' END AS b
      FROM conversations c JOIN n USING (conv_id)),
m AS (SELECT *, CASE b WHEN '200-400' THEN 0.8 WHEN '1200+' THEN 2.0 ELSE 1.2 END::DOUBLE AS f,
             CASE b WHEN '200-400' THEN 300 WHEN '1200+' THEN 2000 ELSE 600 END AS total FROM c),
k AS (SELECT *, CASE WHEN n = 1 THEN greatest(80, total) ELSE greatest(150, floor(greatest(80, len) * f)) END::INT AS center FROM m),
l AS (SELECT *, greatest(CASE WHEN n = 1 THEN 50 ELSE 100 END, floor(center * 0.85::DOUBLE))::INT AS low FROM k),
h AS (SELECT *, greatest(low + CASE WHEN n = 1 THEN 10 ELSE 50 END, floor(center * 1.15::DOUBLE))::INT AS high FROM l)
SELECT conv_id, turn, low::BIGINT AS low, high::BIGINT AS high, center::BIGINT AS target,
       least(8000, greatest(CASE WHEN n = 1 THEN 256 ELSE 512 END, floor(high * 2.2::DOUBLE)))::BIGINT AS max_tokens FROM h""")
def q_length_budget(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("role") == "user", "200-400").when(F.col("role") == "system", "1200+").otherwise("none")
    budget = records.length_budget(F.length("text"), bucket, "n")
    rows = turns.join(counts, "conv_id").select("conv_id", "turn", budget.alias("b"))
    return rows.select(
        "conv_id", "turn", *[F.col(f"b.{c}").cast("long").alias(a) for c, a in
                             (("low", "low"), ("high", "high"), ("target_chars", "target"), ("max_tokens", "max_tokens"))],
    )


@catalog.add("q_length_range", """
WITH h AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR || '00 - ' || (p_size % 7)::VARCHAR || '50字'
    WHEN p_size % 3 = 1 THEN '约' || (p_size * 10)::VARCHAR || '字' ELSE '不限' END AS hint, p_size FROM part),
r AS (SELECT *, TRY_CAST(nullif(regexp_extract(hint, '([0-9]+)\\s*[-–~至]\\s*([0-9]+)', 1), '') AS INT) AS a,
             TRY_CAST(nullif(regexp_extract(hint, '([0-9]+)\\s*[-–~至]\\s*([0-9]+)', 2), '') AS INT) AS b,
             TRY_CAST(nullif(regexp_extract(hint, '([0-9]+)', 1), '') AS INT) AS x FROM h)
SELECT p_partkey, coalesce(CASE WHEN a IS NOT NULL THEN least(a, b) END, CASE WHEN x IS NOT NULL THEN greatest(50, x - 50) END, 200)::BIGINT AS lo,
       coalesce(CASE WHEN a IS NOT NULL THEN greatest(a, b) END, x + 200, 500)::BIGINT AS hi,
       greatest(80, least(p_size, 20))::BIGINT AS gen_lo,
       least(greatest(greatest(80, least(p_size, 20)) + 50, greatest(p_size, 20)), 50000)::BIGINT AS gen_hi FROM r""")
def q_length_range(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    text = lambda c: c.cast("string")
    hint = (
        F.when(size % 3 == 0, F.concat(text(size), F.lit("00 - "), text(size % 7), F.lit("50字")))
        .when(size % 3 == 1, F.concat(F.lit("约"), text(size * 10), F.lit("字"))).otherwise("不限")
    )
    rows = load(spark, sf, "part").select(
        "p_partkey", records.parse_length_range(hint).alias("r"), records.clamp_range(size, F.lit(20)).alias("g")
    )
    return rows.select(
        "p_partkey", F.col("r.lo").cast("long").alias("lo"), F.col("r.hi").cast("long").alias("hi"),
        F.col("g.lo").cast("long").alias("gen_lo"), F.col("g.hi").cast("long").alias("gen_hi"),
    )


@catalog.add("q_judge_scores", """
SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 0.0 ELSE least(3.0, greatest(0.0, (p_size - 10) / 4.0)) END::DOUBLE AS grade,
       0.0::DOUBLE AS other_grade FROM part""")
def q_judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = ((F.col("p_size") - 10) / 4.0).cast("string")
    answer = F.when(F.col("p_size") % 5 == 4, F.lit("no answer")).otherwise(
        F.concat(F.lit('Sure: {"scores": [{"entity": "'), F.col("p_name"), F.lit('", "score": '), score, F.lit(', "reason": "r"}]} done'))
    )
    judged = load(spark, sf, "part").select("p_partkey", "p_name", records.judge_scores(answer).alias("s"))
    return judged.select(
        "p_partkey", records.judged_score(F.col("s"), F.col("p_name")).alias("grade"),
        records.judged_score(F.col("s"), F.lit("unknown thing")).alias("other_grade"),
    )


@catalog.add("q_highlight", """
SELECT p_partkey, '**' || split_part(p_name, ' ', 1) || '** ' || split_part(p_name, ' ', 2) || '** by **' || p_brand || '**' AS marked FROM part""")
def q_highlight(spark: SparkSession, sf: str) -> DataFrame:
    # The first word of the name is nested in the name itself.
    names = F.array(F.col("p_brand"), F.element_at(F.split("p_name", " "), 1), F.col("p_name"), F.lit("?"))
    marked = tx.highlight_terms(F.concat_ws(" by ", "p_name", "p_brand"), names)
    return load(spark, sf, "part").select("p_partkey", marked.alias("marked"))


@catalog.add("q_strip_markers", """
SELECT p_partkey, p_name || '|' || p_type AS items FROM part""")
def q_strip_markers(spark: SparkSession, sf: str) -> DataFrame:
    listing = F.concat(F.lit("- "), "p_name", F.lit("\n2. "), "p_type", F.lit("\n* abc\n\n"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(tx.strip_list_markers(listing), "|").alias("items"))


@catalog.add("q_localize", f"""
WITH {CHRONICLE_SQL}
SELECT event_id, CASE WHEN regexp_matches(title, '[一-鿿]') THEN title END AS kept,
       CASE segment WHEN 'BUILDING' THEN '建筑' WHEN 'MACHINERY' THEN '机械' WHEN 'HOUSEHOLD' THEN '家居' ELSE c_name END AS local_name
FROM chronicle""")
def q_localize(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("segment")
    description = (
        F.when(segment == "BUILDING", "A firm (建筑) of old").when(segment == "MACHINERY", "also known as 机械 here")
        .when(segment == "HOUSEHOLD", "家居 is its name").otherwise("no local name")
    )
    return chronicle(spark, sf).select(
        "event_id", tx.localize_name("title", description).alias("kept"),
        tx.localize_name("c_name", description).alias("local_name"),
    )


@catalog.add("q_context_query", f"""
WITH {CHRONICLE_SQL}
SELECT event_id, y || '年 ' || location || ' ' || segment || ' ' || r_name AS query,
       y || chr(10) || location || chr(10) || segment || chr(10) || r_name || chr(10) || content AS vector_query FROM chronicle""")
def q_context_query(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array("segment", "r_name")
    args = (F.col("y"), F.col("location"), words, F.col("content"))
    return chronicle(spark, sf).select(
        "event_id", records.context_to_query(*args).alias("query"), records.build_vector_query(*args).alias("vector_query")
    )


@catalog.add("q_event_text", f"""
WITH {CHRONICLE_SQL}
SELECT event_id, '事件标题：' || title || chr(10) || '时间：' || date || chr(10) || '地点：' || location || chr(10) || chr(10) || content
       || chr(10) || chr(10) || '关键词：' || segment || ', ' || r_name AS text FROM chronicle""")
def q_event_text(spark: SparkSession, sf: str) -> DataFrame:
    text = sinks.event_to_text(F.col("title"), F.col("date"), F.col("location"), F.col("content"), F.array("segment", "r_name"))
    return chronicle(spark, sf).select("event_id", text.alias("text"))


@catalog.add("q_event_roundtrip", f"""
WITH {CHRONICLE_SQL}
SELECT event_id, title, date, location, content FROM chronicle""")
def q_event_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rendered = chronicle(spark, sf).select(
        "event_id", sinks.event_to_text(F.col("title"), F.col("date"), F.col("location"), F.col("content")).alias("text")
    )
    return ev.events_from_text(rendered, "text", ("event_id",)).select("event_id", "title", "date", "location", "content")


@catalog.add("q_merge_documents", f"""
WITH {CHRONICLE_SQL}
SELECT (row_number() OVER (ORDER BY event_id) - 1)::VARCHAR AS id, event_id,
       title || chr(10) || '(' || date || ')' || chr(10) || '地点：' || location || chr(10) || content AS text FROM chronicle""")
def q_merge_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ev.merge_to_documents(chronicle(spark, sf), "event_id").select("id", "event_id", "text")


@catalog.add("q_event_islands", f"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM
             (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {trim_sql('s')}), lambda s: s <> '') AS x FROM documents)),
i AS (SELECT doc_id, no, line, sum((line LIKE 'T%')::INT) OVER (PARTITION BY doc_id ORDER BY no) AS g FROM l)
SELECT doc_id, g::BIGINT - 1 AS event_no,
       string_agg(CASE WHEN line LIKE 'T%' AND no = f THEN {trim_sql('line[2:]')} ELSE line END, chr(10) ORDER BY no) AS content
FROM (SELECT *, min(no) OVER (PARTITION BY doc_id, g) AS f FROM i WHERE g > 0) GROUP BY doc_id, g""")
def q_event_islands(spark: SparkSession, sf: str) -> DataFrame:
    return ev.split_bullets(documents(spark, sf), "doc_id", "text", "T").select(
        "doc_id", F.col("event_no").cast("long").alias("event_no"), "content"
    )


@catalog.add("q_line_events", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {trim_sql('s')}), lambda s: s <> '') AS x FROM documents)
SELECT doc_id, unnest(range(len(x)))::BIGINT AS event_no, unnest(x) AS content FROM l""")
def q_line_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.split_lines(documents(spark, sf), "doc_id", "text").withColumn("event_no", F.col("event_no").cast("long"))


@catalog.add("q_fill_forward", f"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM
             (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {trim_sql('s')}), lambda s: s <> '') AS x FROM documents)),
h AS (SELECT *, CASE WHEN regexp_full_match(line, '[A-Z][^ ]{{3,}} [^ ]+\\.') THEN line END AS head FROM l),
f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no) AS year FROM h)
SELECT doc_id, year, line AS content, count(*) AS n FROM f WHERE head IS NULL AND year IS NOT NULL GROUP BY ALL""")
def q_fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.carry_forward_year(documents(spark, sf), "doc_id", "text", "[A-Z][^ \n]{3,} [^ \n]+\\.")
    return rows.groupBy("doc_id", "year", "content").agg(F.count("*").alias("n"))


@catalog.add("q_corpus_filter", """
SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src7')""")
def q_corpus_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.corpus_filter(load(spark, sf, "documents"), "license", ["text"], True).select("doc_id", "lang", "source").unionByName(
        filters.corpus_filter(load(spark, sf, "documents"), "src7", ["source"], True)
        .where(~F.lower("text").contains("license")).select("doc_id", "lang", "source")
    )


@catalog.add("q_blocklist", """
SELECT doc_id FROM documents WHERE NOT (contains(upper(text), 'THE THE') OR contains(upper(text), 'UNG DER') OR contains(upper(text), 'TOKEN'))
AND length(text) >= 50""")
def q_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.drop_blocked(documents(spark, sf), "text", ["the the", "ung der", "token"], upper=True)
    return filters.long_enough(kept, "text", 50).select("doc_id")


@catalog.add("q_verifiable_sentences", f"""
WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS s FROM documents)
SELECT doc_id, count(*) AS n FROM s WHERE length(s) >= 6 AND regexp_matches(s, '[0-9]|tion|ung') AND NOT regexp_matches(s, '^[^.]*(?:hath|leau)[^.]*$')
GROUP BY doc_id""")
def q_verifiable_sentences(spark: SparkSession, sf: str) -> DataFrame:
    sentences = documents(spark, sf).select("doc_id", F.explode(tx.split_sentences("text", ENDS)).alias("s"))
    ok = records.verifiable_sentence(F.col("s"), "[0-9]|tion|ung", "^[^.]*(?:hath|leau)[^.]*$")
    return sentences.where(ok).groupBy("doc_id").agg(F.count("*").alias("n"))


@catalog.add("q_compliance", """
SELECT doc_id, greatest(0.0, 10.0 - 5.0 * regexp_matches(text, '[0-9]{17}[0-9Xx]')::INT - 3.0 * regexp_matches(text, '1[3-9][0-9]{9}')::INT
       - 2.0 * regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')::INT)::DOUBLE AS score,
       array_to_string(list_filter([CASE WHEN regexp_matches(text, '[0-9]{17}[0-9Xx]') THEN 'id_number' END,
         CASE WHEN regexp_matches(text, '1[3-9][0-9]{9}') THEN 'phone' END,
         CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') THEN 'email' END], lambda x: x IS NOT NULL), '|') AS issues
FROM documents""")
def q_compliance(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", records.compliance_score("text").alias("score"), F.array_join(records.compliance_issues("text"), "|").alias("issues")
    )


@catalog.add("q_source_counts", "SELECT source, count(*) AS n_documents FROM documents GROUP BY source")
def q_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.source_counts(load(spark, sf, "documents"))


@catalog.add("q_index_stats", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("documents", "part", "lineitem", "conversations")))
def q_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.index_stats({t: load(spark, sf, t) for t in ("documents", "part", "lineitem", "conversations")})


def decomposed_sql(rows: str, text: str, keys: str) -> str:
    """Facts of a text: distinct sentences of five characters or more, none that holds or lies in an earlier one."""
    return f"""
sentences AS (SELECT {keys}, {trim_sql(text)} AS whole, list_filter(list_transform(string_split_regex({text}, '[.!?\n]'), lambda s: {trim_sql('s')}),
              lambda s: length(s) >= 5 AND regexp_matches(s, '[\\p{{L}}\\p{{N}}]')) AS l FROM {rows}),
once AS (SELECT {keys}, whole, list_filter(l, lambda s, i: list_position(l, s) = i) AS l FROM sentences),
folded AS (SELECT {keys}, whole, CASE WHEN len(l) = 0 THEN [] ELSE list_reduce(list_transform(l, lambda s: [s]), lambda kept, s:
           CASE WHEN len(list_filter(kept, lambda k: contains(k, s[1]) OR contains(s[1], k))) > 0 THEN kept ELSE list_concat(kept, s) END) END AS f FROM once),
decomposed AS (SELECT {keys}, CASE WHEN len(f) = 0 AND whole <> '' THEN [whole] ELSE f END AS facts FROM folded)"""


@catalog.add("q_decompose", f"""
WITH {decomposed_sql('documents', 'text', 'doc_id')}
SELECT doc_id, unnest(range(len(facts))) AS position, unnest(facts) AS fact FROM decomposed""")
def q_decompose(spark: SparkSession, sf: str) -> DataFrame:
    facts = tx.decompose_facts("text", ".!?\n")
    return documents(spark, sf).select("doc_id", F.posexplode(facts).alias("position", "fact"))


@catalog.add("q_name_variants", """
SELECT n_nationkey::BIGINT AS key, n_name AS name, lower(n_name) AS canonical, lower(n_name) AS variants FROM nation
UNION ALL SELECT r_regionkey + 1000, r_name, CASE r_name WHEN 'EUROPE' THEN 'continent' ELSE lower(r_name) END,
    CASE r_name WHEN 'EUROPE' THEN 'europe|the old world|continent' ELSE lower(r_name) END FROM region""")
def q_name_variants(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"old": ["EUROPE", "The Old World", "continent"]}
    names = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")).unionByName(
        load(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("key"), F.col("r_name").alias("name"))
    )
    return names.select(
        "key", "name", terms.canonical_name("name", groups).alias("canonical"),
        F.array_join(terms.name_variants("name", groups), "|").alias("variants"),
    )
