"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import Catalog
from ..sources.tables import load
from . import cover_tree, decontamination, html_tree, lm, merkle, minhash, packing, phrases, secret_scan, sentencepiece_codec, topk, toxicity, warc
from ..session import cut_lineage
from .common import shared_folder

catalog = Catalog()


@catalog.add("op8_warc", """
WITH named AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, hex, max(page_id) OVER (PARTITION BY payload) AS first FROM named
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM grouped
""")
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back."""
    records = warc.plan_records(load(spark, sf, "pages"))
    manifest = warc.write_archives(records, shared_folder(spark, "warc"))
    chunks = warc.read_archives(manifest, with_data=False)
    return warc.payloads(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@catalog.add("op9_topk", """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM ints q, ints c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""")
def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50, against all rows."""
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(rows.where(F.col("vec_id") % 50 == 0), rows, k=5)


#: Rows of labelled documents that a classifier is fitted on, at most.
LABELLED = 8000


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades of the two label columns: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    toxic = F.col("toxic").cast("int")
    return labels.select("doc_id", (toxic + F.when((toxic == 1) & (F.col("quality") == 0), 1).otherwise(0)).alias("grade"))


@catalog.add("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected severity of every document; grades learnt from the labelled ones."""
    documents = load(spark, sf, "documents")
    model = toxicity.fit(documents, severity_grades(load(spark, sf, "labels")), LABELLED)
    return toxicity.score(documents.select("doc_id", "text"), model).select("doc_id", "expected_severity", "grade", "toxic")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@catalog.add("op7_packing")
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.pack(load(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)


#: Labelled findings that the forest is fitted on, at most.
FINDINGS = 6000


@catalog.add("op5_secrets")
def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict."""
    findings = cut_lineage(secret_scan.scan(load(spark, sf, "documents")))
    model = secret_scan.fit(secret_scan.audited(findings), FINDINGS)
    return secret_scan.classify(findings, model).select("doc_id", "start", "end", "kind", "score", "is_secret")


@catalog.add("op6_html")
def op6_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of all pages."""
    return html_tree.extract(load(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@catalog.add("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents, compared with the sentencepiece library and decoded again."""
    coded = sentencepiece_codec.encode(load(spark, sf, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", "n_ids", "parity", "round_trip")


@catalog.add("op3_minhash", """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sets AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), components AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM shingled JOIN components ON node = doc_id
""")
def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents at a Jaccard similarity of 0.85."""
    return minhash.near_duplicates(load(spark, sf, "documents"), percent=85)


@catalog.add("op2_cover_tree", """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b
  WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), components AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN components ON node = vec_id
""")
def op2_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate vectors at a cosine of 0.9."""
    return cover_tree.near_vectors(load(spark, sf, "embeddings"), cosine=0.9)


@catalog.add("op10_lm")
def op10_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Base and attention-model scores of all documents."""
    return lm.score(load(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@catalog.add("op12_decontamination", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), cuts AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win FROM cuts
), spots AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT r, s, p.n, item_id FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM spots) p JOIN windows USING (win)
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
""")
def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that lie inside benchmark windows of ten words."""
    rows = decontamination.contamination(load(spark, sf, "documents"), load(spark, sf, "benchmark"), size=10)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@catalog.add("op11_merkle", """
WITH RECURSIVE fields AS (
  SELECT *, coalesce(lang, '') AS g, lang IS NULL AS missing,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), hashed AS (
  SELECT doc_id, g, missing, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN low IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS changed FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY missing, g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY missing, g) AS n FROM hashed
), nodes AS (
  SELECT missing, g, 0 AS lvl, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT missing, g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY missing, g, lvl, i // 8
), tops AS (
  SELECT missing, g, lvl AS height, h AS subroot, row_number() OVER (ORDER BY NOT missing, encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, i, subroot AS h, n FROM tops
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM crown WHERE n > 1 GROUP BY lvl, i // 8
), sides AS (
  SELECT missing, g, lvl, i, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW b AS (PARTITION BY missing, g, lvl, i // 8 ORDER BY i)
), crown_sides AS (
  SELECT lvl, i, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM crown WHERE n > 1 WINDOW b AS (PARTITION BY lvl, i // 8 ORDER BY i)
), docs AS (
  SELECT row_number() OVER () AS d, doc_id, missing, g, leaves.i, leaf, subroot, tops.i AS top, height,
         CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS start
  FROM (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
          lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc FROM leaves) leaves
       JOIN tops USING (missing, g)
), steps AS (
  SELECT d, lvl AS k, l, r FROM docs JOIN sides s ON s.missing = docs.missing AND s.g = docs.g AND s.i = docs.i // (8 ** lvl)::BIGINT
  UNION ALL
  SELECT d, height + lvl, l, r FROM docs JOIN crown_sides s ON s.i = docs.top // (8 ** lvl)::BIGINT
), fold AS (
  SELECT d, 0 AS k, start AS h FROM docs
  UNION ALL
  SELECT fold.d, fold.k + 1, sha256(l || h || r) FROM fold JOIN steps ON steps.d = fold.d AND steps.k = fold.k
), proofs AS (SELECT d, string_agg(l || r, '' ORDER BY k) AS p FROM steps GROUP BY d)
SELECT doc_id, leaf, subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256,
       h AS folded_root, h = (SELECT h FROM crown WHERE n = 1) AS verified
FROM docs JOIN (SELECT d, arg_max(h, k) AS h FROM fold GROUP BY d) USING (d) LEFT JOIN proofs USING (d)
""")
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and whether its possibly tampered row still gives the root."""
    return merkle.verify(merkle.tampered_leaves(load(spark, sf, "documents")))


@catalog.add("op13_phrases", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT lang, phrase, a, size, w, unnest(range(1, size)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (
    SELECT lang, a, w, size, m, unnest(range(1, size - m + 2)) AS s FROM candidates, (VALUES (2), (3)) t(m) WHERE m < size)
), held AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN held USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The collocations of each language, phrases of up to four words that occur 30 times or more."""
    return phrases.collocations(load(spark, sf, "documents"), least=30, longest=4, limit=2000)
