"""Table functions for SQL users. They are SQL themselves: Spark inlines and compiles them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .columns import BLANKS

WINDOW_CHUNKS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION window_chunks(content STRING, size INT, overlap INT)
RETURNS TABLE (chunk_index INT, text STRING)
RETURN SELECT t.pos, btrim(substr(content, t.start + 1, greatest(size, 200)), {blanks})
FROM LATERAL posexplode(sequence(
  0,
  CAST(greatest(0, ceil((length(content) - greatest(size, 200)) / (greatest(size, 200) - greatest(0, least(overlap, greatest(size, 200) - 1))))) AS INT)
    * (greatest(size, 200) - greatest(0, least(overlap, greatest(size, 200) - 1))),
  greatest(size, 200) - greatest(0, least(overlap, greatest(size, 200) - 1)))) AS t(pos, start)"""

TOKEN_CHUNKS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION token_chunks(content STRING, size INT, overlap INT)
RETURNS TABLE (unit_index INT, text STRING)
RETURN SELECT t.pos, array_join(slice(array_remove(split(content, '\\s+'), ''), t.start + 1, size), ' ')
FROM LATERAL posexplode(sequence(
  0, CAST(greatest(0, ceil((cardinality(array_remove(split(content, '\\s+'), '')) - size) / (size - overlap))) AS INT) * (size - overlap),
  size - overlap)) AS t(pos, start)
WHERE cardinality(array_remove(split(content, '\\s+'), '')) > 0"""


def register(spark: SparkSession) -> None:
    """Make ``window_chunks(text, size, overlap)`` and ``token_chunks(text, size, overlap)`` known to SQL.

    They are used with ``LATERAL`` and give what the functions of these names give for whole tables.
    """
    blanks = "'" + "".join(f"\\u{ord(c):04x}" for c in BLANKS) + "'"
    spark.sql(WINDOW_CHUNKS.format(blanks=blanks))
    spark.sql(TOKEN_CHUNKS)
