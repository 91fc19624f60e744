"""Inputs that several queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load, spread

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by key, each with its SQL counterpart where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "conversations"))


#: Ends of sentences in the local texts.
ENDS = ".!?"

# Dated records in Chinese made of orders, customers and nations.
CHRONICLE_SQL = """
chronicle AS (
  SELECT o_orderkey AS event_id,
         c_name || '的订单' AS title,
         year(o_orderdate)::VARCHAR || '年' || month(o_orderdate)::VARCHAR || '月' AS date,
         n_name AS location,
         year(o_orderdate)::VARCHAR || '年' || month(o_orderdate)::VARCHAR || '月' || day(o_orderdate)::VARCHAR
           || '日，' || c_name || '在' || n_name || '（' || r_name || '）下单。部门：' || c_mktsegment || '，优先级：'
           || o_orderpriority || '。' AS content,
         year(o_orderdate)::VARCHAR AS y, c_mktsegment AS segment, c_name, n_name, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def chronicle(spark: SparkSession, sf: str) -> DataFrame:
    orders = spread(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
    customer = load(spark, sf, "customer")
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    when = F.col("o_orderdate")
    text = lambda c: c.cast("string")
    month = F.concat(text(F.year(when)), F.lit("年"), text(F.month(when)), F.lit("月"))
    return joined.select(
        F.col("o_orderkey").alias("event_id"),
        F.concat("c_name", F.lit("的订单")).alias("title"),
        month.alias("date"),
        F.col("n_name").alias("location"),
        F.concat(
            month, text(F.dayofmonth(when)), F.lit("日，"), F.col("c_name"), F.lit("在"), F.col("n_name"), F.lit("（"),
            F.col("r_name"), F.lit("）下单。部门："), F.col("c_mktsegment"), F.lit("，优先级："), F.col("o_orderpriority"), F.lit("。"),
        ).alias("content"),
        text(F.year(when)).alias("y"), F.col("c_mktsegment").alias("segment"), "c_name", "n_name", "r_name",
    )


# One parsed query per nation: a year, a place, two topics.
NATION_QUERIES_SQL = """
queries AS (
  SELECT n_nationkey::BIGINT AS query_id, (1995 + n_nationkey % 7)::VARCHAR AS year, n_name AS location,
         [CASE n_nationkey % 3 WHEN 0 THEN 'household' WHEN 1 THEN 'MACHINERY' ELSE 'Building' END, r_name, 'x'] AS keywords,
         n_name || ' ' || r_name || ' ' || (1995 + n_nationkey % 7)::VARCHAR AS text
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def nation_queries(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    key = F.col("n_nationkey")
    year = (1995 + key % 7).cast("string")
    topic = F.when(key % 3 == 0, "household").when(key % 3 == 1, "MACHINERY").otherwise("Building")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.cast("long").alias("query_id"), year.alias("year"), F.col("n_name").alias("location"),
        F.array(topic, F.col("r_name"), F.lit("x")).alias("keywords"),
        F.concat_ws(" ", "n_name", "r_name", year).alias("text"),
    )


# Score of query terms on upper-cased row texts, shared by the scored searches.
EXPANDED_SQL = """
expanded AS (
  SELECT query_id, year AS term, 30 AS weight, 'year' AS kind FROM queries
  UNION ALL SELECT query_id, (year::INT - 1)::VARCHAR, 10, 'near_year' FROM queries
  UNION ALL SELECT query_id, (year::INT + 1)::VARCHAR, 10, 'near_year' FROM queries
  UNION ALL SELECT query_id, location, {place}, 'place' FROM queries
  UNION ALL SELECT query_id, k, 15, CASE WHEN k = year THEN 'year' WHEN {same_place} THEN 'place' ELSE 'topic' END
  FROM (SELECT query_id, year, location, unnest(keywords[1:5]) AS k FROM queries) WHERE length(k) >= 2
)"""


def union_all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
