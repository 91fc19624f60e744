"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt into tiles of bounded size. Every (query tile, shard) pair is one matrix
product, from which each query keeps its k best rows by partial selection. The lists are merged per query in
rounds of a bounded fan-in, so no task ever holds more than a few lists of one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import finite_vector, prepare

#: Sums of products below this are exact in double precision.
EXACT = 2.0**53


def exact_topk(
    queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
    scale: float = 256.0, query_tile: int = 1024, shard_rows: int = 8192, fan_in: int = 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query by integer inner product.

    Components become ``floor(scale * x)``. Ties go to the smaller id; a query never meets rows of its own id.
    Vectors that are null or hold null, NaN or infinite components take no part; vectors of another length
    than the query's are no candidates. Repeated rows are candidates of their own. An empty side gives no rows.
    """
    def usable(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(id_col).alias(name), F.col(vector).alias("_v")).where(
            F.col(name).isNotNull() & finite_vector(F.col("_v"))
        )

    prepare(queries.sparkSession, 10_000)
    left, right = usable(queries, "query_id"), usable(candidates, "vec_id")
    tiles = max(1, -(-left.count() // query_tile))
    shards = max(1, -(-right.count() // shard_rows))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("_tile", deal("query_id", tiles)).withColumn("_shard", spread(shards))
    right = right.withColumn("_shard", deal("vec_id", shards)).withColumn("_tile", spread(tiles))

    def tile(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _best_of_tile(q, c, k, scale).assign(part=int(key[1]))

    lists = left.groupBy("_tile", "_shard").cogroup(right.groupBy("_tile", "_shard")).applyInPandas(
        tile, "query_id long, vec_id long, score long, part int"
    )
    order = [F.desc("score"), F.col("vec_id")]
    while shards > fan_in:
        lists = lists.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        best = Window.partitionBy("query_id", "part").orderBy(*order)
        lists = lists.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
        shards = -(-shards // fan_in)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _integers(vectors: pd.Series, scale: float) -> np.ndarray:
    return np.floor(scale * np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _by_length(rows: pd.DataFrame) -> dict[int, pd.DataFrame]:
    return dict(iter(rows.groupby(rows["_v"].map(len)))) if len(rows) else {}


def _best_of_tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: float) -> pd.DataFrame:
    """The k best candidates of one tile for each query of the tile."""
    found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
    shards = _by_length(candidates)
    for length, some in _by_length(queries).items():
        if length in shards:
            found += list(_products(some, shards[length].sort_values("vec_id"), k, scale))
    return pd.concat(found)


def _products(queries: pd.DataFrame, shard: pd.DataFrame, k: int, scale: float) -> Iterator[pd.DataFrame]:
    q, c = _integers(queries["_v"], scale), _integers(shard["_v"], scale)
    qid, cid = queries["query_id"].to_numpy(), shard["vec_id"].to_numpy()
    largest = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    scores = q @ c.T if largest < EXACT else (q.astype(np.int64) @ c.astype(np.int64).T)
    own, n = qid[:, None] == cid[None, :], len(cid)
    take = min(k, n)
    if largest * n < EXACT / 2:
        # Candidates are in order of their ids, so the position settles ties inside one number.
        ordered = np.where(own, -np.inf, scores * n - np.arange(n))
        top = np.argpartition(-ordered, take - 1, axis=1)[:, :take]
    else:
        top = np.argsort(np.where(own, np.iinfo(np.int64).max, -scores.astype(np.int64)), axis=1, kind="stable")[:, :take]
    rows = np.repeat(np.arange(len(qid)), take)
    columns = top.ravel()
    real = ~own[rows, columns]
    rows, columns = rows[real], columns[real]
    yield pd.DataFrame({"query_id": qid[rows], "vec_id": cid[columns], "score": scores[rows, columns].astype(np.int64)})
