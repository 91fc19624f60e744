"""Exact nearest neighbours, vector profiles and pluggable embedders."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .retrieval import top_k


#: Rows of vectors that one task compares with a block of queries; blocks of vectors are packed rows of binary columns.
GROUP_ROWS = 65_536
#: Queries and vectors of one matrix product, and of the runs whose maxima bound the k-th best from below.
TILE_QUERIES, RUN = 512, 64
#: Candidates that are compared in double precision at once.
CANDIDATES = 65_536


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine",
    query_id: str = "query_id", vector_id: str = "vec_id", query_vector: str = "query_vector", vector: str = "embedding",
    query_block: int = 16384, vector_block: int = 16384, skip_same_id: bool = False, digits: int | None = None,
) -> DataFrame:
    """Best k vectors per query: ``(query_id, rank, vec_id, score)``, exact.

    Both sides are cut into blocks; a block of queries meets a few blocks of vectors in one bounded group. A matrix product
    in single precision finds which vectors can be among the best, with bounds on its error; only those are compared in
    double precision, and only k rows per query leave a group. Ids may be of any type. Nothing is broadcast,
    so either side may grow. ``cosine`` ranks descending, ``l2`` (squared) ascending, ties to the smaller id; scores
    equal after ``digits`` decimals are ties. Vectors that are null or hold null or non-finite components take no part.
    """
    k = max(1, int(k))
    n_queries, n_vectors = queries.count(), vectors.count()
    parallelism = vectors.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(1, math.ceil(n_queries / query_block), min(2 * parallelism, math.ceil(n_queries / 512)))
    wanted = max(1, math.ceil(parallelism / query_blocks))
    vector_blocks = max(math.ceil(n_vectors / vector_block), min(wanted, math.ceil(n_vectors / 256)), 1)
    groups = max(math.ceil(n_vectors / GROUP_ROWS), min(wanted, vector_blocks))
    kind = lambda df, key: df.schema[key].dataType.simpleString()
    element = "float" if all(kind(df, c) == "array<float>" for df, c in ((queries, query_vector), (vectors, vector))) else "double"
    number = np.float32 if element == "float" else np.float64

    def packed(df: DataFrame, key: str, values: str, blocks: int, copies: int | None) -> DataFrame:
        """One row for each block: its ids and the bytes of its matrix. Of equal vectors only ``copies`` ids can be wanted."""

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            matrix, ids = np.ascontiguousarray(np.stack(rows["_v"].to_numpy()), dtype=number), rows["_id"].to_numpy()
            if copies is not None:
                place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                equal = np.unique(matrix.view(np.dtype((np.void, matrix.itemsize * matrix.shape[1]))).ravel(), return_inverse=True)[1].ravel()
                order = np.lexsort((place, equal))
                runs = np.r_[True, equal[order][1:] != equal[order][:-1]]
                first = np.maximum.accumulate(np.where(runs, np.arange(len(order)), 0))
                kept = order[np.arange(len(order)) - first < copies]
                matrix, ids = matrix[kept], ids[kept]
            return pd.DataFrame({"_block": rows["_block"].iloc[:1], "_ids": [list(ids)], "_matrix": [matrix.tobytes()]})

        fine = F.col("_v").isNotNull() & F.forall("_v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        rows = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.col(key).alias("_id"), F.col(values).cast(f"array<{element}>").alias("_v"))
        return rows.where(fine).groupBy("_block").applyInPandas(pack, f"_block int, _ids array<{kind(df, key)}>, _matrix binary")

    left = packed(queries, query_id, query_vector, query_blocks, None).select(
        F.col("_block").alias("_qb"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_vg"), "_ids", "_matrix")
    right = packed(vectors, vector_id, vector, vector_blocks, k + skip_same_id).select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_qb"), (F.col("_block") % groups).alias("_vg"), "_ids", "_matrix")

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"q": pd.Series(dtype=object), "v": pd.Series(dtype=object), "s": pd.Series(dtype="float64")})
        matrix = lambda row_ids, data: np.frombuffer(data, dtype=number).reshape(len(row_ids), -1).astype(np.float64)
        qid, a = np.asarray(q["_ids"].iloc[0]), matrix(q["_ids"].iloc[0], q["_matrix"].iloc[0])
        vid = np.concatenate([np.asarray(ids) for ids in v["_ids"]])
        b = np.concatenate([matrix(ids, data) for ids, data in zip(v["_ids"], v["_matrix"])])
        row, column, score = nearest_pairs(a, b, qid, vid, k, metric, skip_same_id, digits)
        return pd.DataFrame({"q": qid[row], "v": vid[column], "s": score})

    cells = left.groupBy("_qb", "_vg").cogroup(right.groupBy("_qb", "_vg"))
    scored = cells.applyInPandas(best, f"q {kind(queries, query_id)}, v {kind(vectors, vector_id)}, s double")
    direction = F.desc if metric == "cosine" else F.asc
    ranked = top_k(scored, ["q"], [direction("s" if digits is None else F.round("s", digits)), F.col("v")], k)
    return ranked.select(
        F.col("q").alias(query_id), "rank", F.col("v").alias(vector_id), F.col("s").alias("score")
    )


def nearest_pairs(
    a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int, metric: str, skip_same_id: bool = False, digits: int | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and their scores: the k best of ``b`` for each of ``a``, ties to the smaller id of ``b``."""
    place = np.unique(b_ids, return_inverse=True)[1]
    same = np.argsort(b_ids, kind="stable") if skip_same_id else None
    if metric == "cosine":
        left, right = _unit(a), _unit(b)
        shift, scale = np.zeros(len(b)), 1.0
    else:
        # Distances are those from a common middle; the square of the query is left out, as it changes no order.
        middle = b.mean(0)
        left, right = 2 * (a - middle), b - middle
        shift = (right ** 2).sum(1)
        scale = float(np.abs(left).max(initial=0)) ** 2 * a.shape[1] + float(np.abs(right).max(initial=0)) ** 2 * a.shape[1]
    narrow = np.float32 if np.isfinite(scale) and scale < 1e15 else np.float64
    left, right, shift = left.astype(narrow), right.astype(narrow).T.copy(), shift.astype(narrow)
    unit = 0.0 if digits is None else 10.0 ** -digits
    widest = float(np.sqrt((right.astype(np.float64) ** 2).sum(0).max(initial=0)))
    found = []
    for start in range(0, len(a), TILE_QUERIES):
        part = slice(start, min(start + TILE_QUERIES, len(a)))
        n = part.stop - start
        # A bound on the error of a product of narrow numbers, from the lengths of both.
        own = np.sqrt((left[part].astype(np.float64) ** 2).sum(1))
        slack = 2 * (a.shape[1] + 8) * np.finfo(narrow).eps * (own * widest + widest ** 2 * (metric != "cosine")) + 1e-30
        best_row, best_column, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(n, -np.inf)
        for at in range(0, len(b), 8192):
            rough = left[part] @ right[:, at:at + 8192]
            rough -= shift[at:at + 8192]
            if skip_same_id:
                where = np.searchsorted(b_ids, a_ids[part], sorter=same)
                hit = np.flatnonzero(where < len(b_ids))
                hit = hit[b_ids[same[where[hit]]] == a_ids[part][hit]]
                column = same[where[hit]] - at
                inside = (column >= 0) & (column < rough.shape[1])
                rough[hit[inside], column[inside]] = -np.inf
            runs = rough.shape[1] // RUN
            tops = rough[:, :runs * RUN].reshape(n, RUN, runs).max(1) if runs > k else rough
            if tops.shape[1] > k:
                floor = np.maximum(floor, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
            place_in = np.flatnonzero(~(rough < (floor - 2 * slack - unit).astype(narrow)[:, None]).ravel())
            row, column = np.divmod(place_in, rough.shape[1])
            column += at
            scores = np.concatenate([_exact(a[start + row[i:i + CANDIDATES]], b[column[i:i + CANDIDATES]], metric) for i in range(0, len(row), CANDIDATES)] or [np.zeros(0)])
            keep = np.isfinite(scores)
            if skip_same_id:
                keep &= a_ids[start + row] != b_ids[column]
            row, column, scores = (np.concatenate(pair) for pair in zip((best_row, best_column, best_score), (row[keep], column[keep], scores[keep])))
            key = scores if digits is None else np.round(scores, digits)
            order = np.lexsort((place[column], -key, row))
            row = row[order]
            first = np.searchsorted(row, row)
            taken = np.arange(len(row)) - first < k
            best_row, best_column, best_score = row[taken], column[order][taken], scores[order][taken]
            if metric == "cosine":
                full = np.flatnonzero(np.bincount(best_row, minlength=n) == k)
                last = np.searchsorted(best_row, full, side="right") - 1
                floor[full] = np.maximum(floor[full], best_score[last] - unit)
        found.append((best_row + start, best_column, best_score if metric == "cosine" else -best_score))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows, larger ones being better, summed in the order of the components: equal vectors get equal scores."""
    total = np.zeros(len(a))
    if metric == "cosine":
        squares_a, squares_b = np.zeros(len(a)), np.zeros(len(a))
        for x, y in zip(a.T, b.T):
            total += x * y
            squares_a += x * x
            squares_b += y * y
        norms = np.sqrt(squares_a) * np.sqrt(squares_b)
        return np.divide(total, norms, out=np.zeros(len(a)), where=norms != 0)
    for x, y in zip(a.T, b.T):
        total += (x - y) * (x - y)
    return -total


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def normalize_vector(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(doubles, lambda x: F.when(norm == 0, x).otherwise(x / norm))


def hits_lookup(hits: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Entity attributes of vector hits; unknown ids get defaults."""
    attributes = entities.select(key, "title", "type", "description")
    return hits.join(attributes, key, "left").select(
        *hits.columns,
        F.coalesce("title", F.lit("未知实体")).alias("title"),
        F.coalesce("type", F.lit("unknown")).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def with_similarity(hits: DataFrame) -> DataFrame:
    """Keep distance and similarity apart: ``similarity = 1 - distance``."""
    return hits.withColumn("similarity", 1 - F.col("distance"))


def vector_profile(vectors: DataFrame, vector: str = "embedding", keys: Sequence[str] = ()) -> DataFrame:
    """Row count and dimension range, optionally per key."""
    return vectors.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim")
    )


def embed_column(df: DataFrame, text: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 16,
                 out: str = "embedding") -> DataFrame:
    """Add vectors from any batch embedder; texts cross to Python once, in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list = []
            values = texts.fillna("").tolist()
            for start in range(0, len(values), batch):
                vectors.extend(embed(values[start : start + batch]))
            matrix = _unit(np.asarray(vectors, dtype=np.float64)) if vectors else np.zeros((0, 0))
            yield pd.Series([row.astype(np.float32).tolist() for row in matrix], index=texts.index)

    # The types of an iterator function are read from its hints.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text)))


def hashed_embedding(df: DataFrame, text: str = "text", dim: int = 256, n: int = 3, out: str = "embedding") -> DataFrame:
    """Default embedder without a model: hashed character n-gram counts, unit length, JVM only."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    clean = F.lower(F.regexp_replace(text, r"\s+", " "))
    prepared = df.withColumn("_grams", F.regexp_extract_all(clean, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    counted = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dim).transform(prepared)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_grams", "_tf", "_unit")
