"""Vector tables stored by cells, searched exactly with triangle bounds.

A table is cut into cells around centroids taken from its own rows; every row is stored with its distance to the
centroid of its cell, every cell with the largest of them. A query's distance to a centroid then bounds its distance to all
rows of the cell from below, and to each row more closely. The nearest cells that hold k rows together give a first k-th
distance; only cells whose bound does not exceed it are read after that. The result is that of a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table_cutter
from .retrieval import top_k

#: Bytes of centroids that go to every task.
CENTROID_BYTES = 64 << 20
#: Rows of a cell that are compared in one task.
PART_ROWS = 16_384
#: Rows of a frame of cells to read, about, and queries that are compared with a part of a cell at once, about.
FRAME_ROWS, SLICE_QUERIES = 20_000, 4_096
#: Share by which bounds are loosened, for rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class CellStore:
    """Place of a stored vector table: ``rows(id, vector, to_centroid, part)`` by ``cell``, and ``cells``."""

    folder: str
    id_type: str

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = f"id {self.id_type}, vector array<double>, to_centroid double, part int, cell long"
        return spark.read.schema(schema).parquet(f"{self.folder}/rows")

    def cells(self, spark: SparkSession) -> DataFrame:
        """``(cell, centroid, radius, n, parts)``."""
        return spark.read.parquet(f"{self.folder}/cells")


def store_cells(vectors: DataFrame, folder: str, vector_id: str = "id", vector: str = "vector", n_cells: int | None = None) -> CellStore:
    """Write a vector table in cells below ``folder``.

    By default there are as many cells as the square root of the rows. Centroids are the rows with the smallest hashes of
    their ids. Rows without a vector, or with components that are null or not finite, are left out; all others
    must have one dimension.
    """
    spark = vectors.sparkSession
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vector_id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(fine)
    if n_cells is None:
        n_cells = max(1, int(rows.count() ** 0.5))
    chosen = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(n_cells).select("vector").collect()]
    centroids = np.unique(np.array(chosen, dtype=np.float64), axis=0) if chosen else np.zeros((0, 0))
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError(f"{n_cells} centroids take {centroids.nbytes} bytes; ask for fewer cells")
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            points, near = np.stack(batch["vector"].to_numpy()) if len(batch) else np.zeros((0, 0)), np.zeros(len(batch), np.int64)
            away = np.zeros(len(batch))
            for start in range(0, len(batch), 256):
                gaps = np.sqrt(np.maximum(_squares(points[start:start + 256], shared.value), 0))
                near[start:start + 256] = gaps.argmin(1)
                away[start:start + 256] = gaps.min(1)
            yield batch.assign(to_centroid=away, cell=near)

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, to_centroid double, cell long"
    dealt = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("_n") / PART_ROWS), F.lit(1))).cast("int")
    assigned = rows.mapInPandas(assign, kinds)
    assigned.write.parquet(f"{folder}/assigned")
    assigned = spark.read.parquet(f"{folder}/assigned")
    summary = assigned.groupBy("cell").agg(F.max("to_centroid").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell long, centroid array<double>")
    parts = F.greatest(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).cast("int")
    known.join(summary, "cell").withColumn("parts", parts).write.parquet(f"{folder}/cells")
    sizes = spark.read.parquet(f"{folder}/cells").select("cell", F.col("n").alias("_n"))
    placed = assigned.join(sizes, "cell").withColumn("part", dealt).drop("_n")
    # All parts of a cell lie in its folder, written by as many tasks as it has parts.
    placed.repartition("cell", "part").write.partitionBy("cell").parquet(f"{folder}/rows")
    return CellStore(folder, rows.schema["id"].dataType.simpleString())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by differences: no digits are lost to cancellation."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = ((b - a[i]) ** 2).sum(1)
    return out


def cells_to_read(queries: DataFrame, store: CellStore, k: int, later: bool) -> DataFrame:
    """``(query_id, query_vector, to_cell, limit, cell, part)``: the parts of cells that queries have to read.

    First those nearest by their bounds that hold ``k`` rows together. ``later``: of the others those whose bound does not
    exceed the query's ``limit``. The table of cells is in every task; only cells to be read leave it.
    """
    spark = queries.sparkSession
    known = store.cells(spark).orderBy("cell").toPandas()
    shared = spark.sparkContext.broadcast((
        np.stack(known["centroid"].to_numpy()) if len(known) else np.zeros((0, 0)), *(known[c].to_numpy() for c in ("cell", "radius", "n", "parts"))))

    columns = ["query_id", "query_vector", "to_cell", "limit", "cell", "part"]

    def choose(batches):
        centroids, cell, radius, n, parts = shared.value
        for batch in batches:
            rows = []
            # Frames of bounded size, however many cells a query reads.
            for query, vector, limit in zip(batch["query_id"], batch["query_vector"], batch["limit"]):
                if not len(cell):
                    break
                away = np.sqrt(((centroids - np.asarray(vector)) ** 2).sum(1))
                bound = np.maximum(away - radius - SLACK * (1 + away), 0)
                order = np.lexsort((cell, away, bound))
                before = np.cumsum(n[order]) - n[order]
                which = order[(before >= k) & (bound[order] <= limit)] if later else order[before < k]
                rows += [(query, vector, away[c], limit, cell[c], part) for c in which for part in range(parts[c])]
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"), "limit")
    return asked.mapInPandas(choose, f"query_id {kind}, query_vector array<double>, to_cell double, limit double, cell long, part int")


def search_cells(queries: DataFrame, store: CellStore, k: int = 10) -> DataFrame:
    """``(query_id, rank, id, distance)``: the k rows with the smallest squared distance, ties to the smaller id.

    ``queries(query_id, query_vector)``; ids are unique and vectors have the dimension of the table.
    """
    cut = table_cutter(queries.sparkSession, "search")
    asked = cut(queries.select("query_id", "query_vector").where("query_vector IS NOT NULL"))
    endless = F.lit(float("inf"))
    first = cut(_compare(cut(cells_to_read(asked.withColumn("limit", endless), store, k, False)), store, k))
    best = top_k(first, ["query_id"], [F.col("distance"), F.col("id")], k)
    limits = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_worst")).select(
        "query_id", F.when(F.col("_n") >= k, F.sqrt("_worst") * (1 + SLACK)).otherwise(endless).alias("limit"))
    limited = asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", endless))
    more = _compare(cut(cells_to_read(limited, store, k, True)), store, k)
    ranked = top_k(first.unionByName(more), ["query_id"], [F.col("distance"), F.col("id")], k)
    return ranked.select("query_id", "rank", "id", "distance")


def _compare(asked: DataFrame, store: CellStore, k: int) -> DataFrame:
    """Up to k best rows for each query and part of a cell: ``(query_id, id, distance)``. Cells nobody wants are not read."""
    rows, wanted = store.rows(asked.sparkSession), asked
    names = dict(wanted.dtypes) | {"id": dict(rows.dtypes)["id"]}

    def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(v):
            points, away, ids = np.stack(v["vector"].to_numpy()), v["to_centroid"].to_numpy(), v["id"].to_numpy()
            place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            for query, vector, to_cell, limit in zip(q["query_id"], q["query_vector"], q["to_cell"], q["limit"]):
                # |distance to the centroid - row's distance to it| bounds the row's distance.
                near = np.abs(away - to_cell) - SLACK * (1 + to_cell) <= limit
                distance = ((points[near] - np.asarray(vector)) ** 2).sum(1)
                order = np.lexsort((place[near], distance))[:k]
                found.append((len(order), query, ids[near][order], distance[order]))
        if found:
            counts, asking, which, distances = zip(*found)
            return pd.DataFrame({"query_id": pd.Series(asking).repeat(counts).to_numpy(), "id": np.concatenate(which), "distance": np.concatenate(distances)})
        return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "id": v["id"].iloc[:0], "distance": pd.Series(dtype="float64")})

    held = rows.join(F.broadcast(wanted.select("cell").distinct()), "cell", "left_semi")
    most = asked.groupBy("cell", "part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = -(-most // SLICE_QUERIES) or 1
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    cells = asked.groupBy("cell", "part", "slice").cogroup(held.groupBy("cell", "part", "slice"))
    return cells.applyInPandas(nearest, f"query_id {names['query_id']}, id {names['id']}, distance double")


#: Hits of each kind, as retrieval takes them by default.
KIND_LIMITS = {"entity": 10, "community": 5, "text_unit": 10}
#: Characters of a community's text that a hit shows.
COMMUNITY_CHARS = 1000


def search_tables(queries: DataFrame, stores: dict[str, CellStore], texts: dict[str, DataFrame], limits: dict[str, int] = KIND_LIMITS) -> DataFrame:
    """Hits in several vector tables as one: ``(query_id, kind, rank, id, distance, similarity, title, text)``.

    ``texts`` maps a kind to ``(id, title, text)``; unknown ids have empty titles and texts. Communities are cut.
    """
    found = None
    for kind, store in stores.items():
        hits = search_cells(queries, store, limits[kind])
        shown = F.coalesce("text", F.lit(""))
        shown = F.left(shown, F.lit(COMMUNITY_CHARS)) if kind == "community" else shown
        rows = hits.join(texts[kind].select("id", "title", "text"), "id", "left").select(
            "query_id", F.lit(kind).alias("kind"), "rank", "id", "distance", (1 - F.col("distance")).alias("similarity"),
            F.coalesce("title", F.lit("")).alias("title"), shown.alias("text"))
        found = rows if found is None else found.unionByName(rows)
    return found
