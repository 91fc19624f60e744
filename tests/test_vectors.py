"""Vector tables stored by cells, against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import cells

RNG = np.random.default_rng(17)


def clustered(n, dim=6, groups=12):
    centres = 20 * RNG.standard_normal((groups, dim))
    return centres[RNG.integers(0, groups, n)] + RNG.standard_normal((n, dim))


def scan(points, query, k):
    distance = ((points - query) ** 2).sum(1)
    return [(int(i), round(float(distance[i]), 9)) for i in np.lexsort((np.arange(len(points)), distance))[:k]]


@pytest.fixture
def table(spark):
    points = clustered(900)
    points[50:80] = points[49]  # equal vectors
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    odd = [(2000, None), (2001, [1.0, None] + [0.0] * 4), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    return points, spark.createDataFrame(rows + odd, "id long, vector array<double>").repartition(4)


@pytest.mark.parametrize("n_cells, part_rows", [(None, 16_384), (1, 100), (60, 7)])
def test_cells_find_what_a_full_scan_finds(spark, table, tmp_path, monkeypatch, n_cells, part_rows):
    monkeypatch.setattr(cells, "PART_ROWS", part_rows)
    points, df = table
    store = cells.store_cells(df, str(tmp_path / "t"), n_cells=n_cells)
    queries = [points[3], points[49], points[10] + 0.3, np.zeros(6), 500 * np.ones(6)]
    asked = spark.createDataFrame([(f"q{i}", q.tolist()) for i, q in enumerate(queries)] + [("none", None)], "query_id string, query_vector array<double>")
    for k in (1, 10, 40):
        got = {}
        for r in cells.search_cells(asked, store, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 9)))
        assert got == {f"q{i}": scan(points, q, k) for i, q in enumerate(queries)}
    everything = cells.search_cells(asked.limit(1), store, 5000)
    assert everything.count() == 900


def test_few_rows_are_read(spark, table, tmp_path):
    """Queries near a group read its cells only; all stored rows lie within their cell's radius."""
    points, df = table
    store = cells.store_cells(df, str(tmp_path / "t"))
    asked = spark.createDataFrame([(1, points[3].tolist())], "query_id long, query_vector array<double>").withColumn("limit", F.lit(3.0))
    sizes = {r["cell"]: r["n"] for r in store.cells(spark).collect()}
    read = {r["cell"] for later in (False, True) for r in cells.cells_to_read(asked, store, 10, later).collect()}
    assert sum(sizes[c] for c in read) < sum(sizes.values()) / 3
    joined = store.rows(spark).join(store.cells(spark), "cell")
    assert joined.count() == 900 and joined.where("to_centroid > radius").isEmpty()


def test_tables_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<double>")
    store = cells.store_cells(none, str(tmp_path / "t"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>")
    assert cells.search_cells(asked, store, 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("digits", [None, 6])
def test_ties_of_copies_go_to_the_smaller_id(spark, metric, digits, monkeypatch):
    """Groups of equal vectors far larger than k, in several blocks, against a scan in the order of the components."""
    from annalist.operators import vectors

    monkeypatch.setattr(vectors, "GROUP_ROWS", 300)
    points = RNG.standard_normal((1500, 9)).astype(np.float32)
    points[200:700] = points[5]
    points[700:1100] = np.float32(1 + 1e-7) * points[5]  # equal after six decimals only
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(5000, None), (5001, [float("nan")] * 9)], "vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id < 30 OR vec_id IN (250, 650, 5001)").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    got = {}
    for r in vectors.vector_topk(asked, df, 7, metric, skip_same_id=True, digits=digits, query_block=20, vector_block=150).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    wide, want = points.astype(np.float64), {}
    for i in [*range(30), 250, 650]:
        score = vectors._exact(np.repeat(wide[i:i + 1], len(wide), 0), wide, metric)
        score = score if digits is None else np.round(score, digits)
        score[i] = -np.inf
        want[i] = np.lexsort((np.arange(len(wide)), -score))[:7].tolist()
    assert got == want


def test_many_queries_and_cells_are_met_in_bounded_pieces(spark, table, tmp_path, monkeypatch):
    points, vectors = table
    monkeypatch.setattr(cells, "FRAME_ROWS", 7)
    monkeypatch.setattr(cells, "SLICE_QUERIES", 5)
    store = cells.store_cells(vectors, str(tmp_path / "v"), n_cells=20)
    asked = RNG.integers(0, len(points), 40)
    queries = spark.createDataFrame([(n, points[i].tolist()) for n, i in enumerate(asked)], "query_id long, query_vector array<double>")
    found = {}
    for r in cells.search_cells(queries, store, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 9)))
    assert found == {n: scan(points, points[i], 5) for n, i in enumerate(asked)}
