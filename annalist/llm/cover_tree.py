"""Near-duplicate vectors by dual traversal of cover trees.

Vectors are scaled to length one, so a cosine of c is a distance of sqrt(2 - 2c). They are dealt into blocks of
bounded size near a few pivots; each block becomes a cover tree: nested centres, radii that halve from level to
level, and at every node the true covering radius. Pairs of blocks are traversed together: a pair of nodes that lies too
far apart for its radii is dropped, one that lies close enough is taken whole, others are opened, and leaves are
compared exactly. Tasks emit counts and spanning links, so a group of n copies costs n rows and not n * n.

Copies are told by a digest, and a vector is shuffled twice, as it was given, whatever the number of blocks. Trees are
not shuffled: each stays in its partition and meets the others in slices of bounded size, one broadcast after another.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import finite_vector, prepare
from .minhash import forest

#: Rows of a block and of a leaf, pivots, and rows that pivots are chosen from.
BLOCK, LEAF, PIVOTS, SAMPLE = 4096, 256, 128, 4096
#: Centres that a level may try before what is left becomes leaves.
CENTRES = 256
#: Bytes of trees that are broadcast at once.
SLICE_BYTES = 8 << 20
#: Slack of distance bounds against rounding.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class CoverTree:
    """Points in tree order and nodes as arrays; the points of a node are ``start[i]:end[i]``, its centre is at ``place[i]``."""

    ids: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first_child: np.ndarray
    n_children: np.ndarray
    total: np.ndarray
    place: np.ndarray


def build(ids: np.ndarray, weights: np.ndarray, points: np.ndarray) -> CoverTree:
    """The cover tree of unit vectors."""
    order = np.arange(len(points))
    nodes: list[list] = []  # centre, radius, start, end, first child, children

    def add(start: int, end: int, centre: int) -> int:
        away = np.linalg.norm(points[order[start:end]] - points[centre], axis=1)
        nodes.append([centre, float(away.max(initial=0.0)), start, end, 0, 0])
        return len(nodes) - 1

    pending = []
    if len(points):
        pending = [(add(0, len(points), 0), 2.0)]
    while pending:
        node, reach = pending.pop()
        centre, radius, start, end = nodes[node][:4]
        while reach / 2 >= radius and reach > SLACK:
            reach /= 2  # empty levels
        if end - start <= LEAF or radius <= SLACK:
            continue
        members, reach = order[start:end].copy(), reach / 2
        left = np.ones(len(members), dtype=bool)
        parts: list[tuple[int, np.ndarray]] = []
        # The node's own centre comes first (nesting); later ones are spread over what is not covered yet.
        for attempt in range(CENTRES):
            if not left.any():
                break
            free = np.flatnonzero(left)
            pick = centre if attempt == 0 else members[free[(attempt * 7919) % len(free)]]
            covered = free[np.linalg.norm(points[members[free]] - points[pick], axis=1) <= reach]
            left[covered] = False
            if len(covered):
                parts.append((int(pick), members[covered]))
        small = [m for _, m in parts if len(m) < 8 and len(parts) > 1]
        kept = [(c, m) for c, m in parts if len(m) >= 8 or len(parts) == 1]
        rest = np.concatenate([members[left], *small]) if small or left.any() else np.zeros(0, np.int64)
        rest = np.sort(rest)
        kept += [(int(rest[i]), rest[i : i + LEAF]) for i in range(0, len(rest), LEAF)]
        at = start
        nodes[node][4], nodes[node][5] = len(nodes), len(kept)
        for number, (c, m) in enumerate(kept):
            order[at : at + len(m)] = m
            child = add(at, at + len(m), c)
            at += len(m)
            if len(m) > LEAF and len(m) < end - start:
                pending.append((child, reach))
            elif len(m) > LEAF:
                pending.append((child, reach))
    columns = [np.array(c) for c in zip(*nodes)] or [np.zeros(0)] * 6
    ordered = weights[order]
    sums = np.concatenate([[0], np.cumsum(ordered)])
    start, end = columns[2].astype(np.int64), columns[3].astype(np.int64)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return CoverTree(
        ids[order], ordered, points[order], points[columns[0].astype(np.int64)], columns[1].astype(np.float64), start, end,
        columns[4].astype(np.int64), columns[5].astype(np.int64), sums[end] - sums[start], at[columns[0].astype(np.int64)],
    )


def traverse(a: CoverTree, b: CoverTree | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Linked weight of each point of both trees, and links between positions (those of ``b`` follow those of ``a``).

    Without ``b``, the pairs within ``a``. A point is not linked with itself.
    """
    alone = b is None
    b = a if alone else b
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    counts_a, counts_b = np.zeros(len(a.ids)), np.zeros(len(b.ids))
    shift = 0 if alone else len(a.ids)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    left, right = (np.zeros(1, np.int64), np.zeros(1, np.int64)) if len(a.start) and len(b.start) else (np.zeros(0, np.int64),) * 2
    while len(left):
        away = np.linalg.norm(a.centre[left] - b.centre[right], axis=1)
        reach = a.radius[left] + b.radius[right]
        near = away <= limit + reach + SLACK
        left, right, away, reach = left[near], right[near], away[near], reach[near]
        whole = away + reach <= limit - SLACK
        for i, j in zip(left[whole], right[whole]):
            _take(a, b, i, j, alone, shift, counts_a, counts_b, links)
        left, right = left[~whole], right[~whole]
        leaves = (a.n_children[left] == 0) & (b.n_children[right] == 0)
        for i, j in zip(left[leaves], right[leaves]):
            _compare(a, b, i, j, alone, shift, cosine, counts_a, counts_b, links)
        left, right = _opened(a, b, left[~leaves], right[~leaves], alone)
    return counts_a, counts_b, links


def _opened(a: CoverTree, b: CoverTree, left: np.ndarray, right: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs below pairs of nodes: of either node the children, or itself where it is the smaller ball or a leaf."""
    out_l, out_r = [], []
    for i, j in zip(left.tolist(), right.tolist()):
        below = lambda t, n: np.arange(t.first_child[n], t.first_child[n] + t.n_children[n])
        if alone and i == j:
            children = below(a, i)
            x, y = np.triu_indices(len(children))
            out_l.append(children[x])
            out_r.append(children[y])
        elif b.n_children[j] == 0 or (a.n_children[i] > 0 and a.radius[i] >= b.radius[j]):
            children = below(a, i)
            out_l.append(children)
            out_r.append(np.full(len(children), j))
        else:
            children = below(b, j)
            out_l.append(np.full(len(children), i))
            out_r.append(children)
    return (np.concatenate(out_l), np.concatenate(out_r)) if out_l else (np.zeros(0, np.int64),) * 2


def _take(a, b, i, j, alone, shift, counts_a, counts_b, links) -> None:
    """All points of two nodes are linked."""
    p, q = np.arange(a.start[i], a.end[i]), np.arange(b.start[j], b.end[j])
    counts_a[p] += b.total[j]
    if alone and i == j:
        counts_a[p] -= a.weights[p]
    elif alone:
        counts_a[q] += a.total[i]
    else:
        counts_b[q] += a.total[i]
    links.append((np.full(len(q), p[0]), q + shift))
    links.append((p, np.full(len(p), q[0] + shift)))


def _compare(a, b, i, j, alone, shift, cosine, counts_a, counts_b, links) -> None:
    """Exact comparison of two leaves."""
    p, q = slice(a.start[i], a.end[i]), slice(b.start[j], b.end[j])
    linked = a.points[p] @ b.points[q].T >= cosine
    if alone and i == j:
        np.fill_diagonal(linked, False)
        counts_a[p] += linked @ a.weights[p]
    else:
        counts_a[p] += linked @ b.weights[q]
        (counts_a if alone else counts_b)[q] += a.weights[p] @ linked
    x, y = np.nonzero(linked)
    if len(x):
        links.append((x + a.start[i], y + b.start[j] + shift))


def pair_rows(a: CoverTree, b: CoverTree | None, cosine: float) -> list[tuple[int, int, int]]:
    """``(vec_id, n, -1)``: linked weight; ``(vec_id, -1, other)``: spanning links."""
    counts_a, counts_b, links = traverse(a, b, cosine)
    ids = a.ids if b is None else np.concatenate([a.ids, b.ids])
    counts = counts_a if b is None else np.concatenate([counts_a, counts_b])
    found = np.flatnonzero(counts > 0)
    rows = [(int(ids[i]), int(counts[i]), -1) for i in found]
    if links:
        root = forest(len(ids), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
        rows += [(int(ids[i]), -1, int(ids[root[i]])) for i in np.flatnonzero(root != np.arange(len(ids)))]
    return rows


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row.

    Two vectors are linked if their cosine, in double precision, is at least ``cosine``. Null, zero and empty vectors,
    and vectors with null, NaN or infinite components, link with nothing, nor do vectors of different lengths. Copies
    are compared once. Rows of one id count once as a partner; a row without an id has no links and no verdict.
    """
    spark = vectors.sparkSession
    prepare(spark, 4096)
    native = vectors.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(vector).alias("given"))
    usable = given.where(F.col("vec_id").isNotNull() & finite_vector(F.col("v")) & F.exists("v", lambda x: x != 0))
    usable = usable.select("vec_id", F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("digest"), F.col("given" if native else "v").alias("v"))
    # Pivots come from a sample of bounded size; they only decide which vectors share a block.
    sample = [r["v"] for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id", "digest").limit(SAMPLE).select("v").collect()]
    placed = cut_lineage(_placed(usable, _pivots(sample)))
    rows = placed.distinct()
    classes = cut_lineage(rows.groupBy("digest", "size", "pivot").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")))
    found = _pairs_of_blocks(usable, classes, cosine, block) if sample else spark.createDataFrame([], "vec_id long, n long, other long")
    counts = found.where("n >= 0").groupBy(F.col("vec_id").alias("first")).agg(F.sum("n").alias("n"))
    edges = found.where("n < 0").select(F.col("vec_id").alias("source"), F.col("other").alias("target")).distinct()
    components = connected_components(edges).select(F.col("node").alias("first"), "component")
    named = classes.select("digest", "first", "weight").join(counts, "first", "left").join(components, "first", "left")
    labels = rows.select("vec_id", "digest").join(named, "digest").groupBy("vec_id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component", "first")).alias("component")
    )
    component = F.coalesce("component", "vec_id")
    return given.select("vec_id").join(labels, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )


def _placed(usable: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(vec_id, digest, size, pivot)``: the length of each vector and the nearest pivot of that length."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [0] * batch.num_rows
            rows = batch.column("v").to_pylist()
            for length in {len(r) for r in rows}:
                mine = [i for i, r in enumerate(rows) if len(r) == length]
                if length in pivots:
                    best = np.argmax(unit(np.array([rows[i] for i in mine])) @ pivots[length].T, axis=1)
                    for i, k in zip(mine, best.tolist()):
                        at[i] = k
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("vec_id", "digest")] + [pa.array([len(r) for r in rows], pa.int32()), pa.array(at, pa.int32())],
                names=["vec_id", "digest", "size", "pivot"])

    return usable.mapInArrow(nearest, "vec_id long, digest binary, size int, pivot int")


def _pairs_of_blocks(usable: DataFrame, classes: DataFrame, cosine: float, block: int) -> DataFrame:
    spark = classes.sparkSession
    # Cells in order of their pivots fill blocks; a cell of more than a block is dealt out by a hash.
    cells = classes.groupBy("size", "pivot").agg(F.count("*").alias("n")).orderBy("size", "pivot").collect()
    layout, number, room = [], -1, 0
    last = None
    for cell in cells:
        if cell["n"] > block or cell["n"] > room or cell["size"] != last:
            number, room = number + 1, block
        parts = -(-cell["n"] // block)
        layout.append((cell["size"], cell["pivot"], number, parts))
        number, room = number + parts - 1, (room - cell["n"] if parts == 1 else 0)
        last = cell["size"]
    # One row per cell: at most as many as there are pivots of each vector length.
    table = spark.createDataFrame(layout, "size int, pivot int, base int, parts int")
    where = F.col("base") + F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")
    dealt = classes.join(F.broadcast(table), ["size", "pivot"]).select("digest", "first", "weight", "size", "pivot", where.alias("block"))
    dealt = usable.withColumnRenamed("vec_id", "first").join(dealt, ["first", "digest"])

    def tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pivot", "first", "digest"], kind="stable").drop_duplicates(["first", "digest"])
        raw = np.stack(list(rows["v"]))
        packed = pickle.dumps(_packed(rows["first"].to_numpy(), rows["weight"].to_numpy(np.float64), raw))
        return pd.DataFrame({"block": [int(key[0])], "tree": [packed]})

    trees = cut_lineage(dealt.groupBy("block").applyInPandas(tree, "block int, tree binary"))
    prepare(spark, 8)
    slices, held = [[]], 0
    for number, size in sorted((r["block"], r["size"]) for r in trees.select("block", F.length("tree").alias("size")).collect()):
        if held and held + size > SLICE_BYTES:
            slices, held = [*slices, []], 0
        slices[-1].append(number)
        held += size
    parts = [_slice_pairs(trees, numbers, cosine) for numbers in slices]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _slice_pairs(trees: DataFrame, numbers: list[int], cosine: float) -> DataFrame:
    """Counts and links of all trees with those of some blocks; of two blocks the pair is met from one side only."""
    context = trees.sparkSession.sparkContext
    few = context.broadcast([(r["block"], bytes(r["tree"])) for r in trees.where(F.col("block").isin(numbers)).collect()])
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [(number, _unpacked(data)) for number, data in few.value]
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("tree").to_pylist()):
                mine = _unpacked(data)
                for other, tree in others:
                    if number == other:
                        rows = pair_rows(mine, None, cosine)
                    elif (number < other) == ((number + other) % 2 == 1) and mine.points.shape[1] == tree.points.shape[1]:
                        rows = pair_rows(mine, tree, cosine)
                    else:
                        continue
                    columns = list(zip(*rows)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    pairs = cut_lineage(trees.mapInArrow(run, "vec_id long, n long, other long"))
    few.destroy()
    return pairs


def _packed(ids: np.ndarray, weights: np.ndarray, raw: np.ndarray) -> tuple:
    """A tree as its vectors as given, in tree order, and its nodes, whose centres are places of points."""
    built = build(np.arange(len(ids)), weights, unit(raw))
    order = built.ids
    return (ids[order], built.weights, raw[order], built.place, *(getattr(built, c) for c in ("radius", "start", "end", "first_child", "n_children", "total")))


def _unpacked(data: bytes) -> CoverTree:
    ids, weights, raw, place, *nodes = pickle.loads(data)
    points = unit(raw)
    return CoverTree(ids, weights, points, points[place], *nodes, place)


def _pivots(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """For each vector length, spread-out vectors: each next one is the farthest from those chosen."""
    out = {}
    for length in {len(v) for v in sample}:
        points = unit(np.array([v for v in sample if len(v) == length]))
        chosen, best = [0], points @ points[0]
        while len(chosen) < min(PIVOTS, len(points)):
            chosen.append(int(np.argmin(best)))
            best = np.maximum(best, points @ points[chosen[-1]])
        out[length] = points[chosen]
    return out
