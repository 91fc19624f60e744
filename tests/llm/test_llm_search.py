"""Top-k search, near-duplicate vectors and near-duplicate texts against brute force."""

import numpy as np
import pytest

from annalist.llm import cover_tree, minhash, topk

VECTORS = "vec_id long, embedding array<double>, label int, score string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def components(ids, linked):
    """Smallest reachable id of each id."""
    lowest = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(lowest[a], lowest[b])
            changed |= lowest[a] != low or lowest[b] != low
            lowest[a] = lowest[b] = low
    return lowest


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(3)
    base = random.standard_normal((60, 8))
    near = base[:10] + 0.15 * random.standard_normal((10, 8))
    points = np.concatenate([base, near, base[:3], 7 * base[3:5], np.repeat(base[20:21], 30, axis=0) + 0.05 * random.standard_normal((30, 8))])
    rows = [(i, p.tolist(), 0, "x") for i, p in enumerate(points)]
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [], [2.0, 4.0]]
    rows += [(1000 + i, v, None, None) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows + [rows[0], (None, [1.0] * 8, 1, "y")], VECTORS), rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_topk_matches_brute_force(vectors):
    df, rows = vectors
    fine = {i: np.floor(256 * np.array(v)) for i, v, *_ in rows if usable(v)}
    expected = []
    for q in (i for i in fine if i % 5 == 0):
        # Row 0 appears twice in the table, and both times it is a candidate.
        scored = [(-int(fine[q] @ c), i) for i, c in fine.items() if i != q and len(c) == len(fine[q]) for _ in range(2 if i == 0 else 1)]
        for rank, (score, i) in enumerate(sorted(scored)[:4], 1):
            expected.append((q, rank, i, -score))
    queries = df.where("vec_id % 5 = 0").dropDuplicates(["vec_id"])
    found = topk.exact_topk(queries, df, k=4, query_tile=3, shard_rows=5, fan_in=2)
    assert rows_of(found) == sorted(expected)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert topk.exact_topk(empty, empty).count() == 0


def test_topk_ties_and_large_numbers(spark):
    rows = [(i, [1.0 if i < 8 else 1e9, 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = rows_of(topk.exact_topk(df.where("vec_id = 3"), df, k=3))
    assert [r[2] for r in found] == [8, 9, 0]


def test_cover_tree_matches_brute_force(vectors):
    df, rows = vectors
    fine = {i: cover_tree.unit(np.array([v]))[0] for i, v, *_ in rows if usable(v) and any(v)}
    linked = [(i, j) for i in fine for j in fine if i != j and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.9]
    lowest = components([r[0] for r in rows], linked)
    found = {r["vec_id"]: r for r in cover_tree.near_vectors(df, 0.9, block=16).collect()}
    assert found.pop(None)["kept"] is None
    assert set(found) == {r[0] for r in rows}
    for i, *_ in rows:
        r = found[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(a == i for a, _ in linked), lowest[i], lowest[i] == i)
    assert cover_tree.near_vectors(df, 0.9).count() == df.count()


def test_cover_tree_of_nothing(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_tree_invariants_and_traversal():
    random = np.random.default_rng(5)
    centres = random.standard_normal((12, 6))
    points = cover_tree.unit(np.concatenate([c + 0.1 * random.standard_normal((150, 6)) for c in centres] + [random.standard_normal((300, 6))]))
    ids, weights = np.arange(len(points)), random.integers(1, 4, len(points)).astype(float)
    tree = cover_tree.build(ids, weights, points)
    assert sorted(tree.ids) == ids.tolist() and len(tree.start) > 12
    for n in range(len(tree.start)):
        away = np.linalg.norm(tree.points[tree.start[n] : tree.end[n]] - tree.centre[n], axis=1)
        assert away.max() <= tree.radius[n] + 1e-12
        children = range(tree.first_child[n], tree.first_child[n] + tree.n_children[n])
        if children:
            assert sum(tree.end[c] - tree.start[c] for c in children) == tree.end[n] - tree.start[n]
    for cosine in (0.9, 0.99, 0.2):
        linked = points @ points.T >= cosine
        np.fill_diagonal(linked, False)
        counts = {i: n for i, n, other in cover_tree.pair_rows(tree, None, cosine) if n >= 0}
        assert [counts.get(i, 0) for i in ids] == (linked @ weights).tolist()
    half = len(points) // 2
    a, b = (cover_tree.build(ids[s], weights[s], points[s]) for s in (slice(0, half), slice(half, None)))
    linked = points[:half] @ points[half:].T >= 0.9
    rows = cover_tree.pair_rows(a, b, 0.9)
    counts = {i: n for i, n, other in rows if n >= 0}
    assert [counts.get(i, 0) for i in ids] == [*(linked @ weights[half:]), *(weights[:half] @ linked)]
    pairs = [(i, j + half) for i, j in zip(*np.nonzero(linked))]
    assert components(ids.tolist(), pairs) == components(ids.tolist(), [(i, o) for i, n, o in rows if n < 0])


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def near_texts():
    random = np.random.default_rng(9)
    word = lambda: "".join(random.choice(list("abcdeé"), 4))
    texts = {}
    for group in range(8):
        base = [word() for _ in range(120)]
        for copy in range(6):
            words = list(base)
            for _ in range(copy):
                words[random.integers(120)] = word()
            texts[group * 10 + copy] = " ".join(words)
    passage = " ".join(word() for _ in range(60))
    for i in range(100, 120):
        texts[i] = passage + " " + " ".join(word() for _ in range(40))
    texts |= {200: None, 201: "", 202: " \n", 203: "a b c", 204: "A  B\tC", 205: "a b d", 206: "x\x1cy z", 207: texts[0].upper().replace("É", "é")}
    return texts | {208: texts[0] + " tail"}


@pytest.mark.parametrize("blocks", [None, (8, 2)])
def test_minhash_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:  # blocks so small that buckets and clusters are cut
        monkeypatch.setattr(minhash, "BUCKET_BLOCK", blocks[0])
        monkeypatch.setattr(minhash, "CLUSTER_BLOCK", blocks[1])
    texts = near_texts()
    sets = brute_sets(texts)
    linked = [(i, j) for i in sets for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    lowest = components(sets, linked)
    rows = [(i, t, "kept", 1) for i, t in texts.items()]
    df = spark.createDataFrame(rows + [rows[0], (None, texts[0], "x", 1)], "doc_id long, text string, kept string, n_shingles int")
    found = minhash.near_duplicates(df).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is None
            continue
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), lowest[i], lowest[i] == i), i


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("layout", [minhash.CLOSE, minhash.WIDE])
def test_every_close_pair_shares_a_bucket(layout):
    random = np.random.default_rng(1)
    for _ in range(200):
        a = random.integers(0, 1 << 16, layout.slots, dtype=np.uint16)
        b = a.copy()
        b[random.permutation(layout.slots)[: layout.distance]] ^= 1
        keys = minhash.bucket_keys(np.stack([a, b]), layout)
        assert (keys[0] == keys[1]).any()


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 30_000}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1}


def test_trees_meet_in_slices_without_a_shuffle(spark, vectors, monkeypatch):
    df, rows = vectors
    key = lambda found: sorted((tuple(r) for r in found.collect()), key=repr)
    whole = key(cover_tree.near_vectors(df, 0.9))
    plans, cut = [], cover_tree.cut_lineage

    def seen(table):
        if table.columns == ["vec_id", "n", "other"]:
            plans.append(table._jdf.queryExecution().executedPlan().toString())
        return cut(table)

    monkeypatch.setattr(cover_tree, "cut_lineage", seen)
    monkeypatch.setattr(cover_tree, "SLICE_BYTES", 1, raising=False)
    assert key(cover_tree.near_vectors(df, 0.9, block=16)) == whole
    assert len(plans) > 1 and not any("Exchange" in plan for plan in plans)
