"""Manifest, decontamination and phrases against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from annalist.llm import decontamination, merkle, phrases
from annalist.llm.queries import op11_merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, parts=4):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


# --- manifest ------------------------------------------------------------------------------

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, _, lang, source, n_chars = row
    return digest(*map(shown, (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    """All levels of a tree, by hashing whole runs anew."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 8
        out.append((nodes[first:at], nodes[at + 1:first + 8]))
        at //= 8
    return out


def manifest_of(rows):
    """The expected rows of the whole table."""
    order = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))
    groups = {}
    for row in sorted(rows, key=order):
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: tree_of([leaf_of(r, r[1]) for r in groups[name]]) for name in names}
    crown = tree_of([trees[name][-1][0] for name in names])
    expected = []
    for number, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            path = siblings_of(trees[name], at) + siblings_of(crown, number)
            leaf, text = leaf_of(row, row[1]), row[1]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            if hit and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            value = leaf_of(row, text)
            for left, right in path:
                value = digest(*left, value, *right)
            proof = digest(*[x for left, right in path for x in left + right])
            expected.append((row[0], leaf, trees[name][-1][0], crown[-1][0], proof, value, value == crown[-1][0]))
    return expected


def same_manifest(rows, out):
    key = lambda r: tuple(str(x) for x in r)
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out.collect()]
    assert sorted(got, key=key) == sorted(manifest_of(rows), key=key)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_equals_hashing_everything(spark, depth):
    """Subtrees of 8 and 64 nodes make several tiers; nulls, repeated rows and repeated ids are among the rows."""
    rng = random.Random(depth)
    rows = [(i, rng.choice(["Abc Ä", "lower", None, "", "ÉX" * 40]), rng.choice(["en", "en", "en", "de", "", None, "é"]), rng.choice(["s", None]), rng.choice([None, 7]))
            for i in range(150)]
    rows += [(5, "Twice", "en", "s", 1), (5, "Twice", "en", "s", 1), (5, "Other", "en", "s", 1), (None, "No id", "en", "s", 1), (None, None, None, None, None)]
    same_manifest(rows, merkle.verify(merkle.tampered_leaves(documents(spark, rows)), depth))


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_of_one_group(spark, n):
    rows = [(i, f"Row {i}", "en", "s", i) for i in range(n)]
    same_manifest(rows, merkle.verify(merkle.tampered_leaves(documents(spark, rows)), 1))


def test_manifest_of_an_empty_table_and_other_columns(spark):
    assert merkle.verify(merkle.tampered_leaves(documents(spark, []))).count() == 0
    rows = [(1, "A", "en", "s", 1), (2, "B", "en", "s", 1)]
    extra = documents(spark, rows).selectExpr("*", "1 AS pos", "2 AS n", "3 AS leaf", "4 AS digest", "5 AS block")
    same_manifest(rows, merkle.verify(merkle.tampered_leaves(extra)))


def test_manifest_of_a_long_text(spark):
    rows = [(i, "Wort " * 400_000, "de", None, None) for i in (1, 2)]
    same_manifest(rows, merkle.verify(merkle.tampered_leaves(documents(spark, rows))))


def test_fold_resumes_the_kept_state():
    nodes = [digest(str(i)) for i in range(21)]
    tree = merkle.Subtree(nodes, None)
    for at in (0, 7, 8, 20):
        changed = [*nodes[:at], digest("new"), *nodes[at + 1:]]
        assert tree.fold(at, digest("new")) == tree_of(changed)[-1][0]
    # What stands to the left is in the kept state and read no more.
    tree.rows[0] = ["x" * 64] * 7 + nodes[7:]
    assert tree.fold(7, nodes[7]) == tree_of(nodes)[-1][0]


# --- decontamination -----------------------------------------------------------------------

def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination_of(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        words = words_of(text)
        if item_id is not None and words:
            for i in range(max(len(words) - size, 0) + 1):
                windows.setdefault(tuple(words[i:i + size]), set()).add(str(item_id))
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for i in range(len(words)):
            for n in {len(w) for w in windows}:
                if i + n <= len(words) and tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i:i + n])]
        yield doc_id, len(words), len(hit), sorted(found), bool(hit)


def same_contamination(spark, docs, items, size=10):
    out = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), size)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(contamination_of(docs, items, size), key=str)
    return out


def test_contamination_equals_comparing_all_windows(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["ab", "Cd", "é", "x1", "Ünd", "a-b"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 9, 12]))) for i in range(20)] + [(7, "ab cd x1"), (100, None), (101, "  ..."), (None, "ab")]
    docs = [(i, text(rng.randrange(0, 120))) for i in range(60)]
    docs += [(1, items[0][1]), (1, items[0][1]), (70, None), (71, ""), (72, f"x {items[3][1]}! y, {items[3][1]} z"), (None, items[5][1])]
    same_contamination(spark, docs, items, 4)
    same_contamination(spark, docs, items)


def test_items_of_one_word_and_long_texts(spark):
    items = [(1, "lonely"), (2, "a b c d e f g h i j k l")]
    docs = [(1, "so Lonely."), (2, "not here"), (3, "lonely"), (4, "word " * 300_000 + "a b c d e f g h i j"), (5, "a b c d e f g h i")]
    out = same_contamination(spark, docs, items)
    spans = {r["doc_id"]: [(s["start"], s["length"]) for s in r["spans"]] for r in out.collect()}
    assert spans[1] == [(1, 1)] and spans[4] == [(300_000, 10)] and spans[5] == []


def test_contamination_with_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A b")], "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS row_id", "3 AS item_id")
    row = decontamination.contamination(docs, none).first()
    assert (row["n_words"], row["n_hit"], row["item_ids"], row["contaminated"]) == (2, 0, [], False)
    assert decontamination.contamination(docs.limit(0), none).count() == 0
    assert decontamination.contamination(docs, none.union(spark.createDataFrame([(1, "a B")], none.schema))).first()["n_hit"] == 2


def test_a_large_benchmark_takes_several_slices(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 400)
    items = [(i, f"w{i} x y z v u t s r q{i}") for i in range(12)]
    same_contamination(spark, [(i, f"before w{i} x y z v u t s r q{i} after") for i in range(15)], items)


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    out = decontamination.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- phrases -------------------------------------------------------------------------------

def collocations_of(docs, least, limit):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und" if lang is not None else "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang if lang is not None else "und", Counter())[tuple(words[i:i + k])] += 1
    rows = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * n >= 80 * a for q, n in candidates.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:limit], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return rows


def same_collocations(spark, docs, least, limit=2000, **options):
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(table, least, 4, limit, **options).collect()]
    assert sorted(got) == sorted(collocations_of(docs, least, limit))
    assert got or least > 100


def random_docs(seed, n, vocabulary):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " \x1c"]) for _ in range(rng.randrange(0, 60)))
    return [(i, rng.choice([None, "", *[text()] * 8]), rng.choice(["en", "en", "en", "de", None, "und"])) for i in range(n)]


def test_phrases_equal_counting_everything(spark):
    docs = random_docs(1, 120, ["The", "of", "Ärger", "x", "a.b", "ein", "é"])
    same_collocations(spark, docs, 5)
    same_collocations(spark, docs, 30, limit=7)


def test_small_shards_and_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 200)
    docs = random_docs(2, 90, ["a", "b", "c", "D"]) + [(1000 + i, "one hot line of words", "en") for i in range(60)]
    same_collocations(spark, docs, 4, shard_words=50)


def test_phrases_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " . ", "en")], schema)).count() == 0
    same_collocations(spark, [(1, "a b a b a " * 60_000, None), (2, "a b, c", "en")], 30)
    extra = spark.createDataFrame([(1, "x y. " * 40, "en")], schema).selectExpr("*", "1 AS words", "2 AS n", "3 AS shard", "4 AS file")
    assert [r["phrase"] for r in phrases.collocations(extra).collect()] == ["x y"]


@pytest.mark.parametrize("size", [3, 40, 700])
def test_intervals_count_every_phrase(size):
    """Extensions to both sides against counting, with few and with many different ids."""
    rng = np.random.default_rng(size)
    ids = np.concatenate([[0], rng.integers(0, size, 4000), [0]])
    index = phrases.Index.of(ids, 4)
    grams = lambda k: Counter(g for i in range(len(ids) - k + 1) if 0 not in (g := tuple(map(int, ids[i:i + k]))))
    level, names = index.words(), None
    names = [(int(w),) for w in level.word]
    for k in (2, 3, 4):
        for made, join in ((index.left(level), lambda w, p: (w, *p)), (index.right(level), lambda w, p: (*p, w))):
            assert {join(int(w), names[s]): int(n) for w, s, n in zip(made.word, made.source, made.size)} == grams(k)
        made, _, _ = phrases.longer(index, level, np.arange(len(names)))
        names = [(*names[s], int(w)) for s, w in zip(made.source, made.word)]
        assert dict(zip(names, map(int, made.size))) == grams(k)
        level = made


def test_many_ids_are_ranked_in_steps():
    ids = np.concatenate([[0], np.random.default_rng(0).integers(0, 2**20, 5000), [0]])
    order = np.argsort(phrases.ranks(ids, 4), kind="stable")
    expected = sorted(range(len(ids)), key=lambda i: [int(ids[(i + j) % len(ids)]) for j in range(4)])
    keys = [[int(ids[(i + j) % len(ids)]) for j in range(4)] for i in order]
    assert keys == [[int(ids[(i + j) % len(ids)]) for j in range(4)] for i in expected]


def test_whole_query_tables_are_read(spark, sf):
    assert op11_merkle(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
