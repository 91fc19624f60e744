"""Joins without a key of their own, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.functions.text import names_match
from annalist.operators import fuzzy, graph, matching

SPELLINGS = {"中国": ["china", "prc"], "北京": ["beijing"]}


def test_long_terms_are_found_by_their_inner_words(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(0, 5))) for _ in range(n))
    texts = [text(rng.randrange(0, 3000)) for _ in range(30)] + ["", "é" * 5000]
    needles = {t[i:i + n] for t in texts[:10] if len(t) > 200 for i, n in ((0, 30), (50, 120), (7, 5), (len(t) - 26, 26), (3, 2), (90, 24), (90, 25))} | {"é" * 40, "not there at all, never ever", " " * 30}
    t = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, text string").repartition(5)
    n = spark.createDataFrame([(x,) for x in needles], "term string")
    for limit in (matching.MAX_BROADCAST_BYTES, 0):
        got = {(r["id"], r["term"]) for r in matching.contains_join(t, n, "id", "text", "term", limit).collect()}
        assert got == {(i, x) for i, text in enumerate(texts) for x in needles if x and x in text}


def test_texts_are_scanned_without_python(spark):
    t = spark.createDataFrame([(1, "some text")], "id long, text string")
    plan = matching.contains_join(t, t, "id", "text", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.fixture
def names():
    rng = random.Random(9)
    plain = ["".join(rng.choice("abC") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    return plain + ["China", "PRC trade", "中国", "中国人", "北", "北京", "Beijing!", "bei jing", "--", "", None, "abCa", "abCa"]


def test_fuzzy_join_equals_testing_all_pairs(spark, names):
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "l long, name string").repartition(3)
    right = spark.createDataFrame([(i, n) for i, n in enumerate(reversed(names))], "r long, other string").repartition(3)
    sensible = lambda c: F.col(c).rlike("[一-龥a-zA-Z0-9]")
    pairs = left.crossJoin(right).where(sensible("name") & sensible("other") & names_match("name", "other", SPELLINGS))
    got = fuzzy.fuzzy_join(left, right, "name", "other", SPELLINGS)
    assert sorted(map(tuple, got.select("l", "r").collect())) == sorted(map(tuple, pairs.select("l", "r").collect()))
    assert got.columns == ["l", "name", "r", "other"]
    plan = fuzzy.fuzzy_pairs(left, right, "name", "other", SPELLINGS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fuzzy_join_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("a",), (None,), ("?",)], "name string")
    assert fuzzy.fuzzy_pairs(none, some).count() == 0 and fuzzy.fuzzy_pairs(some, none).count() == 0
    assert [tuple(r) for r in fuzzy.fuzzy_pairs(some, some).collect()] == [("a", "a")]


def test_first_match_follows_the_order(spark):
    facts = spark.createDataFrame([("Shenzhen zone",), ("nothing",)], "fact string")
    known = spark.createDataFrame([(2, "shen"), (1, "Zone"), (3, "none")], "at int, title string")
    got = dict(map(tuple, fuzzy.first_match(facts, known, "fact", "title", "at", {}).collect()))
    assert got == {"Shenzhen zone": "Zone", "nothing": None}


def test_packs_hold_entities_and_inner_relationships_in_turns(spark):
    members = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 4)], "community string, node long")
    entities = spark.createDataFrame([(1, 5, "one"), (2, 9, "two"), (3, 1, "three"), (4, 2, "four")], "node long, degree int, line string")
    ties = spark.createDataFrame([(1, 2, 1.0, "1-2"), (2, 3, 4.0, "2-3"), (3, 4, 9.0, "3-4")], "source long, target long, weight double, line string")
    rows = {r["community"]: r for r in graph.community_pack(members, entities, ties).collect()}
    assert rows["x"]["pack"] == "two\none\nthree\n2-3\n1-2" and rows["x"]["n_chars"] == 3 + 4 + 4 + 4 + 6
    assert (rows["y"]["n_entities"], rows["y"]["n_relationships"]) == (1, 0)
    # two, 2-3, one: the budget ends in the middle of the turns.
    short = {r["community"]: r["pack"] for r in graph.community_pack(members, entities, ties, max_chars=12).collect()}
    assert short == {"x": "two\none\n2-3", "y": "four"}
    alone = {r["community"]: r["n_lines"] for r in graph.community_pack(members, entities).collect()}
    assert alone == {"x": 3, "y": 1}


@pytest.mark.parametrize("must", [None, "year"])
def test_few_terms_score_as_many_do(spark, monkeypatch, must):
    """Rows scored where they are read get what the join on grams gives, repeated and empty terms included."""
    from annalist.operators import retrieval

    rows = spark.createDataFrame([(1, "1995 NATION_1 asia"), (2, "1996 Nation_12 ASIA"), (3, ""), (4, None), (5, "19951996")], "id long, text string")
    terms = spark.createDataFrame(
        [(1, "1995", 30, "year"), (1, "1996", 10, "near_year"), (1, "nation_1", 20, "place"), (1, "asia", 15, "topic"), (1, "asia", 15, "topic"),
         (2, "1996", 30, "year"), (2, "1995", 30, "year"), (2, "", 5, "topic"), (2, None, 5, "topic"), (3, "1997", 30, "year")],
        "query_id long, term string, weight int, kind string")
    score = lambda: sorted(map(tuple, retrieval.score_rows(rows, "id", F.col("text"), terms, upper=True, must=must).collect()))
    few = score()
    assert not [n for n in ("Python", "NestedLoop") if n in retrieval.score_rows(rows, "id", F.col("text"), terms, True, must)._jdf.queryExecution().toString()]
    monkeypatch.setattr(matching, "FEW_TERMS", -1)
    assert few == score() and len(few) == (6 if must is None else 5)


def test_terms_without_blanks_are_looked_for_in_distinct_words(spark, monkeypatch):
    monkeypatch.setattr(matching, "FEW_TERMS", -1)
    texts = spark.createDataFrame([(i, "abcd xabcdx  é北京市 x y" if i % 2 else "\tabcd\nab cd") for i in range(200)] + [(900, ""), (901, None)], "id long, text string")
    terms = spark.createDataFrame([(t,) for t in ("abcd", "bc", "北京", "d\nab", "b c", "x y", "none")], "term string")
    seen, inside = [], matching._match_in_place
    monkeypatch.setattr(matching, "_match_in_place", lambda texts, *a: seen.append(texts.count()) or inside(texts, *a))
    got = {(r["id"], r["term"]) for r in matching.contains_join(texts, terms, "id", "text", "term").collect()}
    odd, even = {"abcd", "bc", "北京", "x y"}, {"abcd", "bc", "d\nab", "b c"}
    assert got == {(i, t) for i in range(200) for t in (odd if i % 2 else even)}
    assert seen == [7, 201]
