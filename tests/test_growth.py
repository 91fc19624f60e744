"""Steps whose work must grow no faster than their input."""

import random

from pyspark.sql import functions as F

from annalist.functions import text as tx
from annalist.operators import graph, matching, retrieval, terms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_entities_mention_the_text_once(spark):
    names = tx.rule_entities(F.concat(F.lit("<text>"), "text"))
    assert names._jc.toString().count("<text>") == 1
    df = spark.createDataFrame([("王a师傅\n张\n队长李队长，孙小军",), ("小军德明",), ("老\n王老王",), (None,)], "text string")
    assert [r[0] for r in df.select(tx.rule_entities("text")).collect()] == [
        ["王a师傅", "李队长", "孙小军"], ["德明", "小军"], ["老王"], None]


def test_key_phrases_of_own_keys_need_no_shuffle_and_others_are_counted_together(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 40)))) for k in [*range(30), 3, 3, 7, None, None, 99]]
    rows.append((100, None))
    df = spark.createDataFrame(rows, "k long, text string")
    words = terms.phrase_candidates(terms.tokens("text"), " ")
    assert sorted(terms.key_phrases(df, ["k"], words, 5).collect(), key=str) == sorted(terms._shuffled_phrases(df, ["k"], words, 5, 2).collect(), key=str)
    assert "Exchange" not in plan(terms.key_phrases(df.where("k BETWEEN 10 AND 20"), ["k"], words))


def test_terms_are_counted_in_their_rows(spark):
    df = spark.createDataFrame([(1, "bb aa bb"), (2, "aa cc dd"), (2, "aa ee"), (None, "aa"), (3, ""), (4, None)], "k long, text string")
    rows = terms.tfidf(df, "k", terms.tokens("text"), 6)
    got = {(r.k, r.term): (r.tf, r.df) for r in rows.collect()}
    assert got == {(1, "bb"): (2, 1), (1, "aa"): (1, 4), (2, "aa"): (1, 4), (2, "cc"): (1, 1), (2, "dd"): (1, 1), (2, "ee"): (1, 1), (None, "aa"): (1, 4)}
    assert "_len" not in "".join(line for line in plan(terms.tfidf(df.where("k = 1"), "k", terms.tokens("text"), 6)).splitlines() if "hashpartitioning" in line)


def test_links_of_names_grow_with_the_names(spark):
    units = spark.createDataFrame([(["b", "a", "b", "c"],), (["d"],), (["e", "c"],), ([],), (None,)], "names array<string>")
    assert sorted(map(tuple, graph.name_links(units, F.col("names")).collect())) == [("a", "b"), ("b", "c"), ("c", "e")]


def test_spanning_links_keep_nodes_and_components(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 400)}", f"n{rng.randint(0, 400)}") for _ in range(260)] + [("x", "x"), ("y", None), (None, None)]
    df = spark.createDataFrame(edges, "source string, target string").coalesce(1)
    whole = graph.connected_components(df).collect()
    assert graph.spanning_links(df.union(df).union(df)).count() < len(edges) * 3
    monkeypatch.setattr(graph, "BLOCK_EDGES", 100)
    assert sorted(map(str, graph.connected_components(graph.spanning_links(df)).collect())) == sorted(map(str, whole))


def test_numbered_names_share_few_anchors(spark, monkeypatch):
    names = spark.range(25_000).select(F.format_string("Customer#%09d", "id").alias("name"))
    texts = spark.range(0, 25_000, 5).select("id", F.format_string("Customer#%09d of NATION_3", "id").alias("text"))
    seen, choose = [], matching.choose_anchors
    monkeypatch.setattr(matching, "choose_anchors", lambda *a: seen.append(choose(*a)) or seen[-1])
    for limit in (matching.MAX_BROADCAST_BYTES, 0):
        assert matching.contains_join(texts, names, "id", "text", "name", limit).count() == 5000
    # Grams of four would be shared by more names the more there are: the digits at the end have but 10 000 of them.
    assert {r["n"] for r in seen[0].select(F.length("_gram").alias("n")).distinct().collect()} == {12}


def test_names_of_communities_are_read_in_batches(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(q, f"t{rng.randint(0, 6 if q else 2)}", rng.randint(0, 30), i) for q in range(3) for i in range(60)] + [(7, "only", 1, 1)]
    df = spark.createDataFrame(rows, "query_id long, title string, community long, id long").repartition(4)
    want = {}
    for q, title, c, i in rows:
        want[q, title] = min(want.get((q, title), (c, i)), (c, i))
    for batch in (2, 7, 256):
        got = {(r.query_id, r.title): (r.community, r.id) for r in retrieval.first_names(df, ["community", "id"], 4, batch).collect()}
        assert got.items() <= want.items()
        for q in (0, 1, 2, 7):
            first = sorted(v for key, v in want.items() if key[0] == q)[:4]
            assert sorted(v for key, v in got.items() if key[0] == q)[:4] == first


def test_entities_of_one_name_meet_a_community_once(spark, monkeypatch):
    entities = spark.createDataFrame([(i, "Ann", "PERSON", "d") for i in range(5, 0, -1)] + [(9, "Bob", "PERSON", "d")], "id long, title string, type string, description string")
    found = spark.createDataFrame([(1, "Ann and Bob"), (2, "Ann here")], "community long, full_content string")
    queries = spark.createDataFrame([(1, "1995", "X", ["ann"])], "query_id long, year string, location string, keywords array<string>")
    met, inside = [], retrieval.entities_in_communities
    monkeypatch.setattr(retrieval, "entities_in_communities", lambda *a: met.append(inside(*a)) or met[-1])
    rows = retrieval.community_first(queries, entities, found).orderBy("rank").collect()
    assert [(r.title, r.id, r.origin) for r in rows] == [("Ann", 1, "community"), ("Bob", 9, "community")]
    assert met[0].count() == 3
