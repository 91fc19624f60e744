"""The corpus pipeline, stage by stage, against what a reader would expect of a small corpus."""

import numpy as np
import pytest

import corpus_pipeline
from annalist.llm.queries import vocabulary
from annalist.llm.subwords import SubwordCoder


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random = np.random.default_rng(12)
    word = lambda: "".join(random.choice(list("abcdefg"), 5))
    rows = []
    for i in range(90):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            words[10:12] = ["scum", "idiot"]
        if i % 7 == 1:
            words[20] = 'token = "' + "".join(random.choice(list("0123456789abcdef"), 40)) + '"'
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " more", "en", "s", 1), (202, None, None, None, None), (203, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(90) if i % 3 != 1]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, schema


def test_stages(spark, corpus, tmp_path):
    folder, rows, schema = corpus
    docs = spark.createDataFrame(rows, schema)
    texts = {r[0]: r[1] for r in rows}
    kept = {i for i in texts if not (i < 90 and i % 6 == 0)}
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outputs.append(docs)
    toxicity, minhash, secrets, packing = outputs
    assert {r["doc_id"] for r in toxicity.collect()} == kept
    kept -= {200, 201}
    assert {r["doc_id"]: r["text"] for r in minhash.collect()} == {i: texts[i] for i in kept}
    cleaned = {r["doc_id"]: r["text"] for r in secrets.collect()}
    assert cleaned.keys() == kept
    for i, text in cleaned.items():
        if i % 7 == 1 and i < 90:
            assert 'token = "[SECRET]"' in text and len(text) < len(texts[i])
        else:
            assert text == texts[i]
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in outputs[:3])
    coder = SubwordCoder(vocabulary("byte_bpe_50k.json"))
    sizes = {i: len(coder.encode([t])[0]) + 1 for i, t in cleaned.items()}
    found = packing.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in found} == sizes


def test_repeated_rows_leave_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "s", 1)] * 3 + [(None, "a b c d e f", "x", "s", 1)] * 2, schema)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == ["1", "None", "None"]


def test_run_on_the_given_tables(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "secrets", "packing"]


def test_copies_from_080_on_are_dropped(spark):
    random = np.random.default_rng(3)
    word = lambda: "".join(random.choice(list("abcdefgh"), 6))
    texts = {}
    for group in range(12):
        base = [word() for _ in range(450)]
        for copy, changed in enumerate((0, 8, 9, 11)):
            words = list(base)
            for k in range(changed):
                words[k * (450 // max(1, changed)) + 10] = word()
            texts[group * 10 + copy] = " ".join(words)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    expected = set()
    for group in range(0, 120, 10):
        reached, waiting = {group}, [group]
        while waiting:
            i = waiting.pop()
            new = {j for j in range(group, group + 4) if j not in reached and share(i, j) >= 0.8}
            reached |= new
            waiting += new
        expected |= {group} | ({*range(group, group + 4)} - reached)
        assert all(0.8 <= share(group, group + c) < 0.85 for c in (1, 2)) and share(group, group + 3) < 0.8
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == expected
