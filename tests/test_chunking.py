import random
import re

from pyspark.sql import functions as F

from annalist.functions.dates import extract_years
from annalist.operators import chunking, segmentation

SAMPLE = "\n\n".join(
    f"{year}年，" + "".join(f"那是第{i}件难忘的事情，大家都在场。" for i in range(n))
    for year, n in [("一九七二", 25), ("一九七八", 27), ("一九八四", 24), ("一九九二", 26), ("二〇〇一", 25), ("2008", 26)]
)


def random_texts(n=60, seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        parts = ["".join(rng.choice("天地玄黄ab ") for _ in range(rng.choice([5, 40, 300, 1100, 2500]))) for _ in range(rng.randint(0, 7))]
        texts.append(rng.choice(["\n\n", "\n \n\n", "\r\n\r\n"]).join(parts))
    return texts


def windows(text, size, step):
    out, start = [], 0
    while True:
        out.append(text[start : start + size].strip())
        if start + size >= len(text):
            return out
        start += step


def packed(text, size=900, overlap=150):
    text = re.sub(r"\r\n?", "\n", text).strip()
    out, buffer = [], ""
    for p in [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]:
        if len(p) > size:
            if buffer:
                out.append(buffer)
            buffer = ""
            out += windows(p, size, size - overlap)
        elif buffer and len(buffer) + 2 + len(p) > size:
            out.append(buffer)
            buffer = p
        else:
            buffer = f"{buffer}\n\n{p}" if buffer else p
    if buffer:
        out.append(buffer)
    return [c for c in out if len(c) >= 20]


def test_paragraph_chunks_match_a_loop(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {}
    for r in chunking.paragraph_chunks(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: packed(t) for i, t in enumerate(texts) if packed(t)}


def test_corpus_index_is_dense_and_ordered(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = sorted((r["chunk_index"], r["doc_id"], r["text"]) for r in chunking.chunk_corpus(df).collect())
    expected = [(d, c) for d, t in enumerate(texts) for c in packed(t)]
    assert [r[0] for r in rows] == list(range(len(expected))) and [r[1:] for r in rows] == expected


def test_windows_cover_the_text(spark):
    for n in (0, 1, 899, 900, 901, 1650, 1651, 5000):
        text = "x" * n
        rows = spark.createDataFrame([(1, text)], "doc_id int, text string")
        got = [r["text"] for r in chunking.window_chunks(rows).orderBy("chunk_index").collect()]
        assert got == windows(text, 900, 750)


def segments_of(spark, text, **o):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return segmentation.segment_documents(df, **o).orderBy("segment_index").collect()


def test_empty_and_short(spark):
    assert segments_of(spark, "  \n ") == []
    short = segments_of(spark, "1988年我在深圳。")
    assert len(short) == 1 and short[0]["split_reason"] == "single_short" and short[0]["years"] == ["1988"]


def test_long_sample(spark):
    rows = segments_of(spark, SAMPLE)
    assert 4 <= len(rows) <= 10 and [r["segment_index"] for r in rows] == list(range(len(rows)))
    assert sum(bool(r["temporal_label"]) for r in rows) >= 3
    assert re.sub(r"\s", "", "".join(r["text"] for r in rows)) == re.sub(r"\s", "", SAMPLE)
    assert rows[0]["split_reason"] == "document_start" and "temporal_boundary" in {r["split_reason"] for r in rows}


def test_year_boundary_is_not_merged(spark):
    text = "一九七二年冬天，我们下乡。" + "雪很大。" * 40 + "\n\n一九七七年恢复高考。" + "复习很苦。" * 40
    rows = segments_of(spark, text, minimum=300, maximum=800)
    assert [r["temporal_label"] for r in rows] == ["1972", "1977"]


def test_heading_starts_a_block(spark, one):
    assert one(segmentation.structural_blocks("text"), "开头\n第一章 出发\n正文\n二、归来\n结尾") == ["开头", "第一章 出发\n正文", "二、归来\n结尾"]


def test_unbroken_text_is_cut_hard(one):
    assert [len(p) for p in one(segmentation.split_oversized(F.col("text"), 800), "字" * 2000)] == [800, 800, 400]


def test_validation(spark):
    rows = [(1, 0, "长" * 5000), (1, 2, "1950年与1999年" + "中" * 200), (2, 0, "好" * 400)]
    df = spark.createDataFrame(rows, "doc_id int, segment_index int, text string").withColumn("years", extract_years("text"))
    issues = segmentation.validate_segments(df)
    assert {(r["doc_id"], r["segment_index"], r["issue"]) for r in issues.collect()} == {
        (1, 0, "too_long"), (1, 1, "index_gap"), (1, 2, "wide_year_span"),
    }
    passed = {r["doc_id"]: r["passed"] for r in segmentation.segmentation_passed(df, issues).collect()}
    assert passed == {1: False, 2: True}
