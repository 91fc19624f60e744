import json

import pytest
from pyspark.sql import functions as F

from annalist.operators import benchmark, chunking
from annalist.sources import events, files, sinks
from annalist.streaming import incremental, ingest


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)


def test_corpus_of_three_formats(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps([{"title": "甲", "date": "1988年", "content": "正文", "keywords": ["x"]}, {}], ensure_ascii=False))
    write(tmp_path / "broken.json", '[{"title": ')
    write(tmp_path / "b.csv", 'title,date,location,content,keywords\n乙,1990年,,"多行\n正文","a, b"\n')
    write(tmp_path / "c.txt", "事件标题：丙\n时间：1991年\n地点：广州\n\n正文一\n---\n\n---\n无标签\n---\n事件标题：丁\n事件标题：戊")
    corpus, skipped = events.read_corpus(spark, str(tmp_path))
    rows = {r["title"]: r for r in corpus.collect()}
    assert corpus.count() == 6 and set(rows) == {"甲", "未命名事件", "乙", "丙", "戊"}
    assert rows["甲"]["location"] == "未知地点" and rows["乙"]["location"] == "" and rows["乙"]["keywords"] == ["a", "b"]
    assert rows["丙"]["content"] == "正文一" and rows["戊"]["content"] == "事件标题：丁\n事件标题：戊"
    assert [r["file"] for r in skipped.collect()] == ["broken.json"]


def test_skipped_files_are_reported_with_reasons(spark, tmp_path):
    header = "title,date,location,content,keywords"
    write(tmp_path / "good.csv", header + "\n甲,1990,here,text,\"a,b\"\n")
    write(tmp_path / "short.csv", header + "\n乙,1990,here,text,a\n丙,1991\n丁,1992,x,y,z,too,many\n")
    (tmp_path / "bytes.csv").write_bytes(header.encode() + b"\n\xff\xfe,1990,a,b,c\n")
    write(tmp_path / "other.csv", "content,title\nbody,戊\n")
    (tmp_path / "bytes.txt").write_bytes(b"\xff\xfe text")
    write(tmp_path / "blank.txt", "---\n\n---\n")
    write(tmp_path / "fine.txt", "事件标题：己\n正文")
    write(tmp_path / "broken.json", "[{")
    corpus, skipped = events.read_corpus(spark, str(tmp_path))
    assert sorted(r["title"] for r in corpus.collect()) == sorted("甲乙戊己")
    assert {(r["file"], r["reason"]) for r in skipped.collect()} == {
        ("short.csv", "rows with a wrong number of cells: 2"), ("bytes.csv", "invalid utf-8"), ("bytes.txt", "invalid utf-8"),
        ("blank.txt", "no events"), ("broken.json", "invalid json")}


def test_any_encoding(spark, tmp_path):
    for name, encoding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "gb18030")):
        write(tmp_path / f"{name}.txt", "中文正文", encoding)
    got = files.read_text_any_encoding(spark, str(tmp_path))
    assert {r["text"] for r in got.collect()} == {"中文正文"} and got.count() == 3


def test_recursive_records(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps({"x": {"y": [{"title": "甲", "keywords": ["a", "b"]}, {"z": [{"content": {"k": "v", "m": "w"}}]}]}}, ensure_ascii=False))
    write(tmp_path / "b.json", "not json")
    rows = files.read_recursive_json(spark, str(tmp_path)).orderBy("record_index").collect()
    assert [r["text"] for r in rows] == ["标题: 甲\n关键词: a、b", "正文: v w"]


def test_flatten_stops_at_depth(spark):
    deep = {"title": "top"}
    for _ in range(14):
        deep = {"n": deep}
    df = spark.createDataFrame([("p", json.dumps(deep)), ("q", '{"a": [{"text": "x"}], "title": "y"}')], "path string, text string")
    assert {r["path"]: r["text"] for r in files.flatten_json_text(df).collect()} == {"p": "", "q": "x\n\ny"}


def test_graph_tables_old_names_and_gaps(spark, tmp_path):
    spark.createDataFrame([("1", "A", "desc")], "id string, name string, description string").write.parquet(f"{tmp_path}/create_final_entities.parquet")
    spark.createDataFrame([("A", "B")], "source_title string, target_title string").write.parquet(f"{tmp_path}/relationships.parquet")
    tables = files.read_graph_tables(spark, str(tmp_path))
    assert tables["entities"].first()["title"] == "A" and files.is_ready(tables)
    assert tables["relationships"].first().asDict() == {"source": "A", "target": "B", "description": None, "weight": 1.0}
    assert tables["communities"].count() == 0 and tables["communities"].columns == ["community", "title", "summary", "full_content"]


def test_line_splitters(spark):
    df = spark.createDataFrame([(1, "前言\n● 1980年 设立\n续行\n\n●扩建\n3.第三\nx")], "d int, t string")
    assert [(r["content"], r["date"]) for r in events.split_bullets(df, "d", "t").orderBy("event_no").collect()] == [
        ("1980年 设立\n续行", "1980年"), ("扩建\n3.第三\nx", "未知"),
    ]
    assert [r["content"] for r in events.split_numbered(df, "d", "t").collect()] == ["第三"]
    assert [r["content"] for r in events.split_blocks(df, "d", "t").orderBy("event_no").collect()] == ["前言 ● 1980年 设立 续行", "●扩建 3.第三 x"]


def test_year_headings(spark):
    df = spark.createDataFrame([(1, "序\n一九七八年\n12月18日 开会\n散会\n\n1979年\n建交")], "d int, t string")
    rows = events.carry_forward_year(df, "d", "t").orderBy("section", "event_no").collect()
    assert [(r["date"], r["content"]) for r in rows] == [("一九七八年 12月18日", "12月18日 开会"), ("一九七八年", "散会"), ("1979年", "建交")]


def test_merge_numbers_documents(spark):
    df = spark.createDataFrame([(5, "甲", "", None, "x"), (3, "", None, None, ""), (9, "乙", "1988年", "深圳", None)], "o int, title string, date string, location string, content string")
    rows = events.merge_to_documents(df, "o").orderBy("o").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("0", "甲\nx"), ("1", "乙\n(1988年)\n地点：深圳")]


@pytest.mark.parametrize("broken, fixed", [
    ('{"a": "x "y" z"}', '{"a": "x “y” z"}'), ('{"a": "q\\"q", "b": 1}', '{"a": "q\\"q", "b": 1}'), ('["a" , "b"]', '["a" , "b"]'),
    ('{"a": "one "two" three "four" x", "b": ""q""}', '{"a": "one “two” three “four” x", "b": "“q”"}'), ('{"a": "x\\\\", "b": "y"}', '{"a": "x\\\\", "b": "y"}'),
    ("no quotes", "no quotes"), ('"', '"'), (None, None),
])
def test_repair_quotes(spark, broken, fixed):
    df = spark.createDataFrame([(broken,)], "t string")
    assert files.repair_json_quotes(df, "t").first()["t"] == fixed


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, "c")], "src string, n int, x string")
    sinks.write_separated(df, "src", "n", "x", f"{tmp_path}/sep")
    assert spark.read.text(f"{tmp_path}/sep/src=s", wholetext=False).count() > 0
    details = spark.createDataFrame([("a", "m", 1.0), ("b", "n", 3.0)], "id string, label string, f1 double")
    averages = details.groupBy("label").agg(F.avg("f1").alias("f1"))
    sinks.export_batch(details, averages, averages.limit(1), "label", ["f1"], ["id"], f"{tmp_path}/batch")
    table = spark.read.option("header", True).csv(f"{tmp_path}/batch/table").collect()
    assert {(r["id"], r["f1"]) for r in table} == {("a", "1.0"), ("b", "3.0"), ("AVERAGE", "2.0")}
    sinks.export_benchmark(averages, details, averages, f"{tmp_path}/bench", "label")
    assert spark.read.option("header", True).csv(f"{tmp_path}/bench/details").count() == 2
    sinks.write_chunks_and_vectors(df.withColumnRenamed("n", "chunk_index"), df.selectExpr("n AS chunk_index", "1 AS v"), df, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index/chunks").count() == 5


def test_incremental_update_equals_rebuild(spark):
    old = spark.createDataFrame([(i, f"文本{i} " * 60) for i in range(20)], "doc_id int, text string")
    new = spark.createDataFrame([(i, f"文本{i if i % 3 else -i} " * 60) for i in range(5, 25)], "doc_id int, text string")
    diff = incremental.manifest_diff(incremental.manifest(old), incremental.manifest(new))
    updated = incremental.update_chunks(chunking.paragraph_chunks(old), new, diff)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(updated) == key(chunking.paragraph_chunks(new))
    same = incremental.manifest_diff(incremental.manifest(old), incremental.manifest(old, settings="size=200"))
    assert {r["status"] for r in same.collect()} == {"changed"}


def test_stream_ingest_picks_up_new_files_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = ingest.stream_documents(spark, str(folder), "doc_id long, text string", max_files=1)
        ingest.ingest_chunks(stream, out, state).awaitTermination()
        return spark.read.parquet(out)

    write(folder / "a.json", "\n".join(json.dumps({"doc_id": i, "text": "正文" * 300 * i}) for i in range(1, 4)))
    first = run().count()
    write(folder / "b.json", "\n".join(json.dumps({"doc_id": i, "text": "正文" * 300 * i}) for i in range(3, 6)))
    rows = run()
    batch = spark.createDataFrame([(i, "正文" * 300 * i) for i in range(1, 6)], "doc_id long, text string")
    expected = chunking.paragraph_chunks(batch)
    key = lambda df: sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in df.collect())
    assert key(rows) == key(expected) and first < rows.count() and run().count() == rows.count()


def test_jobs_and_resume(spark):
    segments = spark.createDataFrame([(1,), (2,)], "seg int")
    jobs = benchmark.jobs(segments, benchmark.retrieval_modes("hybrid", True))
    assert jobs.count() == 4
    done = jobs.where("seg = 1 AND mode = 'hybrid'")
    assert benchmark.resume_jobs(jobs, done, ["seg", "mode"]).count() == 3
    assert benchmark.retrieval_modes("keyword", False) == [("keyword", "graph:keyword")]


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,date,content\nA,1980年,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('date,content,title,keywords\n1990年,"y, z",B,"k, l"\n', encoding="utf-8")
    rows = {r["title"]: r for r in events.read_events_csv(spark, f"{tmp_path}/*.csv").collect()}
    assert (rows["A"]["date"], rows["A"]["content"], rows["A"]["keywords"]) == ("1980年", "x", None)
    assert (rows["B"]["date"], rows["B"]["content"], rows["B"]["keywords"]) == ("1990年", "y, z", ["k", "l"])


def test_nested_reports_hold_bounded_parts(spark):
    segments = spark.createDataFrame([("d", i, float(i), None) for i in range(7)] + [("e", 0, 1.0, 0.5)], "doc string, idx int, overall double, fact_score double")
    metrics = spark.createDataFrame([("d", i, "m", float(i), 1.0) for i in range(6)] + [("e", 0, "m", 2.0, 4.0), ("e", 0, "a", 1.0, 1.0)],
                                    "doc string, idx int, name string, value double, max_value double")
    names = spark.createDataFrame([("e", 0, "x"), ("e", 0, "b"), ("e", 0, "x")], "doc string, idx int, name string")
    whole = spark.createDataFrame([("d", "total", 9.0, 10.0)], "doc string, name string, value double, max_value double")
    gate = spark.createDataFrame([("d", False, 3.0, [2])], "doc string, passed boolean, overall_score double, chapters array<int>")
    report = sinks.nested_report(segments, metrics, names, whole, whole.limit(0), gate, "doc", "idx", 3)
    rows = {(r["doc"], r["part"]): r for r in report.collect()}
    assert set(rows) == {("d", 0), ("d", 1), ("d", 2), ("e", 0)}
    assert [[s["segment_index"] for s in rows["d", p]["segments"]] for p in range(3)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert rows["d", 1]["segment_count"] == 7 and rows["d", 2]["segments"][0]["metrics"] is None
    assert rows["e", 0]["segments"][0]["entities"] == ["b", "x"] and rows["e", 0]["segments"][0]["metrics"]["m"]["max"] == 4.0
    assert rows["d", 0]["document"]["total"]["value"] == 9.0 and rows["d", 0]["quality_gate"]["chapters_to_regenerate"] == [2]
    assert rows["e", 0]["quality_gate"] is None and rows["e", 0]["cross_chapter"] is None


def test_a_stream_reads_a_table_of_one_file_or_of_a_folder(spark, tmp_path):
    from annalist.plans.ingest import stream_table

    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "in" / "labels.parquet")
    for number, name in enumerate(("documents", "labels")):
        out = f"{tmp_path}/{number}"
        ingest.ingest_chunks(stream_table(spark, str(tmp_path / "in"), name), f"{out}/table", f"{out}/state", minimum=0).awaitTermination()
        assert spark.read.parquet(f"{out}/table").select("doc_id").distinct().count() == 19


def test_stream_ingest_of_all_rows_equals_its_sql_on_odd_documents(spark, tmp_path):
    import __spark_entry__ as entry
    from oracle import compare
    import duckdb

    texts = ["x" * 901, "", " \r\n ", "a\r\n" * 301, "a\u0001b", " " * 5 + "y" * 900, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "z" * 901), (0, "x" * 901), (None, "n"), (None, "m" * 1000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(entry.queries()["q_stream_ingest"](spark, str(tmp_path)), con, entry.oracle_sql()["q_stream_ingest"]) is None
