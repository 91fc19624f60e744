import pytest
from pyspark.sql import functions as F

from annalist.functions import dates, records, text as tx
from annalist.operators import quality, ranking, terms


@pytest.mark.parametrize(
    "text, year, strict",
    [
        ("1988年夏天", "1988", "1988"), ("88年夏天", "1988", "1988"), ("08年", "2008", "2008"),
        ("一九八八年", "1988", "1988"), ("二零零八年", "2008", "2008"), ("二〇〇八年", "2008", None),
        ("一九四九年", "1949", "2049"), ("code 1999 x", "1999", "1999"), ("no year", None, None),
    ],
)
def test_extract_year(one, text, year, strict):
    assert one(dates.extract_year("text"), text) == year
    assert one(dates.extract_year("text", strict=True), text) == strict


@pytest.mark.parametrize("text, month", [("8月", "8"), ("八月", "8"), ("十二月", "12"), ("十月", "10"), ("无", None)])
def test_extract_month(one, text, month):
    assert one(dates.extract_month("text"), text) == month


@pytest.mark.parametrize(
    "text, place",
    [
        ("我来到深圳工作", "深圳"), ("从广州来到深圳", "深圳"), ("从上海出发去北京", "北京"), ("在老家种地", None),
        ("他在石桥村教书", "石桥村教书"), ("什么也没有", None),
    ],
)
def test_extract_location(one, text, place):
    assert one(dates.extract_location("text"), text) == place


def test_years_keep_first_seen_order(one):
    assert one(dates.extract_years("text"), "2008年与一九八八年，又2008年，二〇一〇年") == ["2008", "1988", "2010"]
    assert one(dates.temporal_label(dates.extract_years("text")), "2008年与一九八八年") == "1988-2008"
    assert one(dates.year_span(dates.extract_years("text")), "2008年与一九八八年") == 20


def test_keyword_set_has_full_years(one):
    assert one(F.array_sort(tx.keyword_set("text")), "深圳1988年 ab Shen 12345") == ["1988", "SHEN", "深圳"]


def test_ngrams(one):
    assert sorted(one(tx.char_ngrams("text", 2), "a b\nab")) == ["ab", "ba"]
    assert one(tx.char_ngrams("text", 9), "short") == []


def test_truncate_at_boundary(one):
    text = "甲" * 30 + "。" + "乙" * 30
    assert one(tx.truncate_at_boundary("text", 40), text) == "甲" * 30 + "。"
    assert one(tx.truncate_at_boundary("text", 40), "丙" * 60) == "丙" * 40 + "…"
    assert one(tx.truncate_at_boundary("text", 80), text) == text


def test_brief(one):
    assert one(tx.brief("text"), "短句。第二句在这里！第三句") == "短句。第二句在这里"
    assert one(tx.brief("text"), "长" * 70 + "。") == "长" * 60 + "…"


def test_rule_entities(one):
    found = one(tx.rule_entities("text"), "老张和王德明去深圳见李小二队长，母亲在家。")
    assert found == ["老张", "李小二队长", "王德明", "母亲", "深圳"]


def test_localize_name(one):
    assert one(tx.localize_name(F.lit("SHENZHEN"), "text"), "City (深圳市) of") == "深圳市"
    assert one(tx.localize_name(F.lit("深圳"), "text"), "x (广州)") == "深圳"
    assert one(tx.localize_name(F.lit("ACME"), "text"), "plain") == "ACME"


def test_mentions(one):
    match = lambda name, **o: tx.mention_match(F.lit(name), "text", **o)
    assert one(match("SHENZHEN CITY"), "他去了深圳")
    assert one(match("深圳"), "the Shenzhen plan")
    assert one(match("庚申年猴票"), "庚申年猴票很贵")
    assert not one(match("北京"), "上海的夜")
    assert not one(match("XQABCJ"), "zz abc zz") and one(match("XQABCJ", any_trigram=True), "zz abc zz")
    assert one(tx.names_match(F.lit("北京市"), F.lit("BEIJING")))
    assert one(tx.names_match(F.lit("深圳湾"), F.lit("Shenzhen")))
    # Names lose their blanks before the lookup, so a longer spelling is not recognised.
    assert not one(tx.names_match(F.lit("SHENZHEN CITY"), F.lit("深圳")))
    assert not one(tx.names_match(F.lit("上海"), F.lit("BEIJING")))


def test_verdicts(one):
    for answer, verdict in {"supported": "SUPPORTED", "Not supported": "NOT_SUPPORTED", "NOT sure": "NOT_SUPPORTED", "?": "UNSURE"}.items():
        assert one(records.normalize_verdict("text"), answer) == verdict


def test_judge_answers(one):
    scores = records.judge_scores("text")
    answer = 'ok {"scores": [{"entity": "深圳市", "score": 7}, {"entity": "b", "score": -1}]} bye'
    assert one(records.judged_score(scores, F.lit("深圳")), answer) == 3.0
    assert one(records.judged_score(scores, F.lit("b")), answer) == 0.0
    assert one(records.judged_score(scores, F.lit("深圳")), "not json") == 0.0


def test_length_values(one):
    assert tuple(one(records.parse_length_range("text"), "400-200字")) == (200, 400)
    assert tuple(one(records.parse_length_range("text"), "300字")) == (250, 500)
    assert tuple(one(records.parse_length_range("text"), "")) == (200, 500)
    assert one(records.fallback_config(F.lit("200-400")))["max_tokens"] == 800
    assert one(records.fallback_config(F.lit("?")))["length_hint"] == "400-800字"
    assert tuple(one(records.clamp_range(F.lit(500), F.lit(20)))) == (80, 500)


def test_fact_decomposition(one):
    text = "甲乙丙丁戊己。甲乙丙丁戊己庚辛！短句。完全不同的句子"
    assert one(tx.decompose_facts("text"), text) == ["甲乙丙丁戊己", "完全不同的句子"]
    assert one(tx.decompose_facts("text"), "短") == ["短"]
    assert one(tx.decompose_facts("text", whole_if_none=False), "短") == []


def test_highlight(one):
    names = F.array(F.lit("深圳"), F.lit("深圳大学"), F.lit("x"))
    assert one(tx.highlight_terms("text", names), "深圳大学在深圳") == "**深圳**大学**在**深圳**"


def test_ndcg_golden(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id int, rank int, name string")
    grades = spark.createDataFrame([(1, "a", 2.0)], "query_id int, name string, grade double")
    relevant = spark.createDataFrame([(1, 3), (2, 0)], "query_id int, n_relevant int")
    rows = {r["query_id"]: r for r in ranking.judged_metrics(results, grades, relevant).collect()}
    assert round(rows[1]["ndcg_3"], 4) == 0.3129 and rows[1]["mrr"] == 1.0
    assert rows[2]["ndcg_3"] == 0.0 and rows[2]["mrr"] == 0.0


def test_ranking_uses_rank_order_and_aliases(spark):
    results = spark.createDataFrame([(1, 1, "北京"), (1, 2, "SHENZHEN"), (1, 3, "深圳")], "query_id int, rank int, name string")
    truth = spark.createDataFrame([(1, "深圳"), (2, "x")], "query_id int, name string")
    rows = {r["query_id"]: r for r in ranking.ranking_metrics(results, truth).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["mrr"]) == (0.5, 1.0, 0.5)
    assert rows[2]["f1"] == 0.0 and not rows[2]["hit_10"]


def test_length_score_bounds(one):
    for n, score in {300: 1.0, 150: 0.7, 600: 0.7, 175: 0.85, 149: 0.3, 601: 0.3}.items():
        assert one(F.round(quality.length_score(F.lit(n)), 6)) == score


def test_char_phrases(one):
    phrases = one(terms.char_phrase_candidates("text"), "知青下乡 知青下乡")
    assert phrases.count("知青") == 2 and phrases.count("知青下") == 2


def test_batch_verdicts_of_odd_answers(one):
    from annalist.functions.records import batch_verdicts

    read = lambda text: [(r["position"], r["content"], r["verdict"]) for r in one(batch_verdicts("text"), text)]
    assert read('```json\n{"results": [{"fact": " a ", "verdict": "Not supported"}]}\n```') == [(0, "a", "Not supported")]
    assert read('Sure: {"results": [{"fact": "a", "supported": "false"}, 7, {"supported": true}]} done') == [
        (0, "a", "NOT_SUPPORTED"), (1, "", "UNSURE"), (2, "", "SUPPORTED")]
    assert read('{"results": {}}') == read('{"other": []}') == read("{broken") == read("") == []


def test_table_functions_bound_their_arguments(spark):
    from annalist.functions import sql
    from annalist.operators import chunking

    sql.register(spark)
    texts = spark.createDataFrame([(1, "x" * 950), (2, " y " * 400), (3, ""), (4, "é" * 201), (5, None)], "doc_id long, text string")
    texts.createOrReplaceTempView("_odd")
    for size, overlap in ((900, 150), (10, 5), (200, 500), (300, -4)):
        got = spark.sql(f"SELECT d.doc_id, c.chunk_index, c.text FROM _odd d, LATERAL window_chunks(d.text, {size}, {overlap}) c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.window_chunks(texts, size=size, overlap=overlap).collect()))
    got = spark.sql("SELECT d.doc_id, c.unit_index, c.text FROM _odd d, LATERAL token_chunks(d.text, 120, 20) c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.token_chunks(texts, size=120, overlap=20).collect()))


def test_a_number_inside_a_longer_one_is_not_in_the_source(one):
    from annalist.functions.columns import text_array
    from annalist.operators.novelty import fact_grounding

    checked = lambda source: fact_grounding(text_array(["1987", "特区"]), F.lit(source), F.lit("无"), text_array([]), {})["unsupported"]
    assert one(checked("Customer#000001987在特区")) == ["1987"]
    assert one(checked("1987年，经济特区")) == []
