"""Text functions, tool wire formats and scorers."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from credence.functions import scoring as S, text as X, toolwire as T, usage as US
from credence.operators import evidence as E, proposals as PR


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_sentences():
    t = "Alice likes tea. Alice drinks tea. Bob codes."
    assert [t[a:b] for a, b in X.sentence_spans(t)] == ["Alice likes tea.", "Alice drinks tea.", "Bob codes."]
    t = "<think>Hm. Ok</think>他来了。真的？ yes\nA.\nlong line"
    assert [t[a:b] for a, b in X.sentence_spans(t)] == ["Hm. Ok", "他来了。真的？", "yes\nA.", "long line"] or all(t[a:b].strip() == t[a:b] for a, b in X.sentence_spans(t))
    assert X.sentence_spans("") == X.sentence_spans("  \n") == X.sentence_spans(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n<>/。", max_size=80))
def test_sentence_spans_are_exact_and_in_order(t):
    spans = X.sentence_spans(t)
    assert all(0 <= a < b <= len(t) and t[a:b] == t[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))



def test_fuzzy():
    assert X.fuzzy("abc", "xaxbxc") is not None and X.fuzzy("abc", "acb") is None
    assert X.fuzzy("abc", "abc") < X.fuzzy("abc", "abcd") < X.fuzzy("abc", "a-x-b-x-c")
    assert X.fuzzy("codex5", "5codex") is not None


def test_json_and_names(spark):
    assert X.first_object('noise ```json\n{"a": {"b": 1}}\n``` {"c": 2}') == '{"a": {"b": 1}}'
    assert X.first_object("{bad") is None
    assert one(spark, X.sanitize_name(F.col("t")), t="__a b/c.d__") == "a_b_c.d"
    assert one(spark, X.trimmed_span(F.col("t"), F.lit(2), F.lit(9)), t="ab  cd  ef").asDict() == {"start": 4, "end": 9}
    assert one(spark, X.estimate_tokens(F.col("t")), t="a" * 10) == 2 and one(spark, X.estimate_tokens(F.col("t")), t="") == 1


def test_answers_with_units(spark):
    f = lambda text, a, q: one(spark, X.bears_answer(F.col("t"), F.col("a"), F.col("q")), t=text, a=a, q=q)
    assert f("He stayed 11 months.", "11", "For how many months?") and not f("On May 11, after months", "11", "For how many months?")
    assert f("The Eiffel-Tower!", "eiffel tower", "") and not f("anything", "", "")


LEGACY = "[Tool result: web_search]\n[1] First title\nURL: https://a.org/x\nSnippet: some  text\nmore\nSource type: news\n[2] Second\nURL: https://b.org/y\n"


def test_tool_results(spark):
    r = spark.createDataFrame([("a", 1, LEGACY)], "item_id string, turn_id long, content string")
    x = PR.rule_result_nodes(r, max_results=1).first()
    assert x["stance"] == "recalled" and x["tool_name"] == "web_search" and len(x["tool_result_items"]) == 1
    assert x["tool_result_items"][0].asDict() == {"rank": 1, "title": "First title", "url": "https://a.org/x", "snippet": "some text more", "source_type": "news"}
    assert "returned 2 result(s)" in x["text"] and "1 additional result(s)" in x["text"] and x["entities"] == ["web_search", "a.org"]
    xml = '<tool_result>{"tool_call_id": "c1", "name": "fetch", "content": "hello", "is_error": false}</tool_result><tool_result>[1]</tool_result><tool_result>{bad</tool_result>'
    y = PR.rule_result_nodes(r.withColumn("content", F.lit(xml))).collect()
    assert len(y) == 1 and y[0]["tool_call_id"] == "c1" and y[0]["tool_result_items"][0]["snippet"] == "hello"


def test_tool_calls(spark):
    c = '<tool_call>{"id": "1", "name": "s", "arguments": {"q": "a b"}}</tool_call> <tool_call>{"name": "t", "arguments": {"x": 1}}</tool_call>'
    assert [(x["id"], x["name"], x["query"]) for x in one(spark, T.tool_calls(F.col("c")), c=c)] == [("1", "s", "a b"), (None, "t", None)]
    assert one(spark, T.is_pure_tool_call(F.col("c")), c=c) and not one(spark, T.is_pure_tool_call(F.col("c")), c=c + "x")
    assert len(one(spark, T.query_calls(F.col("c")), c=c)) == 1
    assert one(spark, T.strip_valid_tool_calls(F.col("c")), c=c + " rest <tool_call>{bad</tool_call>") == "rest <tool_call>{bad</tool_call>"
    assert [tuple(x) for x in one(spark, T.tool_call_spans(F.col("c")), c="ab<tool_call>{}</tool_call>")] == [(2, 27)]


@pytest.mark.parametrize("a, b, want", [("$1,234", "1234", True), ("25%", "25%", True), ("Alpha, Beta", "alpha,beta", True), ("41", "42", False), ("x", "42", False), ("A b!", "a B", True), ("a, b", "a", False)])
def test_gaia(spark, a, b, want):
    assert one(spark, S.gaia_match(F.col("a"), F.col("b")), a=a, b=b) is want


def test_hotpot_and_choices(spark):
    x = one(spark, S.hotpot(S.final_answer(F.col("r")), F.lit("Eiffel Tower")), r="Well.\nFINAL ANSWER: the Eiffel Tower")
    assert x["exact_match"] == 1 and x["f1"] == 1
    assert one(spark, S.multiple_choice(F.col("r")), r="The answer is (J).") == "J"
    assert one(spark, S.multiple_choice(F.col("r")), r="no idea") == ""
    assert one(spark, S.final_answer(F.col("r")), r=" a \n\n b ") == "b"
    assert one(spark, S.is_quota_error(F.col("r")), r="Error 429: Too Many Requests") and one(spark, S.judge_verdict(F.col("r")), r="correct: no\ncorrect: yes")
    u = one(spark, US.coerced_usage(F.parse_json(F.col("u"))), u='{"input_tokens": 3, "output_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 2}}')
    assert u.asDict() == {"prompt": 3, "completion": 4, "total": 7, "reasoning": 2, "cost": None}


def test_marked_pieces(spark):
    t = spark.createDataFrame([("t", "abcdefgh")], "text_id string, text string")
    m = spark.createDataFrame([("t", 1, 5, 7), ("t", 3, 20, 8)], "text_id string, start int, end int, node_id long")
    got = [(x["piece"], x["node_ids"]) for x in E.marked_pieces(t, m).orderBy("start").collect()]
    assert got == [("a", []), ("bc", [7]), ("de", [7, 8]), ("fgh", [8])]


def test_entity_spans(spark):
    s = spark.createDataFrame([("t", 0, 5, "A", 0.5), ("t", 3, 9, "B", 0.9), ("t", 10, 12, "C", 0.1)], "text_id string, start int, end int, label string, confidence double")
    assert [x["label"] for x in E.entity_spans(s).orderBy("start").collect()] == ["B", "C"]


def python_peak(f, *columns):
    """Bytes of Python objects that a function of Arrow columns holds at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        f.func(*columns)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sentences_of_a_batch_are_not_python_objects():
    import pyarrow as pa

    texts = pa.array(["One is here. Two is there. " * 40, None] * 500)
    assert python_peak(X.split_sentences, texts) < 6_000_000  # 40,000 sentences; some 20 MB as objects
    assert X.split_sentences.func(pa.array(["Hm. It is so.", None, ""])).to_pylist() == [[{"index": 0, "text": "Hm. It is so.", "start": 0, "end": 13}], [], []]


def test_scored_texts_of_a_batch_are_not_python_objects():
    import pyarrow as pa

    texts = pa.array(["the station " * 500, None] * 500)
    assert python_peak(X.fuzzy_score, pa.array(["the ion"] * 1000), texts) < 1_000_000  # 3 MB of text
    assert X.fuzzy_score.func(pa.array(["the ion", None, "a", " / "]), pa.array(["xx", "a", None, "a"])).to_pylist() == [None, None, None, 0.0]
