import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

TEXTS = ["Quyết định 12/CP", "chữ ký", "a_b ½ m³ 12", "", "  x　", None, "ΑΣ λ", "日本語 テスト", "é 가", "Ķ", "áéí​o"]


def column(spark, f, texts=TEXTS):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_nfc_and_words(spark):
    assert column(spark, T.nfc) == [None if t is None else unicodedata.normalize("NFC", t) for t in TEXTS]
    want = [re.findall(r"\w+", unicodedata.normalize("NFC", t or "").lower()) for t in TEXTS if t != "ΑΣ λ"]
    assert [w for w, t in zip(column(spark, T.words), TEXTS) if t != "ΑΣ λ"] == want


@pytest.mark.parametrize("tokens, want", [([], []), (["a"], ["a"]), (["a", "b", "a"], ["a", "b", "a", "a_b", "b_a"])])
def test_bigrams(spark, tokens, want):
    assert spark.createDataFrame([(tokens,)], "t array<string>").select(T.with_bigrams(F.col("t"))).first()[0] == want


def test_strip_is_unicode(spark):
    assert column(spark, T.strip, ["  x y　\n", "", None]) == ["x y", "", None]


def test_citation(spark):
    rows = [("10/2019/nđ-cp+5", "Điều 5. Phạm vi"), ("10/2019/nđ-cp+6", "Phạm vi. x"), ("khong", ""), ("a+b+7", None)]
    got = spark.createDataFrame(rows, "i string, t string").select(T.citation(F.col("i"), F.col("t")).alias("c"), T.law_id(F.col("i")).alias("l")).collect()
    assert [r.c for r in got] == ["Điều 5, 10/2019/NĐ-CP", "Điều 6, 10/2019/NĐ-CP", "Điều khong, ", "Điều 7, A+B"]
    assert [r.l for r in got] == ["10/2019/nđ-cp", "10/2019/nđ-cp", "", "a+b"]


def test_prompt_round_trip(spark):
    docs = [[("Điều 1, X", "một [2] (không)\n\nhai"), ("Điều 2, Y", "ba")], [], [("c", "")]]
    df = spark.createDataFrame([("Hỏi gì? ", d, len(d)) for d in docs], "q string, d array<struct<citation string, text string>>, n int")
    got = df.select(T.user_message(F.col("q"), F.col("d")).alias("m"), "n", T.messages(F.col("q"), F.col("d"))[0]["role"].alias("role"))
    back = got.select("role", T.message_question(F.col("m")).alias("q"), T.message_passages(F.col("m"), F.col("n")).alias("p")).collect()
    assert [r.q for r in back] == ["Hỏi gì?"] * 3 and {r.role for r in back} == {"system"}
    assert [r.p for r in back] == [["một [2] (không)\n\nhai", "ba"], [], [""]]
    bad = spark.createDataFrame([("no prompt", 1), (T.CONTEXT_MARK + "[1] (c)\nx" + T.QUESTION_MARK + "q", 2)], "m string, n int")
    assert [r[0] for r in bad.select(T.message_passages(F.col("m"), F.col("n"))).collect()] == [None, None]


def test_citations_and_refusal(spark):
    df = spark.createDataFrame([("[2] x [1] [2] [07] [99999999999]", 3), ("<think>[3]</think> Tôi KHÔNG TÌM THẤY CĂN CỨ.", 3), ("", 0), (None, 2)], "a string, n int")
    got = df.select(T.valid_citations(F.col("a"), F.col("n")).alias("v"), T.invalid_citations(F.col("a"), F.col("n")).alias("i"), T.clean_answer(F.col("a")).alias("c"), T.is_refusal(F.col("a")).alias("r")).collect()
    assert got[0].v == [2, 1] and got[0].i == [7, None]
    assert got[1].c == "Tôi KHÔNG TÌM THẤY CĂN CỨ." and got[1].r
    assert got[2].v == [] and got[3].c is None


def test_verdict_delay_html(spark):
    replies = ['```{"faithful": true}```', 'x {"faithful": false, "reason": "y"} z', "none", '{"faithful": 1}', '{"other": 1}', '{"faithful": tru', None]
    assert column(spark, T.verdict, replies) == [True, False, None, True, None, None, None]
    assert column(spark, T.retry_delay, ["Please retry in 12.5s", "RETRY IN 3 s", "later", None]) == [12.5, 3.0, 30.0, 30.0]
    html = spark.createDataFrame([("a<b [1]\n[3]", 2)], "a string, n int").select(T.answer_html(F.col("a"), F.col("n"))).first()[0]
    assert html == 'a&lt;b <a href="#source-1">[1]</a><br>[3]'
