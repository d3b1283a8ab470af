import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import REFUSAL
from tessera.operators import answers as A
from tessera.operators.contexts import prompt_records, sampled_docs, share, subsample, train_val
from tessera.operators.generate import OutOfQuota, Spacing, answered, first_sentence, generate

ROWS = [
    ("1", "m", [1], 3, "đúng [1][2]", 10.0), ("2", "m", [1], 3, "sai [3] [9]", 20.0), ("3", "m", [2], 3, REFUSAL, 30.0),
    ("4", "m", [], 3, "trả lời", None), ("5", "n", None, 2, None, 5.0),
]
SCHEMA = "id string, model string, gold array<int>, n_docs int, answer string, latency_ms double"


def test_scores_and_summary(spark):
    scored = A.scored(spark.createDataFrame(ROWS, SCHEMA))
    by = {r.id: r for r in scored.collect()}
    assert by["1"].cite_precision == 0.5 and by["1"].cites_gold and not by["1"].invalid_cite
    assert by["2"].invalid_cite and not by["2"].cites_gold and by["3"].refused and by["3"].cite_precision is None
    assert by["4"].uncited and not by["4"].answerable and by["5"].uncited
    s = {r.model: r for r in A.summary(scored, ["model"]).collect()}["m"]
    assert (s.n, s.n_answerable, s.n_negative) == (4, 3, 1)
    assert s.answer_rate == 0.6667 and s.gold_cite_rate == 0.3333 and s.refusal_acc == 0.0 and s.latency_ms == 20.0
    assert s.cite_precision == 0.25 and s.uncited_rate == 0.3333


def test_gate(spark):
    pairs = [(0.9, True), (0.8, True), (0.7, True), (0.6, False), (0.2, False), (0.7, False)]
    points = A.gate_sweep(spark.createDataFrame(pairs, "score double, answerable boolean"))
    got = {r.threshold: r for r in points.collect()}
    for t in (0.0, 0.2, 0.6, 0.7, 0.8, 0.9, math.inf):
        keep = sum(s >= t for s, a in pairs if a) / 3
        block = sum(s < t for s, a in pairs if not a) / 3
        assert (got[t].keep_answerable, got[t].block_negative) == (round(keep, 6), round(block, 6))
    assert A.choose_threshold(points).first().threshold == 0.7
    assert A.choose_threshold(points, 0.6).first().threshold == 0.8
    low = A.gated(spark.createDataFrame([(0.4, "a"), (0.5, "b"), (None, "c")], "s double, answer string"), F.col("s"), 0.5)
    assert [r.answer for r in low.collect()] == [REFUSAL, "b", REFUSAL]


def test_sampling_is_fixed_by_the_seed(spark):
    gold = spark.createDataFrame([(f"q{i}", f"g{j}") for i in range(40) for j in range(i % 4 + 1)], "query string, doc string")
    hits = spark.createDataFrame([(f"q{i}", d, r + 1) for i in range(40) for r, d in enumerate(["g0", "x", "y", "z", "w"])], "query string, doc string, rank int")
    once, twice = (sorted(map(tuple, sampled_docs(gold, hits, neg_ratio=0.5).collect())) for _ in range(2))
    assert once == twice
    kinds = {}
    for q, kind, doc, place, is_gold in once:
        kinds.setdefault((q, kind), []).append((place, doc, is_gold))
    assert len(kinds) == 40 and {k for _, k in kinds} == {"negative", "answerable"}
    for (_, kind), shown in kinds.items():
        assert [p for p, _, _ in sorted(shown)] == [1, 2, 3]
        assert any(g for _, _, g in shown) == (kind == "answerable")
    coin = spark.range(2000).select(F.avg((share(1, "id") < 0.2).cast("int")).alias("p")).first().p
    assert 0.15 < coin < 0.25


def test_split_and_subsample(spark):
    rows = spark.createDataFrame([(f"r{i}", i) for i in range(101)], "id string, n int")
    parts = train_val(rows, "id", 0.1)
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"val": 10, "train": 91}
    assert parts.columns == ["id", "n", "part"]
    articles = spark.createDataFrame([(f"a{i}",) for i in range(30)], "article_id string")
    keep = spark.createDataFrame([("a1",), ("a2",), ("a1",), ("gone",)], "article_id string")
    for size, want in ((10, 10), (1, 2), (99, 30)):
        got = {r.article_id for r in subsample(articles, keep, size).collect()}
        assert len(got) == want and {"a1", "a2"} <= got


def test_prompt_record(spark):
    shown = spark.createDataFrame([("q", "answerable", "b", 1, False), ("q", "answerable", "a", 2, True)], "query string, kind string, doc string, place int, is_gold boolean")
    docs = spark.createDataFrame([("q", "a", "Điều 1, A", "một"), ("q", "b", "Điều 2, B", "hai")], "query string, doc string, citation string, text string")
    r = prompt_records(shown, docs, spark.createDataFrame([("q", "hỏi?")], "query string, text string")).first()
    assert r.gold == [2] and r.n_docs == 2 and r.prompt[1]["content"].startswith("NGỮ CẢNH:\n[1] (Điều 2, B)\nhai\n\n[2] (Điều 1, A)\nmột")


def test_errors_and_quota_are_rows(spark):
    def make():
        def model(prompt):
            text = prompt[-1]["content"]
            if text == "bad":
                raise ValueError("boom")
            if text == "stop":
                raise OutOfQuota
            return text.upper()

        return model

    prompts = [(str(i), [("user", t)]) for i, t in enumerate(["a", "bad", "c", "stop", "e"])]
    df = spark.createDataFrame(prompts, "id string, prompt array<struct<role string, content string>>").coalesce(1)
    got = {r.id: (r.answer, r.status) for r in generate(df, make, callers=1).collect()}
    assert got["1"] == (None, "error: boom") and got["3"] == (None, "quota") and ("A", "ok") in got.values()


def test_spacing():
    now, slept = [0.0], []
    s = Spacing(60, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        s.wait()
    assert slept == [1.0, 2.0]
    free = Spacing(0, clock=lambda: 0.0, sleep=lambda _: pytest.fail("slept"))
    free.wait(), free.wait()


def test_pipeline_gates_before_the_model(spark):
    articles = spark.createDataFrame([("l+1", "Điều 1. T", "đất đai. thêm"), ("l+2", "", "nhà")], "article_id string, title string, text string")
    docs = articles.select(F.col("article_id").alias("doc"), F.concat_ws("\n", "title", "text").alias("text"))
    asked = spark.createDataFrame([("q1", "đất đai"), ("q2", "đất khác hẳn"), ("q3", "không")], "query string, text string")
    hits = spark.createDataFrame([("q1", "l+1"), ("q2", "l+1")], "query string, doc string")
    got = {r["query"]: r for r in answered(hits, asked, docs, articles, first_sentence, threshold=0.5).collect()}
    assert not got["q1"].gated and got["q1"].cited[0]["citation"] == "Điều 1, L" and got["q1"].answer.endswith("[1].")
    assert got["q2"].gated and got["q2"].answer == REFUSAL and got["q3"].gated and got["q3"].top_score is None
