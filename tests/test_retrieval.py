import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import bm25
from tessera.operators.chunking import chunk_articles, lines_of, windows
from tessera.operators.dense import dense_search
from tessera.operators.ranking import fuse, mean_metrics, overlap, per_query_metrics, rerank

DOCS = [("a", "luật đất đai và nhà ở"), ("b", "đất đất đất"), ("c", "nhà"), ("d", ""), ("e", "nhà"), ("f", "xử phạt vi phạm")]


def brute_bm25(docs, query):
    tokens = {d: re.findall(r"\w+", t.lower()) for d, t in docs}
    avg = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = {}
    for d, ts in tokens.items():
        score = 0.0
        for q in set(re.findall(r"\w+", query.lower())):
            tf = ts.count(q)
            if tf:
                idf = math.log(1 + (len(tokens) - df[q] + 0.5) / (df[q] + 0.5))
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if score:
            out[d] = score
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_search_matches_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc string, text string")
    asked = spark.createDataFrame([("q1", "đất nhà nhà"), ("q2", "không có"), ("q3", ""), ("q4", None), ("q5", "NHÀ")], "query string, text string")
    got = bm25.search_texts(docs, asked, 3).orderBy("query", "rank").collect()
    for q, text in (("q1", "đất nhà nhà"), ("q5", "nhà")):
        want = brute_bm25(DOCS, text)[:3]
        assert [(r.doc, round(float(r.score), 6)) for r in got if r["query"] == q] == [(d, round(s, 6)) for d, s in want]
    assert {r["query"] for r in got} == {"q1", "q5"}
    full = bm25.search(bm25.build(bm25.tokenized(docs, "doc", "text")).weights(), bm25.query_terms(asked, "query", "text"), 3)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, got))


def test_search_plan_limits_groups(spark):
    docs = spark.createDataFrame(DOCS, "doc string, text string")
    plan = bm25.search_texts(docs, docs.toDF("query", "text"), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc string, text string")
    assert bm25.search_texts(empty, spark.createDataFrame([("q", "x")], "query string, text string"), 3).count() == 0
    stats = bm25.build(bm25.tokenized(empty, "doc", "text")).stats.first()
    assert (stats.n_docs, stats.avg_len) == (0, 1e-9)


def test_pooling_keeps_the_best_chunk(spark):
    hits = spark.createDataFrame([("q", f"x#{i}", 9.0 - i, i + 1) for i in range(4)] + [("q", "y#0", 1.0, 5)], "query string, doc string, score double, rank int")
    chunks = spark.createDataFrame([(f"x#{i}", "x") for i in range(4)] + [("y#0", "y")], "chunk_id string, article_id string")
    assert [(r.doc, r.chunk) for r in bm25.pooled(hits, chunks, 1).collect()] == [("x", "x#0")]
    assert [(r.doc, r.rank) for r in bm25.pooled(hits, chunks, 2).orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def test_dense_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<float>")
    got = dense_search(df.where("vec_id < 5"), df, "vec_id", "e", 7, block=64).collect()
    score = np.round(v[:5].astype(float) @ v.astype(float).T, 6)
    for q in range(5):
        want = sorted((-score[q, d], d) for d in range(300) if d != q)[:7]
        assert [(r.doc) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [d for _, d in want]


def test_fusion_and_metrics(spark):
    run = lambda docs: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(docs)], "query string, doc string, rank int")
    fused = fuse([run("abc"), run("bda")], 4).orderBy("rank").collect()
    assert [r.doc for r in fused] == ["b", "a", "d", "c"] and fused[0].score == round(1 / 62 + 1 / 61, 9)
    assert [r.run for r in fused] == [0, 0, 1, 0]
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("none", "a")], "query string, doc string")
    per = {r["query"]: r for r in per_query_metrics(run("xbya"), gold, (1, 2)).collect()}
    assert per["q"].recall_1 == 0 and per["q"].recall_2 == 0.5 and per["q"].mrr == 0.5
    assert per["q"].ndcg == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)
    assert per["none"].mrr == 0
    assert mean_metrics(per_query_metrics(run("xbya"), gold, (1, 2))).first().n_queries == 2


def test_rerank_by_overlap(spark):
    hits = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query string, doc string")
    asked = spark.createDataFrame([("q", "một hai")], "query string, text string")
    docs = spark.createDataFrame([("a", "ba"), ("b", "hai một"), ("c", "hai")], "doc string, text string")
    assert [(r.doc, r.score) for r in rerank(hits, asked, docs, 2).orderBy("rank").collect()] == [("b", 1.0), ("c", 0.5)]
    assert spark.range(1).select(overlap(*(__import__("pyspark").sql.functions.lit(x) for x in ("", "a")))).first()[0] == 0.0


@given(st.text("ab \n", max_size=300), st.integers(5, 40), st.integers(0, 39))
@settings(max_examples=300, deadline=None)
def test_windows_hold_every_line(body, limit, overlap_chars):
    overlap_chars = min(overlap_chars, limit - 1)
    lines = lines_of(body, limit, overlap_chars)
    parts = windows(list(map(len, lines)), limit, overlap_chars)
    covered = [i for a, b in parts for i in range(a, b)]
    assert set(covered) == set(range(len(lines)))
    for a, b in parts:
        assert sum(map(len, lines[a:b])) + (b - a - 1) <= limit + overlap_chars + 1
    for (_, end), (start, _) in zip(parts, parts[1:]):
        assert start <= end and len("\n".join(lines[start:end])) <= overlap_chars


def test_chunks_of_articles(spark):
    long = "\n".join(f"khoản {i} " + "từ " * 20 for i in range(60))
    rows = [("s+1", "T", "ngắn"), ("l+1", "Tên", long), ("e+1", "", ""), ("h+1", "H", "x" * 5000)]
    got = chunk_articles(spark.createDataFrame(rows, "article_id string, title string, text string"), 1000, 100).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.article_id, r.chunk_no)):
        by.setdefault(r.article_id, []).append(r.text)
    assert by["s+1"] == ["T\nngắn"] and by["e+1"] == [""]
    assert all(t.startswith("Tên\n") for t in by["l+1"]) and "khoản 59" in by["l+1"][-1]
    assert sum(len(t) - 2 for t in by["h+1"]) >= 5000
    with pytest.raises(ValueError):
        chunk_articles(spark.createDataFrame(rows, "article_id string, title string, text string"), 100, 100)


@pytest.mark.parametrize("bigrams", [False, True])
def test_sharded_search_equals_the_join(spark, bigrams):
    import random

    from tessera.operators import sharded_search

    rng = random.Random(4)
    text = lambda n: " ".join(f"từ{rng.randrange(30)}" for _ in range(n))
    docs = [(f"d{i}", text(rng.randrange(12))) for i in range(200)] + [("same1", "từ1 từ2"), ("same2", "từ1 từ2"), (None, "từ1"), ("null", None)]
    asked = [(f"q{i}", text(rng.randrange(6))) for i in range(30)] + [("none", "lạ"), ("q0", None), (None, "từ1")]
    d, q = spark.createDataFrame(docs, "doc string, text string").where("doc is not null"), spark.createDataFrame(asked, "query string, text string")
    want = sorted(tuple(r) for r in bm25.search_texts(d, q.where("query is not null"), 7, bigrams=bigrams).select("query", "doc", "score", "rank").collect())
    got = sorted(tuple(r) for r in sharded_search.search_texts(spark.createDataFrame(docs, "doc string, text string"), q, 7, bigrams=bigrams, shard_docs=13).select("query", "doc", "score", "rank").collect())
    assert got == want and len(got) > 100
    assert sharded_search.search_texts(d.limit(0), q, 3).count() == 0 and sharded_search.search_texts(d, q.limit(0), 3).count() == 0
