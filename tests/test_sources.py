import pytest

from tessera.operators import bm25
from tessera.sources import records as R
from tessera.sources import stores as S
from tessera.streaming.answers import windowed_judgements, score_files


def test_json_lines(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text('{"_id": "a+1", "title": "T", "text": "cũ"}\n\n{"id": "b+1"}\n{"_id": "a+1", "title": "T", "text": "mới"}\n', encoding="utf-8")
    got = {r.article_id: (r.title, r.text) for r in R.load_articles(spark, str(path)).collect()}
    assert got == {"a+1": ("T", "mới"), "b+1": ("", "")}
    R.save_articles(R.load_articles(spark, str(path)), str(tmp_path / "out"))
    assert {r.article_id for r in R.load_articles(spark, str(tmp_path / "out")).collect()} == set(got)
    path.write_text('{"_id": "a+1", "title"\n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        R.load_articles(spark, str(path)).collect()


def test_judgements_by_file(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"query-id": "q", "corpus-id": "a", "score": 1}\n{"query-id": "q", "corpus-id": "b", "score": 0}\n')
    (tmp_path / "test.jsonl").write_text('{"query-id": "r", "corpus-id": "a"}\n{"query-id": "r", "corpus-id": "a"}\n')
    got = sorted(map(tuple, R.load_judgements(spark, str(tmp_path)).collect()))
    assert got == [("test", "r", "a"), ("train", "q", "a")]
    gold = spark.createDataFrame([("t", "q", "a"), ("t", "q", "gone"), ("t", "r", "gone"), ("t", "x", "a")], "split string, query_id string, article_id string")
    kept = R.judged_with_corpus(gold, spark.createDataFrame([("q",), ("r",)], "query_id string"), spark.createDataFrame([("a",)], "article_id string"))
    assert sorted(map(tuple, kept.collect())) == [("t", "q", "a"), ("t", "q", "gone")]


def test_index_is_checked_on_load(spark, tmp_path):
    docs = spark.createDataFrame([("a", "một hai"), ("b", "ba")], "doc string, text string")
    S.save_index(bm25.build(bm25.tokenized(docs, "doc", "text")), str(tmp_path / "i"), 2)
    asked = spark.createDataFrame([("q", "ba")], "query string, text string")
    hits = bm25.search(S.load_index(spark, str(tmp_path / "i"), docs), bm25.query_terms(asked, "query", "text"), 1)
    assert hits.first().doc == "b"
    with pytest.raises(ValueError):
        S.load_index(spark, str(tmp_path / "i"), docs.limit(1))


def test_log_cache_and_summary(spark, tmp_path):
    work = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    S.append_rows(work.where("id = 'a'"), str(tmp_path / "log"))
    S.append_rows(work.where("id = 'a'"), str(tmp_path / "log"))
    assert {r.id for r in S.unfinished(work, spark.read.parquet(str(tmp_path / "log"))).collect()} == {"b", "c"}
    cache = spark.createDataFrame([("a", 0.5), ("a", 0.4)], "id string, score double")
    hit, miss = S.with_cache(work, cache, ["id"], "score")
    assert [(r.id, r.score) for r in hit.collect()] == [("a", 0.4)] and miss.count() == 2
    old = spark.createDataFrame([("m", 1, 2.0), ("o", 5, 6.0)], "model string, n int, old double")
    new = spark.createDataFrame([("m", 9, None), ("p", 7, "x")], "model string, n int, new string")
    got = {r.model: tuple(r) for r in S.merged_summary(old, new, "model").collect()}
    assert got == {"m": ("m", 9, 2.0, None), "o": ("o", 5, 6.0, None), "p": ("p", 7, None, "x")}


def test_stream_resumes(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "m", [1], 1, "x [1]") for i in ids], "line_no bigint, model string, gold array<int>, n_docs int, answer string")
    places = [str(tmp_path / p) for p in ("in", "out", "progress")]
    rows(1, 2).write.parquet(places[0])
    assert score_files(spark, *places).count() == 2
    rows(3).write.mode("append").parquet(places[0])
    assert sorted(r.line_no for r in score_files(spark, *places).collect()) == [1, 2, 3]


def test_monthly_counts_drop_late_rows(spark, tmp_path):
    from datetime import datetime as D

    df = spark.createDataFrame([(D(2024, 1, 1), "a"), (D(2024, 1, 2), "a"), (D(2024, 9, 1), "a")], "judged_at timestamp_ntz, split string")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_judgements(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("monthly").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.judged for r in spark.table("monthly").collect()] == [2]
