import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lineage import checkpoint_folder
from tessera.operators import bm25
from tessera.operators.contexts import hash_places
from tessera.operators.dense import dense_search, normalized, text_vectors
from tessera.operators.generate import ModelError, OutOfQuota, answered, candidates, first_sentence, patient, wait_hint
from tessera.operators.judge import judge, open_verdicts, verdicts
from tessera.operators.sharded_search import search_counts, search_texts
from tessera.settings import Retrievers, Settings, generator, truth
from tessera.sources.records import load_articles, load_chunks, load_dataset, load_queries, write_jsonl
from tessera.sources.reports import comparison, markdown, write_report
from tessera.sources.stores import build_job, largest, load_index, load_vectors, open_index, save_index, save_vectors, search_index


def model_of(*replies):
    left = list(replies)

    def model(prompt):
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return model


def test_patient_waits_as_asked():
    slept = []
    assert patient(model_of(ModelError(503, "x"), ModelError(503, "x"), ModelError(429, "Retry in 2.5 s"), "ja"), sleep=slept.append)([]) == "ja"
    assert slept == [10, 20, 3.5]
    with pytest.raises(OutOfQuota):
        patient(model_of(ModelError(429, "quota PerDay used up")), sleep=slept.append)([])
    with pytest.raises(ModelError):
        patient(model_of(ModelError(400, "bad")), sleep=slept.append)([])
    with pytest.raises(ModelError):
        patient(model_of(*[ModelError(500, "x")] * 9), attempts=3, sleep=slept.append)([])
    assert len(slept) == 5 and wait_hint("none") == 30 and wait_hint("RETRY IN 7s", 5) == 7 and wait_hint("", 5) == 5


def test_candidates():
    assert candidates(None) == (3, 30) == candidates(0) and candidates(50) == (50, 50) and candidates(5, reranks=False) == (5, 5)


def test_threshold_needs_a_scorer(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    hits = empty("query string, doc string, rank int, score double, hit_text string")
    parts = (hits, empty("query string, text string"), empty("doc string, text string"), empty("article_id string, title string, text string"), first_sentence)
    with pytest.raises(ValueError):
        answered(*parts, threshold=0.5, scorer=None)
    assert answered(*parts, scorer=None).count() == 0


def test_settings():
    assert truth(" YES ") and truth("1") and not truth("0") and not truth("") and truth(None, True)
    assert Settings.read({"TESSERA_THRESHOLD": "0.5", "TESSERA_RERANK": "no"}).threshold is None
    assert Settings.read({"TESSERA_THRESHOLD": "0.5", "TESSERA_CONTEXT_K": "7"}) == Settings(threshold=0.5, context_k=7)
    with pytest.raises(ValueError):
        generator("other")
    assert generator("first_sentence") is first_sentence


def test_retrievers(spark):
    docs = spark.createDataFrame([("a", "đất nhà"), ("b", "thuế phí"), (None, "đất"), ("c", None)], "doc string, text string")
    asked = spark.createDataFrame([("q", "nhà đất"), (None, "x"), ("r", None)], "query string, text string")
    known = Retrievers(docs)
    with pytest.raises(ValueError):
        known.get("colbert")
    assert known.get("bm25") is known.get("bm25")
    for method in ("bm25", "bm25_bigram", "hybrid"):
        assert [(r.query, r.doc) for r in known.get(method)(asked, 5).collect()] == [("q", "a")]


def test_many_queries_are_shuffled_to_shards(spark):
    docs = spark.createDataFrame([(f"d{i:02}", f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)], "doc string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1}") for i in range(8)], "query string, text string")
    rows = lambda **how: sorted(map(tuple, search_texts(docs, asked, 5, **how).select("query", "doc", "rank", "score").collect()))
    assert rows() == rows(most_terms=3) == rows(shard_docs=7) and len(rows()) > 20


def test_stored_index_is_searched_by_shards(spark, tmp_path):
    """Stored postings are compact, and a search makes no row for a pair of query and document."""
    docs = spark.createDataFrame([(f"d{i:03}", f"w{i % 7} w{i % 5} w{i % 3} w{i % 3} chung") for i in range(300)] + [("leer", ""), ("null", None)], "doc string, text string")
    asked = spark.createDataFrame([(f"q{i:02}", f"w{i} w{i + 1} chung fehlt") for i in range(40)] + [("x", ""), ("y", "chung"), (None, "w1")], "query string, text string")
    save_index(bm25.build(bm25.tokenized(docs, "doc", "text")), str(tmp_path))
    index = open_index(spark, str(tmp_path), docs)
    order = lambda df: sorted(map(tuple, df.select("query", "doc", "rank", "score").collect()))
    want = order(bm25.search(load_index(spark, str(tmp_path), docs), bm25.query_terms(asked.where("query is not null"), "query", "text"), 5))
    assert want == order(search_texts(docs, asked, 5)) and len(want) == 205
    found = search_index(spark, str(tmp_path), docs, asked, 5)
    assert order(found) == want
    for how in ({"most_terms": 3}, {"shard_docs": 7}):
        assert order(search_counts(index.documents, index.terms, index.stats, asked, 5, **how)) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
    assert index.documents.count() == 302 and index.documents.where("doc = 'd000'").first().asDict() == {"doc": "d000", "n": 5, "terms": ["w0", "chung"], "times": [4, 1]}


def test_many_vectors_are_shuffled_to_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(50)] + [(None, [1.0, 1.0, 1.0]), (99, None)], "id bigint, v array<double>")
    rows = lambda **how: sorted(map(tuple, dense_search(df.where("id < 6"), df, "id", "v", 4, **how).collect()))
    assert rows() == rows(most_bytes=0, block=7) and len(rows()) == 24
    assert dense_search(df.limit(0), df, "id", "v", 4).count() == 0 == dense_search(df.where("id < 6"), df.limit(0), "id", "v", 4, most_bytes=0).count()


def test_text_vectors(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", []), ("c", None)], "doc string, t array<string>")
    got = {r.doc: r.vector for r in text_vectors(df, "doc", "t", 8).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-12 and got["b"] == got["c"] == [0.0] * 8
    assert spark.range(1).select(normalized(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), normalized(F.array(F.lit(0.0))).alias("z")).first()[:] == ([0.6, 0.8], [0.0])


def test_files_in_order(spark, tmp_path):
    for name, rows in (("b.jsonl", [{"id": "1", "text": "new"}]), ("a.jsonl", [{"_id": "1", "text": "old"}, {"_id": "2"}, {"_id": "2", "text": "last"}])):
        (tmp_path / name).write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    assert {r.query_id: r.text for r in load_queries(spark, str(tmp_path)).collect()} == {"1": "new", "2": "last"}
    assert {r.article_id: r.text for r in load_articles(spark, str(tmp_path)).collect()} == {"1": "new", "2": "last"}


def test_chunks_are_whole(spark, tmp_path):
    write_jsonl(spark.createDataFrame([("c", "a", "t")], "id string, article_id string, text string"), str(tmp_path / "good"))
    assert load_chunks(spark, str(tmp_path / "good")).collect() == [("c", "a", "t")]
    write_jsonl(spark.createDataFrame([("c", None, "t")], "id string, article_id string, text string"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no article_id"):
        load_chunks(spark, str(tmp_path / "bad")).collect()


def test_dataset(spark, tmp_path):
    lines = lambda *rows: "\n".join(map(json.dumps, rows))
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(lines({"_id": "a", "title": "t", "text": "x"}))
    (tmp_path / "queries.jsonl").write_text(lines({"_id": "q", "text": "x"}))
    for split in ("train", "test"):
        (tmp_path / "qrels" / f"{split}.jsonl").write_text(lines({"query-id": "q", "corpus-id": "a"}, {"query-id": "q", "corpus-id": "b", "score": 0}))
    data = load_dataset(spark, str(tmp_path))
    assert data.articles.count() == data.queries.count() == 1
    assert sorted(map(tuple, data.judgements.collect())) == [("test", "q", "a"), ("train", "q", "a")]


def test_vectors_of_another_number_raise(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.0])], "id int, v array<double>")
    save_vectors(vectors, str(tmp_path))
    assert load_vectors(spark, str(tmp_path), vectors).count() == 1
    with pytest.raises(ValueError):
        load_vectors(spark, str(tmp_path), vectors.union(vectors))


def test_build_job(spark, tmp_path):
    articles = spark.createDataFrame([("a", "t", "x y")], "article_id string, title string, text string")
    chunks = spark.createDataFrame([("a#0", "a", "x y"), ("a#1", "a", "x")], "id string, article_id string, text string")
    meta = build_job(articles, chunks, chunks.select("id"), str(tmp_path)).first()
    assert (meta.n_articles, meta.n_chunks, meta.n_terms, meta.n_postings, meta.has_vectors) == (1, 2, 2, 3, True)
    assert load_vectors(spark, str(tmp_path / "dense"), chunks).count() == 2


def test_judge_takes_up_its_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, "NGỮ CẢNH:\nx", f"trả lời {i}", i == 3) for i in range(6)], "id bigint, context string, answer string, refused boolean")

    def limited():
        calls = []

        def model(prompt):
            calls.append(prompt)
            if len(calls) > 1:
                raise OutOfQuota
            return "no verdict" if prompt[-1]["content"].endswith("0") else '{"faithful": true}'

        return model

    log = judge(rows, limited, str(tmp_path))
    assert 0 < verdicts(log).count() < 5 or log.where("faithful is null").count() > 0
    left = open_verdicts(rows, log).count()
    log = judge(rows, lambda: lambda prompt: '{"faithful": false}', str(tmp_path), log)
    assert verdicts(log).count() == 5 and verdicts(log).where("not faithful").count() == left and open_verdicts(rows, log).count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, None)], "model string, rate double, none double")
    assert markdown(df).splitlines()[2] == "| m | 0.5000 | – |"
    write_report(df, str(tmp_path / "r"), k=5)
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"settings": {"k": 5}, "rows": [{"model": "m", "rate": 0.5, "none": None}]}
    assert [tuple(r) for r in comparison({"a": df, "b": df.drop("rate")}, ["model", "rate"]).collect()] == [("a", "m", 0.5), ("b", "m", None)]
    assert largest(spark.createDataFrame([("x",), ("y",), ("y",)], "f string"), "f").first()[:] == ("y", 2)


def test_places(spark):
    rows = spark.createDataFrame([(i, f"k{i}", "x") for i in range(500)], "n int, id string, `a.b` string")
    one, two = (sorted((r.place, r.row["id"]) for r in hash_places(rows, "id", 3, part_rows=p).collect()) for p in (1, 4096))
    assert one == two and [p for p, _ in one] == list(range(1, 501))
    assert hash_places(rows.limit(0), "id", 3).count() == 0


def test_previews_and_anchors(spark):
    row = spark.createDataFrame([("Tên\n" + "x" * 500, "a [01] <b> [2] [3]", "x")], "t string, a string, p string")
    got = row.select(T.source_preview(F.col("t")).alias("p"), T.answer_html(F.col("a"), F.lit(2)).alias("h"), T.prefixed(F.col("p"), "query: ").alias("q")).first()
    assert got.p.title == "Tên" and got.p.more and len(got.p.preview) == 421
    assert got.h == 'a <a href="#source-1">[01]</a> &lt;b&gt; <a href="#source-2">[2]</a> [3]' and got.q == "query: x"


def test_checkpoints_lie_in_the_named_folder(spark):
    assert checkpoint_folder(spark).endswith(spark.sparkContext.getCheckpointDir().rsplit("/", 1)[1])
