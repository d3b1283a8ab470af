import pytest
from test_retrieval import brute_bm25

from tessera.operators.generate import answered
from tessera.operators.sharded_search import search_articles
from tessera.operators.chunking import lines_of, windows
from tessera.plans import answer_queries, pipeline_queries, retrieval_queries

FILLER = "\n".join(f"Khoản {i}. Cơ quan lập sổ và lưu hồ sơ theo mẫu chung của ngành trong năm." for i in range(60))
LONG = FILLER + "\nPhạt chủ thuyền thả neo sai bến"
ASKED = "phạt chủ thuyền thả neo sai bến"
OTHERS = [(f"l+{i}", f"Điều {i}. Khác", f"Nội dung thứ {i} về kho hàng") for i in range(2, 8)]


@pytest.fixture
def folder(spark, tmp_path):
    corpus = [("l+1", "Điều 1. Neo", LONG), *OTHERS]
    gold = [("q", "l+1"), ("r", "l+1")]
    rows = {
        "corpus": ([(*c, i) for i, c in enumerate(corpus)], "_id string, title string, text string, line_no bigint"),
        "queries": ([("q", ASKED, 50), ("r", "về kho hàng", 100)], "_id string, text string, line_no bigint"),
        "qrels": ([("train", *g, 1.0) for g in gold], "split string, `query-id` string, `corpus-id` string, score double"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_passage_is_where_the_match_lies(spark, folder):
    got = {(r["query"], r.doc): r.text for r in answer_queries.R.queries["context_passages_matched"](spark, folder).collect()}
    assert got["q", "l+1"].endswith("Phạt chủ thuyền thả neo sai bến") and got["q", "l+1"].startswith("Điều 1. Neo\n")
    assert len(got["q", "l+1"]) <= 1500 and got["r", "l+3"] == "Điều 3. Khác\nNội dung thứ 3 về kho hàng"


def test_prompts_have_the_match_and_missed_gold_its_start(spark, folder):
    got = {r["query"]: (r.kind, r.prompt[1]["content"]) for r in answer_queries.R.queries["sft_prompts"](spark, folder).collect()}
    assert got["q"][0] == got["r"][0] == "answerable"
    assert "Phạt chủ thuyền thả neo sai bến" in got["q"][1].partition("CÂU HỎI")[0]
    assert "Khoản 0." in got["r"][1] and "Phạt chủ thuyền" not in got["r"][1]


def test_model_sees_the_match(spark, folder):
    answer = pipeline_queries.R.queries["pipeline_answer"](spark, folder).where("query = 'q'").first()
    assert not answer.gated and answer.cited[0]["article_id"] == "l+1"
    articles = spark.createDataFrame([("l+1", "Điều 1. Neo", LONG), *OTHERS], "article_id string, title string, text string")
    asked = spark.createDataFrame([("q", ASKED)], "query string, text string")
    seen = lambda: lambda prompt: prompt[-1]["content"] + " [1]"
    hits = search_articles(articles, asked, 30)
    docs = articles.selectExpr("article_id doc", "concat(title, chr(10), text) text")
    said = answered(hits, asked, docs, articles, seen, threshold=0.5).first().answer
    assert "Phạt chủ thuyền thả neo sai bến" in said.partition("CÂU HỎI")[0]


def test_every_article_is_searched_by_its_chunks(spark, folder):
    chunks = []
    for article, title, text in [("l+1", "Điều 1. Neo", LONG), *OTHERS]:
        lines = lines_of(text, 1200, 200)
        chunks += [(f"{article}#{i}", "\n".join([title, *lines[a:b]])) for i, (a, b) in enumerate(windows([*map(len, lines)], 1200, 200))]
    assert len(chunks) > 8
    got = retrieval_queries.R.queries["bm25_article_chunks"](spark, folder).orderBy("query", "rank").collect()
    for query, text in (("q", ASKED), ("r", "về kho hàng")):
        best = {}
        for chunk, score in brute_bm25(chunks, text)[:40]:
            best.setdefault(chunk.partition("#")[0], (chunk, round(score, 6)))
        want = sorted(((d, c, s) for d, (c, s) in best.items()), key=lambda x: (-x[2], x[0]))[:10]
        assert [(r.doc, r.chunk, round(r.score, 6)) for r in got if r["query"] == query] == want
