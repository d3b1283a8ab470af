"""Queries that write and read again, stream, or run the whole way from question to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import new_folder
from tessera.operators import bm25, sharded_search
from tessera.operators.generate import answered, candidates, first_sentence, generate
from tessera.plans.answer_queries import _ANSWERS, _saved
from tessera.plans.registry import Registry
from tessera.plans.retrieval_queries import _BM25, _articles, _asked, _docs, _hits
from tessera.plans.sql_parts import ARTICLES
from tessera.sources.records import load_articles, save_articles
from tessera.sources.stores import merged_summary, save_index, search_index
from tessera.sources.tables import table
from tessera.streaming.answers import score_files

R = Registry()


@R.add(f"WITH {ARTICLES} SELECT article_id, title, text FROM articles")
def articles_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The articles written as JSON lines and loaded again."""
    place = new_folder(spark, "articles")
    save_articles(_articles(spark, folder), place)
    return load_articles(spark, place)


@R.add(_BM25 + " SELECT query, doc, rank, CAST(score AS double) AS score FROM u_ranked WHERE rank <= 10")
def index_top10(spark: SparkSession, folder: str) -> DataFrame:
    """Search over an index that was stored and loaded again."""
    place, docs = new_folder(spark, "index"), _docs(spark, folder)
    save_index(bm25.build(bm25.tokenized(docs, "doc", "text")), place)
    return _hits(search_index(spark, place, docs, _asked(spark, folder), 10))


@R.add(f"WITH {_ANSWERS} SELECT line_no, model, answerable, refused, invalid_cite, uncited, cites_gold, cite_precision FROM rows")
def stream_score_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Saved answers scored as a stream of files."""
    place = new_folder(spark, "scored")
    return score_files(spark, f"{folder}/generations*.parquet", f"{place}/rows", f"{place}/progress")


@R.add(
    """WITH old AS (SELECT model, count(*) AS n, round(avg(latency_ms), 4) AS latency_ms FROM generations WHERE line_no % 2 = 0 AND model IS NOT NULL GROUP BY model),
new AS (SELECT model, count(*) AS n, max(n_docs) AS most_docs FROM generations WHERE line_no % 2 = 1 AND model IS NOT NULL GROUP BY model)
SELECT coalesce(new.model, old.model) AS model, coalesce(new.n, old.n) AS n, old.latency_ms, new.most_docs FROM old FULL JOIN new ON old.model = new.model"""
)
def summary_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A later summary laid over an earlier one: of rows with an odd number over those with an even one."""
    rows = _saved(spark, folder).where("model is not null")
    old = rows.where("line_no % 2 = 0").groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("latency_ms"))
    new = rows.where("line_no % 2 = 1").groupBy("model").agg(F.count("*").alias("n"), F.max("n_docs").alias("most_docs"))
    return merged_summary(old, new, "model")


@R.add()
def stub_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw prompt answered by a stand-in for a model."""
    prompts = table(spark, folder, "sft_raw").select(F.col("line_no").alias("id"), "prompt")
    return generate(prompts, first_sentence)


@R.add()
def pipeline_answer(spark: SparkSession, folder: str) -> DataFrame:
    """From question to cited answer: search over chunks, re-ranking, gate, prompt, stand-in model, citations."""
    known, docs, asked = _articles(spark, folder), _docs(spark, folder), _asked(spark, folder)
    shown, retrieved = candidates(None)
    return answered(sharded_search.search_articles(known, asked, retrieved), asked, docs, known, first_sentence, k=shown, threshold=0.5)
