"""Queries that store what they make and take it up again, judge answers, and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lineage import new_folder
from tessera.operators import answers as A
from tessera.operators.contexts import context_docs, shown_hits
from tessera.operators.dense import dense_search
from tessera.operators.generate import Generator, OutOfQuota, patient
from tessera.operators.judge import judge, verdicts
from tessera.plans.answer_queries import _ANSWERS, _GATE, _SUMMARY, _gate_rows, _saved, _scored
from tessera.plans.registry import Registry
from tessera.plans.retrieval_queries import _DENSE, _articles, _asked, _chunks, _docs, _gold, _questions, bm25_chunk_pooled
from tessera.plans.sql_parts import ARTICLE_DOCS, ARTICLES, ASKED, CHUNK_DOCS, GOLD, QUESTIONS
from tessera.plans.sql_parts import bm25 as bm25_sql
from tessera.plans.sql_parts import citation as citation_sql
from tessera.plans.sql_parts import strip as strip_sql
from tessera.sources.records import load_chunks, load_dataset, load_queries, save_articles, save_chunks, write_jsonl
from tessera.sources.reports import comparison
from tessera.sources.stores import build_job, largest, load_vectors, save_vectors, unfinished
from tessera.sources.tables import table

R = Registry()


# Records


def _stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where("article_id is not null").select(F.col("doc").alias("id"), "article_id", "text")


@R.add(f"WITH {CHUNK_DOCS} SELECT doc AS id, article_id, text FROM docs WHERE article_id IS NOT NULL")
def chunks_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks written as JSON lines and loaded again."""
    place = new_folder(spark, "chunks")
    save_chunks(_stored_chunks(spark, folder), place)
    return load_chunks(spark, place)


@R.add(f"WITH {QUESTIONS} SELECT query_id, text FROM questions")
def queries_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The questions written as JSON lines and loaded again."""
    place = new_folder(spark, "queries")
    write_jsonl(_questions(spark, folder).select(F.col("query_id").alias("_id"), "text"), place)
    return load_queries(spark, place)


@R.add(
    f"""WITH {ARTICLES}, {QUESTIONS}, {GOLD} SELECT 'articles' AS part, count(*) AS n FROM articles UNION ALL SELECT 'queries', count(*) FROM questions
UNION ALL SELECT concat('qrels ', split), count(*) FROM gold GROUP BY split"""
)
def dataset_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A whole data set written as a folder of JSON lines, loaded again and counted by part."""
    place = new_folder(spark, "dataset")
    save_articles(_articles(spark, folder), f"{place}/corpus.jsonl")
    write_jsonl(_questions(spark, folder).select(F.col("query_id").alias("_id"), "text"), f"{place}/queries.jsonl")
    gold = _gold(spark, folder).select("split", F.col("query_id").alias("query-id"), F.col("article_id").alias("corpus-id"), F.lit(1.0).alias("score"))
    for name in ("train", "val", "test"):
        write_jsonl(gold.where(F.col("split") == name).drop("split"), f"{place}/qrels/{name}.jsonl")
    data = load_dataset(spark, place)
    count = lambda df, part: df.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return count(data.articles, F.lit("articles")).union(count(data.queries, F.lit("queries"))).union(count(data.judgements, F.concat(F.lit("qrels "), "split")))


# Indexes


@R.add(
    f"""WITH {ARTICLES}, {QUESTIONS}, {ASKED}, {CHUNK_DOCS.replace("WHERE newest = 1", "WHERE newest = 1 AND article_id IS NOT NULL")}, {bm25_sql('c')}
SELECT (SELECT count(*) FROM articles) AS n_articles, n_docs AS n_chunks, (SELECT count(*) FROM c_df) AS n_terms, (SELECT count(*) FROM c_tf) AS n_postings, round(avg_len, 6) AS avg_len,
  false AS bigrams, false AS has_vectors FROM c_stats"""
)
def index_build_meta(spark: SparkSession, folder: str) -> DataFrame:
    """What an index build stored: its row of counts and settings."""
    meta = build_job(_articles(spark, folder), _stored_chunks(spark, folder), None, new_folder(spark, "build"))
    return meta.drop("seconds").withColumn("avg_len", F.round("avg_len", 6))


@R.add(_DENSE + " SELECT query, doc, rank, score FROM ranked WHERE rank <= 10")
def dense_index_top10(spark: SparkSession, folder: str) -> DataFrame:
    """Dense search over vectors that were stored and loaded again."""
    place, vectors = new_folder(spark, "vectors"), table(spark, folder, "embeddings")
    save_vectors(vectors, place)
    held = load_vectors(spark, place, vectors)
    return dense_search(held.where("vec_id % 50 = 0"), held, "vec_id", "embedding", 10).select("query", "doc", "rank", "score")


# Hits and passages

_POOLED = f"""WITH {ARTICLES}, {ARTICLE_DOCS.replace('docs AS', 'article_docs AS')}, {GOLD}, {QUESTIONS}, {ASKED}, {CHUNK_DOCS}, {bm25_sql('c')},
best AS (
  SELECT query, article_id, doc, score, row_number() OVER (PARTITION BY query, article_id ORDER BY score DESC, doc) AS best
  FROM c_ranked JOIN (SELECT doc, article_id FROM docs) USING (doc) WHERE rank <= 40 AND article_id IS NOT NULL
), pooled AS (SELECT query, article_id AS doc, doc AS chunk, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank FROM best WHERE best = 1)"""


@R.add(
    _POOLED + f" SELECT query, p.doc, rank, chunk, CASE WHEN a.article_id IS NULL THEN p.doc ELSE {citation_sql('a.article_id', 'a.title')} END AS citation FROM pooled p LEFT JOIN articles a ON a.article_id = p.doc WHERE rank <= 10"
)
def hits_with_citation(spark: SparkSession, folder: str) -> DataFrame:
    """Pooled hits as a search shows them: with the article's citation, or the id itself where the article is not known."""
    known = _articles(spark, folder).select(F.col("article_id").alias("doc"), T.citation(F.col("article_id"), F.col("title")).alias("citation"))
    return bm25_chunk_pooled(spark, folder).join(known, "doc", "left").select("query", "doc", "rank", "chunk", F.coalesce("citation", "doc").alias("citation"))


@R.add(
    _POOLED
    + f""", rights AS (SELECT DISTINCT query_id AS query, article_id AS doc FROM gold WHERE query_id IN (SELECT query FROM asked) AND article_id IN (SELECT article_id FROM articles))
SELECT r.query, r.doc, p.doc IS NOT NULL AS retrieved, CASE WHEN length({strip_sql('d.text')}) <= 1500 THEN {strip_sql('d.text')} ELSE substring(coalesce(c.text, d.text), 1, 1500) END AS text
FROM rights r LEFT JOIN (SELECT * FROM pooled WHERE rank <= 10) p ON p.query = r.query AND p.doc = r.doc LEFT JOIN docs c ON c.doc = p.chunk JOIN article_docs d ON d.doc = r.doc"""
)
def gold_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The passage of each gold article of the query set: the chunk that was found, else the article's start."""
    asked, known, docs = _asked(spark, folder), _articles(spark, folder), _docs(spark, folder)
    gold = _gold(spark, folder).select(F.col("query_id").alias("query"), F.col("article_id").alias("doc")).distinct()
    gold = gold.join(asked.select("query"), "query", "left_semi").join(docs.select("doc"), "doc", "left_semi").withColumn("place", F.lit(1))
    hits = bm25_chunk_pooled(spark, folder).join(_chunks(spark, folder).select(F.col("doc").alias("chunk"), F.col("text").alias("hit_text")), "chunk")
    texts = context_docs(shown_hits(gold, hits, docs), known).select("query", "doc", "text")
    return texts.join(hits.select("query", "doc", F.lit(True).alias("hit")), ["query", "doc"], "left").select("query", "doc", F.coalesce("hit", F.lit(False)).alias("retrieved"), "text")


@R.add(
    f"""WITH {ARTICLES}, {ARTICLE_DOCS}, whole AS (SELECT doc, {strip_sql('text')} AS t FROM docs),
parts AS (SELECT doc, split_part(t, chr(10), 1) AS title, CASE WHEN contains(t, chr(10)) THEN {strip_sql('substr(t, strpos(t, chr(10)) + 1)')} ELSE '' END AS body FROM whole)
SELECT doc, title, CASE WHEN length(body) > 420 THEN concat(substr(body, 1, 420), '…') ELSE body END AS preview, length(body) > 420 AS more FROM parts"""
)
def source_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Each article as a source is shown: title and the start of its body."""
    return _docs(spark, folder).select("doc", T.source_preview(F.col("text")).alias("p")).select("doc", "p.title", "p.preview", "p.more")


# Judging


def _judge(stops: bool):
    """A stand-in for a judge: faithful if the first passage is cited. With ``stops`` its quota is spent now and then."""

    def make() -> Generator:
        def reply(prompt: list[dict]) -> str:
            said = prompt[-1]["content"].rpartition("CÂU TRẢ LỜI: ")[2]
            if stops and len(said) % 7 == 0:
                raise OutOfQuota
            return 'Verdict: {"faithful": %s}' % ("true" if "[1]" in said else "false")

        return patient(reply)

    return make


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).select(F.col("line_no").alias("id"), "context", "answer", "refused")
    place = new_folder(spark, "verdicts")
    log = judge(rows, _judge(True), place)
    return verdicts(judge(rows, _judge(False), place, log))


_FAITHFUL = "contains(string_split(coalesce(answer, ''), 'CÂU TRẢ LỜI: ')[-1], '[1]')"


@R.add(f"WITH {_ANSWERS} SELECT line_no AS id, {_FAITHFUL} AS faithful FROM rows WHERE NOT refused")
def judge_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of a judge whose quota ends in the first run and who is asked for the rest in a second one."""
    return _verdicts(spark, folder).select(F.col("id").cast("bigint").alias("id"), "faithful")


@R.add(
    f"""WITH {_ANSWERS} SELECT model, round(avg({_FAITHFUL}::int) FILTER (WHERE NOT refused), 4) AS faithfulness, count(*) FILTER (WHERE NOT refused) AS n_judged FROM rows GROUP BY model"""
)
def summarize_faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """Faithfulness of each model over its judged answers."""
    found = _verdicts(spark, folder).select(F.col("id").cast("bigint").alias("line_no"), "faithful")
    return A.summary(_scored(spark, folder).join(found, "line_no", "left"), ["model"], "faithful").select("model", "faithfulness", "n_judged")


@R.add(
    """SELECT line_no, coalesce(try_cast(nullif(regexp_extract(lower(m), 'retry in ([0-9]+(?:\\.[0-9]+)?)\\s*s', 1), '') AS double), 30.0) AS seconds
FROM (SELECT line_no, CASE WHEN line_no % 2 = 0 THEN concat('429: please Retry in ', CAST(floor(latency_ms) AS bigint), '.5 s') ELSE concat('503 ', model) END AS m FROM generations)"""
)
def retry_hints(spark: SparkSession, folder: str) -> DataFrame:
    """How long messages ask to wait that are made of the saved latencies."""
    message = F.when(F.expr("line_no % 2 = 0"), F.concat(F.lit("429: please Retry in "), F.floor("latency_ms").cast("bigint").cast("string"), F.lit(".5 s"))).otherwise(F.concat(F.lit("503 "), "model"))
    return _saved(spark, folder).select("line_no", T.retry_delay(message).alias("seconds"))


# Summaries


@R.add("SELECT split, count(*) AS n FROM qrels WHERE split IS NOT NULL GROUP BY split ORDER BY n DESC, split LIMIT 1")
def largest_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of most rows."""
    return largest(table(spark, folder, "qrels").where("split is not null"), "split")


@R.add("SELECT DISTINCT model FROM generations WHERE model IS NOT NULL AND model > (SELECT min(model) FROM generations)")
def models_to_run(spark: SparkSession, folder: str) -> DataFrame:
    """Models without a summary, where the first by name has one."""
    models = _saved(spark, folder).where("model is not null").select("model").distinct()
    return unfinished(models, models.agg(F.min("model").alias("model")), "model")


_COMPARED = ["n", "answer_rate", "gold_cite_rate", "cite_precision", "refusal_acc"]


@R.add(
    f"""WITH RECURSIVE {_GATE}, {_ANSWERS}, flags AS (SELECT line_no AS line, score < 0.5 AS gated FROM gate),
after AS (SELECT r.* REPLACE (r.refused OR gated AS refused, NOT (r.refused OR gated) AND NOT gated AND len(r.valid) = 0 AS uncited, r.cites_gold AND NOT gated AS cites_gold,
  r.invalid_cite AND NOT gated AS invalid_cite, CASE WHEN gated THEN NULL ELSE r.cite_precision END AS cite_precision) FROM rows r JOIN flags ON r.line_no = flags.line)
SELECT 'saved' AS summary, model, {', '.join(_COMPARED)} FROM (SELECT model, {_SUMMARY} FROM rows GROUP BY model)
UNION ALL SELECT 'gated', model, {', '.join(_COMPARED)} FROM (SELECT model, {_SUMMARY} FROM after GROUP BY model)"""
)
def comparison_table(spark: SparkSession, folder: str) -> DataFrame:
    """The summaries of the saved and of the gated answers of each model in one table."""
    rows = _gate_rows(spark, folder)
    sides = {"saved": rows, "gated": A.gated(rows, F.col("score"), 0.5)}
    return comparison({name: A.summary(A.scored(df), ["model"]) for name, df in sides.items()}, ["model", *_COMPARED])
