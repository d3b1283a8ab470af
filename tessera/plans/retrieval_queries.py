"""Queries on articles, words, search, fusion and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import citation, law_id, normalize, prefixed, strip, words
from tessera.operators import bm25, sharded_search
from tessera.operators.chunking import chunk_articles
from tessera.operators.dense import dense_pooled, dense_search, text_vectors
from tessera.operators.ranking import fuse, mean_metrics, overlap, per_query_metrics, rerank
from tessera.operators.references import orphan_report, orphans, references
from tessera.plans.registry import Registry
from tessera.plans.sql_parts import ARTICLE_DOCS, ARTICLES, ASKED, CHUNK_DOCS, GOLD, QUESTIONS
from tessera.plans.sql_parts import bm25 as bm25_sql
from tessera.plans.sql_parts import citation as citation_sql
from tessera.plans.sql_parts import strip as strip_sql
from tessera.plans.sql_parts import vectors as vectors_sql
from tessera.plans.sql_parts import words as words_sql
from tessera.sources.records import articles, judged_with_corpus, judgements, last_rows, questions
from tessera.sources.tables import table

R = Registry()


# References


def _references(spark: SparkSession, folder: str) -> DataFrame:
    qrels = references(table(spark, folder, "qrels"), "qrels", "corpus-id", "judged_at")
    return qrels.union(references(table(spark, folder, "chunks"), "chunks", "article_id", "built_at"))


_ORPHANS = """
WITH refs AS (
  SELECT 'qrels' AS ref_table, "corpus-id" AS k, judged_at AS t, line_no FROM qrels WHERE "corpus-id" IS NOT NULL
  UNION ALL
  SELECT 'chunks', article_id, built_at, line_no FROM chunks WHERE article_id IS NOT NULL
), judged AS (
  SELECT refs.ref_table, refs.t, refs.line_no,
    count(c._id) AS known,
    count(*) FILTER (WHERE c.loaded_at <= t) AS loaded,
    count(*) FILTER (WHERE c.loaded_at <= t AND (c.removed_at IS NULL OR c.removed_at > t)) AS holding
  FROM refs LEFT JOIN corpus c ON c._id = refs.k GROUP BY refs.ref_table, refs.t, refs.line_no
), orphan AS (
  SELECT ref_table, strftime(t, '%Y-%m') AS period, line_no,
    CASE WHEN known = 0 THEN 'missing' WHEN loaded = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE holding = 0
)
"""


@R.add(_ORPHANS + "SELECT ref_table, period, line_no, reason FROM orphan")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of qrels and chunks that no corpus row satisfies at their time."""
    return orphans(_references(spark, folder), table(spark, folder, "corpus"))


@R.add(
    _ORPHANS
    + """
SELECT o.ref_table, o.period, o.reason, count(*) AS orphans, round(count(*) / any_value(n), 6) AS share
FROM orphan o JOIN (SELECT ref_table, strftime(t, '%Y-%m') AS period, count(*) AS n FROM refs GROUP BY 1, 2) USING (ref_table, period)
GROUP BY o.ref_table, o.period, o.reason"""
)
def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphan_report(_references(spark, folder), table(spark, folder, "corpus"))


# Records


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles(table(spark, folder, "corpus"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return _articles(spark, folder).select(F.col("article_id").alias("doc"), F.concat("title", F.lit("\n"), "text").alias("text"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions(table(spark, folder, "queries"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The stated set of queries: rows whose number is divisible by 50."""
    return _questions(spark, folder).where("line_no % 50 = 0").select(F.col("query_id").alias("query"), "text")


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return judgements(table(spark, folder, "qrels"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = last_rows(table(spark, folder, "chunks").select("id", "article_id", "text", "line_no"), "id", "line_no")
    return rows.select(F.col("id").alias("doc"), "article_id", F.coalesce("text", F.lit("")).alias("text"))


@R.add(f"WITH {ARTICLES} SELECT article_id, title, length(text) AS n_chars, md5(text) AS digest FROM articles")
def article_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The articles: the last row of each id, with defaults for what is missing."""
    return _articles(spark, folder).select("article_id", "title", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@R.add(f"WITH {GOLD} SELECT split, query_id, article_id FROM gold")
def qrels_positive(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct positive judgements."""
    return _gold(spark, folder)


@R.add(
    f"""WITH {GOLD}, {ARTICLES}, {QUESTIONS},
held AS (SELECT DISTINCT split, query_id FROM gold JOIN articles USING (article_id))
SELECT gold.split, gold.query_id, gold.article_id FROM gold JOIN held USING (split, query_id) WHERE gold.query_id IN (SELECT query_id FROM questions)"""
)
def qrels_restricted_set(spark: SparkSession, folder: str) -> DataFrame:
    """Whole gold sets of the questions that have a gold article in the corpus."""
    return judged_with_corpus(_gold(spark, folder), _questions(spark, folder), _articles(spark, folder))


@R.add(f"WITH {GOLD} SELECT split, query_id, article_id FROM gold WHERE article_id IN (SELECT _id FROM corpus)")
def qrels_restricted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements whose article is in the corpus."""
    return _gold(spark, folder).join(table(spark, folder, "corpus").select(F.col("_id").alias("article_id")), "article_id", "left_semi").select("split", "query_id", "article_id")


@R.add(f"WITH {GOLD} SELECT split, count(DISTINCT query_id) AS n_queries, count(*) AS n_gold FROM gold GROUP BY split")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and judgements per split."""
    return _gold(spark, folder).groupBy("split").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_gold"))


@R.add(f"WITH {GOLD}, {QUESTIONS} SELECT DISTINCT split, query_id, text FROM gold JOIN questions USING (query_id)")
def split_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of each split."""
    return _gold(spark, folder).select("split", "query_id").distinct().join(_questions(spark, folder).select("query_id", "text"), "query_id").select("split", "query_id", "text")


@R.add(
    f"""WITH {ARTICLES} SELECT article_id, regexp_extract(article_id, '(?s)^(.*)\\+', 1) AS law_id, {citation_sql('article_id', 'title')} AS citation FROM articles"""
)
def citation_format(spark: SparkSession, folder: str) -> DataFrame:
    """Law and citation of every article."""
    return _articles(spark, folder).select("article_id", law_id(F.col("article_id")).alias("law_id"), citation(F.col("article_id"), F.col("title")).alias("citation"))


@R.add(f"WITH {ARTICLES} SELECT regexp_extract(article_id, '(?s)^(.*)\\+', 1) AS law_id, count(*) AS n_articles FROM articles GROUP BY 1")
def law_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Articles per law."""
    return _articles(spark, folder).groupBy(law_id(F.col("article_id")).alias("law_id")).agg(F.count("*").alias("n_articles"))


# Words


@R.add(f"WITH {QUESTIONS} SELECT query_id, lower(nfc_normalize(text)) AS normalized, {strip_sql('text')} AS stripped FROM questions")
def normalized_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions in composed lower-case form, and stripped."""
    return _questions(spark, folder).select("query_id", normalize(F.col("text")).alias("normalized"), strip(F.col("text")).alias("stripped"))


@R.add(f"WITH {ARTICLES}, {ARTICLE_DOCS} SELECT doc, array_to_string({words_sql('text')}, ' ') AS tokens FROM docs")
def tokenize_unigram(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every article, in order."""
    return bm25.tokenized(_docs(spark, folder), "doc", "text").select("doc", F.array_join("tokens", " ").alias("tokens"))


@R.add(f"WITH {QUESTIONS}, asked AS (SELECT query_id AS query, text FROM questions), docs AS (SELECT query AS doc, text FROM asked), {bm25_sql('b', True)} SELECT doc AS query_id, array_to_string(t, ' ') AS tokens FROM b_tokens")
def tokenize_bigram(spark: SparkSession, folder: str) -> DataFrame:
    """Words and neighbouring pairs of every question."""
    return bm25.tokenized(_questions(spark, folder), "query_id", "text", bigrams=True).select("query_id", F.array_join("tokens", " ").alias("tokens"))


def _index(spark: SparkSession, folder: str) -> bm25.Index:
    return bm25.build(bm25.tokenized(_docs(spark, folder), "doc", "text"))


_BM25 = f"WITH {ARTICLES}, {QUESTIONS}, {ASKED}, {ARTICLE_DOCS}, {bm25_sql('u')}"


@R.add(_BM25 + " SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM u_df, u_stats")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and inverse document frequency of every term."""
    index = _index(spark, folder)
    return index.terms.crossJoin(F.broadcast(index.stats)).select("term", "df", F.round(F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@R.add(_BM25 + " SELECT n_docs, round(avg_len, 6) AS avg_len FROM u_stats")
def doc_len_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number of articles and their mean length in words."""
    return _index(spark, folder).stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@R.add(_BM25 + " SELECT term, doc, tf, round(weight, 6) AS weight FROM u_weights")
def bm25_postings_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Every posting with its weight."""
    return _index(spark, folder).weights().select("term", "doc", "tf", F.round("weight", 6).alias("weight"))


# Search


def _hits(run: DataFrame) -> DataFrame:
    return run.select("query", "doc", "rank", F.col("score").cast("double").alias("score"))


@R.add(_BM25 + " SELECT query, doc, rank, CAST(score AS double) AS score FROM u_ranked WHERE rank <= 10")
def bm25_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best articles of each question of the query set."""
    return _hits(sharded_search.search_texts(_docs(spark, folder), _asked(spark, folder), 10))


_BM25_TWO = f"WITH {ARTICLES}, {QUESTIONS}, {ASKED}, {ARTICLE_DOCS}, {bm25_sql('b', True)}"


@R.add(_BM25_TWO + " SELECT query, doc, rank, CAST(score AS double) AS score FROM b_ranked WHERE rank <= 10")
def bm25_bigram_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The same with neighbouring pairs as terms too."""
    return _hits(sharded_search.search_texts(_docs(spark, folder), _asked(spark, folder), 10, bigrams=True))


@R.add(
    f"""WITH {QUESTIONS}, {ASKED}, {CHUNK_DOCS}, {bm25_sql('c')},
best AS (
  SELECT query, article_id, doc, score, row_number() OVER (PARTITION BY query, article_id ORDER BY score DESC, doc) AS best
  FROM c_ranked JOIN (SELECT doc, article_id FROM docs) USING (doc) WHERE rank <= 40 AND article_id IS NOT NULL
), pooled AS (SELECT query, article_id, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank FROM best WHERE best = 1)
SELECT query, article_id AS doc, rank, CAST(score AS double) AS score, doc AS chunk FROM pooled WHERE rank <= 10"""
)
def bm25_chunk_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best articles by their best stored chunk, out of the forty best chunks."""
    chunks = _chunks(spark, folder)
    hits = sharded_search.search_texts(chunks.select("doc", "text"), _asked(spark, folder), 10 * bm25.FANOUT)
    known = chunks.select(F.col("doc").alias("chunk_id"), "article_id").where("article_id is not null")
    return bm25.pooled(hits, known, 10).select("query", "doc", "rank", F.col("score").cast("double").alias("score"), "chunk")


@R.add()
def bm25_article_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best articles by their best chunk, out of the forty best chunks of all articles."""
    hits = sharded_search.search_articles(_articles(spark, folder), _asked(spark, folder), 10)
    return hits.select("query", "doc", "rank", F.col("score").cast("double").alias("score"), "chunk")


@R.add()
def chunk_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every article cut into overlapping windows of whole lines."""
    return chunk_articles(_articles(spark, folder))


_DENSE = """WITH q AS (SELECT vec_id AS query, embedding AS v, label AS query_label FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT query, query_label, vec_id AS doc, label, round(list_dot_product(v::double[], embedding::double[]), 6) AS score FROM q, embeddings WHERE vec_id <> query),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)"""


def _dense(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return dense_search(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", k)


@R.add(_DENSE + " SELECT query, doc, rank, score FROM ranked WHERE rank <= 10")
def dense_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of each vector of the query set."""
    return _dense(spark, folder, 10).select("query", "doc", "rank", "score")


@R.add(_DENSE + " SELECT query, round(avg(CASE WHEN label = query_label THEN 1.0 ELSE 0.0 END), 6) AS same_label FROM ranked WHERE rank <= 10 GROUP BY query")
def dense_same_label(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the ten nearest vectors that have the query's label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    hits = _dense(spark, folder, 10).join(labels.toDF("doc", "label"), "doc").join(labels.toDF("query", "query_label"), "query")
    return hits.groupBy("query").agg(F.round(F.avg(F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0)), 6).alias("same_label"))


_CHUNK_VECTORS = f"""WITH {QUESTIONS}, {ASKED}, {CHUNK_DOCS}, asked_docs AS (SELECT query AS doc, text FROM asked), {bm25_sql('c')}, {vectors_sql('q', 'asked_docs', 'query: ')}, {vectors_sql('d', 'docs', 'passage: ')},
products AS (SELECT q_unit.doc AS query, d_unit.doc AS doc, sum(q_unit.x * d_unit.x) AS score FROM q_unit JOIN d_unit USING (place) GROUP BY 1, 2),
near AS (SELECT asked.query, docs.doc, article_id, round(coalesce(score, 0), 6) AS score FROM asked CROSS JOIN docs LEFT JOIN products p ON p.query = asked.query AND p.doc = docs.doc),
d_ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM near),
d_best AS (SELECT *, row_number() OVER (PARTITION BY query, article_id ORDER BY score DESC, doc) AS best FROM d_ranked WHERE rank <= DEPTH AND article_id IS NOT NULL),
d_pooled AS (SELECT query, article_id AS doc, doc AS chunk, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank FROM d_best WHERE best = 1)"""


def _dense_leg(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """Articles by their best stored chunk, by hashed vectors."""
    chunks = _chunks(spark, folder)
    made = text_vectors(chunks.select("doc", words(prefixed(F.col("text"), "passage: ")).alias("tokens")), "doc", "tokens")
    made = made.join(chunks.select("doc", "article_id"), "doc").select(F.col("doc").alias("chunk_id"), "article_id", "vector")
    asked = text_vectors(_asked(spark, folder).select("query", words(prefixed(F.col("text"), "query: ")).alias("tokens")), "query", "tokens")
    return dense_pooled(asked, made, k)


@R.add(_CHUNK_VECTORS.replace("DEPTH", "40") + " SELECT query, doc, rank, score, chunk FROM d_pooled WHERE rank <= 10")
def dense_chunk_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best articles by their best stored chunk, out of the forty nearest chunks."""
    return _dense_leg(spark, folder, 10).select("query", "doc", "rank", "score", "chunk")


# Fusion, re-ranking, metrics

_FUSED = f"""WITH {ARTICLES}, {QUESTIONS}, {ASKED}, {ARTICLE_DOCS}, {bm25_sql('u')}, {bm25_sql('b', True)},
runs AS (SELECT query, doc, rank, 0 AS run FROM u_ranked WHERE rank <= 100 UNION ALL SELECT query, doc, rank, 1 FROM b_ranked WHERE rank <= 100),
fused AS (SELECT query, doc, round(sum(1.0::double / (60 + rank)), 9) AS score, min(run * 1000000 + rank) AS seen FROM runs GROUP BY query, doc),
ranked AS (SELECT query, doc, score, CAST(seen // 1000000 AS integer) AS run, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen) AS rank FROM fused)"""


def _hybrid(spark: SparkSession, folder: str, k: int, depth: int = 100) -> DataFrame:
    docs, asked = _docs(spark, folder), _asked(spark, folder)
    runs = [sharded_search.search_texts(docs, asked, max(k, depth), bigrams=b) for b in (False, True)]
    return fuse(runs, k)


@R.add(_FUSED + " SELECT query, doc, rank, score, run FROM ranked WHERE rank <= 10")
def hybrid_top10(spark: SparkSession, folder: str) -> DataFrame:
    """Two retrievers fused by reciprocal rank, each to a depth of 100."""
    return _hybrid(spark, folder, 10).select("query", "doc", "rank", "score", "run")


@R.add(
    _CHUNK_VECTORS.replace("DEPTH", "400")
    + """, c_best AS (
  SELECT query, article_id, doc, score, row_number() OVER (PARTITION BY query, article_id ORDER BY score DESC, doc) AS best
  FROM c_ranked JOIN (SELECT doc, article_id FROM docs) USING (doc) WHERE rank <= 400 AND article_id IS NOT NULL
), c_pooled AS (SELECT query, article_id AS doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank FROM c_best WHERE best = 1),
runs AS (SELECT query, doc, rank, 0 AS run FROM c_pooled WHERE rank <= 100 UNION ALL SELECT query, doc, rank, 1 FROM d_pooled WHERE rank <= 100),
fused AS (SELECT query, doc, round(sum(1.0::double / (60 + rank)), 9) AS score, min(run * 1000000 + rank) AS seen FROM runs GROUP BY query, doc),
ranked AS (SELECT query, doc, score, CAST(seen // 1000000 AS integer) AS run, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen) AS rank FROM fused)
SELECT query, doc, rank, score, run FROM ranked WHERE rank <= 10"""
)
def hybrid_dense_top10(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 and the dense leg, both over chunks pooled to articles and to a depth of 100, fused by reciprocal rank."""
    chunks = _chunks(spark, folder)
    hits = sharded_search.search_texts(chunks.select("doc", "text"), _asked(spark, folder), 100 * bm25.FANOUT)
    lexical = bm25.pooled(hits, chunks.select(F.col("doc").alias("chunk_id"), "article_id").where("article_id is not null"), 100)
    return fuse([lexical, _dense_leg(spark, folder, 100)], 10).select("query", "doc", "rank", "score", "run")


_OVERLAP = f"""list_distinct({words_sql('asked.text')})"""


@R.add(
    _BM25
    + f""", scored AS (
  SELECT query, doc, round(coalesce(len(list_intersect(a, d)) / nullif(len(a), 0)::double, 0), 6) AS score FROM (
    SELECT u_ranked.query, u_ranked.doc, {_OVERLAP} AS a, {words_sql('docs.text')} AS d
    FROM u_ranked JOIN asked ON asked.query = u_ranked.query JOIN docs ON docs.doc = u_ranked.doc WHERE rank <= 30)
), again AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)
SELECT query, doc, rank, score FROM again WHERE rank <= 10"""
)
def rerank_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty candidates a question, ordered anew by a lexical scorer in place of a cross-encoder."""
    docs, asked = _docs(spark, folder), _asked(spark, folder)
    return rerank(sharded_search.search_texts(docs, asked, 30), asked, docs, 10).select("query", "doc", "rank", "score")


_METRICS = (
    _BM25
    + f""", {GOLD}, relevant AS (
  SELECT DISTINCT query_id AS query, article_id AS doc FROM gold JOIN asked ON asked.query = gold.query_id WHERE article_id IN (SELECT article_id FROM articles)
), sizes AS (SELECT query, count(*) AS n_gold FROM relevant GROUP BY query),
found AS (
  SELECT r.query, count(*) FILTER (WHERE rank <= 1) AS in_1, count(*) FILTER (WHERE rank <= 5) AS in_5, count(*) AS in_10,
    min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg
  FROM u_ranked r JOIN relevant USING (query, doc) WHERE rank <= 10 GROUP BY r.query
), per_query AS (
  SELECT query, round(coalesce(in_1, 0) / n_gold, 6) AS recall_1, round(coalesce(in_5, 0) / n_gold, 6) AS recall_5, round(coalesce(in_10, 0) / n_gold, 6) AS recall_10,
    round(coalesce(1 / first, 0.0), 6) AS mrr,
    round(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda r: 1 / log2(r + 1))), 0.0), 6) AS ndcg
  FROM sizes LEFT JOIN found USING (query))"""
)


def _measured(spark: SparkSession, folder: str, run: DataFrame) -> DataFrame:
    known, asked = _articles(spark, folder), _asked(spark, folder)
    gold = _gold(spark, folder).select(F.col("query_id").alias("query"), F.col("article_id").alias("doc")).distinct()
    gold = gold.join(asked.select("query"), "query", "left_semi").join(known.select(F.col("article_id").alias("doc")), "doc", "left_semi")
    return per_query_metrics(run, gold)


@R.add(_METRICS + " SELECT * FROM per_query")
def metrics_per_query(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of each judged question of the query set."""
    return _measured(spark, folder, sharded_search.search_texts(_docs(spark, folder), _asked(spark, folder), 10))


@R.add(
    _METRICS
    + " SELECT count(*) AS n_queries, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10,"
    " round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per_query"
)
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The means of the metrics over the judged questions of the query set."""
    return mean_metrics(metrics_per_query(spark, folder))


@R.add(_FUSED + f", {GOLD} SELECT r.query, r.doc, r.rank, coalesce(g.hit, false) AS is_gold FROM ranked r LEFT JOIN (SELECT DISTINCT query_id, article_id, true AS hit FROM gold) g ON g.query_id = r.query AND g.article_id = r.doc WHERE rank <= 10")
def hits_with_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Fused hits, each with whether it is judged relevant in any split."""
    gold = _gold(spark, folder).select(F.col("query_id").alias("query"), F.col("article_id").alias("doc")).distinct().withColumn("hit", F.lit(True))
    return _hybrid(spark, folder, 10).join(gold, ["query", "doc"], "left").select("query", "doc", "rank", F.coalesce("hit", F.lit(False)).alias("is_gold"))


@R.add(
    f"""WITH {QUESTIONS}, ranked AS (SELECT query_id, source, line_no, row_number() OVER (PARTITION BY source ORDER BY line_no) AS place
  FROM questions JOIN (SELECT line_no, coalesce(source, '') AS source FROM queries) USING (line_no))
SELECT source, place, query_id FROM ranked WHERE place > 10 AND place <= 30"""
)
def split_queries_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of questions of each source in file order: twenty after the first ten."""
    sources = table(spark, folder, "queries").select("line_no", F.coalesce("source", F.lit("")).alias("source"))
    rows = _questions(spark, folder).join(sources, "line_no")
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("line_no")))
    return placed.where("place > 10 and place <= 30").select("source", "place", "query_id")


@R.add(f"WITH {GOLD}, ids AS (SELECT \"query-id\" AS query_id, min(line_no) AS line_no FROM qrels WHERE split = 'train' AND \"query-id\" IS NOT NULL GROUP BY 1) SELECT query_id, line_no FROM ids ORDER BY line_no LIMIT 50 OFFSET 100")
def split_ids_page(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty ids of a split in file order, after the first hundred."""
    ids = table(spark, folder, "qrels").where("split = 'train' and `query-id` is not null").groupBy(F.col("query-id").alias("query_id")).agg(F.min("line_no").alias("line_no"))
    return ids.orderBy("line_no").offset(100).limit(50)


@R.add(
    f"""WITH {ARTICLES}, {GOLD}, {QUESTIONS}, pairs AS (SELECT DISTINCT query_id, article_id FROM gold),
texts AS (SELECT p.query_id, p.article_id, q.text AS asked, concat(a.title, chr(10), a.text) AS text FROM pairs p JOIN questions q USING (query_id) JOIN articles a USING (article_id))
SELECT query_id, article_id, round(coalesce(len(list_intersect(a, d)) / nullif(len(a), 0)::double, 0), 6) AS score FROM (
  SELECT query_id, article_id, list_distinct({words_sql('asked')}) AS a, {words_sql('text')} AS d FROM texts)"""
)
def judged_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical score of every judged pair of question and article."""
    pairs = _gold(spark, folder).select("query_id", "article_id").distinct()
    texts = pairs.join(_questions(spark, folder).select("query_id", F.col("text").alias("asked")), "query_id").join(_docs(spark, folder).withColumnRenamed("doc", "article_id"), "article_id")
    return texts.select("query_id", "article_id", F.round(overlap(F.col("asked"), F.col("text")), 6).alias("score"))


