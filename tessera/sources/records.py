"""Articles, queries, judgements and chunks as tables with one meaning; JSON lines in and out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ARTICLE_JSON = "_id string, id string, title string, text string"
QUERY_JSON = "_id string, id string, text string"
QREL_JSON = "`query-id` string, `corpus-id` string, score double"
CHUNK_JSON = "id string, article_id string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """UTF-8 JSON lines under a fixed schema; blank lines are skipped, a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, replacing what is there; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with one key the last by ``order``; rows with a null key fall out."""
    newest = F.row_number().over(W.partitionBy(f"`{key}`").orderBy(F.desc(order)))
    return df.where(F.col(f"`{key}`").isNotNull()).withColumn("newest", newest).where("newest = 1").drop("newest")


def articles(corpus: DataFrame, order: str = "line_no") -> DataFrame:
    """(article_id, title, text): the last row of each id; a missing title or text is empty."""
    rows = last_rows(corpus.select("_id", "title", "text", order), "_id", order)
    return rows.select(F.col("_id").alias("article_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def questions(queries: DataFrame, order: str = "line_no") -> DataFrame:
    """(query_id, text, line_no): the last row of each id; a missing text is empty."""
    rows = last_rows(queries.select("_id", "text", order), "_id", order)
    return rows.select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), order)


def judgements(qrels: DataFrame) -> DataFrame:
    """(split, query_id, article_id): distinct positive judgements; a missing score counts as 1."""
    rows = qrels.where(F.coalesce(F.col("score").cast("double"), F.lit(1.0)) > 0)
    return rows.select("split", F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("article_id")).where("query_id is not null and article_id is not null").distinct()


def judged_with_corpus(gold: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """Judgements of existing questions that have a gold article in the corpus; each keeps its whole gold set."""
    held = gold.join(known.select("article_id"), "article_id", "left_semi").select("split", "query_id").distinct()
    return gold.join(asked.select("query_id"), "query_id", "left_semi").join(held, ["split", "query_id"], "left_semi").select("split", "query_id", "article_id")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows just read from files with ``line_no``: by file name, then by place in the file."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("line_no", place)


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from JSON lines: ``id`` stands in for ``_id``; of repeated ids the last line counts, files in the order of their names."""
    rows = in_order(read_jsonl(spark, path, ARTICLE_JSON))
    return articles(rows.withColumn("_id", F.coalesce("_id", "id")))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) from JSON lines: ``id`` stands in for ``_id``; of repeated ids the last line counts; a missing text is empty."""
    rows = in_order(read_jsonl(spark, path, QUERY_JSON))
    return questions(rows.withColumn("_id", F.coalesce("_id", "id"))).drop("line_no")


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(id, article_id, text) from JSON lines; a chunk without one of them raises when it is read."""
    rows = read_jsonl(spark, path, CHUNK_JSON)
    must = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a chunk has no {c}")).cast("string")).alias(c)
    return rows.select(*map(must, ("id", "article_id", "text")))


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines of ``id``, ``article_id`` and ``text``."""
    write_jsonl(chunks.select("id", "article_id", "text"), path)


@dataclass
class Dataset:
    """articles (article_id, title, text); queries (query_id, text); judgements (split, query_id, article_id)."""

    articles: DataFrame
    queries: DataFrame
    judgements: DataFrame


def load_dataset(spark: SparkSession, folder: str) -> Dataset:
    """``corpus.jsonl``, ``queries.jsonl`` and every ``qrels/*.jsonl`` of a folder, each a file or a folder of parts."""
    return Dataset(load_articles(spark, f"{folder}/corpus.jsonl"), load_queries(spark, f"{folder}/queries.jsonl"), load_judgements(spark, f"{folder}/qrels"))


def load_judgements(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements of every ``*.jsonl`` file of a folder; the split is the file's name."""
    rows = read_jsonl(spark, f"{folder}/*.jsonl", QREL_JSON)
    name = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1))
    return judgements(rows.withColumn("split", name))


def save_articles(df: DataFrame, path: str) -> None:
    """Articles as JSON lines of ``_id``, ``title`` and ``text``."""
    write_jsonl(df.select(F.col("article_id").alias("_id"), "title", "text"), path)
