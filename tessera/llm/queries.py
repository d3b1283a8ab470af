"""Queries of the operators on training and evaluation text, with SQL where SQL can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.answers import answer_rows, defects, train_languages
from tessera.llm.canonical import canonicalize, non_canonical
from tessera.llm.cross_split import overlap_report, split_overlaps
from tessera.llm.near_duplicates import NearDuplicates, near_duplicates
from tessera.llm.packing import fill_report, pack
from tessera.llm.reading import reading_levels, train
from tessera.llm.splitting import split_oversized
from tessera.llm.tokens import encode
from tessera.sources.tables import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# 1. Near-duplicate records with small edits


def _articles(spark: SparkSession, folder: str) -> NearDuplicates:
    corpus = spread_table(spark, folder, "corpus").where(F.col("text").rlike(r"(?U)\S"))
    return near_duplicates(corpus, "_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), "text"), width=3, threshold=0.7)


@query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of articles that are near copies of each other."""
    return _articles(spark, folder).pairs.select("id_a", "id_b")


@query()
def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near copies of each article."""
    return _articles(spark, folder).classes.select(F.col("key").alias("id"), "class_id")


# 3. Splitting oversized items at natural boundaries


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus").select(F.lit("corpus").alias("src"), "line_no", "text").union(
        table(spark, folder, "chunks").select(F.lit("chunks"), "line_no", "text")
    )


@query(
    "SELECT 'corpus' AS src, line_no FROM corpus WHERE length(text) > 1200 "
    "UNION ALL SELECT 'chunks', line_no FROM chunks WHERE length(text) > 1200"
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles and chunks that had to be cut."""
    pieces = split_oversized(_items(spark, folder), ["src", "line_no"], F.col("text"))
    return pieces.where("n_pieces > 1 and piece_no = 0").select("src", "line_no")


@query()
def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every article and chunk."""
    return split_oversized(_items(spark, folder), ["src", "line_no"], F.col("text"))


# 4. Broken prompt and response pairs


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that are no usable reply, with their defect."""
    answers = answer_rows(spread_table(spark, folder, "generations"), spread_table(spark, folder, "sft_raw"))
    return defects(answers, train_languages(spread_table(spark, folder, "documents")))


# 5. Visually identical text with different characters


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of queries and corpus that are not stored in the canonical form."""
    queries = non_canonical(table(spark, folder, "queries"), "queries", ["text"])
    corpus = non_canonical(table(spark, folder, "corpus"), "corpus", ["text", "title"])
    return queries.union(corpus).select("src", "field", "line_no")


@query()
def p5_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """All values of queries and corpus in the canonical form."""
    queries = canonicalize(table(spark, folder, "queries"), ["text"])
    corpus = canonicalize(table(spark, folder, "corpus"), ["title", "text"])
    return queries.select(F.lit("queries").alias("src"), "line_no", F.lit(None).cast("string").alias("title"), "text").union(
        corpus.select(F.lit("corpus"), "line_no", "title", "text")
    )


# 6. Same or near-same records across splits


@query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of val and test that are in train too, exactly or almost."""
    return split_overlaps(table(spark, folder, "queries"), table(spark, folder, "qrels"))


@query()
def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping questions and their pairs per split and source."""
    queries, qrels = table(spark, folder, "queries"), table(spark, folder, "qrels")
    return overlap_report(split_overlaps(queries, qrels), queries, qrels)


# 7. Encoding of the whole corpus with a public tokenizer


@query()
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """byte_bpe_50k ids of every document."""
    return encode(spread_table(spark, folder, "documents"), "doc_id")


# 8. Filling fixed-capacity containers with items


@query()
def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every part of one that exceeds a container."""
    return pack(spread_table(spark, folder, "documents"), "doc_id")


@query()
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(pack(spread_table(spark, folder, "documents"), "doc_id"))


# 9. Reading level of each document


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread_table(spark, folder, "documents")
    return reading_levels(documents, train(documents, table(spark, folder, "reading_labels")))


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Vietnamese documents of level 4 or 5."""
    return _levels(spark, folder).where("level >= 4").select("doc_id")


@query()
def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The estimate and the grades of every Vietnamese document."""
    return _levels(spark, folder)
