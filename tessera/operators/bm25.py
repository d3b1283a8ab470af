"""BM25 over long postings: one row a term and document, so that an index is a table and a search is a join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import with_bigrams, words

K1, B = 1.5, 0.75
FANOUT = 4


def tokenized(docs: DataFrame, key: str, text: str, bigrams: bool = False) -> DataFrame:
    """(key, tokens) of each document."""
    rows = docs.select(key, words(F.col(text)).alias("tokens"))
    return rows.withColumn("tokens", with_bigrams(F.col("tokens"))) if bigrams else rows


@dataclass
class Index:
    """postings (term, doc, tf, n); terms (term, df); stats, one row (n_docs, avg_len); documents as :func:`counted` gives."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    documents: DataFrame | None = None

    def weights(self) -> DataFrame:
        """(term, doc, tf, weight): idf and saturated term frequency, over zero for every posting."""
        n, avg = F.col("n_docs"), F.col("avg_len")
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = K1 * (1 - B + B * F.col("n") / avg)
        # One row of statistics beside every posting.
        return self.postings.join(self.terms, "term").crossJoin(F.broadcast(self.stats)).select(
            "term", "doc", "tf", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("weight")
        )


def counted(sized: DataFrame) -> DataFrame:
    """(doc, n, terms, times) of (doc, tokens, n): the distinct terms of each document and how often it has them, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = tokens.flatten().dictionary_encode()
            wide = max(len(coded.dictionary), 1)
            pair, times = np.unique(np.repeat(np.arange(len(batch)), lengths) * wide + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(pair, wide)
            ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            own = (pa.ListArray.from_arrays(ends, x) for x in (coded.dictionary.take(pa.array(term)), pa.array(times, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), *own], ["doc", "n", "terms", "times"])

    return sized.mapInArrow(run, f"doc {sized.schema['doc'].dataType.simpleString()}, n int, terms array<string>, times array<int>")


def build(tokens: DataFrame, only: DataFrame | None = None) -> Index:
    """The index of (doc, tokens); ``only`` (term) keeps the postings of some terms, for a search without a stored index.

    Length counts all tokens of a document, and documents without a token count in the average. Counting terms
    starts inside the partition a document is in. ``doc`` is unique.
    """
    doc, _ = tokens.columns
    sized = tokens.select(F.col(doc).alias("doc"), "tokens", F.size("tokens").alias("n"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.greatest(F.coalesce(F.avg("n"), F.lit(0.0)), F.lit(1e-9)).alias("avg_len"))
    long = sized.select("doc", "n", F.explode("tokens").alias("term"))
    if only is not None:
        long = long.join(only, "term", "left_semi")
    postings = long.groupBy("doc", "n", "term").agg(F.count("*").alias("tf"))
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), stats, counted(sized))


def query_terms(queries: DataFrame, key: str, text: str, bigrams: bool = False) -> DataFrame:
    """(query, term): the distinct terms of each query; a query's own term counts play no part."""
    rows = tokenized(queries, key, text, bigrams)
    return rows.select(F.col(key).alias("query"), F.explode(F.array_distinct("tokens")).alias("term"))


def search(weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): the best ``k`` documents a query, ties by document.

    Scores are decimal sums of weights rounded to nine places, so that they do not depend on the order of adding. A
    document without a common term is no hit.
    """
    scored = (
        terms.join(weights.select("term", "doc", F.round("weight", 9).cast("decimal(20,9)").alias("weight")), "term")
        .groupBy("query", "doc").agg(F.sum("weight").alias("score"))
    )
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query by score, then by document."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_texts(docs: DataFrame, queries: DataFrame, k: int, *, bigrams: bool = False) -> DataFrame:
    """Search (doc, text) for (query, text) without a stored index: only postings of asked terms are counted.

    Document lengths and their number still cover every document.
    """
    terms = query_terms(queries, "query", "text", bigrams)
    index = build(tokenized(docs, "doc", "text", bigrams), terms.select("term").distinct())
    return search(index.weights(), terms, k)


def pooled(chunk_hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank, chunk): articles by their best chunk, from chunk hits that were cut at k * FANOUT.

    ``chunks``: (chunk_id, article_id). A long article may hold several of the chunk hits, so fewer than k remain.
    """
    hits = chunk_hits.where(F.col("rank") <= k * FANOUT).withColumnRenamed("doc", "chunk_id").join(chunks.select("chunk_id", "article_id"), "chunk_id")
    best = hits.withColumn("best", F.row_number().over(W.partitionBy("query", "article_id").orderBy(F.desc("score"), "chunk_id"))).where("best = 1")
    order = W.partitionBy("query").orderBy(F.desc("score"), "article_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", F.col("article_id").alias("doc"), "score", "rank", F.col("chunk_id").alias("chunk"))
