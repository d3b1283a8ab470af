"""Fusing, re-ranking and measuring ranked hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.bm25 import top

RRF_K = 60


def fuse(runs: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(query, doc, score, rank, run): reciprocal rank fusion; run is the first run that has the document.

    Equal scores keep the order of first sight: run, then rank.
    """
    tagged = [r.select("query", "doc", "rank", F.lit(i).alias("run")) for i, r in enumerate(runs)]
    fused = reduce(DataFrame.unionByName, tagged).groupBy("query", "doc").agg(
        F.round(F.sum(1 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("run", "rank")).alias("seen")
    )
    order = W.partitionBy("query").orderBy(F.desc("score"), "seen")
    ranked = fused.select("query", "doc", "score", F.col("seen.run").alias("run"), F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def overlap(question: Column, text: Column) -> Column:
    """Share of a question's distinct words that a text has: a lexical stand-in for a cross-encoder score in [0, 1]."""
    asked = F.array_distinct(words(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words(text))), F.size(asked)), F.lit(0.0))


def rerank(hits: DataFrame, questions: DataFrame, docs: DataFrame, k: int, scorer=overlap) -> DataFrame:
    """(query, doc, score, rank): hits scored anew with their texts, which are fetched after the first ranking.

    ``questions`` (query, text), ``docs`` (doc, text); ``scorer`` takes two columns, so a model's Arrow function fits.
    Hits with a ``hit_text`` of their own are scored by it and keep it.
    """
    own = ["hit_text"] if "hit_text" in hits.columns else []
    paired = hits.select("query", "doc", *own).join(questions.select("query", F.col("text").alias("asked")), "query")
    paired = paired.withColumn("text", F.col("hit_text")) if own else paired.join(docs.select("doc", "text"), "doc")
    return top(paired.select("query", "doc", *own, F.round(scorer(F.col("asked"), F.col("text")), 6).alias("score")), k)


def per_query_metrics(run: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query, recall_k ..., mrr, ndcg): for every query with gold; MRR and nDCG at the largest k; no run counts as 0.

    ``gold`` (query, doc) is distinct.
    """
    most = max(ks)
    sizes = gold.groupBy("query").agg(F.count("*").alias("n_gold"))
    found = run.where(F.col("rank") <= most).join(gold, ["query", "doc"], "left_semi").groupBy("query").agg(
        *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"in_{k}") for k in ks),
        F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(most)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return sizes.join(found, "query", "left").select(
        "query",
        *(F.round(F.coalesce(F.col(f"in_{k}"), F.lit(0)) / F.col("n_gold"), 6).alias(f"recall_{k}") for k in ks),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row of means over the queries and their number."""
    names = [c for c in per_query.columns if c != "query"]
    return per_query.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in names))
