"""Scoring and summarising answers, tuning and applying the refusal gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import REFUSAL, clean_answer, invalid_citations, is_refusal, valid_citations


def scored(rows: DataFrame) -> DataFrame:
    """Answers (answer, n_docs, gold, ...) with answerable, refused, cited, invalid_cite, uncited, cites_gold, cite_precision.

    A null answer counts as empty, null gold as none. Precision is null where nothing valid is cited.
    """
    answer = clean_answer(F.coalesce("answer", F.lit("")))
    gold = F.coalesce("gold", F.array().cast("array<int>"))
    base = rows.withColumns({"cited": valid_citations(answer, F.col("n_docs")), "refused": is_refusal(answer), "answerable": F.size(gold) > 0})
    right = F.size(F.array_intersect("cited", gold))
    return base.withColumns({
        "invalid_cite": F.size(invalid_citations(answer, F.col("n_docs"))) > 0,
        "uncited": ~F.col("refused") & (F.size("cited") == 0),
        "cites_gold": right > 0,
        "cite_precision": F.try_divide(right.cast("double"), F.size("cited")),
    })


def summary(rows: DataFrame, by: list[str], faithful: str | None = None) -> DataFrame:
    """Rates over scored answers by group, each over its own rows; null over none; four places."""
    rate = lambda when, what: F.round(F.avg(F.when(when, what.cast("double"))), 4)
    can, refused = F.col("answerable"), F.col("refused")
    extra = []
    if faithful:
        extra = [rate(~refused, F.col(faithful)).alias("faithfulness"), F.count(F.when(~refused, F.col(faithful))).alias("n_judged")]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(can, 1)).alias("n_answerable"), F.count(F.when(~can, 1)).alias("n_negative"),
        rate(can, ~refused).alias("answer_rate"), rate(can, F.col("cites_gold")).alias("gold_cite_rate"),
        rate(~refused, F.col("cite_precision")).alias("cite_precision"), rate(~refused, F.col("invalid_cite")).alias("invalid_cite_rate"),
        rate(~refused, F.col("uncited")).alias("uncited_rate"), rate(~can, refused).alias("refusal_acc"),
        F.round(F.avg("latency_ms"), 4).alias("latency_ms"), *extra,
    )


def gate_sweep(rows: DataFrame) -> DataFrame:
    """(threshold, keep_answerable, block_negative, balanced_accuracy) at 0, every score and infinity.

    ``rows``: (score, answerable), scores rounded to a few places. Counts per distinct score come first, in parallel; the
    running sums then see each distinct score once, in one task: ten thousand of them at four places.
    """
    marks = rows.sparkSession.createDataFrame([(0.0,), (float("inf"),)], "threshold double")
    counts = rows.groupBy(F.col("score").alias("threshold")).agg(
        F.count(F.when(F.col("answerable"), 1)).alias("pos"), F.count(F.when(~F.col("answerable"), 1)).alias("neg")
    )
    points = counts.unionByName(marks.withColumns({"pos": F.lit(0), "neg": F.lit(0)})).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    passed = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rated = points.select(
        "threshold",
        F.try_divide(F.sum("pos").over(passed), F.sum("pos").over(total)).alias("keep"),
        (1 - F.try_divide(F.sum("neg").over(passed), F.sum("neg").over(total))).alias("block"),
    )
    return rated.select(
        "threshold", F.round("keep", 6).alias("keep_answerable"), F.round("block", 6).alias("block_negative"),
        F.round((F.col("keep") + F.col("block")) / 2, 6).alias("balanced_accuracy"),
    )


def choose_threshold(points: DataFrame, min_keep: float | None = None) -> DataFrame:
    """The best point: by balanced accuracy, or by blocking among those that keep enough; the lower threshold on ties."""
    goal = "balanced_accuracy" if min_keep is None else "block_negative"
    kept = points if min_keep is None else points.where(F.col("keep_answerable") >= min_keep)
    return kept.orderBy(F.desc(goal), "threshold").limit(1)


def gated(rows: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Answers with the fixed refusal wherever the score is null or under the threshold; ``gated`` says where."""
    low = score.isNull() | (score < threshold)
    return rows.withColumn("gated", low).withColumn("answer", F.when(low, REFUSAL).otherwise(F.col("answer")))
