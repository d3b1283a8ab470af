"""Scoring answers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.answers import scored

COLUMNS = ["line_no", "model", "answerable", "refused", "invalid_cite", "uncited", "cites_gold", "cite_precision"]


def score_stream(answers: DataFrame) -> DataFrame:
    """Each arriving answer with its marks; no state is kept."""
    return scored(answers).select(*COLUMNS)


def score_files(spark: SparkSession, source: str, target: str, progress: str) -> DataFrame:
    """Score every file under ``source`` that ``progress`` has not seen, append to ``target`` and return all of it."""
    schema = spark.read.parquet(source).schema
    stream = score_stream(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def windowed_judgements(judged: DataFrame, late: str = "30 days") -> DataFrame:
    """(start, split, judged) in windows of 28 days over a stream of (judged_at, split), with a watermark for late rows."""
    return (
        judged.withColumn("at", F.col("judged_at").cast("timestamp")).withWatermark("at", late)
        .groupBy(F.window("at", "28 days").alias("w"), "split").agg(F.count("*").alias("judged"))
        .select(F.col("w.start").alias("start"), "split", "judged")
    )
