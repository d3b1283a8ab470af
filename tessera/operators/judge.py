"""Judging whether answers are faithful to their passages, with a log that a later run takes up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CONTEXT_MARK, verdict
from tessera.operators.generate import Generator, generate
from tessera.sources.stores import append_rows, unfinished

JUDGE = 'Nhận xét xem câu trả lời có được các đoạn văn chứng minh không. Chỉ trả lời bằng JSON: {"faithful": true hoặc false, "reason": "..."}.'


def judge_prompts(answers: DataFrame) -> DataFrame:
    """(id, prompt) of answers (id, context, answer): the passages and the question as saved, then the answer."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.concat(F.coalesce("context", F.lit(CONTEXT_MARK)), F.lit("\n\nCÂU TRẢ LỜI: "), F.coalesce("answer", F.lit("")))
    return answers.select("id", F.array(turn("system", F.lit(JUDGE)), turn("user", asked)).alias("prompt"))


def open_verdicts(answers: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The answers (id, refused, ...) that do not refuse and have no verdict in the log (id, faithful)."""
    work = answers.where(~F.col("refused"))
    return work if log is None else unfinished(work, log.where("faithful is not null"))


def judge(answers: DataFrame, make: Callable[[], Generator], path: str, log: DataFrame | None = None, *, per_minute: float = 0) -> DataFrame:
    """Ask for the open verdicts of ``answers`` (id, context, answer, refused), append them to the log at ``path`` and return it.

    (id, faithful, status). A reply without a readable verdict, and an error, give a null verdict, so that a later run asks
    again. After the quota is spent nothing more is asked; rows with status ``quota`` are not logged.
    """
    replies = generate(judge_prompts(open_verdicts(answers, log)), make, per_minute=per_minute)
    append_rows(replies.where("status <> 'quota'").select("id", verdict(F.col("answer")).alias("faithful"), "status"), path)
    return answers.sparkSession.read.parquet(path)


def verdicts(log: DataFrame) -> DataFrame:
    """(id, faithful): one verdict an id; repeated ones agree or count as not faithful."""
    return log.where("faithful is not null").groupBy(F.col("id")).agg(F.min("faithful").alias("faithful"))
