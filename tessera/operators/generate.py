"""Answering prompts with a pluggable model, with even spacing of calls and errors as data."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.answers import gated
from tessera.operators.contexts import context_docs
from tessera.operators.ranking import overlap, rerank

Generator = Callable[[list[dict]], str]


class Spacing:
    """Calls at even distances; ``per_minute`` 0 means without limit."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute if per_minute else 0.0, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if self.gap and now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


class OutOfQuota(Exception):
    """The model will not answer any more today."""


class ModelError(Exception):
    """What a model's server answered instead: an HTTP status and its message."""

    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status, self.message = status, message


def wait_hint(message: str, default: float = 30.0) -> float:
    """Seconds that an error message asks to wait, as ``functions.text.retry_delay``."""
    found = re.search(r"retry in ([0-9]+(?:\.[0-9]+)?)\s*s", message.lower())
    return float(found[1]) if found else default


def patient(model: Generator, *, attempts: int = 5, sleep=time.sleep) -> Generator:
    """The model, asked again where that may help.

    Status 429 waits as long as the message asks and a second more, or raises OutOfQuota where a daily quota is spent; a
    status from 500 on waits 10 s, twice as long each time, at most 120. Other errors, and the last one, are raised.
    """

    def ask(prompt: list[dict]) -> str:
        for n in range(attempts):
            try:
                return model(prompt)
            except ModelError as e:
                if e.status == 429 and "perday" in e.message.lower():
                    raise OutOfQuota(e.message) from e
                if (e.status != 429 and e.status < 500) or n == attempts - 1:
                    raise
                sleep(wait_hint(e.message) + 1 if e.status == 429 else min(10 * 2**n, 120))
        raise AssertionError("no attempt")

    return ask


def candidates(k: int | None, *, default_k: int = 3, pool: int = 30, reranks: bool = True) -> tuple[int, int]:
    """(passages to show, hits to retrieve): 0 or null ``k`` means the default; a re-ranker gets at least ``pool`` hits."""
    shown = k or default_k
    return shown, max(shown, pool) if reranks else shown


def generate(prompts: DataFrame, make: Callable[[], Generator], *, per_minute: float = 0, callers: int = 8) -> DataFrame:
    """(id, answer, status) of (id, prompt: array of role and content).

    ``make`` builds the model once a partition; ``callers`` partitions call it, each with its part of the rate. status is
    ``ok``, ``error: ...`` or ``quota``; after the first ``quota`` a partition asks no more. Rows are keyed by id, so
    that a retried task's repeats can be told from new answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spacing, spent = make(), Spacing(per_minute / callers if per_minute else 0), False
        for batch in batches:
            answers, states = [], []
            for prompt in batch.column(1).to_pylist():
                answer, state = None, "quota"
                if not spent:
                    spacing.wait()
                    try:
                        answer, state = model(prompt), "ok"
                    except OutOfQuota:
                        spent = True
                    except Exception as e:
                        state = f"error: {str(e)[:200]}"
                answers.append(answer)
                states.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(states, pa.string())], ["id", "answer", "status"])

    rows = prompts.select(F.col("id").cast("string").alias("id"), "prompt").repartition(callers, "id")
    return rows.mapInArrow(run, "id string, answer string, status string")


def first_sentence() -> Generator:
    """A stand-in for a model: the first sentence of the first passage, cited."""

    def answer(prompt: list[dict]) -> str:
        body = prompt[-1]["content"].partition(")\n")[2]
        sentence = body.replace("\n", ". ").partition(". ")[0].strip()
        return f"{sentence} [1]." if sentence else T.REFUSAL

    return answer


def answered(
    hits: DataFrame, questions: DataFrame, docs: DataFrame, articles: DataFrame, make: Callable[[], Generator], *,
    k: int = 3, threshold: float | None = None, scorer: Callable[[Column, Column], Column] | None = overlap,
) -> DataFrame:
    """(query, answer, refused, gated, top_score, cited): from candidates to cited answers.

    ``hits`` (query, doc, and hit_text where the match has a text of its own, else it is the whole document's) are
    re-ranked to ``k`` by ``scorer``; a question whose best score is under ``threshold``, or that has no hit, is refused
    without asking the model: only the others' rows reach it. Without a scorer the hits keep their own scores and order, and
    a threshold, which is one of the scorer's scores, raises.
    """
    if threshold is not None and scorer is None:
        raise ValueError("a threshold needs a scorer")
    if "hit_text" not in hits.columns:
        hits = hits.join(docs.select("doc", F.col("text").alias("hit_text")), "doc")
    best = rerank(hits, questions, docs, k, scorer) if scorer else hits.where(F.col("rank") <= k).select("query", "doc", "hit_text", F.col("score").cast("double").alias("score"), "rank")
    top = questions.select("query").join(best.groupBy("query").agg(F.max("score").alias("top_score")), "query", "left")
    rows = gated(top.withColumn("answer", F.lit(None).cast("string")), F.col("top_score"), threshold if threshold is not None else 0.0)
    if threshold is None:
        rows = rows.withColumn("gated", F.lit(False))
    asked = best.join(rows.where(~F.col("gated")).select("query"), "query", "left_semi")
    shown = context_docs(asked.select("query", "doc", "rank", "hit_text"), articles)
    packed = shown.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "citation", "text"))).alias("d"))
    prompts = packed.join(questions, "query").select(
        F.col("query").alias("id"), T.messages(F.col("text"), F.transform("d", lambda x: F.struct(x["citation"].alias("citation"), x["text"].alias("text")))).alias("prompt")
    )
    said = generate(prompts, make).join(packed.select(F.col("query").alias("id"), "d"), "id")
    cited = F.transform(T.valid_citations(F.col("answer"), F.size("d")), lambda i: F.struct(i.alias("index"), F.element_at("d", i)["doc"].alias("article_id"), F.element_at("d", i)["citation"].alias("citation")))
    open_ = said.select(F.col("id").alias("query"), "answer", cited.alias("cited")).join(rows.select("query", "top_score"), "query").select(
        "query", "answer", T.is_refusal(F.col("answer")).alias("refused"), F.lit(False).alias("gated"), "top_score", "cited"
    )
    shut = rows.where("gated").select("query", "answer", F.lit(True), "gated", "top_score", F.lit(None).cast(open_.schema["cited"].dataType))
    return open_.union(shut)
