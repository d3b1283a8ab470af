"""Cutting articles into windows of whole lines with overlap (the retrieval units)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip


def lines_of(body: str, limit: int, overlap: int) -> list[str]:
    """Stripped lines that hold something; a longer line as slices of ``limit`` that overlap."""
    out = []
    for line in map(str.strip, body.split("\n")):
        step, last = limit - overlap, max(0, len(line) - limit)
        starts = range(0, last + step, step) if last else (0,)
        out += [piece for s in starts if (piece := line[s : s + limit])]
    return out


def windows(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first line, end) of each window over lines of the given lengths.

    A line costs its length and one. A window ends before the line that would pass the limit, but it always takes
    the line that closed the one before it, so it may reach limit + overlap. It begins with the longest run of
    whole lines at the end of the one before that is within the overlap.
    """
    at = [0, *accumulate(n + 1 for n in sizes)]
    out, first, taken = [], 0, 0
    while taken < len(sizes):
        # The first line beyond `taken` whose end passes the limit.
        end = max(taken + 1, bisect_right(at, at[first] + limit + 1) - 1)
        out.append((first, min(end, len(sizes))))
        taken = out[-1][1]
        first = max(first, bisect_left(at, at[taken] - overlap - 1))
    return out


def chunk_articles(articles: DataFrame, limit: int = 1200, overlap: int = 200) -> DataFrame:
    """(chunk_id, article_id, chunk_no, text) of articles (article_id, title, text).

    A body within the limit is one chunk, the title in front of it; of a longer one every chunk has the title. An empty
    article is one empty chunk. Short articles stay in the JVM.
    """
    if overlap >= limit:
        raise ValueError("overlap must be smaller than the limit")
    rows = articles.select("article_id", strip(F.col("title")).alias("header"), strip(F.col("text")).alias("body"))
    short = rows.where(F.length("body") <= limit).select(
        F.concat("article_id", F.lit("#0")).alias("chunk_id"), "article_id", F.lit(0).alias("chunk_no"),
        strip(F.concat("header", F.lit("\n"), "body")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int, str]] = []
            for article, header, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = lines_of(body, limit, overlap)
                for no, (a, b) in enumerate(windows(list(map(len, lines)), limit, overlap)):
                    out.append((f"{article}#{no}", article, no, "\n".join([header, *lines[a:b]])))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk_id", "article_id", "chunk_no", "text"])

    long = rows.where(F.length("body") > limit).mapInArrow(run, "chunk_id string, article_id string, chunk_no int, text string")
    return short.union(long)
