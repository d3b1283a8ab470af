"""Metrics as reports: a Markdown table and a JSON payload of a few rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1000


def _rows(metrics: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in metrics.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows; aggregate first")
    return rows


def markdown(metrics: DataFrame) -> str:
    """A table of the rows of aggregated metrics; null as a dash, fractions to four places."""
    show = lambda x: "–" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [metrics.columns, ["---"] * len(metrics.columns), *([show(r[c]) for c in metrics.columns] for r in _rows(metrics))]
    return "\n".join(f"| {' | '.join(cells)} |" for cells in lines)


def write_report(metrics: DataFrame, path: str, **settings: object) -> None:
    """One JSON document under ``path``: the settings and the rows of aggregated metrics."""
    payload = json.dumps({"settings": settings, "rows": _rows(metrics)}, ensure_ascii=False, default=str)
    metrics.sparkSession.createDataFrame([(payload,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def comparison(summaries: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(summary, columns): one row a summary row of each named frame; a column that a summary lacks is null."""
    frames = [
        df.select(F.lit(name).alias("summary"), *(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns))
        for name, df in summaries.items()
    ]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
