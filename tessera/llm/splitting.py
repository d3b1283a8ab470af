"""Splitting oversized items at natural boundaries (problem 3): balanced targets.

The least number of pieces gives equal-length targets. Each target is moved to the strongest boundary near it, or,
where there is none near, to the nearest one anywhere the limits allow. If a limit fails, there are more pieces; a text
that no balance suits, such as one with few boundaries, gets pieces as long as may be.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = re.compile(r"\s+")
_SENTENCE_END = re.compile(r"[.!?…;:。？！][\"'”’)\]»]*\Z")
PARAGRAPH, LINE, SENTENCE, WORD, NONE = 4, 3, 2, 1, 0
PIECE = "piece_no int, n_pieces int, start int, cut int, stop int, boundary int, piece string"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places after white space and how strong each is: paragraph, line, sentence or word."""
    at, strength = [], []
    for m in _BLANKS.finditer(text):
        lines = m.group().count("\n")
        at.append(m.end())
        if lines:
            strength.append(PARAGRAPH if lines > 1 else LINE)
        else:
            strength.append(SENTENCE if _SENTENCE_END.search(text, max(0, m.start() - 4), m.start()) else WORD)
    return at, strength


def _joined(text: str, place: int) -> bool:
    """Whether a cut at ``place`` would part a combining mark or a joiner from its letter."""
    return place < len(text) and ("\u0300" <= text[place] <= "\u036f" or text[place] in "\u200d\ufe0f")


def cuts(text: str, limit: int, overlap: int, slack: float = 0.15) -> list[tuple[int, int, int, int]]:
    """(start, cut, stop, strength of the boundary at stop) of each piece: text[start:stop], new from cut on.

    The parts text[cut:stop] joined give the text; start <= cut repeats at most ``overlap`` characters; no piece
    is longer than ``limit``.
    """
    size, step = len(text), limit - overlap
    if size <= limit:
        return [(0, 0, size, NONE)]
    at, strength = boundaries(text)
    least = pieces = ceil((size - overlap) / step)
    while pieces <= 2 * least + 8:
        if (done := _balanced(text, at, strength, pieces, limit, overlap, slack)) is not None:
            return done
        pieces += 1 + pieces // 20
    return _greedy(text, at, strength, limit, overlap, slack)


def _hard(text: str, low: int, place: int) -> int:
    """A cut without a boundary: at ``place``, or before the letter that marks there belong to."""
    stop = place
    while stop > low and _joined(text, stop):
        stop -= 1
    return stop if stop > low else place


def _repeat_from(text: str, at: list[int], strength: list[int], cut: int, stop: int, overlap: int) -> int:
    """Where the next piece starts: at the first sentence or else word within the overlap before ``stop``."""
    first = max(stop - overlap, cut)
    a, b = bisect_left(at, first), bisect_left(at, stop)
    sentence = next((at[k] for k in range(a, b) if strength[k] >= SENTENCE), None)
    start = sentence if sentence is not None else at[a] if a < b else first
    while start < stop and _joined(text, start):
        start += 1
    return start


def _balanced(text: str, at: list[int], strength: list[int], pieces: int, limit: int, overlap: int, slack: float) -> list | None:
    """The cuts into ``pieces`` pieces, or None if a limit fails or a boundary in reach would be passed over."""
    size, step = len(text), limit - overlap
    done, start, cut = [], 0, 0
    for i in range(pieces - 1):
        left = pieces - 1 - i
        high = min(start + limit, size - left)  # as far as this piece may reach
        low = max(cut + 1, size - left * step)  # what the others can still take
        if low > high:
            return None
        target = cut + round((size - cut) / (left + 1)) + (round(overlap / (left + 1)) if not i else 0)
        target = min(max(target, low), high)
        near = slack * step
        a, b = bisect_left(at, max(low, target - near)), bisect_right(at, min(high, target + near))
        if a < b:
            best = min(range(a, b), key=lambda k: (-strength[k], abs(at[k] - target), at[k]))
        else:
            a, b = bisect_left(at, low), bisect_right(at, high)
            best = min(range(a, b), key=lambda k: (abs(at[k] - target), at[k]), default=None)
        if best is None and bisect_right(at, cut) < bisect_right(at, min(start + limit, size - 1)):
            return None
        stop, kind = (at[best], strength[best]) if best is not None else (_hard(text, low, target), NONE)
        done.append((start, cut, stop, kind))
        start, cut = _repeat_from(text, at, strength, cut, stop, overlap), stop
    return [*done, (start, cut, size, NONE)] if size - start <= limit else None


def _greedy(text: str, at: list[int], strength: list[int], limit: int, overlap: int, slack: float) -> list:
    """Each piece as long as may be, up to the strongest boundary near its limit: for texts that no balance suits."""
    size, done, start, cut = len(text), [], 0, 0
    while size - start > limit:
        high = start + limit
        a, b = bisect_right(at, cut), bisect_right(at, high)
        if a < b:
            close = range(max(a, bisect_left(at, high - slack * (limit - overlap))), b)
            best = max(close, key=lambda k: (strength[k], at[k]), default=b - 1)
            stop, kind = at[best], strength[best]
        else:
            stop, kind = _hard(text, cut + 1, high), NONE
        done.append((start, cut, stop, kind))
        start, cut = _repeat_from(text, at, strength, cut, stop, overlap), stop
    return [*done, (start, cut, size, NONE)]


def split_oversized(df: DataFrame, keys: list[str], text: Column, limit: int = 1200, overlap: int = 200) -> DataFrame:
    """(keys, piece_no, n_pieces, start, cut, stop, boundary, piece): the pieces of each text, in code points.

    A text within the limit is one piece as stored. A null text has no piece, an empty text one empty piece. Repeated
    rows stay repeated. Where unbroken text is longer than a piece it is cut at the target, not before a combining
    mark. Only texts over the limit reach Python; columns of ``df`` besides ``keys`` are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    rows = df.select(*keys, text.alias("piece")).where(F.col("piece").isNotNull())
    whole = rows.where(F.length("piece") <= limit).select(
        *keys, *(F.lit(x).cast("int").alias(n) for n, x in (("piece_no", 0), ("n_pieces", 1), ("start", 0), ("cut", 0))),
        F.length("piece").alias("stop"), F.lit(NONE).alias("boundary"), "piece",
    )
    large = rows.where(F.length("piece") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], {k: [] for k in ("piece_no", "n_pieces", "start", "cut", "stop", "boundary", "piece")}
            for i, t in enumerate(batch.column("piece").to_pylist()):
                parts = cuts(t, limit, overlap)
                for k, (start, cut, stop, kind) in enumerate(parts):
                    row.append(i)
                    for name, x in zip(out, (k, len(parts), start, cut, stop, kind, t[start:stop])):
                        out[name].append(x)
            own = batch.select(keys).take(pa.array(row, pa.int32()))
            made = [pa.array(x, pa.string() if n == "piece" else pa.int32()) for n, x in out.items()]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [*keys, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.select(*keys).schema)
    return whole.unionByName(large.mapInArrow(run, f"{kinds}, {PIECE}"))
