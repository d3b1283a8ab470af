"""Exact inner-product search over stored vectors, and vectors of text for it."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.bm25 import FANOUT, pooled, top

BLOCK = 2048
MOST_BYTES = 64 << 20  # of query vectors that go to every task


def normalized(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def text_vectors(texts: DataFrame, key: str, tokens: str, size: int = 64) -> DataFrame:
    """(key, vector): tokens hashed to ``size`` places with signs, at length one; a stand-in for an encoder model.

    The place is the first seven hexadecimal digits of a token's MD5 modulo ``size``, the sign that of the eighth digit
    (under 8: plus). Null or empty tokens give the zero vector.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}

        def place(token: str) -> tuple[int, int]:
            if (at := known.get(token)) is None:
                digest = md5(token.encode()).hexdigest()
                at = known[token] = (int(digest[:7], 16) % size, 1 if digest[7] < "8" else -1)
            return at

        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            sums = np.zeros((len(batch), size))
            for i, own in enumerate(batch.column(1).to_pylist()):
                for at, sign in map(place, own or ()):
                    sums[i, at] += sign
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            flat = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).ravel()
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], [key, "vector"])

    return texts.select(key, tokens).mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def _best(q_ids: np.ndarray, q_mat: np.ndarray, c_ids: np.ndarray, c_mat: np.ndarray, k: int, skip_self: bool) -> pa.RecordBatch:
    """The best ``k`` of a block of rows for each query, ties by key."""
    score = np.round(q_mat @ c_mat.T, 6) + 0.0
    if skip_self:
        score[q_ids[:, None] == c_ids[None, :]] = -np.inf
    by_key = np.argsort(c_ids, kind="stable")
    best = by_key[np.argsort(-score[:, by_key], axis=1, kind="stable")[:, :k]]
    value = np.take_along_axis(score, best, axis=1)
    keep = np.isfinite(value)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep.sum(axis=1))), pa.array(c_ids[best[keep]]), pa.array(value[keep])], ["query", "doc", "score"])


def _arrays(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    names = np.array(ids.to_pylist(), object) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)
    return names, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def dense_search(
    queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, *, block: int = BLOCK, skip_self: bool = True, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(query, doc, score, rank): the ``k`` largest inner products a query, to six places, ties by key.

    A stated set of queries against all rows. Query vectors of at most ``most_bytes`` in all go to every task and meet the
    rows where these are read: a matrix product a batch, of which the best k of each query go on. More are put in blocks that
    are shuffled to blocks of rows. Rows with a null key or vector are left out. All vectors have one length.
    """
    q, c = (rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null") for rows in (queries, corpus))
    kind = c.schema["id"].dataType.simpleString()
    schema = f"query {kind}, doc {kind}, score double"
    size = q.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8
    if size > most_bytes:
        return top(_blockwise(q, c, block, schema, k, skip_self), k)
    held = q.toArrow().combine_chunks()
    if not len(held):
        return top(c.sparkSession.createDataFrame([], schema), k)
    q_ids, q_mat = _arrays(held.column("id").combine_chunks(), held.column("v").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _best(q_ids, q_mat, *_arrays(batch.column(0), batch.column(1)), k, skip_self)

    return top(c.mapInArrow(run, schema), k)


def _blockwise(q: DataFrame, c: DataFrame, block: int, schema: str, k: int, skip_self: bool) -> DataFrame:
    """Blocks of rows by a hash of their key; every block of queries is sent to each of them."""

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = rows.agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.lit(1)).cast("int").alias("n"))  # one row
        placed = rows.crossJoin(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        return placed.groupBy("block", "n").agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_v"))

    rows = blocks(c, "c")
    count = rows.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"))  # one row
    asked = blocks(q, "q").drop("n", "block").crossJoin(F.broadcast(count)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = asked.select("block", "q_ids", "q_v").join(rows.drop("n").hint("shuffle_hash"), "block").select("q_ids", "q_v", "c_ids", "c_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sides = [_arrays(batch.column(at)[i].values, batch.column(at + 1)[i].values) for at in (0, 2)]
                yield _best(*sides[0], *sides[1], k, skip_self)

    return pairs.mapInArrow(run, schema)


def dense_pooled(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank, chunk): articles by their best chunk.

    ``queries`` (query, vector), ``chunks`` (chunk_id, article_id, vector). Each query first gets FANOUT * k chunks, without
    regard to the sign of their score, so that fewer than ``k`` articles may remain.
    """
    hits = dense_search(
        queries.select(F.col("query").alias("id"), "vector"), chunks.select(F.col("chunk_id").alias("id"), "vector"), "id", "vector", k * FANOUT, skip_self=False
    )
    return pooled(hits, chunks.select("chunk_id", "article_id").where("article_id is not null"), k)
