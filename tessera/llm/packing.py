"""Filling fixed-capacity containers with items (problem 8): lexical retrieval packing.

Documents that share words are brought together: centroids of word weights are fitted on a bounded sample, and documents
are sorted by their nearest and second nearest centroid and cut into shards of a bounded number of documents. Each shard
has a BM25 inverted index. The largest unused document is the seed of a container; the index scores its unused
neighbours over all words of the seed, and the best goes in, again and again. Size only bounds what may go in: a document
must fit and leave a room that is filled, that one unused document fills, or that is larger than any.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.llm.tokens import default_ranks, encoder

WORDS = re.compile(r"[^\W\d_]+")
CAPACITY, SHARD_DOCS = 4096, 2000
K1, B = 1.5, 0.75
CLOSE = 0.01  # of the capacity: the room left at which a container counts as filled
SAMPLE, CENTROIDS, DIMENSIONS = 4000, 256, 2048


class ShardIndex:
    """A BM25 inverted index over the documents of one shard."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray):
        """Words and their counts of all documents in a row; ``sizes`` says how many words are each document's."""
        self.n, sizes = len(sizes), np.asarray(sizes, np.int64)
        doc = np.repeat(np.arange(self.n), sizes)
        _, term, df = np.unique(terms, return_inverse=True, return_counts=True)
        length = np.bincount(doc, times, self.n)
        norm = K1 * (1 - B + B * length / max(length.mean() if self.n else 1.0, 1e-9))
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        self.weights = (idf[term] * times * (K1 + 1) / (times + norm[doc]))[order]
        self.starts = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.terms, self.ends = term, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # Words of a sixteenth of the documents or more have a row over all documents, which is added up faster.
        often = np.flatnonzero(df * 16 >= max(self.n, 1))
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.often = np.zeros((len(often), self.n), np.float32)
        at = self.row[term] >= 0
        self.often[self.row[term[at]], doc[at]] = (idf[term] * times * (K1 + 1) / (times + norm[doc]))[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all distinct words of one document."""
        terms = self.terms[self.ends[seed] : self.ends[seed + 1]]
        rows = self.row[terms]
        dense = self.often[rows[rows >= 0]].sum(axis=0)
        terms = terms[rows < 0]
        if not len(terms):
            return dense
        starts, sizes = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return dense + np.bincount(self.docs[at], self.weights[at], self.n)


def fill(sizes: np.ndarray, index: ShardIndex, capacity: int) -> list[list[int]]:
    """Containers as lists of documents, the seed first; each document is in one.

    Of the documents that may go in, the best neighbour of the seed does; where none shares a word with it, the largest.
    """
    unused = np.ones(len(sizes), bool)
    close = int(CLOSE * capacity)
    left = np.bincount(sizes, minlength=capacity + 1) if len(sizes) else np.zeros(capacity + 1, np.int64)
    containers = []
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        left[sizes[seed]] -= 1
        held, room = [seed], capacity - int(sizes[seed])
        score = None
        while room > 0:
            fits = np.flatnonzero(unused & (sizes <= room))
            if not len(fits):
                break
            if score is None:
                score = index.scores(seed)
            own = sizes[fits]
            after = room - own
            least = np.maximum(after - close, 1)
            below = np.concatenate([[0], np.cumsum(left)])  # unused documents by size
            closing = below[after + 1] - below[least] - ((own >= least) & (own <= after))
            may = (after <= close) | (closing > 0) | (after > own.max())
            chosen = fits[may] if may.any() else fits[own == own.max()]
            best = chosen[np.argmax(score[chosen])]
            if score[best] <= 0:
                best = chosen[np.argmax(sizes[chosen])]
            unused[best] = False
            left[sizes[best]] -= 1
            held.append(int(best))
            room -= int(sizes[best])
        containers.append(held)
    return containers


class Centroids:
    """Directions of word weights that documents are sorted by: spherical k-means over hashed words, in a chain of neighbours."""

    def __init__(self, vectors: np.ndarray, most: int, rounds: int = 10, seed: int = 5):
        """``vectors``: words of some documents, one row each, hashed to DIMENSIONS counts."""
        rng = np.random.default_rng(seed)
        self.idf = np.log1p(len(vectors) / (1 + (vectors > 0).sum(axis=0))).astype(np.float32)
        unit = np.log1p(vectors) * self.idf
        unit = unit[unit.any(axis=1)]
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        k = max(1, min(most, len(unit) // 8))
        centers = unit[rng.choice(len(unit), k, replace=False)] if len(unit) else np.ones((1, vectors.shape[1]), np.float32)
        for _ in range(rounds if len(unit) else 0):
            sums = np.zeros_like(centers)
            np.add.at(sums, (unit @ centers.T).argmax(axis=1), unit)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(length > 0, sums / np.maximum(length, 1e-9), centers)
        near, chain, rest = centers @ centers.T, [0], set(range(1, k))
        while rest:
            following = max(sorted(rest), key=lambda j: near[chain[-1], j])
            chain.append(following)
            rest.remove(following)
        self.columns = np.ascontiguousarray(centers[chain].T)

    def place(self, dimensions: np.ndarray, times: np.ndarray) -> int:
        """Where a document stands: by its nearest centroid, then by the second nearest."""
        n = self.columns.shape[1]
        if not len(dimensions) or n < 2:
            return 0
        alike = (np.log1p(times) * self.idf[dimensions]).astype(np.float32) @ self.columns[dimensions]
        second, first = np.argpartition(alike, n - 2)[n - 2 :] if n > 2 else np.argsort(alike)
        if alike[second] > alike[first]:
            first, second = second, first
        return int(first) * n + int(second)


class _Codes(dict):
    """A 32-bit hash for each word, kept while a batch is read."""

    def __missing__(self, word: str) -> int:
        import xxhash

        code = self[word] = xxhash.xxh32_intdigest(word) - 2**31
        return code


def word_counts(text: str, codes: _Codes) -> tuple[list[int], list[int]]:
    """The distinct words of a text as hashes, and how often each comes."""
    found = Counter(WORDS.findall(text.lower()))
    return [*map(codes.__getitem__, found)], [*found.values()]


def fit_centroids(df: DataFrame, text: str, *, sample: int = SAMPLE, most: int = CENTROIDS) -> Centroids:
    """Fitted on at most ``sample`` documents, chosen by a hash of their text; their counts by dimension come to the driver."""
    rows = df.select(F.col(text).alias("text")).where("text is not null and text <> ''")
    share = min(1.0, 2.0 * sample / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            at, n = [], []
            for t in batch.column(0).to_pylist():
                own, times = word_counts(t, codes)
                counts = np.bincount(np.array(own, np.int64) % DIMENSIONS, times, DIMENSIONS)
                at.append(np.flatnonzero(counts))
                n.append(counts[at[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["at", "n"])

    held = chosen.mapInArrow(run, "at array<int>, n array<float>").toArrow()
    vectors = np.zeros((len(held), DIMENSIONS), np.float32)
    for i, (at, n) in enumerate(zip(held.column("at"), held.column("n"))):
        vectors[i, at.values.to_numpy()] = n.values.to_numpy()
    return Centroids(vectors, most)


def _words(df: DataFrame, key: str, text: str, ranks: str, centroids: Centroids) -> DataFrame:
    """One row a document: its size in tokens, its distinct words as hashes with their counts, and its place among the centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        codes = _Codes()
        for batch in batches:
            if len(codes) > 500_000:
                codes.clear()
            size, terms, times, places = [], [], [], []
            for t in batch.column(1).to_pylist():
                size.append(len(enc.encode_ordinary(t)) if t else 0)
                own, n = word_counts(t, codes) if t else ([], [])
                terms.append(own)
                times.append(n)
                places.append(centroids.place(np.array(own, np.int64) % DIMENSIONS, np.array(n, np.float32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(places, pa.int32())],
                ["doc_id", "size", "terms", "times", "near"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, size int, terms array<int>, times array<int>, near int"
    )


def pack(
    df: DataFrame, key: str, text: str = "text", *, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, ranks: str | None = None
) -> DataFrame:
    """(container, slot, doc_id, piece_no, token_start, n_tokens): where every document goes.

    Sizes are tokens of a public tokenizer. A document larger than a container is divided: full containers of its own,
    and the rest as an item; no other document is. A text without tokens (null, empty) takes no room: one row with a
    null container and no tokens. Every row of ``df`` is placed, repeated rows each. Shards bound what one task
    holds; documents of one place are spread over shards by a hash, so copies of one text fill many shards. Neighbours
    outside a document's shard are not retrieved; the README says how many are inside.
    """
    if capacity < 1 or shard_docs < 1:
        raise ValueError("capacity and shard_docs must be at least 1")
    sized = cut(_words(df, key, text, ranks or default_ranks(), fit_centroids(df, text)))
    kind = sized.schema["doc_id"].dataType.simpleString()
    columns = f"container string, slot int, doc_id {kind}, piece_no int, token_start int, n_tokens int"
    none = sized.where("size = 0").selectExpr(
        "cast(null as string) container", "cast(null as int) slot", "doc_id", "0 piece_no", "0 token_start", "0 n_tokens"
    )
    near = sized.where("size > 0").repartitionByRange("near", F.xxhash64("doc_id")).sortWithinPartitions("near", F.xxhash64("doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= shard_docs:
                table = pa.Table.from_batches(held)
                yield _packed(table.slice(0, shard_docs), f"{part}-{shard}", capacity)
                shard += 1
                held = table.slice(shard_docs).to_batches()
        if held and sum(map(len, held)):
            yield _packed(pa.Table.from_batches(held), f"{part}-{shard}", capacity)

    return near.select("doc_id", "size", "terms", "times").mapInArrow(run, columns).union(none)


def _packed(table: pa.Table, shard: str, capacity: int) -> pa.RecordBatch:
    docs = table.column("doc_id")
    size = table.column("size").to_numpy().astype(np.int64)
    full, rest = size // capacity, size % capacity
    items = np.flatnonzero(rest > 0)
    held_words = table.take(pa.array(items)) if len(items) < len(size) else table
    terms, times = (held_words.column(c).combine_chunks() for c in ("terms", "times"))
    index = ShardIndex(terms.flatten().to_numpy(), times.flatten().to_numpy().astype(np.float64), terms.value_lengths().to_numpy())
    rows = []
    number = 0
    for i in np.flatnonzero(full):
        for p in range(full[i]):
            rows.append((f"{shard}-{number}", 0, int(i), p, p * capacity, capacity))
            number += 1
    for held in fill(rest[items], index, capacity):
        for slot, k in enumerate(held):
            i = int(items[k])
            rows.append((f"{shard}-{number}", slot, i, int(full[i]), int(full[i]) * capacity, int(rest[i])))
        number += 1
    container, slot, at, piece, start, n = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(container, pa.string()), pa.array(slot, pa.int32()), docs.take(pa.array(at, pa.int64())).combine_chunks(),
            pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
        ],
        ["container", "slot", "doc_id", "piece_no", "token_start", "n_tokens"],
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of room in use."""
    used = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return used.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("filled"), F.min("used").alias("least_used"),
    )
