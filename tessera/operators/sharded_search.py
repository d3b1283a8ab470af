"""BM25 for many queries at once over documents in shards of bounded size.

Only the best k of each query and shard go on, so that no row is made for a pair of query and document. Queries of a
checked size go to every task and meet the documents where these are read, so that no document is shuffled; a larger set
of queries is streamed past each shard's index. Inverse document frequencies come with the queries; term frequencies and
lengths with the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.bm25 import FANOUT, K1, B, pooled, query_terms, tokenized, top
from tessera.operators.chunking import chunk_articles

SHARD_DOCS, LEAST_DOCS = 8000, 1000
MOST_TERMS = 1_000_000  # of queries that go to every task: some tens of MB
SCALE = 10**9  # scores are sums of whole billionths, exact in any order
WORDS = re.compile(r"\w+")  # letters, numbers and underscores, as functions.text.words


class Shard:
    """The index of one shard: documents in the order of their keys, postings by term."""

    def __init__(self, docs: list[str], tokens: pa.ListArray, avg_len: float):
        n = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        self.docs = docs
        self.ids = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        doc = np.repeat(np.arange(len(docs)), n)
        pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * max(len(docs), 1) + doc, return_counts=True)
        term, self.doc = np.divmod(pair, max(len(docs), 1))
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / avg_len)) * SCALE
        self.starts = np.searchsorted(term, np.arange(len(self.ids) + 1))

    def best(self, terms: list[str], idf: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``k`` documents, ties by key."""
        known = [(self.ids[t], w) for t, w in zip(terms, idf) if t in self.ids]
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        ids = np.fromiter((t for t, _ in known), np.int64, len(known))
        sizes = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        parts = np.rint(np.repeat(np.fromiter((w for _, w in known), float, len(known)), sizes) * self.part[at])
        score = np.bincount(self.doc[at], parts, len(self.docs))
        return _first(score, k)


def search_texts(docs: DataFrame, queries: DataFrame, k: int, *, bigrams: bool = False, shard_docs: int = SHARD_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(query, doc, score, rank): the best ``k`` of (doc, text) for each of (query, text), as the join over postings gives.

    Document frequency and length cover all documents. Documents are read once; what is stored in the shared folder are the
    counts of asked terms in each. Queries of at most ``most_terms`` terms in all go to every task; more are shuffled to
    shards. Null keys are left out, null texts have no term.
    """
    docs = docs.select(F.col("doc").cast("string").alias("doc"), "text").where("doc is not null")
    asked = query_terms(queries.select(F.col("query").cast("string").alias("query"), "text"), "query", "text", bigrams).where("query is not null")
    held = asked.limit(most_terms + 1).toArrow()
    if len(held) > most_terms:
        return _search_shards(cut(tokenized(docs, "doc", "text", bigrams)), asked, k, shard_docs)
    names = held.column("query").combine_chunks().dictionary_encode()
    terms = held.column("term").combine_chunks().dictionary_encode()
    vocabulary = {t: i for i, t in enumerate(terms.dictionary.to_pylist())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own, times = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = WORDS.findall(normalize("NFC", text or "").lower())
                if bigrams:
                    tokens += ["_".join(pair) for pair in zip(tokens, tokens[1:])]
                sizes.append(len(tokens))
                found = Counter(map(vocabulary.get, tokens))
                found.pop(None, None)
                own.append([*found])
                times.append([*found.values()])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(own, ints), pa.array(times, ints)], ["doc", "size", "terms", "times"])

    counted = cut(docs.mapInArrow(count, "doc string, size int, terms array<int>, times array<int>"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("avg_len")).first()
    df = np.zeros(len(vocabulary))
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # as many rows as asked terms
        df[term] = n
    return _ranked(counted, names, terms, df, stats.n, max(stats.avg_len or 0.0, 1e-9), k, shard_docs)


def search_counts(
    documents: DataFrame, known: DataFrame, stats: DataFrame, queries: DataFrame, k: int, *,
    bigrams: bool = False, shard_docs: int = SHARD_DOCS, most_terms: int = MOST_TERMS,
) -> DataFrame:
    """The same over stored counts (doc, n, terms, times) with their ``known`` terms (term, df) and one row of ``stats`` (n_docs, avg_len)."""
    documents = documents.select(F.col("doc").cast("string").alias("doc"), F.coalesce("n", F.lit(0)).alias("size"), "terms", "times").where("doc is not null")
    asked = query_terms(queries.select(F.col("query").cast("string").alias("query"), "text"), "query", "text", bigrams).where("query is not null")
    held = asked.limit(most_terms + 1).toArrow()
    if len(held) > most_terms:
        again = F.flatten(F.transform(F.arrays_zip("terms", "times"), lambda x: F.array_repeat(x["terms"], x["times"])))
        return _search_shards(documents.select("doc", again.alias("tokens")), asked, k, shard_docs)
    names = held.column("query").combine_chunks().dictionary_encode()
    terms = held.column("term").combine_chunks().dictionary_encode()
    vocabulary = terms.dictionary

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, times = batch.column("terms"), batch.column("times")
            codes = pc.index_in(own.flatten(), value_set=vocabulary)
            here = pc.is_valid(codes)
            row = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy(zero_copy_only=False))[here.to_numpy(zero_copy_only=False)]
            ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, x.filter(here)) for x in (codes, times.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("size"), *lists], ["doc", "size", "terms", "times"])

    df = np.zeros(len(vocabulary))
    places = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    for term, n in known.join(asked.select("term").distinct(), "term", "left_semi").select("term", "df").collect():  # as many rows as asked terms
        df[places[term]] = n
    of = stats.first()
    return _ranked(documents.mapInArrow(keep, "doc string, size int, terms array<int>, times array<int>"), names, terms, df, of.n_docs, of.avg_len, k, shard_docs)


def _ranked(counted: DataFrame, names: pa.DictionaryArray, terms: pa.DictionaryArray, df: np.ndarray, n_docs: int, avg_len: float, k: int, shard_docs: int) -> DataFrame:
    """The best ``k`` of (doc, size, terms, times) for each query; ``names`` and ``terms`` hold a query and one of its terms at each place."""
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    of_query = np.split(terms.indices.to_numpy()[order], np.cumsum(np.bincount(names.indices.to_numpy(), minlength=len(names.dictionary)))[:-1])
    ids = names.dictionary.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= shard_docs:
                yield _best_of(held, idf, avg_len, ids, of_query, k)
                held = []
        if held:
            yield _best_of(held, idf, avg_len, ids, of_query, k)

    scored = counted.mapInArrow(run, "query string, doc string, score decimal(20,0)").withColumn("score", (F.col("score") / F.lit(SCALE)).cast("decimal(20,9)"))
    return top(scored, k)


def _best_of(held: list[pa.RecordBatch], idf: np.ndarray, avg_len: float, ids: list[str], of_query: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The best ``k`` of one shard for every query, ties by key."""
    table = pa.Table.from_batches(held).sort_by("doc").combine_chunks()
    docs, length = table.column("doc").to_pylist(), table.column("size").to_numpy()
    own, times = (table.column(c).combine_chunks() for c in ("terms", "times"))
    doc = np.repeat(np.arange(len(docs)), own.value_lengths().to_numpy())
    term, tf = own.flatten().to_numpy(), times.flatten().to_numpy()
    parts = np.rint(idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / avg_len)) * SCALE))
    by_term = np.argsort(term, kind="stable")
    doc, parts, starts = doc[by_term], parts[by_term], np.searchsorted(term[by_term], np.arange(len(idf) + 1))
    # Terms of a quarter of the documents have a whole row each, which is added faster than its postings.
    often = np.flatnonzero(np.diff(starts) * 4 >= len(docs))
    row = np.full(len(idf), -1)
    row[often] = np.arange(len(often))
    whole = np.zeros((len(often), len(docs)))
    for i, t in enumerate(often):
        whole[i, doc[starts[t] : starts[t + 1]]] = parts[starts[t] : starts[t + 1]]
    out: tuple[list, list, list] = ([], [], [])
    for query, terms in zip(ids, of_query):
        rare = terms[row[terms] < 0]
        sizes = starts[rare + 1] - starts[rare]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[rare] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        score = np.bincount(doc[at], parts[at], len(docs)).astype(float, copy=False)  # of nothing it counts in integers
        for i in row[terms]:
            if i >= 0:
                score += whole[i]
        places, scores = _first(score, k)
        out[0].extend([query] * len(places))
        out[1].extend(docs[p] for p in places)
        out[2].append(scores.astype(np.int64))
    score = pa.array(np.concatenate(out[2]) if out[2] else [], pa.int64()).cast(pa.decimal128(20, 0))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), score], ["query", "doc", "score"])


def _first(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` largest positive scores, the first place on ties."""
    least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0
    found = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score > 0)
    order = found[np.argsort(-score[found], kind="stable")][:k]
    return order, score[order]


def _search_shards(tokens: DataFrame, asked: DataFrame, k: int, shard_docs: int) -> DataFrame:
    """The same for a set of queries of any size: their terms are shuffled to every shard.

    (doc, tokens) are read more than once. The one row of statistics fixes the number of shards.
    """
    stats = tokens.agg(
        F.count("*").alias("n_docs"), F.greatest(F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)), F.lit(1e-9)).alias("avg_len"),
        # A few shards even for few documents, so that they keep several tasks busy.
        F.greatest(F.ceil(F.count("*") / F.least(F.lit(shard_docs), F.greatest(F.lit(LEAST_DOCS), F.count("*") / 8))), F.lit(1)).cast("int").alias("shards"),
    )
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_docs")
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query", "term", "shards", "avg_len", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    packed = weighed.groupBy("query", "shards", "avg_len").agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    copies = packed.select(
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), F.col("query").alias("key"),
        F.col("t.term").alias("tokens"), F.col("t.idf").alias("idf"), "avg_len",
    )
    held = tokens.crossJoin(F.broadcast(stats)).select(
        F.pmod(F.xxhash64("doc"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("doc").alias("key"),
        "tokens", F.lit(None).cast("array<double>").alias("idf"), "avg_len",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, index = None, [], None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            breaks = np.flatnonzero(np.diff(shards * 2 + kinds)) + 1
            for a, b in zip([0, *breaks], [*breaks, len(batch)]):
                part = batch.slice(a, b - a)
                if shards[a] != at:
                    at, waiting, index = shards[a], [], None
                if not kinds[a]:
                    waiting.append(part)
                    continue
                if index is None:
                    table = pa.Table.from_batches(waiting, schema=batch.schema).combine_chunks()
                    tokens_of = table.column("tokens").combine_chunks() if len(table) else pa.array([], pa.list_(pa.string()))
                    index = Shard(table.column("key").to_pylist(), tokens_of, part.column("avg_len")[0].as_py())
                    waiting = []
                for query, terms, idf in zip(*(part.column(c).to_pylist() for c in ("key", "tokens", "idf"))):
                    places, scores = index.best(terms, idf, k)
                    out[0].extend([query] * len(places))
                    out[1].extend(index.docs[p] for p in places)
                    out[2].extend(scores.astype(np.int64).tolist())
            score = pa.array(out[2], pa.int64()).cast(pa.decimal128(20, 0))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), score], ["query", "doc", "score"])

    rows = held.union(copies).repartition("shard").sortWithinPartitions("shard", "kind", "key")
    scored = rows.mapInArrow(run, "query string, doc string, score decimal(20,0)").withColumn("score", (F.col("score") / F.lit(SCALE)).cast("decimal(20,9)"))
    return top(scored, k)


def search_articles(articles: DataFrame, queries: DataFrame, k: int, *, bigrams: bool = False) -> DataFrame:
    """(query, doc, score, rank, chunk, hit_text): the best ``k`` articles by their best chunk, with that chunk's text.

    Every article (article_id, title, text) is cut into its chunks and can be found. The texts are joined after the top k.
    """
    chunks = cut(chunk_articles(articles))
    hits = search_texts(chunks.select(F.col("chunk_id").alias("doc"), "text"), queries, k * FANOUT, bigrams=bigrams)
    return pooled(hits, chunks, k).join(chunks.select(F.col("chunk_id").alias("chunk"), F.col("text").alias("hit_text")), "chunk").select("query", "doc", "score", "rank", "chunk", "hit_text")
