"""Near-duplicate records with small edits (problem 1).

Texts become sets of hashed word shingles. Texts with one and the same set are represented once. Many universal hash
minima make a signature; bands of it are bucket keys. Only bucket keys and signatures are kept; signatures
are verified for those that share a bucket. Buckets with the same members count once. Within a bucket every text is
compared with the bucket's smallest one by signature; those not surely like it choose a smallest one among them, which
meets the bucket too; what then still has no neighbour in common meets one by one, so that no link between a bucket's
members is lost although a bucket of m alike texts costs m comparisons. Shingles, made again for what is alike by
signature only, verify the links, and alternating large-star and small-star joins them to classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut, merged, release
from tessera.llm.canonical import canonical_text
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\W_]+")
BANDS, ROWS = 50, 5


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run."""
    words = WORD.findall(canonical_text(text).lower())
    if not words:
        return np.empty(0, np.uint64)
    codes = np.array([_codes[w] for w in words], np.uint64)
    width = min(width, len(words))
    run = np.zeros(len(codes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            run = (run ^ codes[k : len(codes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
    run.sort()
    return run[np.concatenate([[True], run[1:] != run[:-1]])]


class _Codes(dict):
    """A 64-bit hash for each word, kept while a worker lives."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def _coefficients(n: int, seed: int, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    most = np.iinfo(kind).max
    return rng.integers(0, most, n, dtype=kind) | kind(1), rng.integers(0, most, n, dtype=kind)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each multiply-add hash function over the shingles, folded to 32 bits."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(folded), 128):
            block = folded[at : at + 128, None] * a
            block += b
            np.minimum(least, block.min(axis=0), out=least)
    return least


def _sketched(df: DataFrame, key: str, text: Column, schema: str, width: int, describe: Callable[[np.ndarray], list]) -> DataFrame:
    """``schema``: key, set_id and what ``describe`` makes of the shingles of each row whose text has a word."""
    import xxhash

    source = df.select(F.col(key).cast("string").alias("key"), text.alias("text")).where("key is not null and text is not null")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, more = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_hashes(t, width)
                if len(s):
                    keys.append(k)
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    more.append(describe(s))
            lists = [_lists(list(x)) for x in zip(*more)] if more else [_lists([], k) for k in KINDS[names[2:][0]]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.binary()), *lists], names)

    return source.mapInArrow(run, schema)


def sketch(df: DataFrame, key: str, text: Column, width: int, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(key, set_id, buckets, signature) for each row whose text has a word.

    set_id is a 128-bit hash of the shingle set. A signature holds the lowest byte of each minimum: it tells minima
    apart but for one in 256.
    """
    a, b = _coefficients(bands * rows, seed, np.uint32)
    mix = _coefficients(rows, seed + 1)[0]
    band = _coefficients(bands, seed + 2)[0]

    def describe(shingles: np.ndarray) -> list:
        m = minima(shingles, a, b)
        with np.errstate(over="ignore"):
            h = (m.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * mix
            h = np.bitwise_xor.reduce(h ^ (h >> np.uint64(31)), axis=1) * band
            h ^= h >> np.uint64(32)
        return [h.view(np.int64), m.astype(np.uint8).view(np.int8)]

    return _sketched(df, key, text, "key string, set_id binary, buckets array<bigint>, signature array<tinyint>", width, describe)


KINDS = {"buckets": (pa.int64(), pa.int8()), "shingles": (pa.int64(),)}


def _lists(arrays: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _agreement(a: str, b: str) -> Column:
    """Share of equal minima: an estimate of the shared part of two shingle sets."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def shared(a: str, b: str) -> Column:
    """Shingles common to both over shingles in either."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def crowded(cells: DataFrame) -> DataFrame:
    """(bucket, head, rep) of the cells (bucket, rep) whose bucket holds others too; head is its smallest member.

    Cells are shuffled once, and most of them are alone in their bucket. A bucket's key is of one band: the bands' keys
    are multiplied by numbers of their own. Buckets of the same members (by number, smallest and two sums of hashes)
    count once, under the smallest of their keys.
    """
    inside = W.partitionBy("bucket")
    held = cells.select("bucket", "rep", F.count("*").over(inside).alias("n")).where("n > 1")
    sums = (F.sum(F.xxhash64("rep", F.lit(i)).bitwiseAND(2**40 - 1)).over(inside).alias(f"sum{i}") for i in range(2))
    known = held.select("bucket", "rep", "n", F.min("rep").over(inside).alias("head"), *sums)
    return known.groupBy("n", "head", "sum0", "sum1", "rep").agg(F.min("bucket").alias("bucket")).select("bucket", "head", "rep")


class NearDuplicates:
    """The result of :func:`near_duplicates`.

    members: (key, rep): every key that has a word, and the number of its shingle set; one row for each set of a key
    classes: (key, class_id): one row a key; class_id is the smallest key of its class
    pairs:   (id_a, id_b, similarity): every pair of keys at or over the threshold, id_a < id_b
    """

    def __init__(self, named: DataFrame, sets: DataFrame, members: DataFrame, detail: Callable[[DataFrame], DataFrame], threshold: float, slack: float):
        self.members, self._threshold, self._slack = members, threshold, slack
        own = merged(named.select(F.col("row").alias("rep"), "buckets"), sets.select("rep"), "rep", "left_semi")
        self._crowded = cut(crowded(own.select("rep", F.explode("buckets").alias("bucket"))))
        release(named.sparkSession)
        # Only texts that share a bucket are looked at again.
        self._signs = cut(merged(named.select(F.col("row").alias("rep"), "signature"), self._crowded.select("rep").distinct(), "rep", "left_semi"))
        alike = cut(self._alike_in_buckets())
        release(named.sparkSession)
        self._shingles = cut(detail(alike.select(F.explode(F.array("a", "b")).alias("rep")).distinct()))
        self._links = cut(self._verified(alike))
        release(named.sparkSession)
        same_key = members.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
        edges = self._links.select("a", "b").union(merged(members, same_key.select("key", "a"), "key").select("a", F.col("rep").alias("b")))
        self._components = cut(connected_components(edges))

    def _alike_in_buckets(self) -> DataFrame:
        """(a, b), a < b: pairs alike by signature that connect what is alike in any bucket."""
        pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        sure = F.col("agreement") >= self._threshold + self._slack / 2
        crowded = self._crowded.where("rep <> head")
        first = cut(self._alike(crowded.select(*pair("head", "rep")).distinct()))
        found = first.where(sure).select(F.col("a").alias("head"), F.col("b").alias("rep"))
        # Texts that are not surely like the head of their bucket.
        stray = cut(merged(crowded, found, ["head", "rep"], "left_anti").select("bucket", "rep"))
        second = stray.groupBy("bucket").agg(F.min("rep").alias("second"))
        others = merged(crowded, second, "bucket").where("rep <> second").select("bucket", "second", "rep")
        again = cut(self._alike(others.select(*pair("second", "rep")).distinct()))
        close = again.where(sure).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
        close = close.select(F.col("p.a").alias("second"), F.col("p.b").alias("rep"), F.lit(True).alias("near"))
        placed = merged(others, close, ["second", "rep"], "left").select("bucket", "rep", F.coalesce("near", F.lit(False)).alias("near"))
        # Two that are both near the second head are connected through it.
        left = merged(placed, stray, ["bucket", "rep"], "left_semi").toDF("bucket", "x", "near_x")
        rest = merged(left, placed.toDF("bucket", "y", "near_y"), "bucket").where("x <> y and not (near_x and near_y)").select(*pair("x", "y")).distinct()
        return first.union(again).union(self._alike(rest)).select("a", "b").distinct()

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """(a, b, agreement) of the pairs (a, b) that may reach the threshold by their signatures."""
        met = merged(merged(pairs, self._signs.toDF("a", "sign_a"), "a"), self._signs.toDF("b", "sign_b"), "b")
        return met.select("a", "b", _agreement("sign_a", "sign_b").alias("agreement")).where(F.col("agreement") >= self._threshold - self._slack)

    def _verified(self, alike: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that reach the threshold by their shingles."""
        met = merged(merged(alike, self._shingles.toDF("a", "set_a"), "a"), self._shingles.toDF("b", "set_b"), "b")
        return met.select("a", "b", shared("set_a", "set_b").alias("similarity")).where(F.col("similarity") >= self._threshold)

    @property
    def classes(self) -> DataFrame:
        rows = merged(self.members, self._components.toDF("rep", "class"), "rep", "left").select("key", F.coalesce("class", "rep").alias("class"))
        named = rows.groupBy("class").agg(F.min("key").alias("class_id"))
        return merged(rows.distinct(), named, "class").select("key", "class_id")

    @property
    def pairs(self) -> DataFrame:
        """Every pair of a class that shares a bucket is checked; copies of a text are pairs too.

        Candidates are numbers of sets only; signatures are fetched for those that no link has settled, shingles for
        those that pass by signature.
        """
        classed = merged(self._crowded, self._components.toDF("rep", "class"), "rep").select("bucket", "class", "rep")
        met = merged(classed.toDF("bucket", "class", "a"), classed.toDF("bucket", "class", "b"), ["bucket", "class"]).where("a < b").select("a", "b").distinct()
        more = self._alike(merged(met, self._links.select("a", "b"), ["a", "b"], "left_anti"))
        near = self._links.union(self._verified(more.select("a", "b")))
        m = self.members
        between = merged(merged(near, m.toDF("x", "a"), "a"), m.toDF("y", "b"), "b").select("x", "y", "similarity")
        within = merged(m.toDF("x", "rep"), m.toDF("y", "rep"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
        named = between.where("x <> y").union(within).groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return named.agg(F.max("similarity").alias("similarity"))


def near_duplicates(
    df: DataFrame, key: str, text: Column, *, width: int = 5, threshold: float = 0.8,
    bands: int = BANDS, rows: int = ROWS, seed: int = 1,
) -> NearDuplicates:
    """Group records whose word shingles overlap by at least ``threshold``, without comparing all pairs.

    Words are runs of letters and digits in canonical lower-case text. Rows with a null key, a null text or a text
    without a word are left out. Of several rows with one key every different text counts, as that key's. A text
    shorter than ``width`` words is one shingle. Other columns of ``df`` are ignored, whatever their names. An empty
    table gives empty results. ``df`` is read twice.

    With 50 bands of 5 minima a pair at 0.7 is missed with probability 0.0001, at 0.8 with less than 1e-8, and a pair
    at 0.1 is compared with probability 0.0005. ``slack`` (0.12, four standard errors of the estimate) keeps pairs
    whose estimate falls short by chance, and an estimate half as much over the threshold is taken for sure where a
    text need not meet the rest of its bucket; the check on the shingles themselves follows. ``pairs`` has as many rows as
    there are pairs, so that a class of m copies gives m * (m - 1) / 2; ``classes`` grows with the keys only.
    """
    # Numbers of rows, stored: they stay the same. A set goes by the smallest number of its rows.
    named = cut(sketch(df, key, text, width, bands, rows, seed).withColumn("row", F.monotonically_increasing_id()))
    first = named.groupBy("set_id").agg(F.min(F.struct("row", "key")).alias("first"))
    sets = cut(first.select("set_id", F.col("first.row").alias("rep"), F.col("first.key").alias("of")))
    members = cut(merged(named.select("key", "set_id").distinct(), sets.select("set_id", "rep"), "set_id").select("key", "rep"))

    def detail(wanted: DataFrame) -> DataFrame:
        """(rep, shingles) of the wanted sets, from one row of each."""
        asked = merged(sets, wanted, "rep")
        own = merged(df.select(F.col(key).cast("string").alias("key"), text.alias("text")), asked.select(F.col("of").alias("key")).distinct(), "key", "left_semi")
        made = _sketched(own, "key", F.col("text"), "key string, set_id binary, shingles array<bigint>", width, lambda s: [s.view(np.int64)])
        return merged(made, asked.select("rep", F.col("of").alias("key"), "set_id"), ["key", "set_id"]).dropDuplicates(["rep"]).select("rep", "shingles")

    return NearDuplicates(named, sets, members, detail, threshold, slack=4 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5)
