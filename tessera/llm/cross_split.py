"""Same or near-same records across splits (problem 6): a weighted cosine join with inverted lists.

Distinct word sets become unit vectors of term weights. In one global order of terms (rare first) a vector's list
entries stop where what is left can no longer reach the threshold: by the norm of the rest (residual norm) or by the
rest times the largest weight that the other side has for each term (maximum weight). Two vectors that reach the
threshold then share a listed term, and the first term they share is listed for both. The join on listed terms drops a
pair inside the join by size, by the residual norms after the shared term and by a bit map of the sets; only pairs
that pass all bounds leave it. Exact dot products follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.llm.canonical import canonical_text

WORD = re.compile(r"[^\W_]+")
MAP_WORDS = 4  # of 64 bits
MAPS = [f"m{k}" for k in range(MAP_WORDS)]


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the sorted distinct words of each canonical lower-case text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(WORD.findall(canonical_text(t).lower()))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string()))], ["key", "words"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.where("key is not null and text is not null").mapInArrow(run, "key string, words array<string>").where("size(words) > 0")


def _vectors(sets: DataFrame, weighting: str) -> DataFrame:
    """(set_id, side, n, terms: array<struct<df, term, w>> in the global order, unit length).

    df counts distinct sets; ``set`` gives all terms of a set one weight, ``idf`` ln(1 + N / df).
    """
    terms = sets.select("set_id", "side", F.explode("words").alias("term"))
    df = terms.groupBy("term").agg(F.count_distinct("set_id").alias("df"))
    if weighting == "idf":
        total = sets.agg(F.count_distinct("set_id").alias("total"))  # one row
        df = df.crossJoin(F.broadcast(total)).select("term", "df", F.log1p(F.col("total") / F.col("df")).alias("w"))
    else:
        df = df.withColumn("w", F.lit(1.0))
    listed = terms.join(df, "term").groupBy("set_id", "side").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("terms"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    return listed.withColumn("norm", norm).select(
        "set_id", "side", F.size("terms").alias("n"),
        F.transform("terms", lambda t: F.struct(t["df"].alias("df"), t["term"].alias("term"), (t["w"] / F.col("norm")).alias("w"))).alias("terms"),
    )


class _Bits(dict):
    """The bit of each word in a 256-bit map, kept while a task runs."""

    def __missing__(self, word: str) -> int:
        bit = self[word] = xxhash.xxh32_intdigest(word) % (64 * MAP_WORDS)
        return bit


def _bit_maps(sets: DataFrame) -> DataFrame:
    """(set_id, side, m0 ...): a 256-bit map of each set: its words' bits, in 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _Bits()
        for batch in batches:
            if len(bits) > 500_000:
                bits.clear()
            maps = np.zeros((len(batch), 64 * MAP_WORDS), np.uint8)
            for row, words in zip(maps, batch.column(2).to_pylist()):
                row[[*map(bits.__getitem__, words)]] = 1
            packed = np.packbits(maps, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m) for m in packed.T)], ["set_id", "side", *MAPS])

    return sets.select("set_id", "side", "words").mapInArrow(run, "set_id string, side string, " + ", ".join(f"{m} bigint" for m in MAPS))


def _postings(vectors: DataFrame, most: DataFrame, threshold: float) -> DataFrame:
    """Inverted-list entries of one side; ``most`` (term, most) has the other side's largest weights.

    A term the other side lacks counts for nothing, so only shared terms are listed and add to the bounds.
    """
    order = W.partitionBy("set_id").orderBy("df", "term")
    after = order.rowsBetween(1, W.unboundedFollowing)
    entries = (
        vectors.select("set_id", "n", *MAPS, F.inline("terms"))
        .join(most, "term")
        .withColumn("rest", F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w")).over(after), F.lit(0.0))))
        .withColumn("here", F.sqrt(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(0, W.unboundedFollowing))))
        .withColumn("bound", F.sum(F.col("w") * F.col("most")).over(order.rowsBetween(0, W.unboundedFollowing)))
    )
    return entries.where(F.least("here", "bound") >= threshold - 1e-9).select(
        "term", "set_id", "n", "w", "rest", *MAPS
    )


def cosine_join(sets: DataFrame, threshold: float, weighting: str = "set") -> DataFrame:
    """(a, b, cosine) for every set a of side 'l' and b of side 'r' with a cosine of at least ``threshold``.

    ``sets``: (set_id, side, words), words distinct and not empty; (set_id, side) is unique. Exact: the bounds only
    drop pairs that cannot reach the threshold. No cap on lists; long lists are split by AQE's skew join.
    """
    # The maps are made before the vectors are taken apart, once a set.
    vectors = cut(_vectors(sets, weighting).join(_bit_maps(sets), ["set_id", "side"]))
    left, right = vectors.where("side = 'l'"), vectors.where("side = 'r'")
    most = vectors.select("side", F.inline("terms")).groupBy("side", "term").agg(F.max("w").alias("most"))
    l, r = (
        _postings(own, most.where(f"side = '{other}'").select("term", "most"), threshold).select(
            "term", *(F.col(c).alias(f"{own_side}_{c}") for c in ("set_id", "n", "w", "rest", *MAPS))
        )
        for own, own_side, other in ((left, "l", "r"), (right, "r", "l"))
    )
    reach = F.col("l_w") * F.col("r_w") + F.col("l_rest") * F.col("r_rest") >= threshold - 1e-9
    joined = l.join(r, "term").where(reach)
    if weighting == "set":
        # Terms in one set only, at least; the cosine of sets is common / sqrt(n m).
        apart = sum((F.bit_count(F.col(f"l_m{k}").bitwiseXOR(F.col(f"r_m{k}"))) for k in range(1, MAP_WORDS)), F.bit_count(F.col("l_m0").bitwiseXOR(F.col("r_m0"))))
        common = (F.col("l_n") + F.col("r_n") - apart) / 2
        joined = joined.where(common >= (threshold - 1e-9) * F.sqrt(F.col("l_n").cast("double") * F.col("r_n")))
    pairs = joined.select(F.col("l_set_id").alias("a"), F.col("r_set_id").alias("b")).distinct()
    terms = lambda side, at: side.select(F.col("set_id").alias(at), F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], t["w"]))).alias(f"v{at}"))
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at("va", t) * F.try_element_at("vb", t), F.lit(0.0)))
    return (
        pairs.join(terms(left, "a"), "a").join(terms(right, "b"), "b")
        .select("a", "b", F.round(dot, 12).alias("cosine"))
        .where(F.col("cosine") >= threshold - 1e-9)
    )


def split_overlaps(
    queries: DataFrame, qrels: DataFrame, *, key: str = "_id", text: str = "text", split: str = "split",
    reference: str = "query-id", train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), jaccard: float = 0.75,
) -> DataFrame:
    """(split, id_a, id_b): records of an evaluation split that are in the training split too, exactly or almost.

    Two word sets with a Jaccard of t have a cosine of at least 2t / (1 + t), so the cosine join over unit weights finds
    all of them; the Jaccard itself is checked after it. id_a <= id_b; a record judged in both splits is a case with
    itself. Null ids, null splits and ids without a text are left out of pairs; texts without a word never pair. Several
    texts of one id all count. Copies of a text share one vector and are paired through it, so that a text that
    holds a third of all rows costs one vector a side.
    """
    judged = qrels.select(F.col(split).alias("split"), F.col(f"`{reference}`").cast("string").alias("key")).where(
        F.col("split").isin(train, *evaluation) & F.col("key").isNotNull()
    ).distinct()
    known = queries.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).join(judged.select("key").distinct(), "key", "left_semi")
    sets = word_sets(known, "key", "text").withColumn("set_id", F.concat_ws("-", F.xxhash64("words"), F.hash("words"), F.size("words"))).distinct()
    placed = cut(sets.join(judged, "key"))
    sides = placed.select("set_id", "words", F.explode(F.array(F.when(F.col("split") == train, "l").otherwise("r"))).alias("side"))
    unique = cut(sides.groupBy("set_id", "side").agg(F.first("words").alias("words")))
    near = cosine_join(unique, 2 * jaccard / (1 + jaccard))
    words = unique.groupBy("set_id").agg(F.first("words").alias("words"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    alike = (
        near.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
        .where(common / (F.size("words_a") + F.size("words_b") - common) >= jaccard)
        .select("a", "b")
    )
    ids = placed.select("key", "set_id", "split").distinct()
    trained = ids.where(F.col("split") == train).select(F.col("set_id").alias("a"), F.col("key").alias("x"))
    judged_on = ids.where(F.col("split") != train).select(F.col("set_id").alias("b"), F.col("key").alias("y"), "split")
    pairs = alike.join(trained, "a").join(judged_on, "b").select("split", "x", "y")
    both = judged.where(F.col("split") != train).join(judged.where(F.col("split") == train).select("key"), "key").select("split", F.col("key").alias("x"), F.col("key").alias("y"))
    return pairs.union(both).select("split", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def overlap_report(found: DataFrame, queries: DataFrame, qrels: DataFrame, train: str = "train") -> DataFrame:
    """(split, source, overlapping, pairs): evaluation records with an overlap and their pairs, per split and source.

    ``found`` is the result of :func:`split_overlaps`. A missing or null source counts as 'unknown'; a record with
    several sources counts under the first of them by name.
    """
    sources = queries.groupBy(F.col("_id").alias("id")).agg(F.coalesce(F.min("source"), F.lit("unknown")).alias("source"))
    evaluated = qrels.select("split", F.col("`query-id`").alias("id")).where(F.col("split") != train).distinct()
    ends = found.select("split", F.explode(F.array("id_a", "id_b")).alias("id"), F.struct("id_a", "id_b").alias("pair")).distinct()
    return (
        ends.join(evaluated, ["split", "id"]).join(sources, "id", "left")
        .groupBy("split", F.coalesce("source", F.lit("unknown")).alias("source"))
        .agg(F.count_distinct("id").alias("overlapping"), F.count_distinct("pair").alias("pairs"))
    )
