"""Passages for a question: from hits, or sampled with gold and hard negatives."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import citation, messages, strip


def share(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that the seed and the keys fix: seven hexadecimal digits of an MD5."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *keys))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / 16**7


def order_key(seed: int, *keys: str) -> Column:
    """A text to order by, random as to the keys but fixed by the seed."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *keys))


def context_docs(hits: DataFrame, articles: DataFrame, max_chars: int = 1500) -> DataFrame:
    """(query, doc, rank, citation, text) for hits (query, doc, rank, hit_text).

    A whole short article, else the start of the hit's own text; an article that is not known keeps its hit's text and an
    id-only citation. Texts are joined to ranked hits only.
    """
    known = articles.select(F.col("article_id").alias("doc"), "title", strip(F.concat("title", F.lit("\n"), "text")).alias("whole"))
    rows = hits.join(known, "doc", "left")
    text = F.when(F.length("whole") <= max_chars, F.col("whole")).otherwise(F.substring("hit_text", 1, max_chars))
    return rows.select("query", "doc", "rank", citation(F.col("doc"), F.col("title")).alias("citation"), text.alias("text"))


def shown_hits(shown: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, rank, hit_text) of shown articles (query, doc, place): the matched text, else the article (doc, text).

    ``hits`` (query, doc, hit_text) are those that the articles were drawn from; gold may be missing there.
    """
    rows = shown.select("query", "doc", F.col("place").alias("rank")).join(hits.select("query", "doc", "hit_text"), ["query", "doc"], "left")
    return rows.join(docs.select("doc", "text"), "doc").select("query", "doc", "rank", F.coalesce("hit_text", "text").alias("hit_text"))


def sampled_docs(
    gold: DataFrame, hits: DataFrame, *, n_contexts: int = 3, pool: int = 10, neg_ratio: float = 0.15, seed: int = 13
) -> DataFrame:
    """(query, kind, doc, place, is_gold): which articles a question is shown, in a shuffled order.

    ``gold`` (query, doc) and ``hits`` (query, doc, rank). With a share of ``neg_ratio`` of the questions, fixed by seed
    and id, the first ``n_contexts`` hits that are not gold (kind ``negative``); else up to ``n_contexts`` gold articles
    by id, filled up with such hits (``answerable``).
    """
    gold = gold.distinct()
    negatives = hits.where(F.col("rank") <= pool).join(gold, ["query", "doc"], "left_anti")
    negatives = negatives.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("rank"))).select("query", "doc", "n")
    right = gold.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("doc"))).where(F.col("n") <= n_contexts)
    asked = gold.groupBy("query").agg(F.least(F.count("*"), F.lit(n_contexts)).alias("n_gold"))
    asked = asked.withColumn("kind", F.when(share(seed, "query") < neg_ratio, "negative").otherwise("answerable"))
    shown = right.join(asked.where("kind = 'answerable'"), "query").select("query", "kind", "doc", F.col("n").alias("base"), F.lit(True).alias("is_gold"))
    room = F.when(F.col("kind") == "negative", n_contexts).otherwise(n_contexts - F.col("n_gold"))
    filler = negatives.join(asked, "query").where(F.col("n") <= room).select("query", "kind", "doc", F.col("n").alias("base"), F.lit(False).alias("is_gold"))
    both = shown.union(filler)
    mixed = F.row_number().over(W.partitionBy("query").orderBy(F.when(F.col("kind") == "negative", F.lpad(F.col("base").cast("string"), 9, "0")).otherwise(order_key(seed, "query", "doc")), "doc"))
    return both.select("query", "kind", "doc", mixed.alias("place"), "is_gold")


def prompt_records(shown: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query, kind, gold, n_docs, prompt): one record a question from its placed passages (query, doc, citation, text)."""
    rows = shown.join(docs.select("query", "doc", "citation", "text"), ["query", "doc"])
    packed = rows.groupBy("query", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "is_gold", "citation", "text"))).alias("d"))
    return packed.join(questions.select("query", F.col("text").alias("asked")), "query").select(
        "query", "kind", F.transform(F.filter("d", lambda x: x["is_gold"]), lambda x: x["place"]).alias("gold"), F.size("d").alias("n_docs"),
        messages(F.col("asked"), F.transform("d", lambda x: F.struct(x["citation"].alias("citation"), x["text"].alias("text")))).alias("prompt"),
    )


def hash_places(rows: DataFrame, key: str, seed: int, part_rows: int = 4096) -> DataFrame:
    """(row: the columns of ``rows`` as a struct, place, total): the place of each row from 1 on, in an order that the seed fixes, and their number.

    Rows are numbered within hash prefixes of about ``part_rows`` rows, whose length follows from the number of rows; the
    prefixes are counted up within their first three digits, and these, at most 4,096, one after another.
    """
    digits = max(3, ceil(log(max(rows.count(), 1) / part_rows, 16)))
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), order_key(seed, key).alias("at")).withColumn("fine", F.substring("at", 1, digits))
    fine = keyed.groupBy("fine").agg(F.count("*").alias("size")).withColumn("coarse", F.substring("fine", 1, 3))
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy("coarse").agg(F.sum("size").alias("size"))
    whole = F.sum("size").over(W.orderBy("coarse").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    coarse = coarse.select("coarse", earlier(W.orderBy("coarse")).alias("before"), whole.alias("total"))
    starts = fine.select("fine", "coarse", earlier(W.partitionBy("coarse").orderBy("fine")).alias("inside")).join(F.broadcast(coarse), "coarse")
    within = F.row_number().over(W.partitionBy("fine").orderBy("at", F.col("row")[key]))
    return keyed.withColumn("within", within).join(starts, "fine").select("row", (F.col("before") + F.col("inside") + F.col("within")).alias("place"), "total")


def subsample(articles: DataFrame, keep: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """All kept articles that exist, filled up to ``size`` with others in an order that the seed fixes."""
    kept = articles.join(keep.select("article_id").distinct(), "article_id", "left_semi")
    rest = articles.join(keep.select("article_id"), "article_id", "left_anti")
    room = kept.agg(F.greatest(F.lit(size) - F.count("*"), F.lit(0)).alias("room"))
    # One row of room beside the places.
    fill = hash_places(rest.select("article_id"), "article_id", seed).crossJoin(F.broadcast(room)).where("place <= room")
    return kept.union(articles.join(fill.select("row.article_id"), "article_id", "left_semi"))


def train_val(rows: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """``rows`` with ``part`` (in place of a column of that name): exactly max(1, floor(n * ratio)) of them ``val``, by the order of a hash."""
    placed = hash_places(rows, key, seed)
    val = F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("total") * ratio))
    return placed.select(*(F.col("row")[c].alias(c) for c in rows.columns if c != "part"), F.when(val, "val").otherwise("train").alias("part"))
