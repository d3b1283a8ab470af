"""References to records that do not exist (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def references(df: DataFrame, ref_table: str, key: str | Column, time: str | Column, row: str | Column = "line_no") -> DataFrame:
    """(ref_table, key, time, line_no): the references that one table makes; null keys are none."""
    col = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    return df.select(
        F.lit(ref_table).alias("ref_table"), col(key).cast("string").alias("key"), col(time).alias("time"), col(row).alias("line_no")
    ).where(F.col("key").isNotNull())


def orphans(
    refs: DataFrame, parents: DataFrame, *, key: str = "_id", since: str = "loaded_at", until: str = "removed_at"
) -> DataFrame:
    """(ref_table, period, line_no, reason): references that no parent row satisfies at their time.

    A parent row holds from ``since`` (inclusive) until ``until`` (exclusive; null: still there). reason is ``missing``
    if no parent row has the key, ``late`` if all were loaded after the time, ``deleted`` if each one loaded by then had
    been removed by then. Keys compare exactly; an empty key is a key. A reference without a time can only be
    ``missing`` and has a null period. A parent row without ``since`` was never loaded; its key exists. Repeated
    references each give a row; repeated parent rows change nothing.

    Missing keys come from a left anti join of the distinct referred keys against the parent keys, joined back. For the
    others, loads and removals are summed by key and day before they meet the references, and only within a
    day are they run through in order: no key's history is gathered in one task beyond one day of it.
    """
    known = parents.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(since).alias("since"), F.col(until).alias("until")).where("key is not null")
    parent_keys = known.groupBy("key").agg(F.min("since").alias("first_since"))
    absent = refs.select("key").distinct().join(parent_keys.select("key"), "key", "left_anti")
    missing = refs.join(absent, "key").withColumn("reason", F.lit("missing"))

    present = refs.where(F.col("time").isNotNull()).join(parent_keys, "key")
    late = present.where(F.col("first_since").isNull() | (F.col("time") < F.col("first_since"))).withColumn("reason", F.lit("late"))
    loaded = present.where(F.col("time") >= F.col("first_since")).drop("first_since")

    holds = known.where(F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    changes = (
        holds.select("key", F.explode(F.array(
            F.struct(F.col("since").alias("time"), F.lit(1).alias("change")),
            F.struct(F.col("until").alias("time"), F.lit(-1).alias("change")),
        )).alias("c")).select("key", "c.*").where("time is not null")
        .groupBy("key", "time").agg(F.sum("change").alias("change"))
        .withColumn("day", F.to_date("time"))
    )
    asked = loaded.withColumn("day", F.to_date("time"))
    # What holds when a day begins: running sums over the (key, day) totals.
    days = asked.select("key", "day", F.lit(0).cast("bigint").alias("change")).distinct().union(changes.select("key", "day", "change"))
    before = W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.groupBy("key", "day").agg(F.sum("change").alias("total")).select("key", "day", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    # Within the day, changes at the very time of a reference apply to it.
    within = W.partitionBy("key", "day").orderBy("time", "asks").rowsBetween(W.unboundedPreceding, 0)
    # References of one key at one moment share a row here, so that repeats cost nothing.
    moments = asked.select("key", "day", "time").distinct()
    line = (
        moments.select("key", "day", "time", F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("change"))
        .union(changes.select("key", "day", "time", F.lit(0), "change"))
        .withColumn("running", F.sum("change").over(within))
        .where("asks = 1")
    )
    gone = line.join(carried, ["key", "day"]).where(F.col("running") + F.col("carried") <= 0).select("key", "time")
    deleted = loaded.join(gone, ["key", "time"]).withColumn("reason", F.lit("deleted"))
    columns = ["ref_table", F.date_format("time", "yyyy-MM").alias("period"), "line_no", "reason"]
    return missing.select(*columns).union(late.select(*columns)).union(deleted.select(*columns))


def orphan_report(refs: DataFrame, parents: DataFrame, **names: str) -> DataFrame:
    """(ref_table, period, reason, orphans, share): orphan references per table, month and reason.

    share is of all references of the table and month. Months without an orphan have no row.
    """
    total = refs.groupBy("ref_table", F.date_format("time", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
    found = orphans(refs, parents, **names).groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"))
    t = total.select(F.col("ref_table").alias("t"), F.col("period").alias("p"), "n")
    return found.join(t, (F.col("ref_table") == F.col("t")) & F.col("period").eqNullSafe(F.col("p"))).select(
        "ref_table", "period", "reason", "orphans", F.round(F.col("orphans") / F.col("n"), 6).alias("share")
    )
