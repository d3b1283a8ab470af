import random

import networkx_free as nf
import pytest
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.near_duplicates import crowded, near_duplicates, shingle_hashes


def similar(a, b, width):
    grams = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split())]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    texts = {}
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        texts[f"d{i:03}"] = " ".join(words)
        for j in range(rng.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 2, 9])):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(9)}"
            texts[f"d{i:03}-{j}"] = " ".join(edited)
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "_id string, text string, rep int, a int")


@pytest.mark.parametrize("width, threshold", [(3, 0.7), (5, 0.8)])
def test_pairs_and_classes_match_brute_force(spark, width, threshold):
    texts = corpus()
    found = near_duplicates(frame(spark, texts), "_id", F.col("text"), width=width, threshold=threshold)
    keys = sorted(texts)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similar(texts[a], texts[b], width) >= threshold}
    pairs = found.pairs.collect()
    assert {(r.id_a, r.id_b) for r in pairs} == want and len(pairs) == len(want) and len(want) > 20
    assert {r.key: r.class_id for r in found.classes.collect()} == nf.components(keys, want)


def test_copies_meet_once(spark):
    texts = {f"c{i:03}": "một hai ba bốn năm sáu" for i in range(80)} | {"other": "bảy tám chín mười một hai"}
    found = near_duplicates(frame(spark, texts), "_id", F.col("text"))
    assert found.members.select("rep").distinct().count() == 2
    assert found.classes.groupBy("class_id").count().orderBy("class_id").collect()[0]["count"] == 80
    assert found.pairs.count() == 80 * 79 // 2


def test_odd_rows(spark):
    rows = [("n", None), (None, "a b c d e"), ("e", ""), ("p", "!!"), ("s", "ngắn"), ("t", "Ngắn."), ("s", "ngắn"), ("f", "ｎgắn​")]
    found = near_duplicates(spark.createDataFrame(rows, "_id string, text string"), "_id", F.col("text"))
    assert {(r.id_a, r.id_b) for r in found.pairs.collect()} == {("s", "t"), ("f", "s"), ("f", "t")}
    assert {r.key: r.class_id for r in found.classes.collect()} == {"s": "f", "t": "f", "f": "f"}
    empty = near_duplicates(spark.createDataFrame([], "_id string, text string"), "_id", F.col("text"))
    assert empty.pairs.count() == 0 and empty.classes.count() == 0


def test_very_long_text_and_word_order():
    assert len(shingle_hashes(" ".join(map(str, range(200_000))), 5)) == 199_996
    assert set(shingle_hashes("a b c", 3)) != set(shingle_hashes("c b a", 3))
    assert len(shingle_hashes("a", 5)) == 1 and not len(shingle_hashes("  ", 5))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, 100), (None, 3)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "x int, y int")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100} | {300 + i: 300 for i in range(40)}
    assert connected_components(spark.createDataFrame([], "x int, y int")).count() == 0


def test_class_of_some_thousand_members(spark):
    """Near copies in great number, and one text that heads their buckets without being like them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(2000):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        texts[f"m{i:04}"] = " ".join(words)
    texts["a"] = " ".join(base[:150] + [f"y{i}" for i in range(150)])
    found = near_duplicates(frame(spark, texts), "_id", F.col("text"))
    sizes = sorted(r["count"] for r in found.classes.groupBy("class_id").count().collect())
    assert sizes == [1, 2000]


def test_key_with_two_texts(spark):
    rows = [("k", "một hai ba bốn năm sáu"), ("k", "bảy tám chín mười trăm nghìn"), ("a", "một hai ba bốn năm sáu"), ("z", "bảy tám chín mười trăm nghìn"), ("o", "chín mươi chín con mèo")]
    found = near_duplicates(spark.createDataFrame(rows, "_id string, text string"), "_id", F.col("text"))
    assert {r.key: r.class_id for r in found.classes.collect()} == {"k": "a", "a": "a", "z": "a", "o": "o"}
    assert {(r.id_a, r.id_b) for r in found.pairs.collect()} == {("a", "k"), ("k", "z")}


def test_no_join_is_broadcast(spark):
    """Tables that grow with the rows don't pass through the driver, whatever the threshold, and cells are shuffled once."""
    found = near_duplicates(frame(spark, corpus(n=20)), "_id", F.col("text"), width=3, threshold=0.7)
    for rows in (found.pairs, found.classes, connected_components(spark.createDataFrame([(1, 2), (2, 3)], "x int, y int"))):
        assert rows.count() and rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan or "Scan ExistingRDD" in plan
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_buckets_of_the_same_members_count_once(spark):
    cells = [(1, 10), (1, 11), (2, 11), (2, 10), (3, 10), (3, 11), (3, 12), (4, 12), (5, 13), (5, 12)]
    df = spark.createDataFrame(cells, "bucket bigint, rep bigint")
    got = crowded(df)
    assert sorted(map(tuple, got.collect())) == [(1, 10, 10), (1, 10, 11), (3, 10, 10), (3, 10, 11), (3, 10, 12), (5, 12, 12), (5, 12, 13)]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(bucket") == 1
