import math
import random

from tessera.llm.cross_split import cosine_join, overlap_report, split_overlaps


def world(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    queries, qrels = {}, []
    for i in range(n):
        if queries and rng.random() < 0.4:
            words = rng.choice(list(queries.values())).split()
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = rng.sample(vocabulary, rng.randint(4, 14))
        queries[f"q{i}"] = " ".join(words)
        for split in rng.sample(["train", "val", "test"], rng.choice([1, 1, 2])):
            qrels.append((split, f"q{i}", "a", 0.0))
    return queries, qrels


def frames(spark, queries, qrels):
    return (
        spark.createDataFrame([(k, t, "s" if int(k[1:]) % 3 else None, 1) for k, t in queries.items()], "_id string, text string, source string, a int"),
        spark.createDataFrame(qrels, "split string, `query-id` string, `corpus-id` string, score double"),
    )


def test_overlaps_match_brute_force(spark):
    queries, qrels = world()
    sets = {k: set(t.split()) for k, t in queries.items()}
    of = lambda s: {q for split, q, _, _ in qrels if split == s}
    want = {
        (s, *sorted((x, y))) for s in ("val", "test") for x in of("train") for y in of(s) if x == y or len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.75
    }
    q, r = frames(spark, queries, qrels + qrels[:20])
    found = split_overlaps(q, r)
    got = [tuple(x) for x in found.collect()]
    assert set(got) == want and len(got) == len(want) and any(a != b for _, a, b in want)
    report = {(x.split, x.source): (x.overlapping, x.pairs) for x in overlap_report(found, q, r).collect()}
    for split in ("val", "test"):
        ids = {i for s, a, b in want for i in (a, b) if s == split and (split, i) in {(s2, q2) for s2, q2, _, _ in qrels}}
        assert sum(v[0] for k, v in report.items() if k[0] == split) == len(ids)
    assert {k[1] for k in report} <= {"s", "unknown"}


def test_null_empty_and_repeated(spark):
    queries = spark.createDataFrame([("a", None, "x"), ("b", "", "x"), ("c", "một HAI", "x"), ("d", "hai​ một!", "x"), ("c", "một hai", "x"), (None, "một hai", "x")], "_id string, text string, source string")
    qrels = spark.createDataFrame([("train", i) for i in "abc"] + [("test", i) for i in "bdd"] + [("test", None), (None, "c"), ("val", "zz"), ("train", "zz")], "split string, `query-id` string")
    assert {tuple(r) for r in split_overlaps(queries, qrels).collect()} == {("test", "c", "d"), ("test", "b", "b"), ("val", "zz", "zz")}
    assert split_overlaps(queries.limit(0), qrels.limit(0)).count() == 0


def test_idf_weights_are_exact(spark):
    rng = random.Random(5)
    sets = {f"s{i}": sorted(rng.sample([f"t{j}" for j in range(25)], rng.randint(2, 7))) for i in range(90)}
    rows = [(k, "l" if i % 2 else "r", w) for i, (k, w) in enumerate(sets.items())]
    total = len(sets)
    df = {t: sum(t in w for w in sets.values()) for w in sets.values() for t in w}
    weight = lambda t: math.log1p(total / df[t])
    norm = {k: math.sqrt(sum(weight(t) ** 2 for t in w)) for k, w in sets.items()}
    want = {
        (a, b) for a, sa, wa in rows for b, sb, wb in rows
        if (sa, sb) == ("l", "r") and sum(weight(t) ** 2 for t in set(wa) & set(wb)) / norm[a] / norm[b] >= 0.6
    }
    got = cosine_join(spark.createDataFrame(rows, "set_id string, side string, words array<string>"), 0.6, "idf").collect()
    assert {(r.a, r.b) for r in got} == want and want
