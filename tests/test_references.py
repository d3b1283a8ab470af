from datetime import datetime as D

from tessera.operators.references import orphan_report, orphans, references

PARENT = "_id string, loaded_at timestamp_ntz, removed_at timestamp_ntz, key string"
CHILD = "`corpus-id` string, judged_at timestamp_ntz, line_no bigint, time string"


def brute(refs, parents):
    out = set()
    for key, t, n in refs:
        if key is None:
            continue
        rows = [(a, b) for k, a, b, _ in parents if k == key]
        if not rows:
            out.add((n, "missing"))
        elif t is not None:
            loaded = [(a, b) for a, b in rows if a is not None and a <= t]
            if not loaded:
                out.add((n, "late"))
            elif not any(b is None or b > t for _, b in loaded):
                out.add((n, "deleted"))
    return out


def frames(spark, refs, parents):
    child = spark.createDataFrame([(k, t, n, "x") for k, t, n in refs], CHILD)
    return references(child, "qrels", "corpus-id", "judged_at"), spark.createDataFrame(parents, PARENT)


def test_reasons_match_brute_force(spark):
    d = lambda day, hour=0: D(2024, 1, day, hour)
    parents = [
        ("a", d(2), None, "x"), ("b", d(1), d(5), "x"), ("b", d(7), None, "x"), ("c", d(1), d(1), "x"), ("d", None, None, "x"),
        ("", d(3), None, "x"), (None, d(1), None, "x"), ("e", d(2), d(4), "x"), ("e", d(4), d(6), "x"), ("b", d(1), d(5), "x"), ("f", d(3, 5), d(3, 9), "x"),
    ]
    keys = ["a", "b", "c", "d", "e", "f", "", "A", None]
    times = [d(1), d(2), d(3, 4), d(3, 5), d(3, 9), d(4), d(5), d(6), d(8), None]
    refs = [(k, t, i * 100 + j) for i, k in enumerate(keys) for j, t in enumerate(times)]
    refs += refs[:10]  # repeated rows
    found = orphans(*frames(spark, refs, parents)).collect()
    assert {(r.line_no, r.reason) for r in found} == brute(refs, parents)
    assert len(found) == len(brute(refs, parents)) + sum(1 for r in refs[:10] for n, _ in brute(refs, parents) if n == r[2])
    assert {r.period for r in found if r.reason != "missing"} == {"2024-01"}


def test_hot_key_and_empty_tables(spark):
    parents = [("hot", D(2024, 1, 1), D(2024, 2, 1), "x")] * 50
    refs = [("hot", D(2024, 1, 1 + i % 28, i % 24), i) for i in range(300)] + [("hot", D(2024, 3, 1), 1000 + i) for i in range(100)]
    assert {(r.line_no, r.reason) for r in orphans(*frames(spark, refs, parents)).collect()} == {(1000 + i, "deleted") for i in range(100)}
    assert orphans(*frames(spark, [], [])).count() == 0
    assert {r.reason for r in orphans(*frames(spark, refs, [])).collect()} == {"missing"}


def test_report_counts(spark):
    refs = [("x", D(2024, 1, 1), 1), ("x", D(2024, 1, 2), 2), ("a", D(2024, 1, 3), 3), ("y", None, 4)]
    got = {(r.period, r.reason): (r.orphans, r.share) for r in orphan_report(*frames(spark, refs, [("a", D(2024, 1, 1), None, "x")])).collect()}
    assert got == {("2024-01", "missing"): (2, 0.666667), (None, "missing"): (1, 1.0)}
