import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.splitting import LINE, NONE, PARAGRAPH, SENTENCE, WORD, boundaries, cuts, split_oversized

TEXT = st.lists(st.sampled_from(["a", "bc", " ", ". ", "\n", "\n\n", "x" * 30, "ệ", "́", "q" * 90]), max_size=120).map("".join)


@given(TEXT, st.integers(10, 80), st.integers(0, 40))
@settings(max_examples=600, deadline=None)
def test_nothing_is_lost_and_limits_hold(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    parts = cuts(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in parts) == text
    for (start, cut, stop, kind), before in zip(parts, [None, *parts]):
        assert stop - start <= limit and 0 <= cut - start <= overlap
        assert before is None or (cut == before[2] and start >= before[0])
    at, strength = boundaries(text)
    known = dict(zip(at, strength))
    for start, cut, stop, kind in parts[:-1]:
        assert kind == known.get(stop, NONE) or kind == NONE
        if kind == NONE:  # only where there is none at all in reach
            assert not [p for p in at if cut < p <= min(start + limit, len(text) - 1)]


def test_boundary_strength():
    at, strength = boundaries("Một. Hai\nba\n\nbốn năm.” Sáu")
    assert strength == [SENTENCE, LINE, PARAGRAPH, WORD, SENTENCE] and at[0] == 5


def test_strongest_boundary_near_the_target():
    text = "từ " * 290 + "hết câu. " + "từ " * 320
    a = cuts(text, 1200, 0)[0]
    assert a[3] == SENTENCE and text[a[1] : a[2]].endswith("hết câu. ")
    assert [p[3] for p in cuts("x" * 3000, 1200, 200)] == [NONE] * 3


def test_rows(spark):
    rows = [("a", 1, None, 7), ("a", 2, "", 7), ("a", 3, "ngắn", 7), ("b", 4, "từ " * 1000, 7), ("b", 4, "từ " * 1000, 7), (None, None, "y" * 1201, 7), ("c", 5, "z" * 1200, 7)]
    df = spark.createDataFrame(rows, "src string, line_no bigint, text string, piece_no int")
    got = split_oversized(df, ["src", "line_no"], F.col("text")).collect()
    count = {}
    for r in got:
        assert len(r.piece) <= 1200 and r.stop - r.start == len(r.piece) and r.cut - r.start <= 200
        count[r.line_no] = count.get(r.line_no, 0) + 1
    assert count == {2: 1, 3: 1, 4: 6, None: 2, 5: 1}
    whole = sorted((r for r in got if r.line_no == 4), key=lambda r: r.piece_no)[::2]
    assert "".join(r.piece[r.cut - r.start :] for r in whole) == "từ " * 1000
    assert split_oversized(df.limit(0), ["src"], F.col("text")).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, ["src"], F.col("text"), 100, 100)
