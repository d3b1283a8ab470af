import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.tokens import Piece, default_ranks, edge, encode, encoder, join_all, joint

ENC = encoder(default_ranks())
PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "l", "r", "e", "v", "é", "ệ", "日", "1", "23", ".", "!!", "“", "🙂", "hello", " the", "́", "\xa0", "x" * 40]), max_size=60).map("".join)


@given(PARTS, st.integers(1, 40))
@settings(max_examples=500, deadline=None)
def test_join_is_exact(text, size):
    pieces = [Piece(text[i : i + size], ENC.encode_ordinary(text[i : i + size])) for i in range(0, max(1, len(text)), size)]
    assert join_all(pieces, ENC).tokens == ENC.encode_ordinary(text)


def strung(text, size, chars):
    """The tokens by joints of edges only; None where they do not suffice."""
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    ids = [ENC.encode_ordinary(p) for p in pieces]
    found = [joint(edge(pieces[i], ids[i], chars, ENC, True), edge(pieces[i + 1], ids[i + 1], chars, ENC, False), ENC, i == 0, 4) for i in range(len(pieces) - 1)]
    if None in found:
        return None
    out = []
    for i, own in enumerate(ids):
        dropped, given, made = (found[i - 1][2] if i else 0), (found[i][0] if i < len(found) else 0), (found[i][1] if i < len(found) else [])
        if dropped + given > len(own):
            return None
        out += own[dropped : len(own) - given] + made
    return out


@given(st.lists(PARTS, min_size=4, max_size=12).map("".join), st.integers(40, 90), st.integers(9, 30))
@settings(max_examples=800, deadline=None)
def test_edges_give_the_same_or_nothing(text, size, chars):
    got = strung(text, size, chars)
    assert got is None or got == ENC.encode_ordinary(text)


RUNS = st.lists(st.tuples(st.sampled_from([" ", "\n", "a", "ab", "ệ", "7", ".", "'", "日", "\xa0", " x", "s"]), st.integers(1, 90)).map(lambda x: x[0] * x[1]), min_size=1, max_size=8).map("".join)


@given(RUNS, st.integers(40, 90), st.integers(9, 30))
@settings(max_examples=800, deadline=None)
def test_edges_of_long_runs(text, size, chars):
    got = strung(text, size, chars)
    assert got is None or got == ENC.encode_ordinary(text)


def test_edges_suffice_for_prose_and_long_runs():
    rng = random.Random(4)
    prose = " ".join(rng.choice(["điều", "khoản", "hợp", "12.000", "(a)", "\n", "đồng,"]) for _ in range(20_000))
    for text in (prose, "a" * 40_000, "thequick" * 5000, "ệ" * 30_000):
        got = strung(text, 2000, 300)
        assert got is not None and got == ENC.encode_ordinary(text), text[:20]


@pytest.mark.parametrize("unit", ["a", "ab", " ", ".", "ệ", "thequick", "日本", "<|endoftext|>", "1"])
def test_long_unsplit_text(unit):
    text = (unit * 20_000)[:20_000]
    pieces = [Piece(text[i : i + 700], ENC.encode_ordinary(text[i : i + 700])) for i in range(0, len(text), 700)]
    assert join_all(pieces, ENC).tokens == ENC.encode_ordinary(text)


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(default_ranks().replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Điều 5. <|endoftext|> x\r\n  y", "🙂é", "a'll b"):
        assert other.encode(text, add_special_tokens=False).ids == ENC.encode_ordinary(text)


def test_rows(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["điều", "khoản", "hợp", "x" * 99, "12.000", "\n"]) for _ in range(3000))
    texts = [None, "", " ", "ngắn", long, long, long + "!", "y" * 9000]
    df = spark.createDataFrame([(i, t, 0, "n") for i, t in enumerate(texts)] + [(None, long, 0, "n"), (3, "ngắn", 0, "n")], "doc_id bigint, text string, ids int, name string")
    got = [(r.doc_id, r.ids) for r in encode(df, "doc_id", piece_chars=500).collect()]
    want = [(i, ENC.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(None, ENC.encode_ordinary(long)), (3, ENC.encode_ordinary("ngắn"))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode(df.limit(0), "doc_id").count() == 0
