import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.canonical import _BLOCKS, _JVM_BLOCKS, LOOK_ALIKES, _segment, canonical_text, canonicalize, is_stable, non_canonical, stable_class

CASES = [
    ("Trong trường hợ́p", None), ("trường", "trường"), ("hợp", "hợp"), ("ｋｈôｎｇ？", "không?"),
    ("mό̛i", "mới"), ("ЖЩЮ‐17", "ЖЩЮ-17"), ("Ðội thay ðổi", "Đội thay đổi"), ("Ɖơn", "Đơn"), ("a b c　d", "a b c d"),
    ("﻿x​y­z⁠", "xyz"), ("a\r\nb\rc d", "a\nb\nc\nd"), ("Khi", "Khi"), ("đạt;", "đạt;"), ("Тên", "Tên"),
    ("KΙỂΜ", "KIỂM"), ("МОСКВА", "MOCKBA"),
]
STAY = ["Quyết định số 5 – “mức ½”… 12 °C, m³, § 4", "ЖЩЮ-17", "ДИЯ", "МОСКВЯ", "λ Ω31 Σ δ π", "日本語", "", "a\n\tb", "Ü ñ ß"]


@pytest.mark.parametrize("stored, want", CASES)
def test_brings_to_one_form(stored, want):
    got = canonical_text(stored)
    assert got == (unicodedata.normalize("NFC", stored) if want is None else want)
    assert canonical_text(got) == got


@pytest.mark.parametrize("text", STAY)
def test_leaves_what_looks_different(text):
    assert canonical_text(text) == text


def test_null():
    assert canonical_text(None) is None


@given(st.text(st.sampled_from("ab ợ̛̣́​ ＡΒΟοvЖ½.\r\n"), max_size=40))
@settings(max_examples=500, deadline=None)
def test_is_idempotent_and_composed(text):
    got = canonical_text(text)
    assert canonical_text(got) == got and unicodedata.is_normalized("NFC", got)


@given(st.text("abcợđ–“ \n", max_size=30), st.text("ｋο​́", min_size=1, max_size=3), st.text("abc ợ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_unchanged_text_is_spliced(before, odd, after):
    got = canonical_text(before + " " + odd + " " + after)
    assert got.startswith(before) and got.endswith(after)


def test_long_text_is_linear():
    text = ("ữ" * 1000 + "​") * 400
    assert canonical_text(text) == "ữ" * 400_000


def test_columns(spark):
    rows = [(1, "x​", None, 9), (2, None, "ok", 9), (3, "", "Ａ", 9), (3, "", "Ａ", 9), (None, "λ", "½", 9)]
    df = spark.createDataFrame(rows, "line_no bigint, text string, title string, stored int")
    got = sorted((r.field, r.line_no, r.stored, r.canonical) for r in non_canonical(df, "t", ["text", "title"]).collect())
    assert got == [("text", 1, "x​", "x"), ("title", 3, "Ａ", "A"), ("title", 3, "Ａ", "A")]
    assert [r.title for r in canonicalize(df, ["text", "title"]).orderBy("line_no", "title").collect()] == ["½", None, "ok", "A", "A"]
    assert non_canonical(df.limit(0), "t", ["text"]).count() == 0


def test_quick_check_follows_the_unicode_properties():
    """Yes of NFC_Quick_Check: composed alone and after any base letter or mark; combining class 0; no look-alike."""
    for block in _BLOCKS[:1]:
        for c in block:
            if is_stable(ch := chr(c)):
                assert unicodedata.combining(ch) == 0 and unicodedata.is_normalized("NFC", ch) and ch not in LOOK_ALIKES
    assert not any(map(is_stable, "\u0301\u1161\u11a8\u09be\u212bОο\u200b\xa0\r"))
    assert all(map(is_stable, "aĐợ–½Жλ日\n\t"))
    every = re.compile(f"[{stable_class()}]")
    assert all(every.match(chr(c)) for block in _JVM_BLOCKS for c in block if re.match(f"[{stable_class(_JVM_BLOCKS)}]", chr(c)))


@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x2FFF), max_size=20))
@settings(max_examples=500, deadline=None)
def test_stable_characters_stay_in_any_order(text):
    kept = "".join(filter(is_stable, text))
    assert unicodedata.normalize("NFC", kept) == kept == canonical_text(kept)


@given(st.text(st.sampled_from("=<ab\u0338\u0301\u0323ợοЖ \u200b"), max_size=20))
@settings(max_examples=500, deadline=None)
def test_segments_have_boundary_context(text):
    assert canonical_text(text) == _segment(text)
