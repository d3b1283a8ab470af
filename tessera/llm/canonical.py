"""One stored form for text that reads the same (problem 5).

Normalization quick-check properties isolate what may change: a character is stable if it is its own composed form, never
joins the character before it (NFC_Quick_Check = Yes), has combining class 0 and imitates no other. Stable
characters in a row stay as they are. Only the runs of others, with the character before them and the words around them as
boundary context, are normalized; the canonical segments are spliced into the unchanged text.

Canonical form: composed letters (NFC), full-width and half-width forms as ordinary ones, every blank as U+0020,
every line end as ``\\n``, nothing invisible, and look-alike letters as the Latin letters they imitate. A word that
also has letters unlike any Latin one is foreign and keeps its letters. Signs with a look of their own
(``… – “ ” ² ½ °``) stay.

Null stays null, empty stays empty, the function is idempotent and linear in the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letter, then the letter it imitates.
LOOK_ALIKES = dict(
    pair.split("=")
    for pair in (
        # Cyrillic
        "А=A В=B С=C Е=E Н=H І=I Ј=J К=K М=M О=O Р=P Ѕ=S Т=T Х=X У=Y Ү=Y Ѵ=V Ԛ=Q Ԝ=W Ԍ=G Ӏ=I "
        "а=a с=c е=e һ=h і=i ј=j о=o р=p ѕ=s х=x у=y ү=y ѵ=v ԁ=d ԛ=q ԝ=w ӏ=l "
        # Greek
        "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ϲ=c ϳ=j Ϲ=C "
        # Latin beyond the Vietnamese alphabet
        "Ð=Đ Ɖ=Đ ð=đ ɡ=g ɑ=a ʋ=v ɩ=i"
    ).split()
)
# Look-alike sign, then the ordinary sign.
LOOK_ALIKE_SIGNS = {
    "\u2010": "-", "\u2011": "-", "\u2024": ".", "\u2044": "/", "\u2215": "/", "\u2236": ":", "\ua789": ":",
    "\u201a": ",", "\u02bc": "'",
}

_LETTERS = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_MARKS = re.compile(r"[\u0300-\u036f]")


@lru_cache(maxsize=None)
def _plain(ch: str) -> str | None:
    """What replaces one decomposed character whatever its neighbours are; None to leave it."""
    if ch in LOOK_ALIKE_SIGNS:
        return LOOK_ALIKE_SIGNS[ch]
    if ch in "\n\t":
        return None
    if ch in "\r\x0b\x0c\x85\u2028\u2029":
        return "\n"
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if kind in ("Cf", "Cc") or "\ufe00" <= ch <= "\ufe0f" or ch in "\u034f\u115f\u1160\u3164\uffa0":
        return ""
    how = unicodedata.decomposition(ch)
    if how.startswith(("<wide>", "<narrow>", "<small>")) or "\U0001d400" <= ch <= "\U0001d7ff" or "\ufb00" <= ch <= "\ufb06":
        return unicodedata.normalize("NFKC", ch)
    return None


def _latin(ch: str) -> bool:
    return ch in LOOK_ALIKES or ch.isascii() or "LATIN" in unicodedata.name(ch, "")


def _word(m: re.Match) -> str:
    word = m.group()
    if not any(ch in LOOK_ALIKES for ch in word):
        return word
    if not all(_latin(ch) for ch in _MARKS.sub("", word)):
        return word
    return "".join(LOOK_ALIKES.get(ch, ch) for ch in word)


def _segment(text: str) -> str:
    decomposed = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
    plain = "".join(ch if (to := _plain(ch)) is None else to for ch in decomposed)
    return unicodedata.normalize("NFC", _LETTERS.sub(_word, unicodedata.normalize("NFD", plain)))


# Quick check

_BLOCKS = (range(0x3000), range(0x4E00, 0xA000))  # others get the closer look
_JVM_BLOCKS = (range(0x250), range(0x1E00, 0x1F00), range(0x2010, 0x2030), range(0x20A0, 0x20D0))


@cache
def _joining() -> frozenset[int]:
    """Characters that may join the one before them: second parts of composed letters, and vowels and finals of Hangul."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x10000))
    return frozenset(int(p[1], 16) for p in parts if len(p) == 2 and p[0][0] != "<") | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}


def is_stable(ch: str) -> bool:
    """Whether a character stays as it is, whatever stands beside it."""
    return not (unicodedata.combining(ch) or ord(ch) in _joining() or ch in LOOK_ALIKES) and _segment(ch) == ch


@cache
def stable_class(blocks: tuple[range, ...] = _BLOCKS) -> str:
    """The inside of a regular expression's class of stable characters, derived from the Unicode data."""
    spans: list[list[int]] = []
    for c in (c for block in blocks for c in block if is_stable(chr(c))):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


@cache
def _unstable() -> re.Pattern:
    return re.compile(f"[^{stable_class()}]+")


def canonical_text(text: str | None) -> str | None:
    """The canonical form of one text."""
    if not text:
        return text
    parts, done = [], 0
    unstable = _unstable()
    for m in unstable.finditer(text):
        if m.end() <= done:
            continue
        start, end = m.span()
        start = max(done, start - 1)  # what a mark may join
        while start > done and (text[start - 1].isalnum() or text[start - 1] == "\r"):
            start -= 1
        grown = True
        while grown:  # to the end of the word, over further unstable runs in it
            grown = False
            while end < len(text) and text[end].isalnum():
                end += 1
                grown = True
            if end < len(text) and (more := unstable.match(text, end)):
                end, grown = more.end(), True
        if text[end - 1] == "\r" and text[end : end + 1] == "\n":
            end += 1
        parts += (text[done:start], _segment(text[start:end]))
        done = end
    return "".join(parts) + text[done:] if parts else text


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Column function: the canonical form of each text."""
    return texts.map(canonical_text, na_action="ignore")


def is_unstable(text: Column) -> Column:
    """JVM-side quick check: false only if the text is certainly canonical already."""
    return text.rlike(f"[^{stable_class(_JVM_BLOCKS)}]")


def canonicalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the named string columns in canonical form. Rows that pass the quick check in all of them never reach Python."""
    open_ = reduce(or_, (F.coalesce(is_unstable(F.col(c)), F.lit(False)) for c in columns))
    return df.where(~open_).union(df.where(open_).withColumns({c: canonical(F.col(c)) for c in columns}))


def non_canonical(df: DataFrame, src: str, fields: list[str], key: str = "line_no") -> DataFrame:
    """(src, field, key, stored, canonical): every value that is not in canonical form.

    Values that pass the quick check never reach Python. Null and empty values are canonical.
    """
    values = df.select(
        F.col(key).alias(key),
        F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("stored")) for f in fields))),
    ).where(is_unstable(F.col("stored")))
    return (
        values.withColumn("canonical", canonical(F.col("stored")))
        .where(F.col("canonical") != F.col("stored"))
        .select(F.lit(src).alias("src"), "field", key, "stored", "canonical")
    )
