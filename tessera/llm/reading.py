"""Reading level of each document (problem 9): the median of classic readability formulas.

Words are syllables in Vietnamese; rules in the manner of hyphenation patterns take a word apart into onset, nucleus and
coda. They tell Vietnamese from other text, count syllables and weigh rhymes; a word of two syllables' weight or more
counts as one of many syllables. Six formulas over sentence length and these counts (Flesch and Kincaid, Gunning's Fog,
McLaughlin's SMOG, the automated readability index, Bjornsson's LIX, Linsear Write) are put on the levels 1 to 5 by cut
points fitted on a bounded sample of labelled documents; the estimate is the median of the six.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"(?<!\S)\d")
_MARKUP = re.compile(r"<[^<>]{1,200}>|-{2,} *\w+ \d+ *-{2,}")
_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)]|[-•*–]|[a-zđ]\))\s+", re.MULTILINE)
_BROKEN_CLAUSE = re.compile(r";[ \t]*\n")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|\n+|\s[-•]\s(?=[^\W\d_])")
_CLAUSE = re.compile(r"[,;:]+(?=\s|$)|[.!?…]+(?=\s|$)|\n+")
_HIGH = re.compile("[\x80-\xff]{2,}")
#: Rules for one syllable: onset, nucleus, coda, without accents.
_SYLLABLE = re.compile(r"(ngh|ng|nh|gh|gi|kh|ph|th|tr|ch|qu|[bcdghklmnprstvx])?([aeiouy]{1,3})(ng|nh|ch|[cmnpt])?")
_VOWELS = re.compile(r"[aeiouy]+")

FORMULAS = ("flesch_kincaid", "fog", "smog", "ari", "lix", "linsear_write")
LONGEST, ALONE = 160, 40  # words: see sentences()


@lru_cache(maxsize=200_000)
def _flat(word: str) -> str:
    return re.sub(r"[̀-ͯ]", "", unicodedata.normalize("NFD", word)).replace("đ", "d")


@lru_cache(maxsize=200_000)
def syllable_weight(word: str) -> tuple[int, float, bool]:
    """(syllables, weight, whether it is one Vietnamese syllable) of a lower-case word without accents.

    A rhyme with a coda and one with several vowels each weigh half a syllable more.
    """
    if m := _SYLLABLE.fullmatch(word):
        return 1, 1 + 0.5 * bool(m[3]) + 0.5 * (len(m[2]) > 1), True
    n = max(1, len(_VOWELS.findall(word)))
    return n, float(n), False


def _utf8(m: re.Match) -> str:
    """Bytes of UTF-8 that were read as Latin-1; others stay."""
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m.group()


def readable(text: str) -> str:
    """The prose of a text: encoding repaired, without markup and page marks, list marks and clause breaks undone."""
    text = _HIGH.sub(_utf8, text)
    text = unicodedata.normalize("NFC", _MARKUP.sub(" ", text))
    return _BROKEN_CLAUSE.sub(", ", _ITEM.sub("", text))


@dataclass
class Counts:
    """What the formulas need of one text; of words the mean weight, the mean length, and the shares of heavy and long ones."""

    n_words: int
    n_numbers: int
    sentence_length: float
    vietnamese: float
    weight: float
    letters: float
    heavy: float
    long: float


def sentences(prose: str) -> int:
    """The number of sentences that hold a word.

    A sentence that holds most of a text and has more than LONGEST words, or more than ALONE without a capital letter at
    its start, has lost the marks inside: its clauses are counted in its place. So has one of more than ALONE words that is
    all of a text and in capitals.
    """
    parts = [(s, n) for s in _SENTENCE.split(prose) if (n := len(WORDS.findall(s)))]
    total = len(parts)
    for part, n in parts:
        if n > ALONE and 1.5 * n > sum(m for _, m in parts):
            first = WORDS.search(part)[0]
            if n > LONGEST or not first[0].isupper() or (len(parts) == 1 and part.isupper()):
                total += sum(1 for c in _CLAUSE.split(part) if WORDS.search(c)) - 1
    return max(1, total)


def count(text: str) -> Counts:
    prose = readable(text)
    # Each different word is looked at once.
    words = Counter(WORDS.findall(prose.lower()))
    n = viet = heavy = long = letters = 0
    weight = 0.0
    for word, k in words.items():
        flat = _flat(word)
        _, w, is_viet = syllable_weight(flat)
        n += k
        viet += k * is_viet
        weight += k * w
        heavy += k * (w >= 2)
        long += k * (len(flat) >= 5)
        letters += k * len(flat)
    numbers = len(_NUMBER.findall(prose))
    m = max(1, n)
    return Counts(n, numbers, n / sentences(prose), viet / m, weight / m, letters / m, heavy / m, long / m)


def is_vietnamese_prose(c: Counts, text: str, least_words: int = 40) -> bool:
    """Whether a text is mainly Vietnamese running text of at least ``least_words`` blank-separated words."""
    return (
        c.vietnamese >= 0.75 and c.n_numbers <= 0.25 * (c.n_words + c.n_numbers)
        and c.n_words >= least_words / 2 and len(text.split()) >= least_words
    )


def formulas(c: Counts) -> list[float]:
    """The six formulas, with the constants they were published with."""
    s = c.sentence_length
    return [
        0.39 * s + 11.8 * c.weight - 15.59,
        0.4 * (s + 100 * c.heavy),
        1.043 * (30 * c.heavy * s) ** 0.5 + 3.1291,
        4.71 * c.letters + 0.5 * s - 21.43,
        s + 100 * c.long,
        s * (1 + 2 * c.heavy) / 2,
    ]


@dataclass
class Model:
    """Each formula's cut points between the levels."""

    cuts: list[list[float]]

    def grades(self, c: Counts) -> list[float]:
        """Each formula's estimate on the scale of the levels, between 0.5 and 5.5."""
        out = []
        for x, cut in zip(formulas(c), self.cuts):
            first, last = max(cut[1] - cut[0], 1e-9), max(cut[3] - cut[2], 1e-9)
            known = [cut[0] - first, *cut, cut[3] + last]
            out.append(float(np.interp(x, known, [0.5, 1.5, 2.5, 3.5, 4.5, 5.5])))
        return out


def _best_cuts(values: np.ndarray, levels: np.ndarray) -> list[float]:
    """For each pair of neighbouring levels the value that parts lower from higher.

    Ratings err, so that of the cuts with at most a hundredth of all documents more errors than the best the widest gap
    between two documents is taken, and its middle.
    """
    order = np.argsort(values, kind="stable")
    v, y = values[order], levels[order]
    ends = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    cuts: list[float] = []
    for k in (1.5, 2.5, 3.5, 4.5):
        errors = np.concatenate([[0], np.cumsum(y > k)]) + (y <= k).sum() - np.concatenate([[0], np.cumsum(y <= k)])
        near = np.flatnonzero(errors <= errors.min() + 0.01 * len(y))
        at = int(near[np.argmax(ends[near + 1] - ends[near])])
        cut = float(ends[at] + ends[at + 1]) / 2
        cuts.append(max(cut, cuts[-1] + 1e-6) if cuts else cut)
    return cuts


def train(documents: DataFrame, labels: DataFrame, *, sample: int = 4000) -> Model:
    """Fitted on at most ``sample`` labelled documents, the first by a hash of their id.

    Ratings of one document are averaged; null levels and documents without one are not used. What comes to the driver are
    the level and the values of the six formulas of each document of that bounded sample.
    """
    rated = labels.where("level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("level"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` ids: a bounded side.
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([formulas(count(t)) for t in batch.column(1).to_pylist()]).reshape(-1, len(FORMULAS))
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(v) for v in values.T)], ["level", *FORMULAS])

    found = rows.mapInArrow(measure, "level double, " + ", ".join(f"{n} double" for n in FORMULAS)).toArrow()
    if not len(found):
        return Model([[1.0, 2.0, 3.0, 4.0]] * len(FORMULAS))
    levels = found.column("level").to_numpy()
    return Model([_best_cuts(found.column(n).to_numpy(), levels) for n in FORMULAS])


def reading_levels(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, estimate, level, the six grades) of every document that is mainly Vietnamese prose of 40 words.

    Null and empty texts, tables, scraps and texts in other languages give no row; the ``lang`` column is not asked.
    Text without accents and text with a broken UTF-8 encoding are read as the Vietnamese they are. Repeated rows stay
    repeated. level is the estimate rounded, from 1 to 5.
    """
    grades = [f"grade_{n}" for n in FORMULAS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = count(text)
                if is_vietnamese_prose(c, text):
                    g = model.grades(c)
                    estimate = median(g)
                    ids.append(doc)
                    rows.append((estimate, min(5, max(1, int(estimate + 0.5))), *g))
            columns = list(zip(*rows)) or [()] * (2 + len(grades))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[2:])],
                ["doc_id", "estimate", "level", *grades],
            )

    schema = "doc_id bigint, estimate double, level int, " + ", ".join(f"{g} double" for g in grades)
    return documents.select("doc_id", "text").where("text is not null and length(text) >= 40").mapInArrow(run, schema)
