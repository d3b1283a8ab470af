"""Broken prompt and response pairs (problem 4).

Each answer gets the first defect that applies: ``empty``, ``refusal``, ``copied``, ``other_language``, ``truncated``.
Refusals come from naive Bayes over word n-grams, learnt from what is answered where there is no gold. Languages come
from character-trigram naive Bayes: the answer's posterior is compared with the prompt's. Truncation comes from end-of-text
n-gram likelihood: how often a sentence ends after the last words of an answer anywhere inside the answers, together
with the mark the answer ends in, whose weight is learnt from all answers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.llm.canonical import canonical_text

THINK = re.compile(r"(?s)<think>.*?</think>")
CITATION = re.compile(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]")
LETTERS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?](?=[\s\"'”’)\]*]|$)|\n")
CLOSERS = "\"'”’)»*_"
LEAD_IN = re.compile(r"^\W*(?:(?:tra loi|dap|cau hoi|hoi|ban hoi|question|answer)\s*:|anh chi (?:muon biet|hoi)|ban (?:muon biet|hoi)|you ask(?:ed)?)\W*")
LIST_MARK = re.compile(r"(?:^|\s)(?:[a-zđ]|\d{1,2})[.)]$|(?:^|\n)\s*[-•*]$")
ANNOUNCED = re.compile(r"\b(?:có|gồm|là|sau) (hai|ba|bốn|năm|[2-9]) [^.:\n]{2,40}:", re.IGNORECASE)
ITEM = re.compile(r"(?:^|\s)(?:[a-zđ]|\d{1,2})\)")
NUMBERS = {"hai": 2, "ba": 3, "bốn": 4, "năm": 5}
MOST = 8  # words of context at the end, the start of the sentence counted as one
START = "<s>"

# Well-known ways of declining, in lower case without accents; one feature of those that are learnt.
DECLINES = re.compile(
    "|".join(
        (
            r"khong the (?:dua ra|tra loi|giai dap|tu van|ho tro|cung cap|xac dinh|ket luan)",
            r"khong (?:tim )?thay (?:can cu|quy dinh|co so|thong tin|dieu khoan|noi dung)",
            r"(?:chua|khong) (?:co )?du (?:thong tin|can cu|co so|du lieu)",
            r"khong (?:de cap|nhac den|neu ro|chua thong tin)",
            r"khong co (?:dieu khoan|quy dinh|thong tin|can cu|co so|doan|noi dung|cau tra loi)",
            r"(?:nam )?ngoai (?:pham vi|kha nang|tham quyen)",
            r"(?:toi|minh|em|chung toi) khong (?:co quyen|duoc phep|ro|biet|chac)",
            r"xin phep (?:khong|tu choi|duoc tu choi)|xin (?:duoc )?tu choi|tu choi tra loi",
            r"(?:can ?not|can't|could not|couldn't|unable to|not able to|won't|will not) (?:\w+ ){0,2}(?:answer|help|assist|reply|provide|give|find|determine|conclude|say|respond)",
            r"no answer can|(?:do|does|did) not (?:cover|contain|mention|address|provide|include|say)|not enough information|insufficient|beyond (?:my|the) scope|outside (?:my|the) scope|no (?:legal )?basis",
            r"je ne (?:peux|puis|suis)|ne (?:permettent|permet|contiennent|contient|traitent|traite|couvrent|mentionnent) pas|impossible de repondre|aucune (?:reponse|base|information)|pas en mesure",
            r"no (?:puedo|es posible|puede|se puede|podemos|tengo)|no (?:contienen?|cubren?|tratan?|mencionan?|permiten?)|fuera de(?:l)? alcance|ninguna respuesta",
            r"kann (?:ich )?(?:\w+ ){0,4}nicht|nicht beantwort|keine (?:antwort|grundlage|angaben)",
            r"^\W*(?:xin loi|rat tiec|sorry|i'm sorry|i am sorry|desole|lo siento|leider|es tut mir leid)\b",
        )
    )
)
POLITE = re.compile(
    r"vui long|thong cam|mong anh|mong ban|lien he|hoi don vi|please|contact|consult|veuillez|por favor|consulte|bitte|apolog|xin loi|rat tiec|cam on"
)
# What makes a clause conditional, and what sets an answer against a decline, in lower case with accents: without them
# "nêu" (state) is "nếu" (if), "những" (plural) "nhưng" (but) and "sĩ" "si".
CONDITION = re.compile(r"\b(?:nếu|khi|trừ khi|trường hợp|if|when|unless|where|si|lorsque|cuando|wenn)\b")
CONTRAST = re.compile(r"\b(?:tuy nhiên|nhưng|however|mais|pero)\b")
# For Vietnamese without any accent; "neu ro", "da neu", "duoc neu" and "nhung cau hoi" and the like are no conditions.
PLAIN_CONDITION = re.compile(r"\b(?:(?<!da )(?<!duoc )(?<!khong )(?<!vua )(?<!chua )neu(?! ro\b| tren\b| o\b)|khi|tru khi|truong hop)\b")
PLAIN_CONTRAST = re.compile(r"\b(?:tuy nhien|nhung(?! (?:cau|van de|noi dung|dieu|quy dinh|thong tin|doan|truong hop|can cu|yeu cau)\b))\b")


def fold(text: str) -> str:
    """Lower case without accents."""
    flat = unicodedata.normalize("NFD", text.lower()).replace("đ", "d").replace("’", "'")
    return re.sub(r"[̀-ͯ]", "", flat)


def _excused(sentence: str, start: int, end: int) -> bool:
    """Whether the decline at start:end of a folded sentence is not all it says: it stands in a condition, or an answer goes on beside it.

    Conditions count outside the declining words.
    """
    letters = [fold(c) for c in sentence]
    flat = "".join(letters)
    # Places of the folded characters in the sentence, which may be longer or shorter.
    at = [i for i, c in enumerate(letters) for _ in c] + [len(sentence)]
    plain = flat == sentence.replace("’", "'")
    tests = (PLAIN_CONDITION, PLAIN_CONTRAST) if plain else ()
    first, last = at[start], at[end]
    outside = sentence[:first] + " " * (last - first) + sentence[last:]
    opening = re.match(r"\W*sau khi[^,]*,", flat)
    if opening:
        outside = outside[at[opening.end()] :]
    return any(p.search(outside) for p in (CONDITION, CONTRAST, *tests))


def declines(text: str) -> bool:
    """Whether a text without reasoning and citations does nothing but decline.

    Its main clause declines; a decline inside a condition or one that an answer follows is none.
    """
    whole = unicodedata.normalize("NFC", text.lower())
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", whole.strip()) if LETTERS.search(s)]
    rest = declined = 0
    for accented in sentences:
        s = fold(accented)
        m = DECLINES.search(s)
        if m and len(WORDS.findall(s)) <= 40 and not _excused(accented, m.start(), m.end()):
            declined += 1
        elif not POLITE.search(s):
            rest += len(WORDS.findall(s))
    return declined > 0 and rest <= 6


def _within(words: list[str], pairs: set[tuple[str, str]]) -> float:
    """Share of neighbouring words that are neighbours in the question too."""
    return sum(p in pairs for p in zip(words, words[1:])) / max(1, len(words) - 1)


def copies(answer: str, question: str) -> bool:
    """Whether the answer only gives the question back: once or more, with a lead-in or slight changes.

    What follows the repeated question, be it one word, is an answer unless it is from the question too.
    """
    text = LEAD_IN.sub("", fold(answer))
    a, q = WORDS.findall(text), WORDS.findall(fold(question))
    if len(a) < 5 or len(q) < 4 or len(set(a) & set(q)) < 0.4 * len(set(q)):
        return False
    known = set(zip(q, q[1:]))
    rest = WORDS.findall(re.split(r"[?\n]|\b(?:tra loi|dap|answer)\s*:", text.rstrip("?!. \n\t\"”’'*_"))[-1])
    return _within(a, known) >= 0.75 and (not rest or len(rest) == len(a) or _within(rest, known) >= 0.6)


# Languages


def trigrams(text: str) -> Counter:
    words = " ".join(LETTERS.findall(text.lower()))
    padded = f" {words} "
    return Counter(map("".join, zip(padded, padded[1:], padded[2:]))) if words else Counter()


ONE_SCRIPT = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "IDEOGRAPHIC": "CJK"}  # Japanese mixes them


@cache
def _script(letter: str) -> str:
    """The script of a letter, by the first word of its Unicode name."""
    name = unicodedata.name(unicodedata.normalize("NFKC", letter)[0], "?").split()[0]
    return ONE_SCRIPT.get(name, name)


def scripts(text: str) -> Counter:
    """How many letters of the text are in each script."""
    found: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[_script(c)] += n
    return found


def _share(found: Counter, held: set[str]) -> float:
    return sum(n for s, n in found.items() if s in held) / max(1, found.total())


class Languages:
    """Character-trigram naive Bayes over labelled texts; without accents a Vietnamese text is Vietnamese."""

    def __init__(self, counts: dict[tuple[str, str], int], size: int):
        total = Counter()
        for (_, gram), n in counts.items():
            total[gram] += n
        self.index = {g: i for i, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size])}
        self.classes = sorted({c for c, _ in counts})
        table = np.zeros((len(self.classes), len(self.index) + 1))
        for (c, gram), n in counts.items():
            table[self.classes.index(c), self.index.get(gram, len(self.index))] += n
        # A fixed share for what a class has not seen, so that classes with fewer labelled texts gain nothing by it.
        seen = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
        self.logs = np.log(0.95 * seen + 0.05 / table.shape[1]).astype(np.float32)
        self.groups = [c.split("-")[0] for c in self.classes]
        letters: dict[str, Counter] = {}
        for (c, gram), n in counts.items():
            held = letters.setdefault(c.split("-")[0], Counter())
            for s, k in scripts(gram).items():
                held[s] += n * k
        #: The scripts each language is written in: those of a twentieth of its letters.
        self.scripts = {g: {s for s, n in held.items() if n >= 0.05 * held.total()} for g, held in letters.items()}

    def other_script(self, question: str, answer: str, asked: str) -> bool | None:
        """Whether most letters of the answer are in scripts that the question's language is not written in.

        None where both are in scripts that no labelled text has: likelihoods of trigrams say nothing then. A question
        outside of the scripts of ``asked`` stands for its own.
        """
        q, a, held = scripts(question), scripts(answer), self.scripts.get(asked, set())
        if _share(q, held) >= 0.5:
            return _share(a, held) < 0.5
        return True if _share(a, {s for s, n in q.items() if n >= 0.05 * q.total()}) < 0.5 else None

    def scores(self, text: str) -> dict[str, float]:
        """Log-likelihood of the text by language."""
        grams = trigrams(text)
        if not grams:
            return {}
        at = np.fromiter((self.index.get(g, len(self.index)) for g in grams), np.int64, len(grams))
        sums = self.logs[:, at] @ np.fromiter(grams.values(), np.float32, len(grams))
        best: dict[str, float] = {}
        for g, s in zip(self.groups, sums.tolist()):
            best[g] = max(best.get(g, -math.inf), s)
        return best


def train_languages(documents: DataFrame, *, per_language: int = 1000, grams: int = 30_000) -> Languages:
    """Fitted on at most ``per_language`` labelled documents of each language, the first by a hash of their id.

    Labels are trimmed and lower case, of two letters after ``vie`` = ``vi``; others and null are not used. What comes to
    the driver are the trigram counts of that bounded sample.
    """
    label = F.lower(F.trim("lang"))
    label = F.when(label == "vie", "vi").otherwise(label)
    rows = documents.select(label.alias("lang"), "text", F.xxhash64("doc_id").alias("h")).where("lang rlike '^[a-z]{2}$' and length(text) > 100")
    sample = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = canonical_text(text)
                for c, t in ((lang, text), *([(f"{lang}-plain", fold(text))] if lang == "vi" else [])):
                    for g, n in trigrams(t).items():
                        found[c, g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.string()), pa.array([g for _, g in found], pa.string()), pa.array(found.values(), pa.int64())],
                ["lang", "gram", "n"],
            )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Languages({(r.lang, r.gram): r.n for r in counted.collect()}, grams)


# Ends of texts


def visible(text: str) -> str:
    """Without finished reasoning blocks and invisible characters."""
    return canonical_text(THINK.sub(" ", text)).strip()


def _key(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - 2**63


def sentence_words(words: list[str]) -> list[str]:
    """The last words of a sentence, its start among them where they reach it."""
    return [START, *words][-MOST:]


def end_events(text: str) -> Iterator[tuple[list[str], bool]]:
    """(last words up to a place, whether a sentence ends there) over the text.

    Its own last place is an end if a full stop is there; otherwise it is left open, for that is what is asked.
    """
    body = CITATION.sub("", text)
    at = 0
    stopped = last_mark(text) == "stop"
    last = len(body.rstrip().rstrip(CLOSERS + ".!? "))
    for stop in [*(m.start() for m in SENTENCE_END.finditer(body)), len(body)]:
        words = WORDS.findall(body[at:stop].lower())
        ends = stop < last
        for i in range(len(words) if ends or stopped else len(words) - 1):
            yield sentence_words(words[: i + 1]), (ends or stopped) and i == len(words) - 1
        at = stop + 1


def end_counts(answers: DataFrame) -> DataFrame:
    """(key, n, ends) over every run of up to MOST words of all answers; counted in each task before the shuffle."""

    def rows(n: Counter, ends: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n.values(), pa.int64()), pa.array([ends[k] for k in n], pa.int64())], ["key", "n", "ends"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        ends: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words, end in end_events(visible(text)):
                    for k in range(1, len(words) + 1):
                        run = _key(words[-k:])
                        n[run] += 1
                        if end:
                            ends[run] += 1
            if len(n) > 500_000:  # what a task holds is bounded
                yield rows(n, ends)
                n, ends = Counter(), Counter()
        yield rows(n, ends)

    counted = answers.select("answer").where("answer is not null").mapInArrow(count, "key bigint, n bigint, ends bigint")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


#: What is believed of whole and of broken-off answers before any is read, in numbers of answers by the mark they end in.
WHOLE = {"stop": 20.0, "citation": 5.0, "bare": 0.05, "hanging": 0.02}
BROKEN = {"stop": 0.02, "citation": 0.2, "bare": 5.0, "hanging": 4.0}
USUAL_END = 0.05  # share of places in a text at which a sentence ends, before any text is read
OFTEN = 5  # times that words must have been seen to speak for themselves


def end_chance(n, ends):
    """How likely a sentence ends after words seen ``n`` times, ``ends`` times at the end of one."""
    return (ends + 2 * USUAL_END) / (n + 2)


def mark_weights(rows: list[tuple[str, float, int]], rounds: int = 30) -> dict[str, float]:
    """For each last mark the log odds that an answer with it is whole, before its words are looked at.

    ``rows``: (mark, log likelihood ratio of the last words, number of answers). Whether an answer is whole is not known;
    expectation and maximization in turn find how often whole and broken-off answers end in each mark.
    """

    def weights(whole: dict[str, float], broken: dict[str, float]) -> dict[str, float]:
        most, least = sum(whole.values()), sum(broken.values())
        return {m: math.log(whole[m] / most) - math.log(broken[m] / least) + math.log(most / least) for m in WHOLE}

    found = weights(WHOLE, BROKEN)
    for _ in range(rounds):
        whole, broken = dict(WHOLE), dict(BROKEN)
        for mark, words, n in rows:
            share = 1 / (1 + math.exp(-max(-500.0, min(500.0, found[mark] + words))))
            whole[mark] += n * share
            broken[mark] += n * (1 - share)
        found = weights(whole, broken)
    return found


def last_mark(text: str) -> str:
    """What an answer ends in: a full stop, a citation, a bare word or something that goes on."""
    cited = bool(re.search(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]\W*$", text))
    bare = CITATION.sub("", text).rstrip()
    inner = bare.rstrip(CLOSERS).rstrip()
    if LIST_MARK.search(bare):
        return "hanging"
    if inner.endswith((".", "!", "?")) and not inner.endswith(".."):
        return "stop"
    if not bare or (inner and inner[-1].isalnum()):
        return "citation" if cited else "bare"
    if inner and inner[-1] in ",;:([“‘«-–…/" or inner.endswith(".."):
        return "hanging"
    return "citation" if cited else "bare"


def list_breaks_off(text: str) -> bool:
    """Whether a list was announced with more items than came."""
    for m in ANNOUNCED.finditer(text):
        n = NUMBERS.get(m[1].lower()) or int(m[1])
        items = ITEM.findall(text, m.end())
        if items and len(items) < n:
            return True
    return False


def ending(text: str) -> list[int]:
    """Keys of the last one, two, ... words of an answer's last sentence."""
    bare = CITATION.sub(" ", text).rstrip().rstrip(CLOSERS + ".!?…:;,([“‘«-–/ ")
    words = sentence_words(WORDS.findall(SENTENCE_END.split(bare)[-1].lower()))
    return [_key(words[-k:]) for k in range(1, len(words) + 1)]


# Refusals


def decline_grams(text: str) -> set[str]:
    """Runs of one to three words of a text without citations, with its start and end."""
    words = ["<s>", *WORDS.findall(text.lower()), "</s>"]
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)} - {"<s>", "</s>"}


USUAL = 20.0
EFFECT = 3.0
#: Log odds for and against a refusal of a match with the list of known ways: as if it held four in five refusals and one in 250 answers.
KNOWN, UNKNOWN = math.log(0.8 / 0.004), math.log(0.2 / 0.996)


class Declining:
    """Naive Bayes of refusals: n-grams of what is said without gold against those of what is said with gold.

    Without gold a refusal is the right answer and with gold it is rare, so that what tells the two apart is the wording of
    refusals. Matching a well-known way of declining is one feature more, of a fixed weight.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], matches: tuple[int, int], sizes: tuple[int, int]):
        """(without gold, with gold): answers that hold each n-gram, that match a known way, and in all."""
        none, some = sizes
        likely = max(none, sum(matches))
        self.prior = math.log((likely + 1) / (none + some - likely + 6))
        share = (none + 1) / (none + some + 7)
        self.logs = {}
        for gram, (a, b) in counts.items():
            # What few answers hold says little: as if USUAL more held it, with and without gold as all answers are.
            self.logs[gram] = math.log((a + USUAL * share) / (none + 1)) - math.log((b + USUAL * (1 - share)) / (some + 6))

    def score(self, text: str) -> float:
        """Log odds that a text without reasoning and citations declines.

        The n-grams of a text overlap; together they weigh as much as EFFECT independent ones.
        """
        grams = decline_grams(text)
        mean = sum(self.logs.get(g, 0.0) for g in grams) / max(1, len(grams))
        return self.prior + (KNOWN if declines(text) else UNKNOWN) + EFFECT * mean


def train_declining(answers: DataFrame, *, per_class: int = 4000, least: int = 3) -> Declining:
    """Fitted on at most ``per_class`` answers with gold and as many without, the first by a hash of their place.

    N-grams that fewer than ``least`` of these answers hold are not used. What comes to the driver are the counts of that
    bounded sample.
    """
    rows = answers.select("has_gold", "answer", F.xxhash64("src", "line_no").alias("h")).where("answer is not null and has_gold is not null")
    sample = rows.withColumn("n", F.row_number().over(W.partitionBy("has_gold").orderBy("h"))).where(F.col("n") <= per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for gold, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = CITATION.sub(" ", visible(answer))
                if not WORDS.search(text):
                    continue
                for gram in (*decline_grams(text), "<all>", *(["<known>"] if declines(text) else [])):
                    found.setdefault(gram, [0, 0])[gold] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([n for _, n in found.values()], pa.int64())],
            ["gram", "without", "with"],
        )

    counted = sample.select("has_gold", "answer").mapInArrow(count, "gram string, without bigint, with bigint").groupBy("gram")
    held = counted.agg(F.sum("without").alias("a"), F.sum("with").alias("b")).where(f"a + b >= {least} or gram like '<%>'")
    counts = {r.gram: (r.a, r.b) for r in held.collect()}
    sizes, known = counts.pop("<all>", (0, 0)), counts.pop("<known>", (0, 0))
    return Declining(counts, known, sizes)


def defects(answers: DataFrame, languages: Languages, *, margin: float = 3.0, use_words: bool = True) -> DataFrame:
    """(src, line_no, defect): the answers that have a defect, each with the first that applies.

    ``answers``: (src, line_no, question, answer, has_gold). A null or absent answer is ``empty``. A refusal without
    gold is no defect of any kind. A null or empty question can neither be copied nor give a language. Repeated rows and
    rows that share (src, line_no) count each on their own; an empty table gives none. ``use_words`` false leaves the
    likelihood of the last words out, for comparison.
    """
    rows = cut(answers.select("src", "line_no", "question", "answer", "has_gold"))
    declining = train_declining(rows)
    schema = "src string, line_no bigint, defect string, mark string, keys array<bigint>"

    def judge(question: str | None, answer: str | None, has_gold: bool | None) -> tuple[str | None, str | None, list[int]]:
        text = visible(answer) if answer else ""
        bare = CITATION.sub(" ", text).replace("<think>", " ")
        if not WORDS.search(bare):
            return "empty", None, []
        if declining.score(bare) > 0:
            return ("refusal" if has_gold else None), None, []
        if question and copies(bare, question):
            return "copied", None, []
        if question:
            put = canonical_text(question)
            q, a = languages.scores(put), languages.scores(bare)
            if q and a:
                asked = max(q, key=q.get)
                best = max(a, key=a.get)
                other = languages.other_script(put, bare, asked)
                if other or (other is False and best != asked and a[best] - a[asked] > margin):
                    return "other_language", None, []
        if "<think>" in text or list_breaks_off(text):
            return "truncated", None, []
        return None, last_mark(text), ending(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(*x) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([d for d, _, _ in out], pa.string()),
                    pa.array([m for _, m, _ in out], pa.string()), pa.array([k for _, _, k in out], pa.list_(pa.int64())),
                ],
                ["src", "line_no", "defect", "mark", "keys"],
            )

    # A number for each row; stored, so that it stays the same.
    judged = cut(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    certain = judged.where("defect is not null").select("src", "line_no", "defect")
    # Likelihood of an end after the most of the last words that are often seen.
    asked = judged.where("mark is not null").select("row", "src", "line_no", "mark", F.posexplode_outer("keys").alias("k", "key"))
    wanted = asked.select("key").distinct()
    counts = end_counts(rows).join(wanted, "key")
    seen = asked.join(counts, "key", "left").groupBy("row", "src", "line_no", "mark").agg(
        F.array_sort(F.collect_set(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ends", F.lit(0)).alias("ends")))).alias("runs")
    )
    # An answer that ends in a full stop does not speak for itself.
    own = F.when(F.col("mark") == "stop", 1).otherwise(0)
    chance = F.aggregate("runs", F.lit(USUAL_END).cast("double"), lambda p, r: F.when(r["n"] - own >= OFTEN, end_chance(r["n"] - own, r["ends"] - own)).otherwise(p))
    odds = lambda p: F.log(p / (1 - F.least(p, F.lit(1 - 1e-9))))
    words = F.round(odds(chance) - math.log(USUAL_END / (1 - USUAL_END)), 1) if use_words else F.lit(0.0)
    ends = cut(seen.select("src", "line_no", "mark", words.alias("words")))
    # Four marks and some hundred values.
    weights = mark_weights([(r.mark, r.words, r.n) for r in ends.groupBy("mark", "words").agg(F.count("*").alias("n")).collect()])
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("mark")]
    return certain.union(ends.where(weight + F.col("words") < 0).select("src", "line_no", F.lit("truncated").alias("defect")))


def question_of(prompt: Column) -> Column:
    """The question after the last marker of a prompt; the whole prompt where there is none."""
    return F.substring_index(prompt, "CÂU HỎI: ", -1)


def answer_rows(generations: DataFrame, sft_raw: DataFrame) -> DataFrame:
    """(src, line_no, question, answer, has_gold) of the saved answers and the raw training pairs."""
    has_gold = F.coalesce(F.size("gold") > 0, F.lit(False))
    saved = generations.select(
        F.lit("generations").alias("src"), "line_no", question_of(F.col("context")).alias("question"), "answer", has_gold.alias("has_gold")
    )
    user = F.filter("prompt", lambda m: m["role"] == "user")
    reply = F.filter("completion", lambda m: m["role"] == "assistant")
    raw = sft_raw.select(
        F.lit("sft_raw"), "line_no", question_of(F.try_element_at(user, F.lit(-1))["content"]), F.try_element_at(reply, F.lit(-1))["content"], has_gold
    )
    return saved.union(raw)
