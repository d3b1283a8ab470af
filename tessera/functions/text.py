"""Text columns: normalization, words, citations, prompts and answers. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompt layout and the fixed refusal: fixed values that saved prompts and answers are written in.
CONTEXT_MARK = "NGỮ CẢNH:\n"
QUESTION_MARK = "\n\nCÂU HỎI: "
REFUSAL = "Tôi không tìm thấy căn cứ pháp lý phù hợp trong các văn bản được cung cấp."
REFUSAL_SIGN = "không tìm thấy căn cứ"
SYSTEM = "Bạn trả lời câu hỏi pháp luật, chỉ dùng các đoạn được đánh số và ghi nguồn dạng [n]."

# Letters whose composed form may differ: marks, single letters with another composed form, jamo.
_MAYBE_OPEN = (
    r"[\p{M}\x{0340}-\x{0345}\x{0374}\x{037E}\x{0387}\x{0958}-\x{0FFF}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2000}\x{2001}"
    r"\x{2126}-\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}\x{1D100}-\x{1D1FF}\x{2F800}-\x{2FA1F}]"
)


def nfc(text: Column) -> Column:
    """Composed form; null stays null. Only text that may change is handed to the normalizer."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(_MAYBE_OPEN), composed).otherwise(text)


def normalize(text: Column) -> Column:
    """Composed form in lower case."""
    return F.lower(nfc(text))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of letters, numbers and underscores of the normalized text, in order; null as none."""
    return F.coalesce(F.regexp_extract_all(normalize(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))


def with_bigrams(tokens: Column) -> Column:
    """The tokens, followed by each two neighbours joined by an underscore."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))


def law_id(article_id: Column) -> Column:
    """What stands before the last plus sign; empty if there is none."""
    return F.regexp_extract(article_id, r"(?s)^(.*)\+", 1)


def citation(article_id: Column, title: Column) -> Column:
    """Article label and law: the title's head if it names an article, else the number in the id."""
    head = strip(F.substring_index(F.coalesce(title, F.lit("")), ".", 1))
    label = F.when(F.startswith(F.lower(head), F.lit("điều")), head).otherwise(F.concat(F.lit("Điều "), F.substring_index(article_id, "+", -1)))
    return F.concat(label, F.lit(", "), F.upper(law_id(article_id)))


def context_text(docs: Column) -> Column:
    """Numbered passages from an array of (citation, text)."""
    one = lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), d["citation"], F.lit(")\n"), strip(d["text"]))
    return F.array_join(F.transform(docs, one), "\n\n")


def user_message(question: Column, docs: Column) -> Column:
    """The user turn: passages, then the question."""
    return F.concat(F.lit(CONTEXT_MARK), context_text(docs), F.lit(QUESTION_MARK), strip(question))


def messages(question: Column, docs: Column) -> Column:
    """System and user turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(SYSTEM)), turn("user", user_message(question, docs)))


def message_question(message: Column) -> Column:
    """The question after the last mark; null if the text is no such message."""
    whole = F.startswith(message, F.lit(CONTEXT_MARK)) & F.contains(message, F.lit(QUESTION_MARK))
    return F.when(whole, strip(F.substring_index(message, QUESTION_MARK, -1)))


def message_passages(message: Column, n_docs: Column) -> Column:
    """The passages of a user turn without their header lines, in order; null if one of the n is not found.

    Passage i starts at the first ``[i] (`` after passage i - 1 started, at the beginning or after a blank line, so that
    bracketed numbers inside a passage do no harm.
    """
    body = F.concat(F.lit("\n\n"), F.regexp_extract(message, "(?s)^" + CONTEXT_MARK + "(.*)" + QUESTION_MARK, 1))
    mark = lambda i: F.concat(F.lit("\n\n["), i.cast("string"), F.lit("] ("))
    find = lambda found, i: F.concat(found, F.array(F.expr("0").cast("int") + F.call_function("locate", mark(i), body, F.element_at(found, -1) + 1)))
    starts = F.aggregate(F.when(n_docs > 0, F.sequence(F.lit(1), n_docs)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), find)
    found = F.slice(starts, 2, F.greatest(n_docs, F.lit(0)))
    ends = F.concat(F.slice(starts, 3, F.greatest(n_docs - 1, F.lit(0))), F.array(F.length(body) + 1))
    block = F.zip_with(found, ends, lambda a, b: F.substring(body, a + 2, b - a - 2))
    text = F.transform(block, lambda t: F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(""))
    whole = message_question(message).isNotNull() & F.forall(found, lambda at: at > 0)
    return F.when(whole & (n_docs > 0), text).when(whole, F.array().cast("array<string>"))


def clean_answer(answer: Column) -> Column:
    """Without finished reasoning blocks and outer white space."""
    return strip(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))


def cited(answer: Column) -> Column:
    """Distinct cited numbers in order of first use; a number too long to hold is null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), 1), lambda d: d.try_cast("int")))


def valid_citations(answer: Column, n_docs: Column) -> Column:
    return F.filter(cited(answer), lambda i: F.coalesce(i.between(1, n_docs), F.lit(False)))


def invalid_citations(answer: Column, n_docs: Column) -> Column:
    return F.filter(cited(answer), lambda i: ~F.coalesce(i.between(1, n_docs), F.lit(False)))


def is_refusal(answer: Column) -> Column:
    """Whether the answer holds the refusal's words."""
    return F.contains(F.lower(answer), F.lit(REFUSAL_SIGN))


def verdict(reply: Column) -> Column:
    """A judge's verdict: truth of ``faithful`` in the outermost braces; null without readable JSON or the key."""
    raw = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.faithful")
    return F.when(raw.isNotNull(), ~raw.isin("false", "0", "0.0", "", "null", "[]", "{}"))


def retry_delay(message: Column, default: float = 30.0) -> Column:
    """Seconds that an error message asks to wait; ``default`` if it names none."""
    found = F.regexp_extract(F.lower(message), r"retry in ([0-9]+(?:\.[0-9]+)?)\s*s", 1)
    return F.coalesce(found.try_cast("double"), F.lit(default))


def escape_html(text: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def answer_html(answer: Column, n_docs: Column) -> Column:
    """Escaped answer with anchors on citations of existing passages and line breaks. ``[01]`` cites passage 1."""
    marked = F.aggregate(
        F.when(n_docs > 0, F.sequence(F.lit(1), n_docs)).otherwise(F.array().cast("array<int>")),
        escape_html(answer),
        lambda t, i: F.regexp_replace(
            t, F.concat(F.lit(r"\[(0*"), i.cast("string"), F.lit(r")\]")),
            F.concat(F.lit('<a href="#source-'), i.cast("string"), F.lit('">[$1]</a>')),
        ),
    )
    return F.replace(marked, F.lit("\n"), F.lit("<br>"))


def source_preview(text: Column, most: int = 420) -> Column:
    """(title, body, preview, more) of a passage: the first line, the rest, its start, and whether something is left out."""
    whole = strip(text)
    title = F.substring_index(whole, "\n", 1)
    body = F.when(F.contains(whole, F.lit("\n")), strip(F.substring(whole, F.length(title) + 2, F.length(whole)))).otherwise(F.lit(""))
    more = F.length(body) > most
    preview = F.when(more, F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body)
    return F.struct(title.alias("title"), body.alias("body"), preview.alias("preview"), more.alias("more"))


def prefixed(text: Column, prefix: str) -> Column:
    """The text with what an encoder wants in front of it; null stays null."""
    return F.concat(F.lit(prefix), text)
