import pytest

from tessera.llm import answers as module
from tessera.llm.answers import CITATION, Languages, answer_rows, copies, declines, defects, last_mark, list_breaks_off, mark_weights, train_declining, train_languages, trigrams, visible

Q = "Trong trường hợp con dấu bị mất, việc gia hạn hợp đồng lưu kho của chủ tàu cá có cần đăng tải lô hàng sau 12 ngày không?"
DONE = "Chủ tàu cá phải gia hạn hợp đồng trong 12 ngày [1]. Mức thu là 5.000 đồng cho mỗi lô hàng [2]."


@pytest.mark.parametrize("text, want", [
    ("Xin lỗi, tôi không tìm thấy căn cứ cho nội dung được hỏi!", True), ("toi khong the dua ra cau tra loi [1]", True),
    ("Sau khi đọc các đoạn trên, câu hỏi này nằm ngoài phạm vi tôi có thể hỗ trợ", True), ("Sorry, no answer can be given here.", True),
    ("Désolé, je ne peux pas répondre à cette question.", True), ("Lo siento, no puedo responder.", True), ("Tut mir leid, das kann ich nicht beantworten.", True),
    ("Hiện chưa đủ thông tin để kết luận. Anh chị vui lòng hỏi đơn vị chuyên môn.", True), (DONE, False), ("Không [1].", False), ("", False),
    ("Kho vật chứng có quyền từ chối bảng kê nếu không tìm thấy căn cứ về kinh doanh; khi đó trạm được thu hồi lại trong 65 ngày.", False),
    ("Ngữ cảnh không nêu riêng bản cam kết, tuy nhiên bên thuê kho vẫn phải kê khai giấy xác nhận trong 70 ngày.", False),
    ("Tài liệu không nêu rõ vấn đề này.", True), ("Tôi không thể trả lời những câu hỏi này.", True), ("Các đoạn đã nêu không đủ thông tin để kết luận.", True),
    ("Tai lieu khong neu ro van de nay.", True), ("Toi khong the tra loi nhung cau hoi nay.", True), ("Cac doan da neu khong du thong tin de ket luan.", True),
    ("Tôi không có quyền trả lời về bác sĩ này.", True), ("Nếu không tìm thấy căn cứ, kho vật chứng trả lại hồ sơ.", False), ("Kho tra lai ho so neu khong tim thay can cu.", False),
    ("Tài liệu không nêu rõ mức thu, nhưng chủ tàu phải nộp phí.", False), ("Tai lieu khong neu ro muc thu, nhung chu tau phai nop phi.", False),
    ("The clerk cannot answer before 5 days if the figures do not match. The fee is 5 dong for each request of the kind.", False),
])
def test_declines(text, want):
    assert declines(CITATION.sub(" ", text)) is want


@pytest.mark.parametrize("answer, want", [
    (Q, True), ("Anh chị muốn biết " + Q, True), (Q + " " + Q, True), (Q.upper().replace("?", "!"), True), (Q.replace("lưu kho ", ""), True),
    ("Câu hỏi: " + Q + " Trả lời: Không.", False), (Q + "\n57 ngày.", False), (DONE, False), ("", False), ("Có.", False),
])
def test_copies(answer, want):
    assert copies(answer, Q) is want


def test_marks():
    got = [last_mark(t) for t in ("xong.", "xong [1]", "xong [1].", "(xong [1].)", "dở", "dở,", "dở…", "a [1]; b)", "dở (", "“xong.”", "còn:")]
    assert got == ["stop", "citation", "stop", "stop", "bare", "hanging", "hanging", "hanging", "hanging", "stop", "hanging"]
    assert list_breaks_off("Có ba trường hợp: a) một [1]; b) hai [2].") and not list_breaks_off("Có hai trường hợp: a) một; b) hai.")
    assert visible("<think>x</think> a​b") == "ab"


def test_first_defect_of_each_answer(spark):
    english = "The licensing office must check the storage contract within {} days if the figures do not match and no reply was received. "
    french = "Le bureau des licences doit vérifier le registre dans un délai de {} jours si les chiffres ne concordent pas. "
    viet = "Chủ tàu cá phải gia hạn hợp đồng lưu kho trong {} ngày khi con dấu bị mất và phải thông báo cho cơ quan cấp phép. "
    docs = [(i, lang, text.format(i) * 3) for lang, text in (("vi", viet), (" VI", viet), ("en", english), ("fr", french)) for i in range(20)] + [(99, None, "x" * 200), (98, "en", None)]
    languages = train_languages(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))
    answers = [
        (1, Q, None, True, "empty"), (2, Q, " ​\n", True, "empty"), (3, Q, "<think>nghĩ</think> [1] ...", True, "empty"),
        (4, Q, "Xin lỗi, tôi không thể trả lời.", True, "refusal"), (5, Q, "Xin lỗi, tôi không thể trả lời", False, None), (6, Q, "Sorry, I cannot answer this.", False, None),
        (7, Q, Q, True, "copied"), (8, Q, english.format(5), True, "other_language"), (9, Q, french.format(5), True, "other_language"),
        (10, Q, "Chu tau ca phai gia han hop dong luu kho trong 5 ngay [1].", True, None), (11, "How long does the office have to keep the records of the depot?", english.format(8), True, None),
        (12, english.format(7), DONE, True, "other_language"), (13, Q, DONE, True, None), (14, Q, DONE[:-1], True, None),
        (15, Q, DONE + " Đồng thời chủ tàu cá phải gia", True, "truncated"), (16, Q, "<think>Cần xem lại đoạn", True, "truncated"),
        (17, Q, "Có ba trường hợp: a) chủ tàu cá gia hạn hợp đồng [1]; b)", True, "truncated"), (18, Q, DONE[: DONE.index("[1]") + 3], True, None),
        (19, None, DONE, True, None), (20, "", english.format(1), True, None), (21, Q, "Có [1].", None, None),
    ]
    rows = [("s", n, q, a, g) for n, q, a, g, _ in answers] + [("s", 100 + i, Q, DONE + f" Chủ tàu cá phải gia hạn hợp đồng trong {i} ngày.", True) for i in range(30)]
    df = spark.createDataFrame(rows, "src string, line_no bigint, question string, answer string, has_gold boolean")
    got = {r.line_no: r.defect for r in defects(df, languages).collect()}
    assert got == {n: d for n, _, _, _, d in answers if d}
    assert defects(df.limit(0), languages).count() == 0


def test_other_scripts():
    texts = {"vi": Q + DONE, "en": "The licensing office must check the storage contract in time. "}
    languages = Languages({(c, g): n for c, t in texts.items() for g, n in trigrams(t).items()}, 1000)
    foreign = ["合同必须在十二天内续签，并通知发证机关。", "契約は十二日以内に更新しなければなりません。", "계약은 십이일 이내에 갱신해야 합니다.", "ต้องต่อสัญญาภายในสิบสองวัน", "يجب تجديد العقد خلال اثني عشر يوما.", "Договор нужно продлить в течение двенадцати дней."]
    for text in foreign:
        assert languages.other_script(Q, text + " [1]", "vi") and languages.other_script(text, DONE, "en")
        assert languages.other_script(text, text, "en") is None
    assert languages.other_script(Q, DONE, "vi") is False and languages.other_script(Q, DONE + " (合同)", "vi") is False
    assert languages.other_script(foreign[0], foreign[1], "en") is None and languages.other_script(foreign[0], foreign[5], "en")


def test_answers_in_other_scripts(spark):
    viet = "Chủ tàu cá phải gia hạn hợp đồng lưu kho trong {} ngày khi con dấu bị mất và phải thông báo cho cơ quan cấp phép. "
    english = "The licensing office must check the storage contract within {} days if the figures do not match. "
    docs = [(i, lang, text.format(i) * 3) for lang, text in (("vi", viet), ("en", english)) for i in range(20)]
    languages = train_languages(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))
    chinese, russian = "合同必须在十二天内续签，并通知发证机关。", "Договор нужно продлить в течение двенадцати дней [1]."
    rows = [("s", 1, Q, chinese, True), ("s", 2, Q, russian, True), ("s", 3, russian, "Да, это так и есть [1].", True), ("s", 4, Q, DONE, True)]
    got = defects(spark.createDataFrame(rows, "src string, line_no bigint, question string, answer string, has_gold boolean"), languages)
    assert {r.line_no: r.defect for r in got.collect()} == {1: "other_language", 2: "other_language"}


def test_rows_of_one_number_count_each(spark):
    docs = [(1, "vi", (Q + " " + DONE) * 3), (2, "en", "The licensing office must check the storage contract in time. " * 5)]
    languages = train_languages(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))
    broken = DONE + " Đồng thời chủ tàu cá phải gia"
    rows = [("s", 1, Q, broken, True)] * 2 + [("s", 2, Q, broken, True), ("s", 2, Q, DONE + " Chủ tàu cá phải gia hạn", True), ("s", 3, Q, DONE, True)]
    rows += [("s", 100 + i, Q, DONE + f" Chủ tàu cá phải gia hạn hợp đồng trong {i} ngày.", True) for i in range(30)]
    got = defects(spark.createDataFrame(rows, "src string, line_no bigint, question string, answer string, has_gold boolean"), languages)
    assert sorted((r.line_no, r.defect) for r in got.collect()) == [(1, "truncated")] * 2 + [(2, "truncated")] * 2


def test_languages_read_whole_texts(spark):
    docs = [(1, "en", "office " * 3000 + "zyzzyva " * 10), (2, "vi", "chủ tàu " * 30)]
    languages = train_languages(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))
    assert "zyz" in languages.index


def test_rows_of_both_tables(spark):
    gen = spark.createDataFrame([(1, [1], "NGỮ CẢNH:\nx\n\nCÂU HỎI: a CÂU HỎI: b", "c"), (2, None, None, None)], "line_no bigint, gold array<int>, context string, answer string")
    turn = "array<struct<role string, content string>>"
    raw = spark.createDataFrame([(3, [], [("system", "s"), ("user", "CÂU HỎI: q")], [("assistant", "r")]), (4, [1], None, None), (5, [1], [], [("assistant", None)])], f"line_no bigint, gold array<int>, prompt {turn}, completion {turn}")
    got = [tuple(r) for r in answer_rows(gen, raw).orderBy("line_no").collect()]
    assert got == [("generations", 1, "b", "c", True), ("generations", 2, None, None, False), ("sft_raw", 3, "q", "r", False), ("sft_raw", 4, None, None, True), ("sft_raw", 5, None, None, True)]


def _languages(spark):
    docs = [(1, "vi", (Q + " " + DONE) * 3), (2, "en", "The licensing office must check the storage contract in time. " * 5)]
    return train_languages(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))


def _judged(spark, rows):
    return spark.createDataFrame(rows, "src string, line_no bigint, question string, answer string, has_gold boolean")


def test_last_words_decide(spark):
    """The same marks at the end: a whole answer without a full stop, and answers that break off before a citation or full stop."""
    usual = [("s", 100 + i, Q, f"Chủ tàu cá phải gia hạn hợp đồng trong {i} ngày. Việc này do cơ quan cấp phép quyết định. Mức thu là {i} đồng.", True) for i in range(300)]
    usual += [("s", 1000 + i, Q, f"Mức thu là {i} đồng. Chủ tàu cá phải gia", True) for i in range(12)]
    rows = [
        ("s", 1, Q, DONE + " Việc này do cơ quan cấp phép quyết định", True), ("s", 2, Q, DONE + " Chủ tàu cá phải gia [1]", True),
        ("s", 3, Q, DONE + " Việc này do cơ quan cấp phép quyết định [1]", True),
    ]
    found = lambda **how: {r.line_no for r in defects(_judged(spark, rows + usual), _languages(spark), **how).collect() if r.line_no < 100}
    assert found() == {2}
    assert found(use_words=False) == {1}


def test_mark_weights():
    got = mark_weights([("stop", 3.0, 900), ("citation", 3.0, 200), ("bare", -4.0, 60), ("hanging", -3.0, 30)])
    assert got["stop"] > 3 and got["citation"] > 3 and got["bare"] < -3 and got["hanging"] < -3
    assert min(mark_weights([]).values()) < 0 < max(mark_weights([]).values())


def test_refusals_off_the_list_are_learnt(spark, monkeypatch):
    """Wordings that are held out of the list of known ways are found by what is said where there is no gold."""
    ways = ["Chúng tôi mạn phép dừng tại đây.", "Câu này xin nhường cho luật sư.", "Nội dung vượt quá tài liệu hiện có."]
    rows = [("s", i, Q, ways[i % 3], False) for i in range(90)] + [("s", 100 + i, Q, f"Mức thu là {i} đồng mỗi lô hàng. Chủ tàu cá phải gia hạn hợp đồng.", True) for i in range(400)]
    rows += [("s", 900 + i, Q, w, True) for i, w in enumerate(ways)]
    assert not any(map(declines, ways))
    got = {(r.line_no, r.defect) for r in defects(_judged(spark, rows), _languages(spark)).collect()}
    assert got == {(900 + i, "refusal") for i in range(3)}
    model = train_declining(_judged(spark, rows), per_class=50)
    assert all(model.score(w) > 0 for w in ways) and model.score("Mức thu là 5 đồng mỗi lô hàng.") < 0
    monkeypatch.setattr(module, "declines", lambda text: False)
    assert all(model.score(w) > 0 for w in ways)


def test_known_refusals_without_answers_without_gold(spark):
    rows = [("s", i, Q, f"Mức thu là {i} đồng mỗi lô hàng. Chủ tàu cá phải gia hạn hợp đồng.", True) for i in range(300)]
    rows += [("s", 900 + i, Q, "Xin lỗi, tôi không thể trả lời câu hỏi này.", True) for i in range(12)]
    assert {(r.line_no, r.defect) for r in defects(_judged(spark, rows), _languages(spark)).collect()} == {(900 + i, "refusal") for i in range(12)}
