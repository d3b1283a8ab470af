from tessera.llm.reading import count, formulas, is_vietnamese_prose, readable, reading_levels, sentences, syllable_weight, train

EASY = "Bạn nhớ mua cuốn vở nhé. Chị gái đã hỏi gian hàng. Ai giữ bộ áo ở xã? Hãy lấy thùng rác. "
HARD = (
    "Việc khước từ quyền truy đòi của quỹ hỗ trợ phục vụ xuất khẩu, dù được thể hiện bằng cột mốc sản xuất hay suy đoán từ thời hiệu khởi kiện, "
    "chỉ có hiệu lực đối kháng với ủy ban cấp xã nếu chế tài bổ sung đã được tiếp nhận theo khoản 8 Điều 94 và nhật ký ghi không đầy đủ. "
)


def test_syllables():
    assert [syllable_weight(w)[0] for w in ("nghieng", "quyen", "a", "window", "parliament")] == [1, 1, 1, 2, 3]
    assert syllable_weight("nghieng")[2] and not syllable_weight("strength")[2]
    assert syllable_weight("quyen")[1] > syllable_weight("la")[1]


def test_readable_undoes_layout():
    assert readable("<p>- Một</p>\n--- Trang 2 ---\n1. hai;\nba").split() == ["Một", "hai,", "ba"]
    assert readable("Việc này".encode().decode("latin-1")) == "Việc này"
    assert count(EASY.lower().replace(". ", ", ").replace("? ", ", ") * 4).sentence_length < 12


def test_what_is_vietnamese_prose():
    table = "Biểu thu\n" + "\n".join(f"dấu niêm phong\t{i}73\t461.000" for i in range(40))
    english = "Where the figures do not match, the ferry operator must withdraw the noise report within ten days. " * 4
    flat = "Viec khuoc tu quyen truy doi cua quy ho tro phuc vu xuat khau du duoc the hien bang cot moc san xuat hay suy doan tu thoi hieu. " * 2
    for text, want in ((EASY * 4, True), (HARD * 2, True), (HARD, True), (EASY, False), (table, False), (english, False), (flat, True), ("", False)):
        assert is_vietnamese_prose(count(text), text) is want, text[:40]


def test_formulas_grow_with_sentences_and_heavy_words():
    assert all(h > e for e, h in zip(formulas(count(EASY * 3)), formulas(count(HARD * 3))))
    light, heavy = count("Ai đi ra xa. Cô ấy về quê. " * 5), count("Người quyết đoán nghiêng xuống. Khuyến khích chuyên quyền. " * 5)
    assert light.heavy < heavy.heavy and light.weight < heavy.weight


def test_sentences():
    lines = "\n".join("- " + HARD.strip(". ") for _ in range(2))
    assert sentences(readable(lines)) == 2  # a list without full stops
    assert sentences(readable(HARD)) == 1  # one sentence of several clauses
    assert sentences((EASY * 4).replace(".", ",").replace("?", ",").lower()) == 16  # marks lost
    assert sentences((EASY * 9).replace(".", ",").replace("?", ",")) == 36
    assert sentences("") == 1 and sentences("Một. Hai! Ba?") == 3


def test_levels(spark):
    docs = [(i, (EASY if i % 2 else HARD) * (3 + i % 5), "zz") for i in range(60)] + [(100, None, "vi"), (101, "", "vi"), (102, EASY * 5, None), (103, HARD * 5, "en"), (103, HARD * 5, "en"), (None, HARD * 3, "vi")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, level int")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(40)] + [(0, 4), (50, None), (None, 3), (999, 2)], "doc_id bigint, level int")
    model = train(df, labels)
    got = {}
    for r in reading_levels(df, model).collect():
        got.setdefault(r.doc_id, []).append(r.level)
    assert set(got) == {*range(60), 102, 103, None} and len(got[103]) == 2
    assert all((levels[0] >= 4) == (i % 2 == 0) for i, levels in got.items() if i is not None and i < 60)
    assert got[102][0] < 4 <= got[103][0]
    assert len(train(df, labels, sample=5).cuts) == 6
    empty = train(df.limit(0), labels.limit(0))
    assert reading_levels(df.limit(0), empty).count() == 0


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "reading_labels"))
    fitted = train(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1 and level is not null").groupBy("doc_id").avg("level").toDF("doc_id", "truth")
    rows = reading_levels(docs, fitted).join(held, "doc_id").collect()
    assert sum((r.level >= 4) == (r.truth >= 3.5) for r in rows) >= 0.85 * len(rows) > 10
