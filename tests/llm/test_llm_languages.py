import numpy as np
import pytest

from newsloom.llm.languages import NgramModel, document_languages, em_proportions, infer, read_label, segment_languages, segments, words

SCHEMA = "id string, title string, summary string, source_lang string, lang string, share double"
EN = ["The council approved the bridge contract after long talks.", "Officials said the roads near the harbour stayed closed on Monday.", "The ministry published a list of the missing ships this week."]
FR = ["Le conseil a approuvé le contrat du pont après de longs entretiens.", "Les routes près du port restaient fermées lundi soir.", "Le ministère a publié cette semaine une liste des navires disparus."]
RU = ["Совет одобрил договор о ремонте моста после долгих переговоров.", "Дороги возле порта в понедельник оставались закрытыми.", "Министерство на этой неделе опубликовало список пропавших судов."]


@pytest.mark.parametrize("label, want", [("en", {"en"}), ("en_GB", {"en"}), ("UK", {"uk"}), ("Persian", {"fa"}), ("zh-CN", {"zh"}), ("es-419", {"es"}), ("deu", {"de"}), ("und", set()), ("", set()), (None, set()), ("??", set()), ("xx", set()), ("en, fr", {"en", "fr"}), ("فارسی", {"fa"})])
def test_labels(label, want):
    assert read_label(label) == want


def test_segments():
    found = segments("Council approves bridge plan", "(Dovra) The council met today. It was cut off right h…")
    assert [(f, whole) for f, _, whole, _ in found] == [("title", True), ("summary", True), ("summary", False)]
    assert segments("(no title)", None) == [] and segments(None, "Yes.") == [] and segments("", "") == []
    assert words("Ab 迪帕图") == ["ab", "迪帕", "帕图"]


def test_em_and_penalty():
    scores = np.array([[0.0, -50.0], [-60.0, 0.0], [0.0, -40.0]])
    pi, post, _ = em_proportions(scores, np.ones(3))
    assert abs(pi[0] - 2 / 3) < 1e-6 and post.argmax(1).tolist() == [0, 1, 0]
    assert infer(scores, np.ones(3))[0] == [0, 1]
    assert infer(np.array([[0.0, -5.0], [-3.0, 0.0]]), np.ones(2))[0] == [0]  # a small gain is no second language


def corpus():
    rows = [(f"{lang}-{i}-{j}", t[j % 3], f"{t[i % 3]} {t[(i + 1) % 3]}", lang, "clash", 9.0) for lang, t in (("en", EN), ("fr", FR), ("ru", RU)) for i in range(3) for j in range(3)]
    return rows


def test_mixed_missing_and_wrong_labels(spark):
    rows = corpus() + [
        ("mixed", EN[0], f"{FR[1]} {EN[1]}", "en", "", 0.0),
        ("wrong", FR[0], FR[1], "ru", "", 0.0),
        ("missing", RU[0], None, None, "", 0.0),
        ("right", RU[0], RU[1], "Russian", "", 0.0),
        ("tag", EN[0], EN[1] + " (Le Monde)", "en", "", 0.0),
    ]
    got = {}
    for r in document_languages(spark.createDataFrame(rows, SCHEMA)).filter("not label_is_right").collect():
        got.setdefault(r.id, set()).add(r.lang)
    assert got == {"mixed": {"en", "fr"}, "wrong": {"fr"}, "missing": {"ru"}}


def test_held_out_accuracy():
    model = NgramModel.train({"en": [words(t) for t in EN[:2]], "fr": [words(t) for t in FR[:2]], "ru": [words(t) for t in RU[:2]]})
    best = model.score([words(EN[2]), words(FR[2]), words(RU[2])]).argmax(1)
    assert [model.languages[i] for i in best] == ["en", "fr", "ru"]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert document_languages(empty).count() == 0 and segment_languages(empty).count() == 0
    rows = corpus() + [("n", None, None, None, None, None), (None, EN[0], EN[1], "en", "", 0.0), ("e", "", "", "", "", 0.0), ("long", EN[0], " ".join(EN) * 2000, None, "", 0.0), ("long", EN[0], " ".join(EN) * 2000, None, "", 0.0)]
    got = [(r.id, r.lang) for r in document_languages(spark.createDataFrame(rows, SCHEMA)).filter("not label_is_right").collect()]
    assert got == [("long", "en")]
    seg = segment_languages(spark.createDataFrame(rows[:9], SCHEMA)).collect()
    assert all(0 < r.confidence <= 1 and 0 < r.share <= 1 for r in seg)
