import random

from quillon.llm import language

TEXTS = {
    "en": "The sample was taken in the morning and the label should be checked twice before the next dose is given to the child",
    "de": "Die Probe wurde am Morgen genommen und das Etikett soll vor der nächsten Gabe noch einmal geprüft werden weil es wichtig ist",
    "fr": "Le prélèvement a été fait le matin et il faut vérifier deux fois la fiche avant de donner la dose suivante à l'enfant",
    "es": "La muestra se tomó por la mañana y la etiqueta debe comprobarse dos veces antes de dar la siguiente dosis al niño pequeño",
    "ru": "Проба была взята утром и этикетку нужно проверить дважды перед тем как ребёнок получит следующую дозу лекарства из шкафа",
    "uk": "Пробу було взято вранці й етикетку треба перевірити двічі перед тим як дитина отримає наступну дозу ліків із шафи поруч",
}


def sentence(r, code, n=12):
    return " ".join(r.choice(TEXTS[code].split()) for _ in range(n)).capitalize() + "."


def test_labels():
    f = language.named_language
    assert f("EN") == f("en-US") == f("en_GB") == f("eng") == f("English") == " en".strip() == "en"
    assert f("Deutsch") == f("deu") == "de" and f("українська") == f("UK") == "uk" and f("español") == "es"
    for bad in (None, "", "  ", "und", "n/a", "unknown", "xx", "12", "???"):
        assert f(bad) is None


def rows():
    r = random.Random(2)
    docs = []
    for i in range(240):
        code = list(TEXTS)[i % 6]
        text = "\n".join(" ".join(sentence(r, code) for _ in range(3)) for _ in range(3))
        label = code if i % 10 else list(TEXTS)[(i + 1) % 6]
        docs.append((i, label, text, "x"))
    mixed = " ".join([sentence(r, "de") for _ in range(6)] + [sentence(r, "ru") for _ in range(4)])
    extra = [(1000, "de", mixed, "x"), (1001, None, sentence(r, "fr", 40), "x"), (1002, "ru", sentence(r, "uk", 60), "x"), (1003, "en", None, None), (1004, "en", "12345 ... !!", None), (1005, "es", sentence(r, "es") * 3000, None)]
    return docs, extra


DOC = "doc_id long, lang string, text string, language string"
PACK = "id string, language string, title string, description string"


def test_accuracy_and_problems(spark, save):
    docs, extra = rows()
    save("catalog", [("p", "German", "Titel", TEXTS["de"]), ("q", "und", None, TEXTS["es"]), ("r", "fr", "Title", TEXTS["en"])], PACK)
    where = save("documents", docs + extra, DOC)
    model = language.fitted(spark, where)
    assert model.languages == sorted(TEXTS)
    got = {r["key"]: r for r in language.identified(language.document_rows(spark, where), model).collect()}
    right = sum(got[str(i)]["language"] == list(TEXTS)[i % 6] for i in range(240))
    assert right >= 236
    assert got["1000"]["language"] == "de" and got["1000"]["second"] == "ru" and 0.2 < got["1000"]["second_share"] < 0.6
    assert [s["language"] for s in got["1000"]["segments"]] == ["de", "ru"]
    assert got["1003"]["language"] == got["1004"]["language"] == "und"
    assert got["1005"]["language"] == "es"
    problems = {tuple(r) for r in language.found(spark, where).collect()}
    assert {("documents", "1000", "mixed"), ("documents", "1001", "missing"), ("documents", "1002", "wrong"), ("catalog", "q", "missing"), ("catalog", "r", "wrong")} <= problems
    wrong = {k for t, k, p in problems if t == "documents" and p == "wrong"}
    assert {str(i) for i in range(0, 240, 10)} <= wrong
    assert language.segments(spark, where).count() >= 2


def test_no_documents(spark, save):
    save("catalog", [("p", "de", "Titel", None)], PACK)
    where = save("documents", [], DOC)
    assert language.found(spark, where).count() == 0
