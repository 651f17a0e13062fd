import random

import pytest
from tests.conftest import rows

from chronocue.llm.language import fit, labelled_sample, languages, named_language
from chronocue.llm.queries import cases

# Short sentences made of invented phrases, so that held-out ones share words but not wording.
PARTS = {
    "en": (["the teacher", "our group", "she", "nobody", "the machine"], ["cleans", "shows", "opens", "measures", "describes"], ["the old table", "a small picture", "every second line", "the lesson"], ["before the break", "with great care", "because it was late", "without a word"]),
    "es": (["la maestra", "nuestro grupo", "ella", "nadie", "la máquina"], ["limpia", "muestra", "abre", "mide", "describe"], ["la tabla vieja", "una imagen pequeña", "cada segunda línea", "la lección"], ["antes del descanso", "con mucho cuidado", "porque era tarde", "sin decir nada"]),
    "pt": (["a professora", "nosso grupo", "ela", "ninguém", "a máquina"], ["limpa", "mostra", "abre", "mede", "descreve"], ["a tabela velha", "uma imagem pequena", "cada segunda linha", "a lição"], ["antes do intervalo", "com muito cuidado", "porque era tarde demais", "sem dizer nada"]),
    "he": (["המורה", "הקבוצה שלנו", "היא", "אף אחד", "המכונה"], ["מנקה", "מראה", "פותחת", "מודדת", "מתארת"], ["את הטבלה הישנה", "תמונה קטנה", "כל שורה שנייה", "את השיעור"], ["לפני ההפסקה", "בזהירות רבה", "כי היה מאוחר", "בלי לומר מילה"]),
    "ru": (["учительница", "наша группа", "она", "никто", "машина"], ["чистит", "показывает", "открывает", "измеряет", "описывает"], ["старую таблицу", "маленькую картину", "каждую вторую строку", "урок"], ["перед перерывом", "очень осторожно", "потому что было поздно", "без единого слова"]),
}


def sentence(r, code):
    return " ".join(r.choice(p) for p in PARTS[code])


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    sample = []
    for code in PARTS:
        for i in range(60):
            true = code if i % 8 else r.choice(list(PARTS))  # some labels are wrong
            sample.append((code, ". ".join(sentence(r, true) for _ in range(5)) + "."))
    return fit(sample)


def test_held_out_accuracy(model):
    r = random.Random(2)
    right = n = 0
    for _ in range(400):
        code = r.choice(list(PARTS))
        right += [x[0] for x in model.languages_of(sentence(r, code).split())] == [code]
        n += 1
    assert right / n > 0.98


def test_mixed_texts_and_borrowed_words(model):
    r = random.Random(3)
    right = 0
    for _ in range(200):
        a, b = r.sample(list(PARTS), 2)
        words = f"{sentence(r, a)} {sentence(r, a)} {sentence(r, b)} {sentence(r, b)}".split()
        right += {x[0] for x in model.languages_of(words)} == {a, b}
    assert right / 200 > 0.95
    for _ in range(50):
        words = sentence(r, "he").split() + ["random", "forest"] + sentence(r, "he").split()
        assert [x[0] for x in model.languages_of(words)] == ["he"]


def test_far_texts_are_rejected(model):
    assert model.languages_of("qqq xzx wkw jjj vvv".split()) == []
    assert model.languages_of([]) == []
    got = model.languages_of("the teacher shows the lesson".split())
    assert got[0][0] == "en" and 0 < got[0][1] <= 1 and got[0][2] == 5


@pytest.mark.parametrize("label, code", [("he", "he"), ("iw", "he"), ("HE", "he"), ("he-IL", "he"), ("heb", "he"), ("Hebrew", "he"), ("en_US", "en"), ("pt-BR", "pt"), ("Português", "pt"), ("German (DE)", "de"), ("xx", None), ("und", None), ("auto", None), ("N/A", None), ("", None), (None, None), ("unknown", None), ("ｅｎ", "en")])
def test_labels(label, code):
    assert named_language(label) == code


def test_rows_and_cases(spark, model):
    en, es = "the teacher shows the lesson before the break", "nuestro grupo mide la tabla vieja con mucho cuidado"
    data = [(1, en, "en", "x"), (2, en, "he", "x"), (3, en, None, "x"), (4, f"{en} {es}", "en", "x"), (5, "short text", "he", "x"), (6, None, "en", "x"), (7, "", "en", "x"), (8, "[0:01] [music] um", "en", "x"), (None, en, "xx", "x"), (9007199254740993, en, "xx", "x"), (2, en, "he", "x")]
    df = spark.createDataFrame(data, "row_id bigint, text string, primary_language string, lang string")
    found = languages(df, model, "row_id", label="primary_language")
    got = rows(cases(found, "row_id").select("row_id", "lang"))
    assert got == sorted([(2, "en"), (2, "en"), (3, "en"), (4, "en"), (4, "es"), (None, "en"), (9007199254740993, "en")], key=repr)
    assert languages(df.limit(0), model, "row_id").count() == 0


def test_a_very_long_text(spark, model):
    df = spark.createDataFrame([(1, "the teacher shows the lesson " * 20_000)], "row_id bigint, text string")
    assert languages(df, model, "row_id").first().lang == "en"


def test_the_sample_is_bounded(spark):
    docs = [(i, "x" * 50, "en" if i % 2 else "HE-il") for i in range(400)] + [(1000, None, "en"), (1001, "y" * 50, None), (1002, "z" * 50, "xx")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    s = labelled_sample(df, 30)
    assert len(s) == 60 and {c for c, _ in s} == {"en", "he"} and s == labelled_sample(df.repartition(5), 30)
    with pytest.raises(ValueError):
        fit([])


def test_the_sample_is_the_same_however_rows_lie(spark):
    r = random.Random(3)
    data = [(i, r.choice(["", None, f"text {i} " * 12, f"other {i} " * 12, "long " * 9000]), r.choice(["en", "EN-us", "Hebrew", "he", "xx", None, ""]), "clash") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, __key string")
    a = labelled_sample(df.repartition(7), per_language=20)
    assert a == labelled_sample(df.coalesce(1), per_language=20)
    assert {c: sum(x[0] == c for x in a) for c in ("en", "he")} == {"en": 20, "he": 20} and all(40 < len(t) <= 32_000 for _, t in a)
    assert set(labelled_sample(df, per_language=20)) <= set(labelled_sample(df, per_language=5000))
    assert labelled_sample(df.limit(0)) == [] and labelled_sample(df.where("lang = 'xx'")) == []
