import unicodedata
from types import SimpleNamespace

import pytest
from hypothesis import given
from hypothesis import strategies as st
from py4j.protocol import Py4JError
from tests.conftest import rows

from chronocue.llm import forms
from chronocue.llm.forms import canonical_form, form, look, look_key, same_look_pairs


@pytest.mark.parametrize(
    "stored, same",
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ．", "full width."), ("a​b­c⁠﻿", "abc"), ("‫שלום‬", "שלום"), ("a b c\td\ne", "a b c d e"), ("  x 　", "x"),
        ("café", "café"), ("muѕіс", "music"), ("Ρасо", "Paco"), ("не́т", "не́т"), ("ﬁne", "fine"), ("ﻻ", "لا"), ("ضحک", "ضحك"), ("שׁלום", "שׁלום"),
        ("spk‑01", "spk-01"), ("Kelmo‏", "Kelmo"), ("...", "…"),
    ],
)
def test_looks_the_same(stored, same):
    assert look(stored) == look(same)


@pytest.mark.parametrize("a, b", [("Music", "music"), ("café", "cafe"), ("a.", "a"), ("a b", "ab"), ("a  b", "a b"), ("שָ", "ש"), ("x²", "x2"), ("ё", "е"), ("l", "I")])
def test_looks_different(a, b):
    assert look(a) != look(b)


def test_look_alikes_of_all_cased_scripts(spark):
    known = forms.prototypes(spark)
    for stored, same in [
        ("ԍ", "ɢ"), ("օne", "one"), ("ɡo", "go"), ("Ꭺpple", "Apple"), ("ıt", "it"), ("ѕԛυаге", "squaге"), ("π", "п"), ("Іt", "It"), ("Ⲟn", "On"), ("ⅴ", "v"), ("о́", "ó"), ("ϳοԁ", "jod"), ("ӧ", "ö"),
    ]:
        assert look(stored, known) == look(same, known), stored
    for a, b in [("l", "I"), ("Іt", "lt"), ("ס", "o"), ("ו", "l"), ("m", "rn"), ("0", "O"), ("ж", "x"), ("э", "e"), ("Ё", "E")]:
        assert look(a, known) != look(b, known), a
    texts = ["привет мир, ёлка", "Καλημέρα", "Ꭺɡо́ й", "ӧ́x", "שלום о"]
    for t in texts:
        assert look(t, known) == unicodedata.normalize("NFC", unicodedata.normalize("NFD", form(t)).translate(known.plain))
    assert set(forms.OWN.plain.items()) <= set(known.plain.items())


def test_without_the_unicode_library_there_is_no_result(spark, monkeypatch):
    def fails(_):
        raise Py4JError("gone")

    monkeypatch.setattr(forms, "_MADE", [])
    checker = lambda skeleton: SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=skeleton))
    for builder, error in [(spark._jvm.com.none.Builder, RuntimeError), (lambda: checker(fails), Py4JError), (lambda: checker(lambda s: s[:9]), RuntimeError)]:
        text = SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=builder))
        session = SimpleNamespace(_jvm=SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text)))))
        with pytest.raises(error):
            forms.prototypes(session)
    with pytest.raises(RuntimeError):
        forms.prototypes(SimpleNamespace())
    assert forms._MADE == [] and len(forms.prototypes(spark).plain) > len(forms.OWN.plain)


def test_the_form_is_of_one_script_of_all(spark):
    known = forms.prototypes(spark)
    for stored, same in [("օne way", "one way"), ("Ꭺpple", "Apple"), ("ɡo on", "go on"), ("ıt ıs", "it is"), ("ⲟn", "on"), ("ɡо́", "gó"), ("мир օ", "мир о"), ("muѕіс", "music")]:
        assert known.resolved(form(stored)) == same, stored
    for own in ("հայերեն լեզու", "ⲙⲉⲧⲣⲉⲙⲛⲭⲏⲙⲓ ⲡⲉ", "привет", "καλημέρα", "שלום", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "straße", "日本"):
        f = known.resolved(form(own))
        assert look(f, known) == look(own, known) and known.resolved(f) == f
    assert known.resolved(form("հայերեն լեզու")) == "հայերեն լեզու"


@given(st.text(max_size=40))
def test_resolving_keeps_the_look(s):
    known = forms._MADE[0] if forms._MADE else forms.OWN
    f = known.resolved(form(s))
    assert look(f, known) == look(s, known)


def test_the_form_is_of_one_script():
    assert form("muѕіс") == "music"
    assert form("пpивет мир") == "привет мир"
    assert form("имeннo тaк") == "именно так"
    assert form("сор по городу") == "сор по городу"  # a whole-script confusable in its own script's text
    assert form("the сор ran") == "the cop ran"
    assert form("בмodel") == "בмodel".replace("м", "м")  # nothing fits all letters of the run: left as it is
    assert form("Τamsin") == "Tamsin"
    assert form(None) is None and form("") == "" and form("​  ") == ""


@given(st.text(max_size=60))
def test_form_is_stable(s):
    assert form(form(s)) == form(s)
    assert look(form(s)) == look(s)
    assert unicodedata.is_normalized("NFC", look(s))


def test_a_very_long_text():
    s = "muѕіс ​ｘ " * 100_000
    assert look(s) == ("music x " * 100_000).strip()


LEFT = "row_id bigint, video_id bigint, chunk_num int, text string, line_id string"
RIGHT = "line_id bigint, video_id bigint, chunk_num int, text string, row_id string"


def test_pairs(spark):
    a = spark.createDataFrame([(1, 1, 1, "muѕic", "x"), (2, 1, 1, "muѕic", "x"), (3, 1, 2, "music", "x"), (4, None, 1, "music", "x"), (5, 1, None, "music", "x"), (6, 1, 1, None, "x"), (7, 1, 1, "​", "x"), (None, 1, 1, "music", "x")], LEFT)
    b = spark.createDataFrame([(10, 1, 1, "music", "x"), (11, 1, 1, "music ", "x"), (12, 1, 1, "Music", "x"), (13, None, 1, "muѕic", "x"), (14, 1, 1, "", "x"), (15, 1, 1, "muѕic", "x"), (16, 1, 1, None, "x")], RIGHT)
    got = rows(same_look_pairs(a, b, ["video_id", "chunk_num"], "row_id", "line_id"))
    assert got == sorted([(1, 10), (1, 11), (2, 10), (2, 11), (None, 11), (None, 15)], key=repr)


def test_pairs_are_as_nested_loops(spark):
    import random

    r = random.Random(4)
    texts = ["music", "muѕic", "ｍusic", "music ", "a b", "a b", "", "שלום", "שלום‏", None]
    a = [(i, r.choice([1, 1, 1, 2]), r.choice([1, 2]), r.choice(texts), "") for i in range(120)]
    b = [(i, r.choice([1, 1, 1, 2]), r.choice([1, 2]), r.choice(texts), "") for i in range(120)]
    exp = [(x[0], y[0]) for x in a for y in b if x[1:3] == y[1:3] and x[3] and y[3] and look(x[3]) and look(x[3]) == look(y[3]) and x[3] != y[3]]
    got = rows(same_look_pairs(spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT), ["video_id", "chunk_num"], "row_id", "line_id"))
    assert got == sorted(exp, key=repr)


def test_columns_and_empty_tables(spark):
    d = spark.createDataFrame([("muѕic",), (None,), ("",)], "t string")
    assert [(r.a, r.b) for r in d.select(canonical_form("t").alias("a"), look_key("t").alias("b")).collect()] == [("music", "music"), (None, None), ("", "")]
    assert same_look_pairs(spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT), ["video_id", "chunk_num"], "row_id", "line_id").count() == 0


def test_what_is_taken_as_it_is_folds_to_itself():
    for o in range(0x110000):
        if not 0xD800 <= o < 0xE000 and not forms._FOLDABLE.match(chr(o)):
            assert forms._fold(chr(o)) == chr(o), hex(o)
