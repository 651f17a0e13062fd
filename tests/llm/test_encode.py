import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronocue.llm import encode as en

pytestmark = pytest.mark.skipif(not os.path.exists(en.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def bpe():
    return en.Bpe(en.read_ranks())


def test_as_the_public_tokenizer(bpe):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(en.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for s in ("Hello world", "<|endoftext|> x", "שלום  לכולם\n\n ", "a'll 12 　 !?", "🙂é\x1c", "x" * 5000):
        ids = t.encode(s, add_special_tokens=False).ids
        assert bpe.encode(s) == ids and bpe.encode(s, block=7) == ids
    assert bpe.encode("") == [] and bpe.encode(None) == []


TEXT = st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "ש", "日本", "é", "🙂", "　", "-", "...", "ab" * 20, " \n ", "\x1c", "​"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_any_cut_gives_the_same_ids(bpe, text, block):
    whole = bpe.enc.encode_ordinary(text)
    assert bpe.encode(text, block) == whole
    assert bpe.text_of(whole).decode() == text


def test_long_unsplit_texts(bpe, monkeypatch):
    monkeypatch.setattr(en, "LEAF_BYTES", 40)
    r = random.Random(1)
    for n in range(60):
        s = "".join(r.choice("abcdefghלםהשאτ日本x") for _ in range(3000))
        assert bpe.encode(s, 113) == bpe.enc.encode_ordinary(s)
    for s in ("x" * 20_000, " " * 5000 + "y", "\n" * 3000, "1" * 3000, "!" * 3000, "ab" * 4000 + " " * 999):
        assert bpe.encode(s, 100) == bpe.enc.encode_ordinary(s)


def test_documents(spark, bpe):
    long = "x" * 700 + " y " + "日本" * 400 + " end"
    data = [(1, "Hello world", 7), (2, None, 7), (3, "", 7), (4, long, 7), (4, long, 7), (None, "a", 7), (5, "b" * 1001, 7), (9007199254740993, "c", 7)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int")
    exp = sorted(((k, bpe.enc.encode_ordinary(t) if t else []) for k, t, _ in data), key=repr)
    for spread_over in (10**6, 100):
        assert sorted(((r.doc_id, r.ids) for r in en.encoded(df, spread_over=spread_over).collect()), key=repr) == exp
    assert en.encoded(df.limit(0)).count() == 0
