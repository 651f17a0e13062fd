import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronocue.llm import encode as en

pytestmark = pytest.mark.skipif(not os.path.exists(en.VOCABULARY), reason="no vocabulary")

TEXT = st.lists(st.sampled_from(["a", "we", " ", "\n", "'", "'s", "'re", "'ve", "'ll", "'d", "'r", "r", "v", "l", "e", "!", "''", "1", "ש", "🙂", "  "]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def bpe():
    return en.Bpe(en.read_ranks())


@pytest.mark.parametrize("text", ["we're go", "we'll go", "we've go", "!'re", "'re", "a''re", "we'r", "we'r're"])
def test_a_cut_inside_a_contraction(bpe, text):
    for block in range(1, len(text)):
        assert bpe.encode(text, block) == bpe.enc.encode_ordinary(text)


def test_a_long_text_is_cut_inside_a_contraction(bpe):
    for end in ("'re", "'ve", "'ll"):
        text = "x " * ((1 << 15) - 2) + "we" + end + " go"
        assert text[: 1 << 16].endswith(end[:2])
        assert bpe.encode(text) == bpe.enc.encode_ordinary(text)


@settings(max_examples=3000, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_any_cut_of_contractions_gives_the_same_ids(bpe, text, block):
    assert bpe.encode(text, block) == bpe.enc.encode_ordinary(text)


def test_spread_texts(spark, bpe):
    texts = ["we're go we'll", "I'll we've " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for over in (3, 4, 5):
        assert {r.doc_id: r.ids for r in en.encoded(df, spread_over=over).collect()} == {i: bpe.enc.encode_ordinary(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("window, widest", [(1, 50), (2, 8), (5, 4)])
def test_windows_of_any_width(bpe, monkeypatch, window, widest):
    import random

    monkeypatch.setattr(en, "WINDOW", window)
    monkeypatch.setattr(en, "WIDEST", widest)
    r = random.Random(window)
    parts = ["a", "we", " ", "  ", "\n", "'", "'re", "'ve", "'ll", "r", "v", "l", "!", "''", "1", "23", "שלום", " שלום", "日本", "é", "🙂", "　", "...", " the", " cat", " 12", "x" * 30, "\x1c", "​"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 80)))
        assert bpe.encode(text, r.randint(1, 25)) == bpe.enc.encode_ordinary(text)


def test_every_place_of_a_block_end(bpe):
    for end in ("'re", "'ve", "'ll", "'s", "שלום'll", "  \n x", "日本語 1234", "🙂🙂"):
        for at in range(1, len(end) + 1):
            text = ("word " * en.BLOCK)[: en.BLOCK - at] + end + " go on " * 600
            assert bpe.encode(text) == bpe.enc.encode_ordinary(text)
    calls = []
    join = bpe.join
    bpe.join = lambda a, b: calls.append(1) or join(a, b)
    bpe.encode("some words " * 1000)
    del bpe.join
    assert len(calls) == -(-11_000 // en.BLOCK) - 1
