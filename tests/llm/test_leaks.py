import random

import numpy as np
import pytest
from tests.conftest import rows

from chronocue.llm import leaks as lk
from chronocue.llm.leaks import Items, leaks, words_of

ITEM = "The quick brown fox jumps over the lazy dog while nine small birds sing in seven old trees"
DOC, IT = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string"


@pytest.mark.parametrize(
    "text",
    [
        ITEM, ITEM.upper(), "before " + ITEM + " after", "\n".join(f"**{w}**" for w in ITEM.split()), ITEM.replace(" ", "  "), ITEM.replace("fox", "fox <br/>\n>"), ITEM.replace("over", "[0:12.50 - 0:13.00] over"),
        ITEM.replace("o", "о"), ITEM.replace("quick", "qu​ick"), "\n> ".join(ITEM.split()), ITEM.replace("lazy", "ｌａｚｙ,"), " ".join(ITEM.split()[3:15]), ITEM.replace("nine", "<b>nine</b>&nbsp;"), "0:05 " + ITEM.replace("sing", "00:01:02 sing"),
    ],
)
def test_altered_passages_are_found(text):
    assert [x[0] for x in Items([(5, ITEM)]).tiles(words_of(text))] == [5]


@pytest.mark.parametrize("text", ["", None, " ".join(ITEM.split()[:11]), ITEM.replace("over", "above").replace("nine", "ten"), " ".join(ITEM.split()[::-1]), "x " * 5000])
def test_others_are_not(text):
    assert Items([(5, ITEM)]).tiles(words_of(text)) == []


def longest_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_longest_tile_is_the_longest_common_run():
    r = random.Random(1)
    for _ in range(150):
        item, doc = ([r.choice("abc") for _ in range(r.randint(4, 30))] for _ in range(2))
        found = Items([(1, " ".join(item))], 4).tiles(doc)
        best = longest_run(item, doc)
        assert (found[0][2] if found else 0) == (best if best >= 4 else 0)


def test_tiles_dont_overlap_and_order_is_free():
    w = [f"w{i}" for i in range(40)]
    moved = w[20:] + ["x"] + w[:20]
    assert Items([(1, " ".join(w))]).tiles(moved) == [(1, 2, 20, 1.0)]
    twice = w[:15] + ["x"] + w[:15]
    assert Items([(1, " ".join(w))]).tiles(twice) == [(1, 1, 15, 15 / 40)]


def test_numbers_are_those_of_the_words():
    index = Items([(5, ITEM)])
    for text in (ITEM, ITEM.replace("fox", "fo\x1dx"), "<b class='x y'>fox</b > fox", "＜b x＞fox", "&lt;fox&#x20;dog &nbsp;fox", "0:12.50 -> 0:13.00] fox\u2028dog\x85fox　dog\u2800fox", "fo\u200bx " * 3, "1234567:00 fox", "f" * 500 + " fox"):
        assert index.numbered(text) == [index.numbers.get(x, 0) for x in words_of(text)], text


def test_long_tags_are_markup():
    tag = "<a href='" + "x y " * 300 + "'>"
    assert Items([(5, ITEM)]).tiles(words_of(ITEM.replace("fox", "fox " + tag))) == [(5, 1, 18, 1.0)]
    assert len(list(Items([(5, ITEM)]).of_texts([None, ITEM.replace("fox", "fox " + tag), ""]))) == 1


def test_a_word_repeated_on_both_sides(monkeypatch):
    import time

    index = Items([(5, "spam " * 200), (6, ITEM)])
    started = time.process_time()
    assert list(index.of_texts(["spam " * 100_000, "no", "spam " * 11, "spam " * 40 + ITEM])) == [(0, (5, 1, 200, 1.0)), (3, (5, 1, 40, 0.2)), (3, (6, 1, 18, 1.0))]
    assert time.process_time() - started < 20
    monkeypatch.setattr(lk, "HITS_AT_A_TIME", 7)
    assert list(index.of_texts(["spam " * 300])) == [(0, (5, 1, 200, 1.0))]


def test_hashes_that_collide(monkeypatch):
    whole = Items([(1, ITEM), (2, "spam " * 30)])
    monkeypatch.setattr(Items, "hashes", lambda self, w: ((np.zeros(max(0, len(w) - 11), np.uint64)), np.ones(max(0, len(w) - 11), bool)))
    flat = Items([(1, ITEM), (2, "spam " * 30)])
    text = "spam " * 15 + "x " + ITEM + " " + " ".join(ITEM.split()[2:16])
    monkeypatch.undo()
    w = np.array(whole.numbered(text), np.int64)
    at = np.repeat(np.arange(len(w) - 11), 1)
    assert flat.tiled(w, at, np.zeros(len(at), np.int64)) == whole.tiled(w, *whole.hits(w))


def test_reordered_passages_are_found_by_coverage(spark):
    w = ITEM.split()
    moved = " ".join([*w[12:18], "and", *w[:6], "or", *w[6:12]])
    d, i = spark.createDataFrame([(1, moved, "x"), (2, " ".join(w[:7]), "x"), (3, ITEM, "x")], DOC), spark.createDataFrame([(5, ITEM, "y")], IT)
    assert rows(leaks(d, i, least=6, least_cover=0.4).select("doc_id", "tiles", "longest", "coverage")) == [(1, 3, 6, 1.0), (3, 1, 18, 1.0)]
    assert rows(leaks(d, i).select("doc_id")) == [(3,)]


def test_tables(spark):
    docs = [(1, "a " + ITEM, "x"), (2, ITEM[:20], "x"), (3, None, "x"), (4, "", "x"), (None, ITEM, "x"), (1, "a " + ITEM, "x"), (9007199254740993, ITEM + " filler" * 100_000, "x")]
    items = [(5, ITEM, "y"), (6, None, "y"), (7, "too short", "y"), (8, ITEM, "y")]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, IT)
    exp = sorted([(k, n) for k in (1, 1, None, 9007199254740993) for n in (5, 8)], key=repr)
    assert rows(leaks(d, i).select("doc_id", "item_id")) == exp
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
    assert leaks(d, i, least_cover=1.1).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    d, i = spark.createDataFrame([(1, ITEM, "x")], DOC), spark.createDataFrame([(n, ITEM, "y") for n in range(9)], IT)
    monkeypatch.setattr(lk, "BLOCK_WORDS", 40)
    assert sorted(r.item_id for r in leaks(d, i).collect()) == list(range(9))
