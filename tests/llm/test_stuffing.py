import random

import pytest
from tests.conftest import rows

from chronocue.llm.stuffing import measures, stuffed_pages, stuffed_share

r = random.Random(1)
KEYS = ["cheap video tool", "buy fans now", "best clip maker", "free music"]
NAMES = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]


def prose(n, seed):
    """Sentences of some 70 nouns, verbs and endings."""
    q = random.Random(seed)
    noun = lambda: f"the {q.choice(NAMES[300:340])}"
    verb = lambda: q.choice(NAMES[340:370]) + "s"
    end = ["before noon", "with great care", "after the break", "near a window", "as she said", "for an hour", "without a word", "in plain view"]
    return " ".join(f"{noun().capitalize()} {verb()} {noun()} {q.choice(end)} and {verb()} {noun()} {q.choice(end)}." for _ in range(n))


def keys(n, sep):
    q = random.Random(n)
    return sep.join(q.choice(KEYS) for _ in range(n))


LINKS = "\n".join(f"- https://{a}.example/{b}" for a, b in zip(NAMES[:60], NAMES[60:]))


@pytest.mark.parametrize(
    "page",
    [
        keys(120, " "), keys(120, ", "), keys(120, " | "), keys(60, "\n"), LINKS, "\n".join(f"watch {n} www.{n}.example" for n in NAMES[:50]), " ".join(f"#{n}" for n in NAMES[:80]),
        "; ".join(f"{n}-12 XL ${i}" for i, n in enumerate(NAMES[:60])), prose(2, 1) + "\n" + keys(100, " "), "\n".join(f"Get {k} and {k} here." for k in (r.choice(KEYS) for _ in range(60))),
    ],
)
def test_stuffed(page):
    assert stuffed_share(measures(page)) > 0.5


@pytest.mark.parametrize(
    "page",
    [
        prose(20, 2), prose(12, 3) + "\n" + "\n".join(LINKS.split("\n")[:6]), prose(10, 4) + "\n0:00 intro\n1:30 middle\n3:00 end\n#one #two #three", "\n".join(["The teacher opens the old table before noon with care."] * 12), " ".join(["we open the old table before noon with great care."] * 30),
        "\n".join(f"{s} https://a.example/{i}" for i, s in enumerate(prose(15, 5).split(". "))), "\n".join(prose(15, 6).split()), None, "", " \n​", "x",
    ],
)
def test_not_stuffed(page):
    assert stuffed_share(measures(page)) <= 0.5


@pytest.mark.parametrize(
    "page, found_by",
    [
        (" / ".join(f"{n.upper()}-12 XL ${i}" for i, n in enumerate(NAMES[:60])), "redundant"), ("; ".join(f"{n}-{i} black {i}₪" for i, n in enumerate(NAMES[:60])), "redundant"), (LINKS, "redundant"),
        (" ".join(f"#{n}" for n in NAMES[:80]), "redundant"), (prose(3, 8) + " " + ". ".join(f"our {r.choice(KEYS)} is {r.choice(KEYS)} for {r.choice(KEYS)}" for _ in range(60)), "redundant"),
        (" / ".join(f"{n.upper()}-12 XL ${i}" for i, n in enumerate(NAMES[:2])), "entries"), (" ".join(f"#{n}" for n in NAMES[:6]), "hashtags"), ("\n".join(LINKS.split("\n")[:5]), "links"),
    ],
)
def test_long_lists_are_found_by_compression_and_short_ones_by_shape(page, found_by):
    m = measures(page)
    assert m[found_by] > 0.5 * m["words"] and m["redundant"] + m["links"] + m["hashtags"] + m["entries"] <= m["words"]


def test_tables(spark):
    data = [(1, keys(120, " "), 1.0), (2, prose(9, 7), 1.0), (3, None, 1.0), (4, "", 1.0), (None, LINKS, 1.0), (1, keys(120, " "), 1.0), (9007199254740993, keys(30_000, " "), 1.0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, share double")
    assert rows(stuffed_pages(df).select("doc_id")) == sorted([(1,), (1,), (None,), (9007199254740993,)], key=repr)
    assert stuffed_pages(df.limit(0)).count() == 0


def test_a_sentence_with_a_pair_twice_that_a_recogniser_repeats():
    s = "Before we go on the editor trims the random forest on the slow laptop."
    assert stuffed_share(measures(prose(4, 9) + "\n" + " ".join([s] * 8))) <= 0.5
