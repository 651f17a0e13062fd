"""Pages of repeated keywords, links, product entries and hashtags.

A page is cut into blocks of words, which are compressed: a block whose
compression ratio lies far under what text of its length and script needs is
redundant to a degree that prose isn't. Before that links become one sign,
hashtags another, and words with digits or currency signs the shape of their
letters and digits, so that a list of different links, tags or products is as
redundant as it looks. Redundancy is confirmed twice: by a low density of
sentence ends, without which only an extreme ratio counts, and on the words: most
of a stuffed line lies in pairs of words that its block repeats. As a
recogniser that repeats a spoken sentence writes redundant blocks too, a whole
sentence of five words or more that follows itself is taken out before and
counts as what its first copy counts as; so is one with another between, if no
pair of its words comes twice in it.

A page with few words has nothing to compress. What no redundant block holds
is therefore looked at by shape as well: lines that are a link with at most a
short caption, hashtags and priced entries.

Defined results: null, empty and wordless texts are never found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows, with_key
from .forms import form

LINK = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
HASHTAG = re.compile(r"#\w[\w\-]*")
PRICE = re.compile(r"[$€£₪¥₽]\s?\d|\d\s?(?:[$€£₪¥₽]|(?:USD|EUR|GBP|ILS|NIS|RUB|BRL)\b)", re.IGNORECASE)
_MARKS = r"\u0300-\u036f\u0591-\u05c7\u064b-\u065f'\u2019\-"
_WORD = re.compile(rf"[\w{_MARKS}]*\w[\w{_MARKS}]*")
_BULLET = re.compile(r"^\s*(?:[-*\u2022]|\d+[.)])\s+")
_ENDS = re.compile(r"(?<=[.?!؟…])\s+|(?<=[.?!؟…])$")
_TIME = re.compile(r"[\[(]?\d+:\d{2}(?::\d{2})?(?:\.\d+)?(?:\s*-\s*\d+:\d{2}(?:\.\d+)?)?[\])]?")
_CODE = re.compile(r"[\d$€£₪¥₽]")
_END = re.compile(r"[.?!؟…]")
_STARTS = frozenset("-*•0123456789")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
#: Signs that part entries which stand on one line.
_BETWEEN = re.compile(r"\s*[;|•·]\s+|\s+[/\\]\s+")
BLOCK_WORDS = 120
CAPTION_WORDS = 6
ENTRY_WORDS = 10
#: A block is redundant under this ratio to the expected one if few sentences end in it, and under the second if more do.
REDUNDANT, EXTREME = 0.75, 0.7
#: Few: one sentence end to so many words.
WORDS_AN_END = 25


def _words(s: str) -> list[str]:
    return _WORD.findall(s)


def _shown(t: str) -> tuple[str, ...]:
    if t[0] in "hw" and LINK.match(t):
        return ("\x01",)
    if t[0] == "#" and len(t) > 1:
        return ("#",)
    if _CODE.search(t):
        return (_DIGITS.sub("9", _LETTERS.sub("A", t)),) if _WORD.search(t) else ()
    return tuple(_words(t))


_KNOWN: dict[str, tuple[str, ...]] = {}


def shown(pieces: list[str]) -> list[str]:
    """The words of pieces between blanks, in small letters, as they are compressed: links and hashtags as a sign, codes and prices as their shape, others as they are."""
    found = [*map(_KNOWN.get, pieces)]
    if None in found:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        for i, f in enumerate(found):
            if f is None:
                found[i] = _shown(pieces[i])
                if len(pieces[i]) <= 40:
                    _KNOWN[pieces[i]] = found[i]
    return [*chain.from_iterable(found)]


def expected_ratio(size: int, wide: float) -> float:
    """Compression ratio of prose of ``size`` bytes, a share ``wide`` of whose characters takes two bytes.

    Short blocks compress worse, as everything in them is new; a script of
    two-byte letters starts from half, as each letter's first byte says little.
    """
    return (0.42 + 3.2 / max(size, 16) ** 0.5) * (1 - 0.33 * wide)


def redundancy(words: list[str]) -> float:
    """Compression ratio of a block over the ratio expected of prose."""
    s = " ".join(words)
    raw = s.encode()
    wide = (len(raw) - len(s)) / max(len(s), 1)
    return len(zlib.compress(raw, 6)) / len(raw) / expected_ratio(len(raw), min(1.0, wide))


def repeated_share(words: list[str], least: int = 3) -> list[bool]:
    """Of each word whether it lies in a pair of words that the block has at least ``least`` times."""
    pairs = Counter(zip(words, words[1:]))
    often = [pairs[p] >= least for p in zip(words, words[1:])]
    single = Counter(words)
    return [(i < len(often) and often[i]) or (i > 0 and often[i - 1]) or single[w] > max(least, len(words) // 4) for i, w in enumerate(words)]


def _shapes(line: str) -> tuple[int, int, int]:
    """Words of a line that are links with a short caption, hashtags and priced entries."""
    links, tags = LINK.findall(line), []
    rest = LINK.sub(" ", line) if links else line
    if "#" in rest:
        tags = HASHTAG.findall(rest)
        rest = HASHTAG.sub(" ", rest)
    n_links = len(links)
    if links:
        n = len(_words(rest))
        if n <= CAPTION_WORDS * len(links) and not re.search(r"[.?!؟]\s*$", rest.rstrip(" -*•")):
            return n_links + n, len(tags), 0
    entries = 0
    if PRICE.search(rest):
        entries = sum(len(w) for part in _BETWEEN.split(rest) if PRICE.search(part) and len(w := _words(part)) <= ENTRY_WORDS)
    return n_links, len(tags), entries


def measures(text: str | None, redundant_below: float = REDUNDANT, extreme_below: float = EXTREME, share: float = 0.6) -> dict[str, float]:
    """Counts of a page's words: words, redundant (those that compression finds), links, hashtags, entries (those that shapes add), and its density of sentence ends and least block ratio."""
    out = {"words": 0, "redundant": 0, "links": 0, "hashtags": 0, "entries": 0, "ends": 0.0, "ratio": 9.0}
    if not text:
        return out
    lines: list[str] = []  # those that may hold links, hashtags or entries
    units: list[list] = []  # words as compressed, copies, whether it ends a sentence, number of its line
    before: list[list[str]] = []  # the last two sentences as written
    for line in re.split(r"[\n\r\u2028\u2029]+", text):
        line = form(line).casefold()
        if line[:1] in _STARTS:
            line = _BULLET.sub("", line)
        if ":" in line:
            line = _TIME.sub(" ", line) if "://" not in line else " ".join(t if "://" in t else _TIME.sub(" ", t) for t in line.split())
        special = False
        for sentence in _ENDS.split(line) if _END.search(line) else [line]:
            raw = sentence.split()
            w = shown(raw)
            if not w:
                continue
            special = special or "\x01" in w or "#" in w or _CODE.search(sentence) is not None
            ended = sentence[-1] in ".?!؟…"
            out["words"] += len(w)
            out["ends"] += ended
            if len(w) >= 5 and raw in before:
                k = -1 if before[-1] == raw else -2 if len(set(zip(raw, raw[1:]))) == len(raw) - 1 else 0
                if k:
                    units[k][1] += 1
                    continue
            units.append([w, 1, ended, len(lines)])
            before = [*before[-1:], raw]
        lines.append(line if special else "")
    counted = [0] * len(lines)
    of_line = [0] * len(lines)
    for w, copies, _, n in units:
        of_line[n] += len(w) * copies
    for block in _blocks(units):
        words = [w for ws, _, _, _ in block for w in ws]
        r = redundancy(words)
        out["ratio"] = min(out["ratio"], r)
        few = sum(ended for _, _, ended, _ in block) * WORDS_AN_END <= len(words)
        if r >= (redundant_below if few else extreme_below):
            continue
        often = repeated_share(words)
        at = 0
        for ws, copies, _, n in block:
            hits = sum(often[at : at + len(ws)])
            at += len(ws)
            if hits >= (share - 0.1 if few else share) * len(ws):
                out["redundant"] += len(ws) * copies
                counted[n] += len(ws) * copies
    for line, found, whole in zip(lines, counted, of_line):
        if line and found < whole:
            links, tags, entries = _shapes(line)
            left = whole - found
            for name, n in (("links", links), ("hashtags", tags), ("entries", entries)):
                out[name] += min(n, left)
                left -= min(n, left)
    out["ends"] = out["ends"] / max(out["words"], 1)
    return out


def _blocks(units: list[list]) -> list[list[list]]:
    """Units in blocks of BLOCK_WORDS words or more; what is left at the end, if under half of that, goes to the block before."""
    out, block, size = [], [], 0
    for u in units:
        block.append(u)
        size += len(u[0])
        if size >= BLOCK_WORDS:
            out.append(block)
            block, size = [], 0
    if block:
        if out and size < BLOCK_WORDS // 2:
            out[-1] += block
        else:
            out.append(block)
    return out


def stuffed_share(m: dict[str, float]) -> float:
    return (m["redundant"] + m["links"] + m["hashtags"] + m["entries"]) / m["words"] if m["words"] else 0.0


def stuffed_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", more_than: float = 0.5) -> DataFrame:
    """Pages more than ``more_than`` of whose words are stuffing: key, share and the counts of ``measures``.

    One pass over the documents without a shuffle; repeated rows count each.
    """
    names = ["words", "redundant", "links", "hashtags", "entries", "ends", "ratio"]

    def start():
        def one(k, t):
            m = measures(t)
            share = stuffed_share(m)
            return [(k, share, *(float(m[n]) for n in names))] if share > more_than else []

        return one

    picked = documents.select(key, F.col(text).alias("__text")).where(F.length("__text") > 0)
    return map_rows(picked, start, with_key(documents, key, "share double", *[f"{n} double" for n in names]))
