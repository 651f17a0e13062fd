"""Test items whose passages stand in training documents.

Greedy string tiling by running Karp-Rabin: the rolling hashes of all runs of
``least`` words of a document are looked up among those of the items; where a
run of hits against an item begins and ends gives a maximal match, whose words
are compared; the longest match not yet marked becomes a tile, what marked
words leave of a shorter one goes back if it is long enough, until no match is
left or the item is covered. Order doesn't matter, so reordered passages count
with all their tiles.

Words are compared by look and without case; punctuation, spacing, markup and
time marks are no words. Words become numbers once a distinct piece of text
between blanks, and the runs of many documents are hashed together.

Defined results: null and empty texts hold and leak nothing, items of fewer
than ``least`` words are never found, repeated documents count each, repeated
items too.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import AT_A_TIME, with_key
from .forms import OWN, Prototypes, look, prototypes

LEAST = 12
#: Words of items that go to every task at once; more items are matched in blocks, one pass over the documents each.
BLOCK_WORDS = 2_000_000
#: Hits that are looked at together, which bounds memory where a run comes very often on both sides.
HITS_AT_A_TIME = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

_MARKUP = re.compile(
    r"</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]+|#\d+|#[xX][0-9a-fA-F]+);"  # tags and entities
    r"|[\[(]?(?<!\d)\d+:\d{2}(?::\d{2})?(?:[.,]\d+)?(?:\s*-+>?\s*\d+:\d{2}(?::\d{2})?(?:[.,]\d+)?)?[\])]?"  # time marks
)
#: What may open a tag, which may hold blanks.
_ANGLE = re.compile("[<\uff1c\ufe64]")
#: Characters that aren't seen but that str.split takes for blanks.
_UNSEEN_BLANKS = dict.fromkeys(range(0x1C, 0x20))
_MARKS = r"\u0300-\u036f\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7\u064b-\u065f"
_WORD = re.compile(rf"[^\W_](?:[^\W_]|[{_MARKS}])*")


def words_of(text: str | None, known: Prototypes = OWN) -> list[str]:
    return _WORD.findall(_MARKUP.sub(" ", look(text, known)).casefold()) if text else []


class Items:
    """Index of test items: word numbers, and of each run of ``least`` words its rolling hash with its places."""

    def __init__(self, items: list[tuple[object, str]], least: int = LEAST, known: Prototypes = OWN):
        self.least = least
        self.known = known
        self.numbers: dict[str, int] = {}
        self.ids: list[object] = []
        words: list[np.ndarray] = []
        for key, text in items:
            w = np.array([self.numbers.setdefault(x, len(self.numbers) + 1) for x in words_of(text, known)], np.int64)
            if len(w) >= least:
                self.ids.append(key)
                words.append(w)
        #: All items' words with a 0 between, and where each item begins.
        self.words = np.concatenate([np.append(w, 0) for w in words]) if words else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        h, good = self.hashes(self.words)
        at = np.flatnonzero(good)
        order = at[np.argsort(h[at], kind="stable")]
        self.places = order
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(order))
        self.pieces: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": {}}

    def hashes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin hashes of all runs of ``least`` numbers, modulo 2^64, and whether the run is without a 0."""
        n = len(w) - self.least + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        u = w.astype(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.least):
                h *= _BASE
                h += u[i : i + n]
        none = np.cumsum(np.append(0, w == 0))
        return h, none[self.least :] == none[:n]

    def numbered(self, text: str) -> list[int]:
        """Numbers of a text's words, 0 for a word of no item."""
        if _ANGLE.search(text):
            return [self.numbers.get(x, 0) for x in words_of(text, self.known)]
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            text = text.translate(_UNSEEN_BLANKS)
        pieces = text.split()
        found = [*map(self.pieces.get, pieces)]
        if None in found:
            found = [self._piece(p) if f is None else f for p, f in zip(pieces, found)]
        return [*chain.from_iterable(found)]

    def _piece(self, piece: str) -> tuple[int, ...]:
        out = tuple(self.numbers.get(x, 0) for x in words_of(piece, self.known))
        if len(piece) <= 40:
            if len(self.pieces) > 200_000:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of w where a run of an item may begin, and the number of its hash."""
        h, good = self.hashes(w)
        if not len(h) or not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(good)
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        same = self.hash[k] == h[at]
        return at[same], k[same]

    def matches(self, w: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Maximal matches of at least ``least`` words as rows (document place, place among the items' words, length), from the hits.

        A hit whose words before differ begins one, a hit whose words after
        differ ends one; on a diagonal they take turns.
        """
        counts = self.first[k + 1] - self.first[k]
        padded, items = np.concatenate(([-1], w, [-1])), np.concatenate(([-2], self.words, [-2]))
        begins, ends = [], []
        sums = np.cumsum(counts)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + HITS_AT_A_TIME)))
            n = counts[i:j]
            a = np.repeat(at[i:j], n)
            b = self.places[np.repeat(self.first[k[i:j]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
            # A word of no item, 0, is equal to nothing.
            begin = (padded[a] != items[b]) | (padded[a] == 0)
            end = (padded[a + self.least + 1] != items[b + self.least + 1]) | (padded[a + self.least + 1] == 0)
            begins.append(np.stack((b[begin] - a[begin], a[begin])))
            ends.append(np.stack((b[end] - a[end], a[end])))
            i = j
        start, stop = (np.concatenate(x, 1) for x in (begins, ends))
        start, stop = (x[:, np.lexsort((x[1], x[0]))] for x in (start, stop))
        if start.shape == stop.shape and (start[0] == stop[0]).all():
            out = np.stack((start[1], start[1] + start[0], stop[1] - start[1] + self.least), 1)
            if all((w[a : a + n] == self.words[b : b + n]).all() for a, b, n in out.tolist()):
                return out
        return self._compared(w, start)

    def _compared(self, w: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Matches where hashes collide: what counts are equal words."""
        rows = set()
        for shift, a in start.T.tolist():
            n = min(len(w) - a, len(self.words) - a - shift)
            differ = np.flatnonzero((w[a : a + n] != self.words[a + shift : a + shift + n]) | (w[a : a + n] == 0))
            n = int(differ[0]) if len(differ) else n
            if n >= self.least:
                rows.add((a, a + shift, n))
        return np.array(sorted(rows), np.int64).reshape(-1, 3)

    def tiles(self, words: list[str]) -> list[tuple[object, int, int, float]]:
        """(item id, tiles, longest tile, share of the item covered) of each item found."""
        w = np.array([self.numbers.get(x, 0) for x in words], np.int64)
        return self.tiled(w, *self.hits(w))

    def tiled(self, w: np.ndarray, at: np.ndarray, k: np.ndarray) -> list[tuple[object, int, int, float]]:
        if not len(at):
            return []
        found = self.matches(w, at, k)
        of = np.searchsorted(self.starts, found[:, 1], side="right") - 1
        out = []
        for n in np.unique(of).tolist():
            base, size = int(self.starts[n]), int(self.starts[n + 1] - self.starts[n] - 1)
            in_doc, in_item = np.zeros(len(w), bool), np.zeros(size, bool)
            heap = [(-m, a, b - base) for a, b, m in found[of == n].tolist()]
            heapq.heapify(heap)
            tiles = longest = left = 0
            left = size
            while heap and left >= self.least:
                m, a, b = heapq.heappop(heap)
                free = ~(in_doc[a : a - m] | in_item[b : b - m])
                if free.all():
                    in_doc[a : a - m] = in_item[b : b - m] = True
                    tiles += 1
                    longest = max(longest, -m)
                    left += m
                    continue
                edges = np.flatnonzero(np.diff(free.astype(np.int8), prepend=0, append=0)).tolist()
                for i, j in zip(edges[::2], edges[1::2]):
                    if j - i >= self.least:
                        heapq.heappush(heap, (i - j, a + i, b + i))
            out.append((self.ids[n], tiles, longest, float(in_item.mean())))
        return out

    def of_texts(self, texts: list[str | None]) -> Iterator[tuple[int, tuple[object, int, int, float]]]:
        """(number of the text, what ``tiles`` gives of it), the texts hashed together."""
        each = [self.numbered(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        starts = np.cumsum(np.append(0, sizes + 1))
        w = np.zeros(int(starts[-1]), np.int64)
        w[np.delete(np.arange(len(w)), starts[1:] - 1)] = np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum()))
        at, k = self.hits(w)
        of = np.searchsorted(starts, at, side="right") - 1
        for n in np.unique(of).tolist():
            own = of == n
            s = int(starts[n])
            for x in self.tiled(w[s : s + int(sizes[n])], at[own] - s, k[own]):
                yield n, x


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", least: int = LEAST, least_cover: float = 0.0) -> DataFrame:
    """Document and item pairs with their tiles: key, item, tiles, longest, coverage.

    Items are read to every task in blocks of at most BLOCK_WORDS words, so
    what is broadcast is bounded however many items there are; the documents
    are scanned once a block, without a shuffle. least_cover drops pairs with
    less of the item covered.
    """
    spark = documents.sparkSession
    known = prototypes(spark)
    picked = items.select(F.col(item).alias("k"), F.col(text).alias("t")).where("t is not null")
    size = picked.select(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_WORDS * 6)))
    schema = with_key(documents, key).add(item, items.schema[item].dataType).add("tiles", "integer").add("longest", "integer").add("coverage", "double")
    wanted = to_arrow_schema(schema)
    docs = documents.select(key, F.col(text).alias("__text")).where(F.length("__text") > 0)
    result = None
    for n in range(blocks):
        own = picked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == n) if blocks > 1 else picked
        shared = spark.sparkContext.broadcast(Items([(r["k"], r["t"]) for r in own.orderBy("k", "t").collect()], least, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for i in range(0, b.num_rows, AT_A_TIME):
                    part = b.slice(i, AT_A_TIME)
                    found = [(n, x) for n, x in index.of_texts(part.column(1).to_pylist()) if x[3] >= least_cover]
                    keys = part.column(0).take(pa.array([n for n, _ in found], pa.int64()))
                    columns = [pa.array([x[j] for _, x in found], wanted.field(j + 1).type) for j in range(4)]
                    yield pa.RecordBatch.from_arrays([keys.cast(wanted.field(0).type), *columns], schema=wanted)

        one = docs.mapInArrow(run, schema)
        result = one if result is None else result.unionByName(one)
    return result
