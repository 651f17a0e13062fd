"""Encoding of texts with a public byte-level BPE vocabulary.

Tree concatenation: a text is cut into blocks wherever their length falls, the
blocks are encoded in parallel and joined pairwise up a tree. At a join a
window of tokens to either side is encoded again and grows until both sides
agree: until it begins and ends at places where the split pattern parts a text
whatever stands around them. Where a side has no such place near, the text is
split again from the left side's last pieces until a split of the right side
is met; a piece that spans the join grows its own window of tokens until its
outer tokens are those of both sides. A sequence of tokens is the encoding of
a piece exactly if each two neighbours are the encoding of theirs, so the
joined tokens are those of the undivided text. A text of one block is a tree
of one leaf.

Defined results: null and empty texts give an empty list; special tokens'
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's split pattern, with white space spelled out as Unicode has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|(?P<blank>[{_SPACE}]++)")

#: Between a letter or digit and a blank before another one there is always a split: no piece holds a blank after a letter, and one begins at that blank.
_SURE = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])")

#: Characters of a block.
BLOCK = 1 << 11
LEAF_BYTES = 1 << 14
#: Tokens at either side of a join in its first window, and in the last before the text is split again.
WINDOW, WIDEST = 12, 200
#: Blocks from which a text is worth threads of its own.
THREADED = 16
#: Characters from which a text is encoded by several tasks.
SPREAD = 1 << 20


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splits(text: str) -> Iterator[tuple[int, int]]:
    """Pieces of the split pattern, as a run of white space leaves its last character to what follows it, if that isn't white space."""
    at, n = 0, len(text)
    while at < n:
        m = _PIECE.match(text, at)
        end = m.end()
        if m.lastgroup == "blank" and end < n and end - at > 1:
            end -= 1
        yield at, end
        at = end


class Bpe:
    """Exact encoding, whole or in parts."""

    def __init__(self, ranks: dict[bytes, int], threads: int = 2):
        import tiktoken

        self.threads = threads
        self.pool: ThreadPoolExecutor | None = None
        self.ranks = ranks
        self.enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.enc._core_bpe.encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b

    def text_of(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of one piece from those of its two parts."""
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            w = self.piece(self.text_of(a[i:] + b[:j]))
            if (i == 0 or w[0] == a[i]) and (j == len(b) or w[-1] == b[j - 1]):
                return a[:i] + w + b[j:]
            k *= 2

    def long_piece(self, b: bytes) -> list[int]:
        """Encoding of one piece by halves."""
        if len(b) <= LEAF_BYTES:
            return self.piece(b)
        half = len(b) // 2
        return self.join_tokens(self.long_piece(b[:half]), self.long_piece(b[half:]))

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of both texts together."""
        if not a or not b:
            return a or b
        i = j = None
        k = WINDOW
        while k <= WIDEST and (i is None or j is None):
            if i is None:
                i = self._last_sure(a, k)
            if j is None:
                j = self._first_sure(b, k)
            k *= 4
        if i is None or j is None:
            return self._split_again(a, b)
        return a[:i] + self.enc.encode_ordinary(self.text_of(a[i:] + b[:j]).decode()) + b[j:]

    def _last_sure(self, a: list[int], k: int) -> int | None:
        """Where in a, within its last k tokens, the last sure split is; the whole of a text that short may be taken, from 0."""
        if k >= len(a):
            return 0
        tail = self.text_of(a[-k:])
        at = None
        for m in _SURE.finditer(tail.decode(errors="replace")):
            at = m.end()
        if at is None:
            return None
        # A character that is cut at the window's start stands as marks; what is behind the place is whole, so it is counted from the end.
        size = len(tail.decode(errors="replace")[at:].encode())
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[a[-n]])
        return len(a) - n

    def _first_sure(self, b: list[int], k: int) -> int | None:
        """Where in b, within its first k tokens, the first sure split is; the whole of a text that short may be taken."""
        if k >= len(b):
            return len(b)
        text = self.text_of(b[:k]).decode(errors="replace")
        m = _SURE.search(text)
        return self._tokens_for(b, len(text[: m.end()].encode())) if m else None

    def _open_end(self, a: list[int]) -> int:
        """How many tokens at the end of a text what follows may change: those of its last split piece, and of a quote before it that ``'r``, ``'v`` or ``'l`` may make a contraction."""
        k = WINDOW
        while (i := self._last_sure(a, k)) is None:
            k *= 4
        before, last = "", ""
        text = self.text_of(a[i:]).decode()
        for s, e in splits(text):
            before, last = last, text[s:e]
        size = len(last.encode()) + (1 if before == "'" and last in ("r", "v", "l") else 0)
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[a[-n]])
        return n

    def _split_again(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of both texts together, where no sure split is near: all splits before a's open end stand, and all after one that the joined text and b's own have in common."""
        n = self._open_end(a)
        kept, tail = a[: len(a) - n], a[len(a) - n :]
        before = self.text_of(tail).decode()
        k = 16
        while True:
            whole = k >= len(b)
            raw = self.text_of(b[:k])
            if not whole:
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    k += 1
                    continue
            new = raw.decode()
            own = {0: 0} | {e: e for _, e in splits(new)}
            done: list[tuple[int, int]] = []
            met = None
            for s, e in splits(before + new):
                if not whole and e >= len(before) + len(new) - 1:
                    break
                done.append((s, e))
                # A split of the right side that its own text decided counts only if the window shows its end.
                if e >= len(before) and e - len(before) in own and (whole or e - len(before) < len(new) - 1):
                    met = e - len(before)
                    break
            if met is None and not whole:
                k *= 4
                continue
            text = before + new
            used = self._tokens_for(b, len(new[:met].encode()))
            ids: list[int] = []
            for s, e in done:
                if len(done) == 1 and 0 < met <= len(new) and self._one_piece(new[:met]):
                    ids += self.join_tokens(tail, b[:used])
                elif s == 0 and e == len(before):
                    ids += tail
                else:
                    ids += self.long_piece(text[s:e].encode())
            return kept + ids + b[used:]

    def _tokens_for(self, ids: list[int], size: int) -> int:
        n = i = 0
        while n < size:
            n += len(self.bytes_of[ids[i]])
            i += 1
        return i

    def _one_piece(self, text: str) -> bool:
        first = next(splits(text), (0, 0))
        return first[1] == len(text)

    def encode(self, text: str | None, block: int = BLOCK) -> list[int]:
        if not text:
            return []
        if len(text) <= block:
            return self.enc.encode_ordinary(text)
        blocks = [text[i : i + block] for i in range(0, len(text), block)]
        if len(blocks) < THREADED:
            return self.tree([*map(self.enc.encode_ordinary, blocks)])
        if self.pool is None:
            self.pool = ThreadPoolExecutor(self.threads)  # the encoder runs outside the interpreter's lock
        return self.tree([*self.pool.map(self.enc.encode_ordinary, blocks)])

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Parts joined pairwise until one is left."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


_HERE: dict[int, Bpe] = {}


def _bpe(shared) -> Bpe:
    """One encoder per Python worker and vocabulary."""
    ranks = shared.value
    if id(ranks) not in _HERE:
        _HERE[id(ranks)] = Bpe(ranks)
    return _HERE[id(ranks)]


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.fromiter(accumulate(map(len, rows), initial=0), np.int32, len(rows) + 1)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, spread_over: int = SPREAD) -> DataFrame:
    """key and ids of every document.

    Blocks of a text are encoded in threads of its task, without a shuffle.
    Texts of more than ``spread_over`` characters are found in a scan of their
    own; their parts of that length are encoded in tasks of their own, which
    hand on ids, and joined in one task a text. Repeated keys are texts of
    their own.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = dict(documents.dtypes)[key]
    picked = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                c = b.slice(i, 2000)
                yield pa.RecordBatch.from_arrays([c.column(0), _lists([bpe.encode(t) for t in c.column(1).to_pylist()])], ["key", "ids"])

    whole = picked.where(F.col("text").isNull() | (F.length("text") <= spread_over)).mapInArrow(in_place, f"key {kind}, ids array<int>")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for b in batches:
            for i in range(b.num_rows):
                c = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(c.column(j) for j in range(3)), _lists([bpe.encode(c.column(3)[0].as_py())])], ["key", "row", "at", "ids"])

    parts = (
        picked.where(F.length("text") > spread_over).withColumn("row", F.monotonically_increasing_id())
        .select("key", "row", F.posexplode(F.expr(f"transform(sequence(0, cast((length(text) - 1) div {spread_over} as int)), i -> substring(text, i * {spread_over} + 1, {spread_over}))")).alias("at", "text"))
        .repartition("row", "at").mapInArrow(leaves, f"key {kind}, row bigint, at int, ids array<int>")
    )

    def joined(t: pa.Table) -> pa.Table:
        bpe = _bpe(shared)
        ids = t.column("ids").to_pylist()
        return pa.table({"key": t.column("key").slice(0, 1), "ids": _lists([bpe.tree([ids[i] for i in np.argsort(t.column("at").to_numpy())])])})

    cut = parts.groupBy("row").applyInArrow(joined, f"key {kind}, ids array<int>")
    return whole.unionByName(cut).select(F.col("key").alias(key), "ids")
