"""Language of a text and of the stretches of a mixed one.

Nearest-centroid classification: words become TF-IDF vectors of character
n-grams, several centroids per language come from spherical k-means over
labelled stretches, and a stretch gets the language of the centroid with the
greatest cosine, or none if even that is too far (distance-based rejection).
As a stretch's vector is the sum of its words' vectors, a word's dot products
with the centroids are all that is needed; a shortest path over the words with
a price for each change of language finds the stretches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_rows, with_key
from .forms import form
from .speech import Labels, pieces, words_of

# Codes and names by which labels call a language (ISO 639, English and own names).
LANGUAGE_NAMES = {
    "he": "he iw heb hebrew עברית ivrit",
    "en": "en eng english",
    "ar": "ar ara arabic العربية عربي",
    "ru": "ru rus russian русский",
    "es": "es spa spanish castilian español castellano",
    "fr": "fr fra fre french français",
    "de": "de deu ger german deutsch",
    "pt": "pt por portuguese português",
}
# End of the fixed values.

_BY_NAME = {n: code for code, names in LANGUAGE_NAMES.items() for n in names.split()}
MIN_WORDS = 5
_LETTER = re.compile(r"[^\W\d_]")


def named_language(label: str | None) -> str | None:
    """The language that a label names by a usual code or name, with region or script or without; None if none of LANGUAGE_NAMES."""
    if not label:
        return None
    parts = re.findall(r"[^\W_]+", form(label).casefold())
    return _BY_NAME.get(parts[0]) if parts else None


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its ends marked, and the word itself."""
    w = f"^{word.casefold()}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [w, w]


@dataclass
class LanguageModel:
    """Weights of the n-grams and the centroids; ``languages[k]`` is the language of centroid k."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    reject_below: float = 0.12
    change_cost: float = 1.0
    settle: float = 0.2
    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        # Centroids of a language stand together, so maxima over them are one reduction.
        order = sorted(range(len(self.languages)), key=lambda k: self.languages[k])
        self.languages = [self.languages[k] for k in order]
        self.centroids = self.centroids[:, order]
        self.codes = sorted(set(self.languages))
        self.heads = np.array([self.languages.index(c) for c in self.codes])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def of_word(self, word: str) -> tuple[np.ndarray, int, tuple[float, ...], np.ndarray, np.ndarray, float]:
        """Of a word its vector's dot products with all centroids, the language nearest to it, the share that each language's cosine has of the nearest's, the vector's columns and values, and its length."""
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > 100_000:
                self.known.clear()
            n = Counter(i for g in grams(word) if (i := self.vocabulary.get(g)) is not None)
            col = np.fromiter(n.keys(), int, len(n))
            val = np.fromiter(n.values(), float, len(n)) * self.idf[col]
            dots = val @ self.centroids[col] if len(col) else np.zeros(len(self.languages))
            best = np.maximum.reduceat(dots, self.heads)
            top = float(best.max())
            # A word of no known n-gram says nothing.
            shares = tuple((best / top).tolist()) if top > 0 else (0.5,) * len(self.codes)
            hit = self.known[word] = dots, int(best.argmax()), shares, col, val, math.sqrt(val @ val)
        return hit

    def dots(self, words: list[str]) -> np.ndarray:
        """Of a stretch's vector the greatest dot product with the centroids of each language."""
        return np.maximum.reduceat(np.add.reduce([self.of_word(w)[0] for w in words]), self.heads)

    def length(self, words: list[str]) -> float:
        each = [self.of_word(w) for w in words]
        total = np.bincount(np.concatenate([x[3] for x in each]), np.concatenate([x[4] for x in each]))
        return math.sqrt(total @ total)

    def nearest(self, words: list[str]) -> tuple[str | None, float]:
        """Language of the nearest centroid, None where it is too far, and the lead over the nearest centroid of any other, as a share of the cosine."""
        c = self.dots(words)
        k = int(c.argmax())
        top = float(c[k])
        if top <= 0:
            return None, 0.0
        # No value is negative, so a sum's length lies between that of its parts square to each other and that of all together.
        lengths = [self.of_word(w)[5] for w in words]
        least = top / self.reject_below
        if least < sum(lengths) and (least < math.sqrt(sum(x * x for x in lengths)) or least < self.length(words)):
            return None, 0.0
        c[k] = 0.0
        return self.codes[k], float((top - c.max()) / top)

    def _settled(self, words: list[str], code: str | None, lead: float, others: set[str]) -> tuple[str | None, float]:
        """A stretch's language, or another one of its text if that is as near but for ``settle``: related languages share words."""
        if code is None:
            return code, lead
        c = self.dots(words)
        own = c[self.codes.index(code)]
        best = max(sorted(others), key=lambda x: c[self.codes.index(x)])
        return (best, 0.0) if (own - c[self.codes.index(best)]) / own < self.settle else (code, lead)

    def stretches(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(from, to, language) of the stretches of a text, without rejection."""
        each = [self.of_word(w) for w in words]
        if len({x[1] for x in each}) == 1:
            return [(0, len(words), self.codes[each[0][1]])]
        cost = self.change_cost * 2
        languages = range(len(self.codes))
        total = list(each[0][2])
        back: list[list[int]] = []
        for x in each[1:]:
            shares = x[2]
            k = max(languages, key=total.__getitem__)
            change = total[k] - cost
            back.append([k if change > total[j] else j for j in languages])
            total = [(change if change > total[j] else total[j]) + shares[j] for j in languages]
        at = [max(languages, key=total.__getitem__)]
        for links in reversed(back):
            at.append(links[at[-1]])
        at.reverse()
        out, start = [], 0
        for i in range(1, len(words) + 1):
            if i == len(words) or at[i] != at[start]:
                out.append((start, i, self.codes[at[start]]))
                start = i
        return out

    def languages_of(self, words: list[str], least: int = MIN_WORDS) -> list[tuple[str, float, int]]:
        """(language, confidence, words) of a text, the most words first.

        Stretches under ``least`` words, such as borrowed terms, count with the
        neighbour before them, or after them at the head of a text. A text
        under ``least`` words has its one nearest language.
        """
        if not words:
            return []
        long: list[list[str]] = []
        loose = 0
        parts = self.stretches(words)
        for a, b, _ in parts:
            if b - a < least and len(parts) > 1:
                if long:
                    long[-1] += words[a:b]
                else:
                    loose = b
            else:
                long.append(words[a - loose if a == loose else a : b])
                loose = 0
        by: dict[str, list] = {}
        near = [self.nearest(ws) for ws in long] if long else [self.nearest(words)]
        found = {code for code, _ in near if code is not None}
        if len(found) > 1:
            near = [self._settled(ws, *x, found - {x[0]}) for ws, x in zip(long, near)]
        for ws, (code, lead) in zip(long or [words], near):
            if code is not None:
                x = by.setdefault(code, [0, 0.0])
                x[0] += len(ws)
                x[1] += lead * len(ws)
        return sorted(((code, x[1] / x[0], x[0]) for code, x in by.items()), key=lambda x: (-x[2], x[0]))


def labelled_sample(documents: DataFrame, per_language: int = 300, text: str = "text", label: str = "lang", key: str = "doc_id", most_words: int = 4000, spare: int = 4) -> list[tuple[str, str]]:
    """(language, text) of at most per_language labelled documents of each language, those of the least hash of their id.

    The bound of the sample on which the classifier is fitted; documents of
    over most_words words and those under 40 characters are passed over, which
    bounds its bytes too. Labels are counted first, which reads no texts; the
    counts say under which hash a language has ``spare`` times as many
    documents as are wanted, and one scan picks those. Where more than three
    of four of a language are passed over, its sample is the smaller for it.
    """
    code = F.lit(None).cast("string")
    name = F.lower(F.regexp_extract(F.col(label), r"^[^\p{L}]*(\p{L}+)", 1))
    for c, names in LANGUAGE_NAMES.items():
        code = F.when(name.isin(names.split()), F.lit(c)).otherwise(code)
    # At most a row a language comes to the driver.
    counts = {r["c"]: r["n"] for r in documents.select(code.alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    hashed = F.xxhash64(key)
    chosen = F.lit(False)
    for c, n in sorted(counts.items()):
        share = min(1.0, per_language * spare / n)
        # Hashes are even over all whole numbers of 64 bits.
        least = F.lit(True) if share == 1.0 else hashed < F.lit(int(-(2**63) + share * 2**64))
        chosen = chosen | ((code == c) & least)
    picked = documents.where(chosen & F.col(label).isNotNull()).where((F.length(text) <= 8 * most_words) & (F.length(text) > 40))
    rows = picked.select(code.alias("__code"), F.col(text).alias("__text"), hashed.alias("__hash"), F.col(key).alias("__key"))
    # In each task the rank keeps the wanted number of a language, so no more than that is shuffled.
    order = Window.partitionBy("__code").orderBy("__hash", "__key")
    best = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    return sorted((r["__code"], r["__text"]) for r in best.select("__code", "__text").collect())


def fit(sample: list[tuple[str, str]], clusters: int = 6, rounds: int = 5, features: int = 30_000, margin: float = 0.03, seed: int = 7, unit_words: tuple[int, int] = (4, 60)) -> LanguageModel:
    """Fit centroids on labelled texts, some of whose labels are wrong.

    Each text is cut into sentences; those of unit_words words are what is
    fitted on, as shorter ones say little and longer ones aren't sentences. After each round sentences that don't lie
    nearer to a centroid of their label than to any other, by ``margin`` of
    cosine, are left out of the next, so wrong labels and foreign sentences
    lose their say.
    """
    units, label = [], []
    for code, text in sample:
        for s in re.split(r"[.?!؟…\n]+", re.sub(r"https?://\S+|www\.\S+|#\w+|\S+\.\S+/\S*", " ", form(text))):
            words = [w for w in words_of(s) if _LETTER.search(w)]
            if unit_words[0] <= len(words) <= unit_words[1]:
                units.append(words)
                label.append(code)
    if not units:
        raise ValueError("no labelled text to fit on")
    of_word = {w: grams(w) for w in {w for words in units for w in words}}
    distinct = {w: set(g) for w, g in of_word.items()}
    known: Counter = Counter()
    for words in units:
        known.update(set().union(*[distinct[w] for w in words]))
    vocabulary = {g: i for i, (g, _) in enumerate(sorted(known.items(), key=lambda x: (-x[1], x[0]))[:features])}
    n = len(units)
    idf = np.zeros(len(vocabulary))
    for g, i in vocabulary.items():
        idf[i] = math.log((1 + n) / (1 + known[g])) + 1
    columns_of = {w: np.array([vocabulary[g] for g in gs if g in vocabulary], np.int32) for w, gs in of_word.items()}
    cols, vals, start = [], [], [0]
    for words in units:
        c, x = np.unique(np.concatenate([columns_of[w] for w in words]), return_counts=True)
        x = x * idf[c]
        cols.append(c)
        vals.append((x / (math.sqrt(x @ x) or 1.0)).astype(np.float32))
        start.append(start[-1] + len(c))
    col, val = np.concatenate(cols), np.concatenate(vals)
    first, sizes = np.array(start[:-1]), np.diff(start)
    codes = sorted(set(label))
    label_id = np.array([codes.index(x) for x in label])
    rng = np.random.default_rng(seed)

    def places(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of units stand, unit by unit, and where among those each unit's begin."""
        ends = np.cumsum(sizes[which])
        heads = ends - sizes[which]
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - heads, sizes[which]), heads

    def mean(which: np.ndarray) -> np.ndarray:
        at, _ = places(which)
        m = np.bincount(col[at], val[at], minlength=len(vocabulary))
        return m / (np.sqrt(m @ m) or 1.0)

    def dots(c: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Dot products of units with the centroids, a bounded stretch of units at a time."""
        which = np.arange(n) if which is None else which
        out = np.zeros((len(which), c.shape[1]), np.float32)
        narrow = c.astype(np.float32)
        for i in range(0, len(which), 500):
            some = i + np.flatnonzero(sizes[which[i : i + 500]])
            if len(some):
                at, heads = places(which[some])
                out[some] = np.add.reduceat(val[at, None] * narrow[col[at]], heads, axis=0)
        return out

    use = np.ones(n, bool)
    for turn in range(rounds):
        k = 1 if turn < rounds - 1 else clusters
        columns, names = [], []
        for li, code in enumerate(codes):
            own = np.flatnonzero(use & (label_id == li))
            if not len(own):
                continue
            cents = [mean(rng.choice(own, max(1, len(own) // 3), replace=False)) for _ in range(min(k, len(own)))]
            if k > 1:
                for _ in range(6):
                    c = np.stack(cents, 1)
                    near = dots(c, own).argmax(axis=1)
                    cents = [mean(own[near == j]) if (near == j).any() else cents[j] for j in range(len(cents))]
            columns += cents
            names += [code] * len(cents)
        c = np.stack(columns, 1)
        near = dots(c)
        own = np.array([[x == code for x in names] for code in codes])[label_id]
        use = np.where(own, near, -1).max(axis=1) > np.where(own, -1, near).max(axis=1) + margin
    return LanguageModel(vocabulary, idf, c, names)


def languages(rows: DataFrame, model: LanguageModel, key: str, text: str = "text", label: str | None = None, least: int = MIN_WORDS, labels: Labels | None = None) -> DataFrame:
    """One row per text and language: key, lang, confidence, words, spoken, n_languages, labelled.

    spoken counts all words of the text, n_languages its languages, labelled is the language that the
    label column names (null if none). Null, empty and wordless texts give no
    row; texts that fit no language give none either. Times and noises don't
    count as words, nor do speaker labels that ``labels`` resolves.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, labels))
    schema = with_key(rows, key, "lang string", "confidence double", "words integer", "spoken integer", "n_languages integer", "labelled string")

    def start():
        m, known = shared.value

        def one(k, t, label_):
            words = [w for _, ws in pieces(t, known) for w in ws]
            own = m.languages_of(words, least)
            return [(k, code, confidence, n, len(words), len(own), named_language(label_)) for code, confidence, n in own]

        return one

    picked = rows.select(key, F.col(text).alias("__text"), (F.col(label) if label else F.lit(None).cast("string")).alias("__label")).where("__text is not null")
    return map_rows(picked, start, schema)
