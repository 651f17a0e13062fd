"""One form for texts that look the same.

``canonical_form`` works token by token: each run of Latin, Greek or Cyrillic
letters gets the intersection of its letters' script sets. An empty
intersection is a mixed-script run, a run all of whose letters have a twin in
another script is a whole-script confusable; both are spelled in the script
that fits all letters, the script of the rest of the text deciding where more
than one fits. What remains (full width, presentation forms, ligatures, order
of combining marks, invisible characters, kinds of blank) is folded by rule
from the Unicode character database.

``look_key`` is the form with every look-alike letter replaced by its
prototype: two texts look the same to a reader exactly if their keys agree.
``prototypes`` has them for the cased letters of all scripts, by the
confusable skeletons of the Unicode library in Spark's JVM, and it is an error
if they can't be had; without a session the letters named below are known.

Defined results: null gives null, a text without a visible character gives the
empty string, blanks at the ends go, blanks inside keep their number.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that print like a Latin letter (Unicode TS 39, the pairs met in practice).
CYRILLIC_TWINS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y",
}
GREEK_TWINS = {
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
ARABIC_TWINS = {"ک": "ك", "ی": "ي", "ہ": "ه", "ھ": "ه"}
DASH_TWINS = {"‐": "-", "‑": "-"}
# End of the fixed values.

FOLDED_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>"}
FAMILY = ("LATIN", "CYRILLIC", "GREEK")

TO_LATIN = {**CYRILLIC_TWINS, **GREEK_TWINS}
_OPTIONS: dict[str, dict[str, str]] = {}
for _script, _twins in (("CYRILLIC", CYRILLIC_TWINS), ("GREEK", GREEK_TWINS)):
    for _c, _latin in _twins.items():
        _OPTIONS.setdefault(_latin, {"LATIN": _latin})[_script] = _c
for _c, _latin in TO_LATIN.items():
    _OPTIONS[_c] = _OPTIONS[_latin]

_LATIN, _GREEK, _CYRILLIC, _ACCENTS = r"A-Za-z\u00aa-\u024f\u1e00-\u1eff", r"\u0370-\u03ff\u1f00-\u1fff", r"\u0400-\u052f", r"\u0300-\u036f"

#: Texts of these characters only are in their form already, but for blanks at the ends.
_PLAIN = re.compile(r"[\t\n\r -~\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u00c0-\u00ff]*")
#: Letters of the scripts that share looks with Latin.
_OTHERS = re.compile(r"[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
#: Characters that may fold to something else.
_FOLDABLE = re.compile(r"[^ -~\u00c0-\u00ff\u0300-\u034e\u0350-\u036f\u0391-\u03c9\u0400-\u0481\u048a-\u052f\u0591-\u05f4\u0620-\u063a\u0641-\u065f]")
_RUNS = re.compile(rf"[{_LATIN}{_ACCENTS}{_GREEK}{_CYRILLIC}]+")
#: Where a text whose own script is Cyrillic may have a run to resolve.
_NOT_CYRILLIC = re.compile(rf"[{_GREEK}]|[{_LATIN}][{_ACCENTS}]*[{_CYRILLIC}]|[{_CYRILLIC}][{_ACCENTS}]*[{_LATIN}]")
_ACCENT = re.compile(rf"[{_ACCENTS}]")
_LETTER_RUN = re.compile(rf"(?:[^\W\d_][{_ACCENTS}]*)+")


@lru_cache(maxsize=1 << 16)
def script_of(c: str) -> str:
    """First word of the letter's name: LATIN, CYRILLIC, HEBREW ...; empty for what isn't a letter."""
    return unicodedata.name(c, "").partition(" ")[0] if unicodedata.category(c)[0] == "L" else ""


def _fold(c: str) -> str:
    kind = unicodedata.category(c)
    if c in "\t\n\r\x0b\x0c\x85" or kind in ("Zs", "Zl", "Zp") or c == "\u2800":
        return " "
    if kind in ("Cf", "Cc") or 0xFE00 <= ord(c) <= 0xFE0F or c in "\u034f\u115f\u1160\u3164\uffa0\u17b4\u17b5":
        return ""
    if c in ARABIC_TWINS:
        return ARABIC_TWINS[c]
    if c in DASH_TWINS:
        return DASH_TWINS[c]
    d = unicodedata.decomposition(c)
    if d.startswith("<") and d.partition(" ")[0] in FOLDED_TAGS:
        return "".join(_fold(x) for x in unicodedata.normalize("NFKC", c))
    return c


class _Folds(dict):
    def __missing__(self, o: int) -> str:
        self[o] = s = _fold(chr(o))
        return s


_FOLDS = _Folds()


def _folded(m: re.Match) -> str:
    return _FOLDS[ord(m[0])]


@lru_cache(maxsize=1 << 16)
def _resolve(run: str, context: str) -> str:
    """The spelling of a decomposed run of Latin, Greek and Cyrillic letters in one script, where there is one."""
    letters = [c for c in run if script_of(c) in FAMILY]
    scripts = {script_of(c) for c in letters}
    if not scripts or scripts == {"LATIN"}:
        return run
    possible = set(FAMILY)
    for c in letters:
        possible &= _OPTIONS[c].keys() if c in _OPTIONS else {script_of(c)}
    if not possible or possible == scripts and len(scripts) == 1:
        return run
    if len(possible) > 1:
        best = context if context in possible else "LATIN" if "LATIN" in possible else sorted(possible)[0]
    else:
        best = next(iter(possible))
    return "".join(_OPTIONS[c][best] if c in _OPTIONS else c for c in run)


def _context(text: str) -> str:
    """The script of the letters that belong to one script only."""
    n: Counter = Counter()
    for c, times in Counter(text).items():
        if c not in _OPTIONS and (s := script_of(c)) in FAMILY:
            n[s] += times
    return max(n, key=n.__getitem__) if n else "LATIN"


def form(text: str | None) -> str | None:
    """The canonical form of a text."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").strip(" ")
    folded = _FOLDABLE.sub(_folded, text)
    if _OTHERS.search(folded):
        folded = unicodedata.normalize("NFD", folded)
        context = _context(folded)
        # A run all in the text's own script stays.
        if context != "CYRILLIC" or _NOT_CYRILLIC.search(folded):
            folded = _RUNS.sub(lambda m: _resolve(m[0], context) if not m[0].isascii() else m[0], folded)
    return unicodedata.normalize("NFC", folded).strip(" ")


class Prototypes:
    """Prototypes of look-alike letters, those of letters with an accent by rule from those without."""

    def __init__(self, plain: dict[str, str]):
        self.plain = {ord(c): p for c, p in plain.items()}
        self.table = dict(self.plain)
        for o in range(0xC0, 0x2100):
            d = unicodedata.normalize("NFD", chr(o))
            if len(d) > 1 and ord(d[0]) in self.plain:
                self.table[o] = unicodedata.normalize("NFC", d.translate(self.plain))
        self.held = re.compile("[" + "".join(map(chr, sorted(self.table))) + "]")
        #: Of each prototype its letters by script, itself first.
        self.letters: dict[str, dict[str, str]] = {}
        for o, p in sorted(self.plain.items()):
            own = self.letters.setdefault(p, {script_of(p): p})
            own.setdefault(script_of(chr(o)), chr(o))
        # What ``form`` alone doesn't resolve: letters of further scripts, and Latin ones that print like a plain one.
        rare = [chr(o) for o in sorted(self.plain) if chr(o) not in _OPTIONS and script_of(chr(o)) not in ("CYRILLIC", "GREEK")]
        self.rare = re.compile("[" + "".join(rare) + "]") if rare else None

    def of(self, f: str) -> str:
        """Of a text in its form the prototypes."""
        if f.isascii() or not self.held.search(f):
            return f
        if _ACCENT.search(f):
            return unicodedata.normalize("NFC", unicodedata.normalize("NFD", f).translate(self.plain))
        return f.translate(self.table)


    def resolved(self, f: str) -> str:
        """A form with runs that hold letters of further scripts in one script, where there is one that has all their looks."""
        if f.isascii() or self.rare is None or not self.rare.search(f):
            return f
        d = unicodedata.normalize("NFD", f)
        options = lambda c: self.letters.get(self.plain.get(ord(c), c)) or {script_of(c): c}
        n: Counter = Counter()
        for c, times in Counter(d).items():
            if script_of(c):
                n[script_of(c)] += times
        context = max(n, key=n.__getitem__) if n else "LATIN"

        def one(m: re.Match) -> str:
            run = m[0]
            if not self.rare.search(run):
                return run
            each = [options(c) if script_of(c) else None for c in run]
            possible = set.intersection(*[set(o) for o in each if o is not None])
            if not possible:
                return run
            best = context if context in possible else "LATIN" if "LATIN" in possible else sorted(possible)[0]
            # Letters of one script that look alike stay what they are, but for those that print like a plain Latin one.
            return "".join(c if o is None or script_of(c) == best != "LATIN" else o[best] for c, o in zip(run, each))

        return unicodedata.normalize("NFC", _LETTER_RUN.sub(one, d))


OWN = Prototypes(TO_LATIN)
_MADE: list[Prototypes] = []


def prototypes(spark: SparkSession) -> Prototypes:
    """Of every cased letter beyond ASCII that is a confusable of another cased letter that letter, by the skeletons of Spark's own Unicode library (TS 39).

    The standard gives I and l one skeleton; here a capital is I. A session
    without the library, or with one that fails, raises: with fewer letters
    the results would be others. Bounded by the number of Unicode's letters,
    and made once a process.
    """
    if _MADE:
        return _MADE[0]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except (TypeError, AttributeError) as e:  # what names no class can't be called
        raise RuntimeError("the look-alike letters need the Unicode library com.ibm.icu in the session's JVM") from e
    cased = [c for o in range(0x80, 0x20000) if not 0xD800 <= o < 0xE000 and unicodedata.category(c := chr(o)) in ("Lu", "Ll")]
    skeletons = checker.getSkeleton("\n".join(cased)).split("\n")
    if len(skeletons) != len(cased):
        raise RuntimeError(f"{len(skeletons)} skeletons of {len(cased)} letters")
    found = {}
    for c, s in zip(cased, skeletons):
        if len(s) == 1 and s != c and unicodedata.category(s) in ("Lu", "Ll") and _FOLDS[ord(c)] == c and unicodedata.normalize("NFD", c) == c:
            found[c] = "I" if s == "l" and unicodedata.category(c) == "Lu" else s
    _MADE.append(Prototypes(found | TO_LATIN))
    return _MADE[0]


def look(text: str | None, known: Prototypes = OWN) -> str | None:
    """The form with prototypes for all look-alike letters."""
    return None if text is None else known.of(form(text))


def canonical_form(text: Column | str, known: Prototypes = OWN) -> Column:
    @F.pandas_udf(T.StringType())
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(lambda t: known.resolved(form(t)), na_action="ignore").astype(object).where(s.notna(), None)

    return canonical(text)


def look_key(text: Column | str, known: Prototypes = OWN) -> Column:
    @F.pandas_udf(T.StringType())
    def key(s: pd.Series) -> pd.Series:
        return s.map(lambda t: look(t, known), na_action="ignore").astype(object).where(s.notna(), None)

    return key(text)


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def same_look_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, text: str = "text") -> DataFrame:
    """Pairs of rows that agree in ``on`` and look the same, but aren't equal as stored.

    Null keys and texts, and texts without a visible character, pair with
    nothing. Repeated rows count each. Only ids and 16-byte digests are
    shuffled, by ``on`` and the digest of the look together, so a hot value of
    ``on`` spreads over all tasks.
    """

    known = prototypes(left.sparkSession)

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        picked = df.select(*on, F.col(key).alias(name), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
        for c in on:
            picked = picked.where(F.col(c).isNotNull())
        keyed = picked.withColumn("__look", look_key("__text", known)).where(F.col("__look") != "")
        return keyed.select(*on, name, _digest(F.col("__look")).alias("__look"), _digest(F.col("__text")).alias(f"__stored_{name}"))

    a, b = side(left, left_id, "__left"), side(right, right_id, "__right")
    pairs = a.join(b, [*on, "__look"]).where(F.col("__stored___left") != F.col("__stored___right"))
    return pairs.select(F.col("__left").alias(left_id), F.col("__right").alias(right_id))
