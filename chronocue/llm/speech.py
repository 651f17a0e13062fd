"""What is spoken in a line of an automatic transcript, and by whom.

``Labels`` resolves a speaker label (number, name in any order or script,
initials, unique role, a doubled letter) to a key of the roster.
``pieces`` takes a text apart into stretches of words with the speaker whose
label precedes them, leaving out time marks, noises, padding marks and
hesitation sounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from .forms import form, look

TIME = r"\d+:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_HEAD_TIME = re.compile(r"^\W*+(\d+):(\d{2})(?::(\d{2}))?([.,]\d+)?")
_TIMES = re.compile(rf"[\[(]\s*{TIME}(?:\s*-+>?\s*{TIME})?\s*[\])]|(?<![\w:.]){TIME}(?![\w:])")
_BRACKETS = re.compile(r"<v\s++([^<>]++)>|<([^<>]*+)>|\[([^\[\]]*+)\]|\(([^()]*+)\)|\*([^*\n]++)\*", re.IGNORECASE)
_COLON = re.compile(r"\s?:(?![\d/])")
_W = r"[\w\u0300-\u036f\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7\u064b-\u065f\u0670]"
_WORD = re.compile(rf"{_W}+(?:['’\-]{_W}+)*")
_TOKEN_BEFORE = re.compile(r"[^\s:>\[\]()<]+$")
#: Hesitation sounds of the eight languages, by sound: drawn-out vowels and hums.
_HESITATION = re.compile(
    r"u+h*m*|u+m+|uh+m*|e+r+m+|er{2,}|h+m+|hu+m+|m+h*|mhm|a+h+m?|e+h+m?|e+u+h+|ä+h*m*|hã+|ã+h?|a+hn+|o+h"
    r"|э+м*|э+-э+|м+|а-а+|א+ה+|א+מ+|ה+מ+|מ{2,}|ا?آ+ه+|ا+ه+|ا+م+|ه+م+|م{2,}"
)
#: The letters of these sounds.
_SOUNDS = frozenset(re.findall(r"[^\W\d_]", _HESITATION.pattern))
_MARK = re.compile(r"(?:>>+|-+>?|–|—|\|)$")
_LETTERS = re.compile(r"[^\W\d_]")


def _squeezed(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", s)


def _within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement at most makes a into b."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class Labels:
    """Speaker labels of a roster of (speaker_key, names, role)."""

    def __init__(self, roster: Iterable[tuple[str, list[str], str | None]]):
        self.by_number: dict[int, str] = {}
        found: dict[str, set[str]] = {}
        full: dict[str, set[str]] = {}
        for key, names, role in roster:
            if m := re.search(r"(\d+)\D*$", key):
                self.by_number[int(m[1])] = key
            forms = {key.casefold()}
            for name in names:
                parts = self.clean(name).split()
                if not parts:
                    continue
                whole = {" ".join(parts), " ".join(parts[::-1])}
                full.setdefault(_squeezed(" ".join(parts)), set()).add(key)
                forms |= whole | {parts[0], parts[-1], f"{parts[0][0]} {parts[-1]}", f"{parts[0]} {parts[-1][0]}"}
            if role:
                forms.add(self.clean(role))
            for f in forms:
                found.setdefault(_squeezed(f), set()).add(key)
        #: A form that several speakers share names nobody.
        self.by_form = {f: next(iter(k)) for f, k in found.items() if len(k) == 1}
        self.by_full = {f: next(iter(k)) for f, k in full.items() if len(k) == 1 and len(f) > 5}
        #: Words of the longest form; a label of a number has two.
        self.most_words = max(2, *(len(f.split()) for f in found)) if found else 2
        self.known: dict[tuple[str, bool], str | None] = {}

    @staticmethod
    def clean(label: str) -> str:
        return " ".join(re.findall(r"[^\W_]+", look(label).casefold()))

    def resolve(self, label: str | None, near: bool = True, number: bool = True) -> str | None:
        """The key that a label names, or None. near: also with one letter wrong in a full name; number: a bare number counts."""
        if label is None:
            return None
        k = (label, near, number)
        if k not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[k] = self._resolve(label, near, number)
        return self.known[k]

    def _resolve(self, label: str, near: bool, number: bool) -> str | None:
        s = self.clean(label)
        if m := re.fullmatch(r"(?:spk|spkr|speaker)? ?0*(\d{1,18})", s):
            return self.by_number.get(int(m[1])) if number or s[0] == "s" else None
        s = _squeezed(s)
        if s in self.by_form:
            return self.by_form[s]
        if near and len(s) > 5:
            hits = {key for f, key in self.by_full.items() if _within_one(s, f) or _within_one(" ".join(s.split()[::-1]), f)}
            if len(hits) == 1:
                return hits.pop()
        return None


def head_seconds(text: str | None) -> float | None:
    """The time mark at the head of a text: minutes:seconds, minutes not rolling into hours, or hours:minutes:seconds. A number of over 15 digits is no time."""
    if not text:
        return None
    m = _HEAD_TIME.match(form(text))
    if not m or len(m[1]) > 15:
        return None
    a, b, c, part = int(m[1]), int(m[2]), m[3], float("0." + m[4][1:]) if m[4] else 0.0
    return (a * 60 + b if c is None else a * 3600 + b * 60 + int(c)) + part


_SAID: dict[str, bool] = {}


def _said(w: str) -> bool:
    """Whether a word isn't a hesitation sound."""
    low = w.casefold()
    known = not (low[0] in _SOUNDS and low[-1] in _SOUNDS and _HESITATION.fullmatch(low))
    if len(w) <= 40:
        if len(_SAID) > 200_000:
            _SAID.clear()
        _SAID[w] = known
    return known


def words_of(s: str) -> list[str]:
    """Words with a letter or digit that aren't hesitation sounds."""
    get = _SAID.get
    if "..." in s and "este..." in s.casefold():  # the Spanish word is a sound where it trails off
        return [m[0] for m in _WORD.finditer(s) if _said(m[0]) and not (m[0].casefold() == "este" and s[m.end() : m.end() + 3] == "...")]
    return [w for w in _WORD.findall(s) if (k := get(w)) or (k is None and _said(w))]


def pieces(text: str | None, labels: Labels | None) -> list[tuple[str | None, list[str]]]:
    """Stretches of words with the speaker named before them (None: nobody). Stretches without words are left out."""
    if not text:
        return []
    s = _TIMES.sub(" ", form(text))
    if labels is None:
        return [(None, w)] if (w := words_of(_BRACKETS.sub(" ", s).replace("♪", " "))) else []
    cuts: list[tuple[int, int, str]] = []  # from, to, key

    def bracket(m: re.Match) -> str:
        voice = m[1]
        inner = voice or m[2] or m[3] or m[4]
        key = labels.resolve(inner, near=voice is not None, number=voice is not None) if inner else None
        return f"\x01{key}\x02" if key else " "

    s = _BRACKETS.sub(bracket, s).replace("♪", " ")
    if ":" in s:
        out, at = [], 0
        for m in _COLON.finditer(s):
            head = s[at : m.start()]
            stripped = head.rstrip()
            end, key, start = len(stripped), None, 0
            first = end
            for _ in range(labels.most_words):
                t = _TOKEN_BEFORE.search(stripped[:first].rstrip())
                if not t or "\x02" in t[0] or not _WORD.search(t[0]):
                    break
                first = t.start()
                if k := labels.resolve(stripped[first:end], near=False, number=False):
                    key, start = k, first
            before = head[:start].rstrip() if key else ""
            if key and (not _LETTERS.search(before.rpartition("\x02")[2]) and not any(out) or _MARK.search(before) or before.endswith("\x02")):
                out.append(head[:start] + f" \x01{key}\x02")
            else:
                out.append(s[at : m.end()])
            at = m.end()
        s = "".join(out) + s[at:]
    result = []
    key = None
    for i, part in enumerate(re.split("\x01([^\x02]*)\x02", s)):
        if i % 2:
            key = part
        elif w := words_of(part):
            result.append((key, w))
    return result
