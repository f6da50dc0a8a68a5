"""Free-entered values mapped to the entries of a reference list.

The reference entries and all their alias paths form one trie; a value is searched in it with a Levenshtein
automaton (edit distance with swaps of neighbours), which returns every entry within a distance that depends on
the length. The trie is built once per task from the broadcast list; values are looked up per Arrow batch with a
cache of those already seen, so there is no shuffle and a value that fills a third of all rows costs one search.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import DESCRIPTORS

#: A reference list above this many keys is refused: it is sent to every task.
MAX_REFERENCE_KEYS = 2_000_000
#: Lists up to this size get the table of letter pairs that spares hopeless searches.
MAX_PAIR_KEYS = 5_000
#: Values a matcher remembers, and matchers a worker process keeps.
CACHE_SIZE, MAX_MATCHERS = 200_000, 8


_BLANKS = re.compile(r"[\s_]+")
_MARKS = re.compile(r"[\s\-./'’&,()\[\]:;|]+")
_JOINTS = re.compile(r"[\s\-/.]+")


class _Plain(dict):
    """For str.translate: marks and format characters are taken out; each character is looked up once."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = out = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else code
        return out


_PLAIN = _Plain()


def fold(text: str) -> str:
    """Lower case without accents, format characters or repeated blanks; đ counts as d."""
    if text.isascii():
        return _BLANKS.sub(" ", text.lower()).strip()
    t = unicodedata.normalize("NFKD", text.lower().replace("đ", "d")).translate(_PLAIN)
    return _BLANKS.sub(" ", t).strip()


def compact(folded: str) -> str:
    """A folded text without blanks and joining marks; + and # are kept, they tell C++ and C# from C."""
    return _MARKS.sub("", folded)


def tolerance(length: int) -> int:
    """Edits allowed for a key of this length."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Trie:
    """Keys with entry ids, searched with a Levenshtein automaton."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.entries: list[list[tuple[int, str]]] = [[]]
        self.lengths: list[list[int]] = [[1 << 30, 0]]  # shortest and longest key below each node
        self.n_keys = 0
        self.pairs: dict[str, np.ndarray] | None = None

    def add(self, key: str, entry: int, spaced: str) -> None:
        """Add a key; `spaced` is its form with blanks."""
        if not key:
            return
        at = 0
        n = len(key)
        for c in key:
            to = self.next[at].get(c)
            if to is None:
                to = len(self.next)
                self.next[at][c] = to
                self.next.append({})
                self.entries.append([])
                self.lengths.append([n, n])
            span = self.lengths[to]
            span[0], span[1] = min(span[0], n), max(span[1], n)
            at = to
        if (entry, spaced) not in self.entries[at]:
            self.entries[at].append((entry, spaced))
            self.n_keys += 1
            if self.n_keys > MAX_REFERENCE_KEYS:
                raise ValueError(f"the reference list has more than {MAX_REFERENCE_KEYS} keys")

    def plausible(self, key: str, limit: int) -> bool:
        """Whether some key can lie within `limit` edits: one edit changes at most three pairs of neighbouring letters.

        A necessary condition, so no entry is lost; for lists above MAX_PAIR_KEYS keys it isn't used.
        """
        need = len(key) - 1 - 3 * limit
        if need <= 0 or self.n_keys > MAX_PAIR_KEYS:
            return True
        if self.pairs is None:
            keys = sorted({compact(s) for es in self.entries for _, s in es})
            self.pairs = {}
            for i, k in enumerate(keys):
                for x in {k[j : j + 2] for j in range(len(k) - 1)}:
                    self.pairs.setdefault(x, np.zeros(len(keys), dtype=np.int16))[i] = 1
        rows = [r for j in range(len(key) - 1) if (r := self.pairs.get(key[j : j + 2])) is not None]
        return len(rows) >= need and bool((np.sum(rows, axis=0) >= need).any())

    def exact(self, key: str) -> list[tuple[int, str]]:
        at = 0
        for c in key:
            to = self.next[at].get(c)
            if to is None:
                return []
            at = to
        return self.entries[at] if key else []

    def search(self, key: str, limit: int) -> list[tuple[int, int, str]]:
        """All (distance, entry, spaced key) within `limit` edits of `key`.

        The automaton's state after a trie path of length i is the band of edit distances to the prefixes of
        `key` of lengths i - limit to i + limit; a state all above `limit` is dead and its subtree is skipped, as
        are subtrees whose keys are too short or too long. A swap of neighbours is one edit.
        """
        n, width = len(key), 2 * limit + 1
        dead = limit + 1
        found: list[tuple[int, int, str]] = []
        start = tuple(j if 0 <= j <= n else dead for j in range(-limit, limit + 1))
        stack = [(child, c, "", start, None, 1) for c, child in self.next[0].items()]
        while stack:
            node, c, last, row, before, depth = stack.pop()
            shortest, longest = self.lengths[node]
            if shortest > n + limit or longest < n - limit:
                continue
            cur = []
            left = dead
            first = depth - limit  # the prefix length of the band's first cell
            for t in range(width):
                j = first + t
                if j < 0 or j > n:
                    d = dead
                else:
                    d = row[t] + (key[j - 1] != c) if j else dead
                    if t + 1 < width and row[t + 1] + 1 < d:
                        d = row[t + 1] + 1
                    if left + 1 < d:
                        d = left + 1
                    if before is not None and j > 1 and c == key[j - 2] and last == key[j - 1] and before[t] + 1 < d:
                        d = before[t] + 1
                    if d > dead:
                        d = dead
                cur.append(d)
                left = d
            end = n - first
            if 0 <= end < width and cur[end] <= limit and self.entries[node]:
                found += [(cur[end], e, s) for e, s in self.entries[node]]
            if min(cur) <= limit or min(row) <= limit:
                state = tuple(cur)
                stack += [(child, x, c, state, row, depth + 1) for x, child in self.next[node].items()]
        return found


def _short_words_agree(a: str, b: str) -> bool:
    """Whether no word of up to three letters has another letter in its place, where both have as many words.

    Short words bear the meaning (AI, BI, QA): swapped, doubled or lost letters are typing errors, other
    letters are other words.
    """
    x, y = _JOINTS.split(a), _JOINTS.split(b)
    if len(x) != len(y):
        return True
    return all(p == q or set(p) <= set(q) or set(q) <= set(p) for p, q in zip(x, y) if min(len(p), len(q)) <= 3)


class Matcher:
    """Finds the entry of a value. `forms` gives the texts to look up, the most complete first."""

    def __init__(self, keys: Iterable[tuple[int, str]], forms: Callable[[str], list[str]]):
        self.trie = Trie()
        self.forms = forms
        for entry, key in keys:
            spaced = fold(key)
            self.trie.add(compact(spaced), entry, spaced)
        self.seen: OrderedDict[str, tuple[int, int]] = OrderedDict()
        self.known: dict[str, tuple[int, int]] = {}  # listed titles and their levels (llm.linkage), for all tasks of the process

    def all(self, value: str) -> list[tuple[int, int, str]]:
        """All (distance, entry, key) within the distance its length allows, over the forms of the value."""
        found = []
        for form in self.forms(value):
            key = compact(form)
            found += [x for x in self.trie.search(key, tolerance(len(key))) if x[0] == 0 or _short_words_agree(form, x[2])]
        return sorted(set(found))

    def listed(self, value: str | None) -> int:
        """The entry that one of the value's forms names exactly, the most complete first; 0 if none."""
        for form in self.forms(value) if value is not None and value.strip() else []:
            if form and (exact := self.trie.exact(compact(form))):
                return min(e for e, _ in exact)
        return 0

    def best(self, value: str | None) -> tuple[int, int]:
        """(entry, distance) of the closest entry, (0, -1) if none fits.

        An exact form wins, the most complete first; else the smallest distance, then the longer key, then the
        smaller entry.
        """
        if value is None or not value.strip():
            return 0, -1
        if (hit := self.seen.get(value)) is not None:
            return hit
        out = (0, -1)
        forms = list(dict.fromkeys(f for f in self.forms(value) if f))
        for form in forms:
            if exact := self.trie.exact(compact(form)):
                out = (min(e for e, _ in exact), 0)
                break
        else:
            keyed = {compact(f): f for f in reversed(forms)}
            for limit in (1, 2):  # one edit is by far the most frequent: the wider search runs only where that fails
                near = [
                    (d, -len(s), e)
                    for key, form in keyed.items()
                    if tolerance(len(key)) >= limit and self.trie.plausible(key, limit)
                    for d, e, s in self.trie.search(key, limit)
                    if tolerance(len(compact(s))) >= d and _short_words_agree(form, s)
                ]
                if near:
                    d, _, e = min(near)
                    out = (e, d)
                    break
        self.seen[value] = out
        if len(self.seen) > CACHE_SIZE:
            self.seen.popitem(last=False)
        return out


#: Words around a job title that don't change what job it is. Fixed vocabulary, folded.
TITLE_NOISE = (
    "tuyen gap|tuyen dung|can tuyen|can gap|tuyen|urgent|hot|gap|new|senior|sr|junior|jr|middle|mid|mid level|fresher|lead|leader|"
    "intern|internship|thuc tap sinh|principal|staff|hybrid|remote|onsite|luong hap dan|luong cao|up to \\$?\\d+k?|x ?\\d+|sl ?\\d+"
)
_TITLE_HEAD, _TITLE_TAIL = re.compile(rf"(?:{TITLE_NOISE})\b\.?[\s:,\-]*"), re.compile(rf"[\s:,\-(]+(?:{TITLE_NOISE})\)?\.?$")
_TITLE_REMARKS, _TITLE_START, _TITLE_BREAKS = re.compile(r"\[[^\]]*\]|\((?:hot|urgent|gap|new)\)"), re.compile(r"[^\w.]+"), re.compile(r"\s[-–—|]\s|,|\(|:\s|\s/\s")

@dataclass(frozen=True)
class Affixes:
    """Folded words that may stand before and after a name without changing what it means."""

    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()

    def __repr__(self) -> str:  # in an order of its own: the sets' differs from process to process
        return f"Affixes({sorted(self.before)}, {sorted(self.after)})"


#: Vietnamese words put before a skill, folded; further ones are learnt (llm.aliases).
DESCRIBED = Affixes(frozenset(fold(d) for d in DESCRIPTORS))


def _without_start(pattern: re.Pattern, text: str) -> str:
    return text[m.end() :] if (m := pattern.match(text)) else text


def title_forms(value: str) -> list[str]:
    """Texts of a job title to look up: without marks and remarks, then cut at each break from the right."""
    t = fold(value)
    t = _without_start(_TITLE_START, _TITLE_REMARKS.sub(" ", t))
    breaks = [m.start() for m in _TITLE_BREAKS.finditer(t)]
    out: list[str] = []
    for end in [len(t), *reversed(breaks)]:
        part = t[:end].strip(" -–—|,:(")
        level = [part]
        while level:
            out += [x for x in level if x not in out]
            cut = [y.strip(" -–—|,:") for x in level for y in (_without_start(_TITLE_HEAD, x), _TITLE_TAIL.sub("", x)) if y != x]
            level = [y for y in cut if y and y not in out]
    # the least stripped of each length first, the longest lengths first
    return list(dict.fromkeys(re.sub(r"\s+", " ", x) for x in out if len(x) > 1))


def skill_forms(value: str, affixes: Affixes = Affixes()) -> list[str]:
    """Texts of a skill name to look up: as written, without remarks in parentheses, without words around it."""
    before, after = affixes.before | DESCRIBED.before, affixes.after
    longest = 1 + max((a.count(" ") for a in before | after), default=0)
    t = fold(value)
    out = list(dict.fromkeys([t, re.sub(r"\s*\([^)]*\)", "", t).strip()]))
    for x in out:  # grows; every further form is shorter
        words = x.split(" ")
        for k in range(1, min(longest + 1, len(words))):
            if " ".join(words[:k]) in before and (y := " ".join(words[k:])) not in out:
                out.append(y)
            if " ".join(words[-k:]) in after and (y := " ".join(words[:-k])) not in out:
                out.append(y)
    return out


#: Matchers of this worker process, by list and forms: the tasks that follow one another share the values already searched.
_matchers: dict[str, Matcher] = {}


def matcher_of(keys: list[tuple[int, str]], forms: Callable[[str], list[str]]) -> Matcher:
    """The process's matcher of a list; at most MAX_MATCHERS are kept."""
    named = (forms.func.__qualname__, sorted(map(repr, forms.keywords.items()))) if isinstance(forms, partial) else forms.__qualname__
    digest = hashlib.sha256(repr((named, keys)).encode()).hexdigest()
    if digest not in _matchers:
        if len(_matchers) >= MAX_MATCHERS:
            _matchers.clear()
        _matchers[digest] = Matcher(keys, forms)
    return _matchers[digest]


def entry_udf(keys: list[tuple[int, str]], forms: Callable[[str], list[str]], exact: bool = False) -> Callable[[Column], Column]:
    """A column function value -> entry id (0 = fits none, also for null and blank); with `exact` only names as they are listed fit."""

    @F.pandas_udf("int")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(keys, forms)
        find = matcher.listed if exact else lambda v: matcher.best(v)[0]
        for values in batches:
            codes, uniques = pd.factorize(values)
            ids = [find(u) for u in uniques] + [0]  # code -1 (null) takes the last
            yield pd.Series([ids[c] for c in codes], dtype="int32")

    # a deterministic function would be evaluated once more for every filter that is pushed below it
    return match.asNondeterministic()
