"""The same jobs across two boards that share no key.

Sorted neighbourhood: every posting gets several composite sort keys from its noisy attributes; for each key all
postings are sorted by range partitions and every posting is compared with its next WINDOW neighbours, across partition
borders too. Where the first part of a key, its block, already says that two postings may be the same job, the window
reaches over the whole block, however many postings that holds: a fixed number of places would find less the more
postings there are. A comparison adds up field weights, as in
Fellegi-Sunter linkage. Cross-board pairs above the threshold are assigned one to one so that the total confidence (the sum of
its log odds) is greatest; postings of one board that are the same job again share the partner.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.aliases import Keys, elected, forms_of, further, title_votes
from postmill.llm.entries import CACHE_SIZE, Affixes, Matcher, compact, fold, matcher_of, title_forms
from postmill.llm.names import city_bits, company_key
from postmill.operators.clusters import components
from postmill.session import checkpointed

WINDOW = 20
#: Score from which a pair is the same job, and from which two postings of one board are. A score this far over EVEN is its log odds.
THRESHOLD, REPOST_THRESHOLD, EVEN = 9.0, 13.0, 7.0
#: The agreement of a company with this share of all postings weighs most and least; in between it falls with the logarithm.
RARE, COMMON, MOST, LEAST = 10**-2.5, 0.1, 6.0, 1.0
#: What company names weigh that are nearly equal, of which one (of PART_LETTERS or more) begins the other, or that differ.
CLOSE, PART, UNLIKE, PART_LETTERS = 5.0, 4.0, -6.0, 6
#: What a company must weigh at least for a pair that agrees in it, title (3), place (1), level (1) and skills (2) and says no more.
LIGHT = THRESHOLD - 7

#: Levels a title may name. Fixed vocabulary.
LEVELS = re.compile(r"\b(senior|sr|junior|jr|middle|fresher|lead|intern|principal)\b")
_LEVEL_CODE = {"senior": 1, "sr": 1, "junior": 2, "jr": 2, "middle": 3, "fresher": 4, "lead": 5, "intern": 6, "principal": 7}
_SENTENCE = re.compile(r"[.\n\r\u3002!?]+")
_ENDS = ".\n\r\u3002!?"
# what stands before is looked at behind the first character: a pattern that begins with the character itself is searched far faster
_NAME = re.compile(r"[A-Z](?<![\w.-][A-Z])[a-z]{3,}(?![a-z])")
_COUNT = re.compile(r"\d(?<![\w-]\d)\d*(?![\w-])")
_PIECES = re.compile(r"[,;|\u2022\u3001\n/]|\s-\s")

FEATURES = (
    "posting_id long, board int, at timestamp_ntz, company string, title int, job_title string, level int, city long, facts string, low long, high long, skills binary"
)


def named_counts(text: str | None, common: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """(name, count) for each capitalised word inside a sentence that also states a number, the first of it.

    A team, a project or a site is told from others by its name and its size, in any language that marks names. Words of
    `common` (those of skills and titles) and a sentence's first word are no names. In order, without repeats.
    """
    out: dict[tuple[str, int], None] = {}
    text, at = text or "", 0
    while (m := _COUNT.search(text, at)) is not None:  # only sentences with a number are cut out
        first = m.start()
        begin = max(at, *[text.rfind(c, at, first) + 1 for c in _ENDS])
        at = end.start() if (end := _SENTENCE.search(text, m.end())) else len(text)
        digits = m.group()
        count = int(digits) if len(digits) < 19 else _h(digits)
        sentence = text[begin:at].strip(" -*\u2022+\t")
        for n in _NAME.finditer(sentence):
            if n.start() and (word := n.group().lower()) not in common:
                out[word, count] = None
    return list(out)


def _h(text: str, bits: int = 62) -> int:
    return xxhash.xxh64_intdigest(text) >> (64 - bits)


def features(postings: DataFrame, titles: Keys, skills: Keys, affixes: Affixes = Affixes()) -> DataFrame:
    """One row of comparable features per posting_id (that of the latest crawl), texts dropped.

    `postings`: posting_id, board (0 or 1), company, job_title, location, required_skills, job_description,
    crawled_at, low_kvnd, high_kvnd; other columns are ignored. Missing values become "", 0 or null and neither
    help nor harm a match; rows without posting_id are dropped. title is the entry that is listed as the title stands, else 0 and
    job_title is kept (with_titles finds what it means). skills holds a bit per entry of the list.
    """
    place = {e: i for i, e in enumerate(sorted({e for e, _ in skills}))}
    width = -(-max(len(place), 1) // 8)
    common = frozenset(w for _, k in [*titles, *skills] for w in re.split(r"[\s/.\-]+", fold(k)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        title_of, skill_of = matcher_of(titles, title_forms), matcher_of(skills, forms_of(affixes))

        known = title_of.known

        def title_level(x: str | None) -> tuple[int, int]:
            if not x:
                return 0, 0
            if (hit := known.get(x)) is None:
                m = LEVELS.search(fold(x))
                if len(known) > CACHE_SIZE:
                    known.clear()
                hit = known[x] = (title_of.listed(x), _LEVEL_CODE[m.group(1)] if m else 0)
            return hit

        def skill_bits(x: str | None) -> bytes:
            bits = 0
            for p in _PIECES.split(x or ""):
                if e := skill_of.best(p.strip(" []'\""))[0]:
                    bits |= 1 << place[e]
            return bits.to_bytes(width, "little")

        for pdf in batches:
            named = [title_level(x) for x in pdf["job_title"]]
            yield pd.DataFrame(
                {
                    "posting_id": pdf["posting_id"], "board": pdf["board"], "at": pdf["crawled_at"], "company": [company_key(x) for x in pdf["company"]], "title": [t for t, _ in named],
                    "job_title": [None if t else x for x, (t, _) in zip(pdf["job_title"], named)], "level": [v for _, v in named], "city": [city_bits(x) for x in pdf["location"]],
                    "facts": [",".join(f"{n}:{k}" for n, k in named_counts(x, common)) for x in pdf["job_description"]],
                    "low": pd.to_numeric(pdf["low_kvnd"]).fillna(0).astype("int64"), "high": pd.to_numeric(pdf["high_kvnd"]).fillna(0).astype("int64"), "skills": [skill_bits(x) for x in pdf["required_skills"]],
                }
            )

    needed = ("posting_id", "board", "company", "job_title", "location", "required_skills", "job_description", "crawled_at", "low_kvnd", "high_kvnd")
    each = postings.filter(F.col("posting_id").isNotNull()).select(*needed).mapInPandas(run, FEATURES)
    names = [c.split()[0] for c in FEATURES.split(", ")]
    rest = [c for c in names if c not in ("posting_id", "board", "at")]
    latest = each.groupBy("posting_id", "board").agg(F.max_by(F.struct(*rest), F.struct("at", *rest)).alias("x"))
    return latest.select("posting_id", "board", "x.*")


def title_number(matcher: Matcher, x: str | None) -> int:
    """The entry of a title; a title outside the list is a number below 0 by its shortest form, a blank one 0."""
    if x is None or not x.strip():
        return 0
    if entry := matcher.best(x)[0]:
        return entry
    forms = title_forms(x)
    return -1 - _h(compact(min(forms, key=lambda f: (len(f), f))), 30) if forms else 0


def with_titles(rows: DataFrame, titles: Keys) -> DataFrame:
    """`rows` of features with the entry of every title: titles that aren't listed are looked up among the listed ones and those that other postings of the same jobs teach.

    A title outside both is a number below 0 by its shortest form, a blank one 0. job_title is dropped.
    """
    facts = rows.select("posting_id", "board", "company", "city", F.col("low").alias("low_kvnd"), F.col("high").alias("high_kvnd"), F.coalesce("job_title", F.col("title").cast("string")).alias("job_title"), "title")
    keys = titles + further(titles, elected(title_votes(facts)), title_forms)

    @F.pandas_udf("int")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(keys, title_forms)
        for values in batches:
            codes, uniques = pd.factorize(values)
            found = [title_number(matcher, x) for x in uniques] + [0]
            yield pd.Series([found[c] for c in codes], dtype="int32")

    listed = rows.filter(F.col("job_title").isNull()).drop("job_title")
    others = rows.filter(F.col("job_title").isNotNull()).withColumn("title", look_up.asNondeterministic()(F.col("job_title"))).drop("job_title")
    return listed.unionByName(others)


def _sort_keys(heavy: list[str]) -> list[tuple[str, Column, Column, Column, Column]]:
    """(pass, block, rest, whole, value): composite keys block + rest as bytes, which take half the room of digits; a null block leaves a posting out of the pass.

    The postings of a block that is `whole` are compared beyond the window too, as far as _reach says. Together these blocks hold every
    pair across the boards that reaches THRESHOLD, agrees in company and states its pay alike (that is, no lower bound of one is the upper of the other):
    with a counted name in d, else with the title in g, or, if the company is one of `heavy`, with an amount in p (title, company, place, level and skills
    are not enough there), else with a title unknown in a. A pair that agrees in title and a counted name is in c whatever its companies, one with
    title and pay and a company unknown in f, one with the title and a company's letters in b. Pairs that say less alike are found by the window only.
    """
    c = F.col
    zero = F.lit("0")

    def num(x: Column, digits: int = 8) -> Column:
        return F.unhex(F.lpad(F.hex(x.cast("long")), digits, zero))

    def text(x: Column) -> Column:
        return F.concat(x, F.lit("|")).cast("binary")

    title, city, level = num(c("title") + F.lit(1 << 31)), num(c("city")), num(c("level"), 2)
    low, high, company, skills = num(c("low"), 16), num(c("high"), 16), text(c("company")), c("skills")
    letters = text(F.array_join(F.sort_array(F.array_distinct(F.split("company", ""))), ""))
    known = c("company") != ""
    count = F.substring_index("fact", ":", -1).cast("long")
    fact, size = text(F.substring_index("fact", ":", 1)), num(count, 16)
    backwards = F.reverse(F.hex("skills")).cast("binary")
    light = ~c("company").isin(heavy)
    first = lambda x: F.when(x, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    yes, no, none = F.lit(True), F.lit(False), F.lit(0).cast("long")
    by_amount = lambda x: F.when(~light & (c("title") != 0) & (x > 0), F.concat(company, title, num(x, 16)))
    return [
        ("a", F.when(known, company), F.concat(first(c("title") == 0), title, city, text(c("facts")), low, skills), light, none),
        # of names that are nearly equal: with the same letters, or different in their first ones
        ("b", F.when(known & (c("title") != 0), F.concat(title, letters)), F.concat(city, high, skills), light, none),
        ("e", F.when(known & (c("title") != 0), F.concat(title, text(F.reverse("company")))), F.concat(city, high, skills), no, none),
        ("f", F.when(c("high") > 0, F.concat(title, high, low)), F.concat(first(~known), city, company), yes, none),
        # without names and pay, which one of two postings may leave out
        ("g", F.when(known, F.concat(company, title)), F.concat(city, level, skills), light, none),
        ("h", F.when(c("title") != 0, F.concat(title, city)), F.concat(backwards, company), no, none),
        ("p", by_amount(c("low")), F.concat(city, skills), yes, none),
        ("p", by_amount(F.when(c("high") != c("low"), c("high"))), F.concat(city, skills), yes, none),
        # by each name that the description counts
        ("c", F.concat(fact, title), F.concat(size, company), yes, count),
        ("d", F.concat(fact, company), F.concat(size, title), known, count),
    ]


#: Passes with one row per counted name of a posting.
FACT_PASSES = ("c", "d")


#: Scores are summed in single precision until most pairs are out.
F32 = np.float32


class _Columns:
    """Feature columns of a run of sorted rows, as arrays."""

    def counted(self, code: int) -> list[tuple[str, int]]:
        """The counted names of a coded text, read once."""
        if code not in self.read:
            self.read[code] = _counts(self.texts[code])
        return self.read[code]

    def __init__(self, rows: pa.RecordBatch, weights: dict[str, float] | None = None):
        def coded(name: str) -> tuple[np.ndarray, list]:
            d = rows.column(name).dictionary_encode()
            return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()

        for n in ("posting_id", "board", "title", "level", "city", "low", "high"):
            setattr(self, n, rows.column(n).to_numpy(zero_copy_only=False))
        self.pass_, self.passes = coded("pass")
        self.company, self.names = coded("company")
        of_name = lambda f, dtype: np.array([f(x) for x in self.names], dtype=dtype)[self.company]
        self.blank = of_name(lambda x: not x, bool)
        self.weight = of_name(lambda x: (weights or {}).get(x, MOST), np.float32)
        self.letters, self.length, self.begins = (x[self.company] for x in _signatures(self.names))
        skills = rows.column("skills")
        width = len(skills[0].as_py()) if len(skills) else 1
        fixed = skills.cast(pa.binary(width))
        self.skills = np.frombuffer(fixed.buffers()[1], dtype=np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(len(fixed), width)
        self.n_skills = np.bitwise_count(self.skills).sum(axis=1)
        # the only counted name of a posting as (code, count); -1 where there is none, -2 where there are several
        code, self.texts = coded("facts")
        self.facts, codes = code, {}
        self.read: dict[int, list[tuple[str, int]]] = {}
        one = [-1 if not f else -2 if "," in f else codes.setdefault(f.split(":")[0], len(codes)) for f in self.texts]
        self.fact = np.array(one, dtype=np.int64)[code]
        self.size = np.array([int(f.split(":")[1]) if k >= 0 else 0 for f, k in zip(self.texts, one)], dtype=np.int64)[code]


def _counts(facts: str) -> list[tuple[str, int]]:
    return [(n, int(k)) for n, k in (p.split(":") for p in facts.split(","))]


def _facts_agree(x: list[tuple[str, int]], y: list[tuple[str, int]]) -> float:
    """Score of two lists of counted names, one of which has several: a shared name of like count helps, nothing shared harms little."""
    shared = [abs(k - m) <= 2 for n, k in x for o, m in y if n == o]
    return 6.0 if any(shared) else -2.0 if shared else -3.0


def _edit_within(a: str, b: str, limit: int) -> bool:
    """Whether two names are within `limit` edits, a swap of neighbours counting as one."""
    if abs(len(a) - len(b)) > limit:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            d = min(row[j] + (x != y), row[j + 1] + 1, cur[j] + 1)
            if before is not None and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, before[j - 1] + 1)
            cur.append(d)
        if min(cur) > limit:
            return False
        before, row = row, cur
    return row[-1] <= limit


def _alike(a: str, b: str) -> float:
    """How much two different company names agree: CLOSE within two edits, PART where one begins with the other, else UNLIKE."""
    short, long = sorted((a, b), key=len)
    if len(short) >= PART_LETTERS and long.startswith(short):
        return PART
    return CLOSE if _edit_within(a, b, 2) else UNLIKE


def _signatures(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, length, begin) of company names, by which _unlike tells most names apart: a bit for each letter and one for its second time, the first PART_LETTERS as a number."""
    data = [x.encode() for x in names]
    length = np.array([len(x) if x.isascii() else -1 for x in names], dtype=np.int64)
    of = np.repeat(np.arange(len(data)), [len(x) for x in data])
    times = np.bincount(of * 32 + (np.frombuffer(b"".join(data), dtype=np.uint8) & 31), minlength=32 * len(data)).reshape(-1, 32)
    letters = np.packbits(np.hstack([times > 0, times > 1]), axis=1).view(np.uint64).ravel()
    begin = np.array([int.from_bytes(x[:PART_LETTERS]) if len(x) >= PART_LETTERS else -1 - k for k, x in enumerate(data)], dtype=np.int64)
    return letters, length, begin


def _unlike(letters: tuple, length: tuple, begin: tuple) -> np.ndarray:
    """Where two different names are surely UNLIKE: two edits change at most four of the letters' bits and two of the length. Names not in ASCII may be alike."""
    (a, b), (m, n) = letters, length
    return ((np.bitwise_count(a ^ b) > 4) | (np.abs(m - n) > 2)) & (begin[0] != begin[1]) & (m >= 0) & (n >= 0)


def compare(c: _Columns, a: slice | np.ndarray, b: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs of the rows `a` with the rows `b`, one by one, that stand in one pass and reach the least threshold."""
    # sides that are stretches of the columns are not copied until most pairs are out
    g = lambda n: (getattr(c, n)[a], getattr(c, n)[b])
    row = lambda side, at: at + side.start if isinstance(side, slice) else side[at]
    if not isinstance(a, slice):
        # different counted names weigh more than all else can make up for
        pa, pb = g("fact")
        able = (pa < 0) | (pb < 0) | (pa == pb)
        a, b = a[able], b[able]
    ta, tb = g("title")
    score = np.where((ta == 0) | (tb == 0), F32(0), np.where(ta == tb, F32(3), F32(-5)))
    (ca, cb), (la, lb) = g("city"), g("level")
    score += np.where((ca == 0) | (cb == 0), F32(0), np.where(ca & cb != 0, F32(1), F32(-4)))
    score += np.where((la == 0) | (lb == 0), F32(0), np.where(la == lb, F32(1), F32(-4)))
    (pa, pb), (sa, sb) = g("fact"), g("size")
    one = (pa >= 0) & (pb >= 0)
    score += np.where(~one, F32(0), np.where(pa != pb, F32(-8), np.where(np.abs(sa - sb) <= 2, F32(6), F32(-2))))
    (ka, kb), (ba, bb) = g("company"), g("blank")
    agree = np.minimum(*g("weight"))
    differ = (ka != kb) & ~(ba | bb)
    score += np.where((ka == kb) & ~ba, agree, F32(0))
    several = ~one & (pa != -1) & (pb != -1)
    (oa, ob), (xa, xb), (ia, ib) = g("board"), g("pass_"), g("posting_id")
    least = np.where(oa == ob, F32(REPOST_THRESHOLD), F32(THRESHOLD))
    # what is not yet compared - pay, skills, several names, names of companies - can add so much; the rest is compared no further
    may = (score + 5 + 6 * several + differ * np.minimum(agree, F32(CLOSE)) >= least) & (xa == xb) & (ia != ib)
    at = np.flatnonzero(may)
    i, j = row(a, at), row(b, at)
    score, several, least, agree, differ = (x[at].astype(np.float64) if x.dtype == np.float32 else x[at] for x in (score, several, least, agree, differ))
    unlike = differ & _unlike(*((x[i], x[j]) for x in (c.letters, c.length, c.begins)))
    score[unlike] += np.minimum(agree[unlike], UNLIKE)
    differ &= ~unlike
    maybe = score + 5 + 6 * several + differ * np.minimum(agree, CLOSE) >= least
    i, j, score, several, least, agree, differ = (x[maybe] for x in (i, j, score, several, least, agree, differ))
    (l1, l2), (h1, h2) = (c.low[i], c.low[j]), (c.high[i], c.high[j])
    stated = ((l1 > 0) | (h1 > 0)) & ((l2 > 0) | (h2 > 0))
    half = ((l1 > 0) & ((l1 == l2) | (l1 == h2))) | ((h1 > 0) & ((h1 == h2) | (h1 == l2)))
    score = score + np.where(~stated, 0.0, np.where((l1 == l2) & (h1 == h2), 3.0, np.where(half, 2.0, -4.0)))
    shared = np.bitwise_count(c.skills[i] & c.skills[j]).sum(axis=1, dtype=np.int64)
    na, nb = c.n_skills[i], c.n_skills[j]
    ratio = shared / np.maximum(np.minimum(na, nb), 1)
    score = score + np.where((na == 0) | (nb == 0), 0.0, np.where(ratio >= 0.75, 2.0, np.where(ratio >= 0.5, 1.0, -2.0)))
    near = score + 6 * several + differ * np.minimum(agree, CLOSE) >= least
    i, j, score, several, least, agree, differ = (x[near] for x in (i, j, score, several, least, agree, differ))
    for k in np.flatnonzero(several):
        score[k] += _facts_agree(c.counted(c.facts[i[k]]), c.counted(c.facts[j[k]]))
    alike: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(differ & (score + np.minimum(agree, CLOSE) >= least)):
        pair = (min(c.company[i[k]], c.company[j[k]]), max(c.company[i[k]], c.company[j[k]]))
        if pair not in alike:
            alike[pair] = _alike(c.names[pair[0]], c.names[pair[1]])
        score[k] += min(agree[k], alike[pair])
        differ[k] = False
    score[differ] = -np.inf  # even close names would not do
    keep = score >= least
    return i[keep], j[keep], score[keep]


PAIRS = "id_a long, id_b long, board_a int, board_b int, score double"


def _emit(c: _Columns, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    a, b = c.posting_id[i], c.posting_id[j]
    flip = (c.board[i] > c.board[j]) | ((c.board[i] == c.board[j]) & (a > b))
    i, j = np.where(flip, j, i), np.where(flip, i, j)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (c.posting_id[i], c.posting_id[j], c.board[i], c.board[j], s)], names=["id_a", "id_b", "board_a", "board_b", "score"])


#: Pairs that are compared at a time beyond the window.
CHUNK = 32_768


def _reach(c: _Columns, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end): each row of a block that is compared whole is to be compared with the rows from begin to before end that stand before it.

    With counted names (passes c and d) those of a count up to 2 less; in passes a and f only rows that leave out what the pass is about, the title or the
    company, which stand first in their block; else the block.
    """
    n = rows.num_rows
    at = np.arange(n)
    whole = rows.column("block").is_valid().to_numpy(zero_copy_only=False)
    block = rows.column("block").fill_null(0).to_numpy(zero_copy_only=False)
    new = np.r_[True, (block[1:] != block[:-1]) | (c.pass_[1:] != c.pass_[:-1]) | (whole[1:] != whole[:-1])]
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)[number]
    # counts stand in order within a block; those beyond 2**40 count as one, which compares more than it must
    value = rows.column("value").to_numpy(zero_copy_only=False)
    order = (number.astype(np.int64) << 42) + np.minimum(value - value[first], 1 << 40)
    begin = np.maximum(np.searchsorted(order, order - 2), first)
    code = {p: k for k, p in enumerate(c.passes)}
    end = at.copy()
    for p, lacks in (("a", c.title == 0), ("f", c.blank)):
        mine = c.pass_ == code.get(p, -1)
        last = np.maximum.accumulate(np.where(lacks & mine, at + 1, 0))
        end = np.where(mine, np.minimum(end, last), end)
    return begin, np.where(whole, end, begin)


def _kept(rows: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """The rows that later ones are to be compared with: the last `window`, and before them those of the last block that reach so far."""
    n = rows.num_rows
    if n <= window:
        return rows
    last = n - 1
    final = rows.column("pass")[last].as_py()
    tail = np.arange(n - window, n)
    if rows.column("block")[last].as_py() is None:
        return rows.slice(n - window)
    begin, end = _reach(_Columns(rows), rows)
    before = np.arange(begin[last], max(min(end[last], n - window), begin[last]))
    if final not in ("a", "f"):
        return rows.slice(min(int(begin[last]), n - window))
    return pa.RecordBatch.from_struct_array(rows.to_struct_array().take(pa.array(np.r_[before, tail])))


def _slide(rows: pa.RecordBatch, carried: int, window: int, weights: dict[str, float] | None = None, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs within the window, and within blocks if `whole`, among rows in order; the first `carried` rows were compared with each other already."""
    c = _Columns(rows, weights)
    n = rows.num_rows
    for step in range(1, window + 1):
        begin = max(step, carried)
        if begin < n:
            i, j, s = compare(c, slice(begin - step, n - step), slice(begin, n))
            if len(i):
                yield _emit(c, i, j, s)
    if not whole or n <= window:
        return
    begin, end = _reach(c, rows)
    far = np.maximum(np.minimum(end, np.arange(n) - window) - begin, 0)
    far[:carried] = 0
    later = np.flatnonzero(far)
    done = np.r_[0, np.cumsum(far[later])]
    low = 0
    while low < len(later):
        high = max(int(np.searchsorted(done, done[low] + CHUNK, side="right")) - 1, low + 1)
        mine = later[low:high]
        i, j, s = compare(c, np.arange(done[high] - done[low]) + np.repeat(begin[mine] - done[low:high] + done[low], far[mine]), np.repeat(mine, far[mine]))
        if len(i):
            yield _emit(c, i, j, s)
        low = high


def company_weights(rows: DataFrame) -> dict[str, float]:
    """What the agreement of each frequent company weighs; all others weigh MOST. At most 1 / RARE companies are frequent."""
    n = rows.count()
    common = rows.filter(F.col("company") != "").groupBy("company").count().filter(F.col("count") > RARE * n).collect()
    fall = (MOST - LEAST) / np.log(COMMON / RARE)
    return {r[0]: float(max(LEAST, MOST - fall * np.log(r[1] / n / RARE))) for r in common}


def keyed_rows(rows: DataFrame, heavy: list[str]) -> DataFrame:
    """`rows` once for each of their keys, with pass, key, rest, whole and value (see _sort_keys)."""
    keys, names = _sort_keys(heavy), rows.columns
    # the pass is a key's first byte: sorting looks at the first eight bytes of a key before anything else
    entry = lambda p, block, rest, whole, value: F.struct(F.lit(p).alias("pass"), F.concat(F.lit(p).cast("binary"), block).alias("key"), rest.alias("rest"), whole.alias("whole"), value.alias("value"))

    def each(rows: DataFrame, keys: list) -> DataFrame:
        # columns turned into rows: an array of the keys, exploded, takes three times the CPU seconds
        entries = [entry(*k).alias(f"__{i}") for i, k in enumerate(keys)]
        return rows.select(*names, *entries).unpivot(names, [f"__{i}" for i in range(len(keys))], "__of", "__k").select(*names, "__k.*")

    named = rows.filter("facts != ''").select("*", F.explode(F.split("facts", ",")).alias("fact"))
    both = each(rows, [k for k in keys if k[0] not in FACT_PASSES]).unionByName(each(named, [k for k in keys if k[0] in FACT_PASSES]))
    return both.filter(F.col("key").isNotNull())


def neighbour_pairs(rows: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(id_a, id_b, board_a, board_b, score): the best score of every pair that reaches its threshold in some pass.

    Rows keep their places over all partitions: a border is compared with the `window` rows before and after it, however many
    partitions those stand in. A block that is compared whole stands in one partition.
    """
    weights = company_weights(rows)
    keyed = keyed_rows(rows, [name for name, weight in weights.items() if weight < LIGHT])
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    # equal keys in an order that mixes the boards, whose ids may lie in ranges apart, and differs by pass
    mixed = F.xxhash64("pass", "posting_id")
    cut = lambda x: F.when(~F.col("whole"), x)
    ordered = keyed.repartitionByRange(parts, "key", cut(F.col("rest")), cut(mixed), cut(F.col("posting_id"))).sortWithinPartitions("key", "rest", mixed, "posting_id")
    ordered = ordered.withColumn("block", F.when(F.col("whole"), F.hash("key"))).drop("key", "rest", "whole").withColumn("place", F.monotonically_increasing_id())
    ordered = checkpointed(ordered)  # fixes the order that the readings below need
    # such an id is the partition's number over a row's number in it
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = dict(ordered.groupBy(part.alias("part")).count().collect())  # one number per partition
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    borders = np.array(sorted(starts.values())[1:], dtype=np.int64)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            run = batch if tail is None else pa.concat_batches([tail, batch])
            yield from _slide(run, 0 if tail is None else tail.num_rows, window, weights, True)
            tail = _kept(run, window)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            place = np.array([starts[int(x) >> 33] + (int(x) & ((1 << 33) - 1)) for x in pdf["place"]], dtype=np.int64)
            low, high = np.searchsorted(borders, place - window + 1), np.searchsorted(borders, place + window, side="right")
            hits = np.maximum(high - low, 0)
            if hits.any():
                pick = np.repeat(np.arange(len(pdf)), hits)
                border = np.concatenate([borders[a:b] for a, b in zip(low, high)])
                yield pdf.iloc[pick].assign(border=border, place=place[pick])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        carried = int((pdf["place"] < pdf["border"]).sum())
        found = list(_slide(pa.RecordBatch.from_pandas(pdf), carried, window, weights)) if 0 < carried < len(pdf) else []
        return pa.Table.from_batches(found).to_pandas() if found else pd.DataFrame(columns=["id_a", "id_b", "board_a", "board_b", "score"])

    # only rows this near to an end of their partition can be near a border
    sizes = F.create_map(*(F.lit(int(x)) for kv in counts.items() for x in kv)) if counts else F.create_map(F.lit(0), F.lit(0))
    near = ordered.filter((at < window) | (at >= F.try_element_at(sizes, part.cast("int")) - window))
    schema = ordered.schema.simpleString()[len("struct<") : -1]
    beside = near.mapInPandas(edges, schema + ",border long").groupBy("border").applyInPandas(across, PAIRS)
    pairs = ordered.mapInArrow(inside, PAIRS).unionByName(beside)
    return pairs.groupBy("id_a", "id_b", "board_a", "board_b").agg(F.max("score").alias("score"))


#: Bounds of the auctions that once matched large components. Every component is matched exactly now; only tests still read them.
EXACT_WORK, TASK_EDGES, STEP, FAR_STEP = 2_000_000, 5_000_000, 1 / 32, 0.5


def _exact(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Edges of a matching of greatest total weight (weights above 0), by shortest augmenting paths with potentials."""
    order = np.argsort(a, kind="stable")
    first = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
    begin = [*first.tolist(), len(a)]
    things, worth = b[order], w[order]
    u = np.maximum.reduceat(worth, first).tolist()
    p: dict[int, float] = {}
    mate_a: dict[int, tuple[int, int]] = {}
    mate_b: dict[int, int] = {}
    for root in range(len(first)):
        # distances over reduced costs u + p - w; a path may end at a free b, or leave its last a unmatched at the cost u
        dist_a, dist_b, via = {root: 0.0}, {}, {}
        heap: list[tuple[float, int, int]] = [(0.0, 0, root)]
        done_a: set[int] = set()
        best, end = u[root], (0, root)
        while heap:
            d, _, x = heapq.heappop(heap)
            if d >= best:
                break
            if x in done_a:
                continue
            done_a.add(x)
            if d + u[x] < best:
                best, end = d + u[x], (0, x)
            mine = slice(begin[x], begin[x + 1])
            for y, v, k in zip(things[mine].tolist(), worth[mine].tolist(), range(mine.start, mine.stop)):
                to = d + u[x] + p.get(y, 0.0) - v
                if to < dist_b.get(y, best):
                    dist_b[y], via[y] = to, (x, k)
                    if y not in mate_b:
                        if to < best:
                            best, end = to, (1, y)
                    else:
                        z = mate_b[y]
                        if to < dist_a.get(z, np.inf):
                            dist_a[z] = to
                            heapq.heappush(heap, (to, 1, z))
        for x, d in dist_a.items():
            if d < best:
                u[x] -= best - d
        for y, d in dist_b.items():
            if d < best:
                p[y] = p.get(y, 0.0) + best - d
        side, at = end
        if side == 0:
            if at == root:
                continue
            y = mate_a.pop(at)[0]
        else:
            y = at
        while True:
            x, k = via[y]
            before = mate_a.get(x)
            mate_a[x], mate_b[y] = (y, k), x
            if x == root:
                break
            y = before[0]
    return order[[k for _, k in mate_a.values()]]


def assign(edges: DataFrame) -> DataFrame:
    """One-to-one matching of (id_a, id_b, score) whose scores above EVEN, the log odds of the confidence, have the greatest sum.

    An edge whose ends have no other is taken at once. The rest falls into connected components, each of which one task
    matches exactly, whatever its size. No edge is dropped unmatched while both its ends are free. The sides'
    ids may overlap. Scores up to EVEN are never matched; null ids are dropped.
    """
    rows = checkpointed(edges.select("id_a", "id_b", "score").filter(F.col("id_a").isNotNull() & F.col("id_b").isNotNull() & (F.col("score") > EVEN)).groupBy("id_a", "id_b").agg(F.max("score").alias("score")))
    degrees = [rows.groupBy(x).agg(F.count("*").alias(f"n_{x}")) for x in ("id_a", "id_b")]
    rows = checkpointed(rows.join(degrees[0], "id_a").join(degrees[1], "id_b"))
    alone = (F.col("n_id_a") == 1) & (F.col("n_id_b") == 1)
    single, rest = rows.filter(alone).select("id_a", "id_b", "score"), rows.filter(~alone).drop("n_id_a", "n_id_b")
    # two sides may use one number: a is even, b odd in the graph
    node = lambda c, k: F.xxhash64(F.lit(k), F.col(c))
    graph = checkpointed(rest.withColumns({"a": node("id_a", 0), "b": node("id_b", 1)}))
    ids = graph.select(F.col("a").alias("id")).unionByName(graph.select(F.col("b").alias("id"))).distinct()
    of = components(graph.select("a", "b"), ids)
    whole = checkpointed(graph.join(of.select(F.col("id").alias("a"), "component"), "a").select("component", "id_a", "id_b", "score"))

    def match(edges: pa.Table) -> pa.Table:
        edges = edges.select(["id_a", "id_b", "score"]).sort_by([("id_a", "ascending"), ("id_b", "ascending")])
        a, b, score = (edges.column(c).to_numpy() for c in ("id_a", "id_b", "score"))
        return edges.take(pa.array(_exact(a, b, score - EVEN)))

    return single.unionByName(whole.groupBy("component").applyInArrow(match, "id_a long, id_b long, score double"))


def link(postings: DataFrame, titles: Keys, skills: Keys, affixes: Affixes = Affixes(), window: int = WINDOW) -> DataFrame:
    """(id_a, id_b, score, confidence): postings of board 0 and board 1 that are the same job.

    The one-to-one assignment joins jobs; a posting that is a job's other posting on its own board and fits the
    partner gets the partner too. confidence is the logistic of the score above EVEN.
    """
    rows = checkpointed(features(postings, titles, skills, affixes))
    rows = checkpointed(with_titles(rows, titles))
    pairs = checkpointed(neighbour_pairs(rows, window))
    cross = pairs.filter("board_a != board_b")
    again = pairs.filter("board_a = board_b").select("id_a", "id_b")
    again = again.unionByName(again.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    one = checkpointed(assign(cross))
    b2 = again.select(F.col("id_a").alias("id_b"), F.col("id_b").alias("other"))
    a2 = again.select(F.col("id_a").alias("id_a"), F.col("id_b").alias("other"))
    more_b = one.join(b2, "id_b").select("id_a", F.col("other").alias("id_b"))
    more_a = one.join(a2, "id_a").select(F.col("other").alias("id_a"), "id_b")
    more = more_b.unionByName(more_a).distinct().join(cross.select("id_a", "id_b", "score"), ["id_a", "id_b"])
    out = one.unionByName(more.select("id_a", "id_b", "score")).groupBy("id_a", "id_b").agg(F.max("score").alias("score"))
    return out.withColumn("confidence", F.round(1 / (1 + F.exp(-0.6 * (F.col("score") - EVEN))), 6))
