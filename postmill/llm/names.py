"""Comparable forms of company names and places of postings."""

from __future__ import annotations

import re
from functools import lru_cache

from postmill.llm.entries import fold

#: Words of company names that don't tell companies apart: legal forms and the country. Fixed vocabulary, folded.
LEGAL = re.compile(
    r"\b(cong ty|cty|chi nhanh|tnhh|mtv|mot thanh vien|co phan|cong nghe|cp|tap doan|jsc|pte ltd|co ltd|co|ltd|limited|llc|inc|corp|corporation|incorporated|company|group|holdings|vietnam|viet nam|vn)\b"
)
#: Spellings of cities, folded. Fixed vocabulary.
CITIES = {
    "hcm": "ho chi minh|hcm|sai gon|saigon|tphcm", "hn": "ha noi|hanoi|hn", "dn": "da nang|danang", "hp": "hai phong|haiphong", "ct": "can tho|cantho",
    "bd": "binh duong", "dna": "dong nai|dongnai", "bn": "bac ninh|bacninh", "hue": "hue|thua thien hue", "kh": "nha trang|khanh hoa", "qn": "quang ninh|ha long",
    "vt": "vung tau|ba ria vung tau", "la": "long an", "hy": "hung yen", "lc": "da lat|lam dong", "na": "nghe an|vinh", "qna": "quang nam|hoi an", "bdi": "binh dinh|quy nhon",
}
_CITY_BIT = {name: 1 << i for i, names in enumerate(CITIES.values()) for name in names.split("|")}
_CITY = re.compile(rf"\b(?:{'|'.join(sorted(_CITY_BIT, key=len, reverse=True))})\b")


@lru_cache(maxsize=100_000)
def company_key(name: str | None) -> str:
    """What a company is known by: folded, without legal words, abbreviations in parentheses, blanks and marks."""
    t = re.sub(r"[.,]", " ", re.sub(r"\([^)]*\)", " ", fold(name or "")))
    return re.sub(r"\W+", "", LEGAL.sub(" ", t))


@lru_cache(maxsize=100_000)
def city_bits(place: str | None) -> int:
    """The cities a place names, one bit each."""
    bits = 0
    for name in _CITY.findall(fold(place or "").replace("-", " ")):
        bits |= _CITY_BIT[name]
    return bits
