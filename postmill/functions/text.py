"""Text normalisation as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words put before a skill in Vietnamese, longest first. Fixed values.
DESCRIPTORS = ("có kinh nghiệm với", "có kinh nghiệm", "hiểu biết về", "kiến thức về", "kinh nghiệm", "kỹ năng", "khả năng", "kĩ năng", "am hiểu")
#: Suffixes of library names. Fixed values.
LIBRARY_SUFFIXES = ("js", "framework", "library")
#: Vietnamese letters with marks and their plain forms. Fixed values, in the order of the plain letters.
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def squash(c: Column) -> Column:
    """Line ends as single blanks, trimmed."""
    return strip(F.regexp_replace(c, r"\r?\n", " "))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case, stripped, Vietnamese letters without marks."""
    return F.translate(strip(F.lower(c)), MARKED, PLAIN)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^\p{ASCII}*$")


def _dots(c: Column) -> Column:
    """A dot stays between two letters of a text shorter than six characters; at the end it goes, elsewhere it becomes a blank."""
    cut = F.regexp_replace(c, r"\.+$", "")
    return F.when(F.length(c) < 6, F.regexp_replace(cut, r"(?<!\p{L})\.|\.(?!\p{L})", " ")).otherwise(F.translate(cut, ".", " "))


def skill_key(c: Column) -> Column:
    """A skill's canonical spelling: lower case, one leading descriptor dropped, joining marks as blanks."""
    t = strip(F.lower(c))
    t = F.regexp_replace(t, rf"^(?:{'|'.join(DESCRIPTORS)}) (?=.*\S)", "")
    t = F.regexp_replace(F.translate(t, "/_", "  "), r"(?<=[a-z0-9])-(?=[a-z0-9])", " ")
    return strip(F.regexp_replace(_dots(t), " +", " "))


def skill_match_key(c: Column) -> Column:
    """A skill's spelling for comparing annotators: marks deleted, one library suffix of a single word dropped."""
    t = collapse(F.translate(strip(F.lower(c)), ".-_/", ""))
    out = t
    for suffix in reversed(LIBRARY_SUFFIXES):
        out = F.when(t.endswith(suffix) & (F.length(t) > len(suffix)), F.substring(t, F.lit(1), F.length(t) - len(suffix))).otherwise(out)
    return F.when(t.contains(" "), t).otherwise(out)


def category_key(c: Column) -> Column:
    """A category without blanks around slashes; "Other" for null and blank."""
    return F.when(blank(c), "Other").otherwise(F.regexp_replace(strip(c), r"\s*/\s*", "/"))


def tokens(c: Column) -> Column:
    """ASCII words, lower case; a run glued to an accented letter is none."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-zA-Z0-9]+\b"), 0)


def url_key(url: Column, base: str) -> Column:
    """A URL without its query, made absolute against `base`."""
    cut = F.substring_index(url, "?", 1)
    return F.when(cut.rlike("^https?://"), cut).when(cut.startswith("/"), F.concat(F.lit(base.rstrip("/")), cut)).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), cut))


def slug(href: Column, prefix: str, stop: tuple[str, ...] = ("search", "login", "all", "companies"), most: int = 50) -> Column:
    """The last path piece after `prefix`; null if it has further pieces, is too long or a stop word."""
    t = F.regexp_replace(F.substring_index(href, "?", 1), rf"^{prefix}", "")
    t = F.regexp_replace(t, r"^/+|/+$", "")
    return F.when((t != "") & ~t.contains("/") & (F.length(t) < most) & ~t.isin(*stop), t)


def file_name(c: Column) -> Column:
    """A text with the characters that file names can't hold as underscores."""
    return F.regexp_replace(c, r'[\\/*?:"<>|]', "_")


def content_hash(values: Column) -> Column:
    """sha256 of an array's JSON in sorted order."""
    return F.sha2(F.to_json(F.array_sort(values)), 256)
