"""Labels of annotated skills, as annotators write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the two labels, folded to lower case with single blanks. Fixed vocabulary.
REQUIRED = ("required_skill", "required skill", "required", "must have", "must-have", "mandatory", "bắt buộc", "bat buoc", "yêu cầu", "必須", "필수")
PREFERRED = ("preferred_skill", "preferred skill", "preferred", "nice to have", "nice-to-have", "optional", "plus", "ưu tiên", "uu tien", "歓迎", "우대")


def required_vote(label: Column) -> Column:
    """1 for a spelling of required_skill, 0 for one of preferred_skill, null for anything else (abstained)."""
    x = F.lower(F.trim(F.regexp_replace(label, r"[\s\u00a0]+", " ")))
    return F.when(x.isin(*REQUIRED), 1).when(x.isin(*PREFERRED), 0)


def label_name(label: Column) -> Column:
    """required_skill, preferred_skill or null."""
    vote = required_vote(label)
    return F.when(vote == 1, "required_skill").when(vote == 0, "preferred_skill")
