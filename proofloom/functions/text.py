"""Words and keys as column expressions and as Python functions that agree with them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def words(text: Column | str) -> Column:
    """Lower-case runs of letters or digits, in order; null and empty texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def words_of(text: str | None) -> list[str]:
    """The words of one text, as ``words`` gives them."""
    return _WORD.findall((text or "").lower())


def key(c: Column | str) -> Column:
    """A key without outer white space and in lower case; null if nothing is left."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(x != "", x)
