"""Modification sites in all written forms; Python, since the letter form depends on the text around it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from proofloom.functions import textrules

_NAMES = {"s": "Ser", "t": "Thr", "y": "Tyr", "ser": "Ser", "thr": "Thr", "tyr": "Tyr", "lys": "Lys", "serine": "Ser", "threonine": "Thr", "tyrosine": "Tyr", "lysine": "Lys"}
_LONG = re.compile(r"\b(serine|threonine|tyrosine|lysine|ser|thr|tyr|lys)[-\s]+(\d{1,4})\b", re.IGNORECASE)
_LETTER = re.compile(r"\b([STY])(?:-|\s)?(\d{1,4})\b")
_CALLOUT = re.compile(r"\b(fig\.?|figure|table|tab\.?|supplementary|suppl?\.?|fig)\s*$", re.IGNORECASE)
_DENIED = frozenset(["S100", "T7", "Y1", "Y2", "Y4", "Y5", "Y6"])
_ENTITY = re.compile(r"^\s*(?:protein|family|receptor|phage|polymerase|kinase|phosphatase|complex|domain|element|expression|levels|transcription|translation|isoform|paralog|orthologue|orthologs?)\b", re.IGNORECASE)
_ANCHOR = re.compile(r"\b(?:phospho(?:rylat\w*)?|de-?phospho\w*|acetylat\w*|methylat\w*|ubiquitin\w*|sumoylat\w*|residue|site|position|amino\s+acid|modified|catalyz\w*)\b", re.IGNORECASE)


def spaced_and_letter_sites(text: str | None) -> list[str]:
    """Sites written serine 102, Ser 102 or S102, as Ser102.

    A letter form counts with a modification word within 50 characters, unless it is a denied name, follows a figure or
    table word, or the next word makes it part of a name.
    """
    out: dict[str, None] = {}
    for m in _LETTER.finditer(text or ""):
        a, b = m.span()
        if f"{m[1]}{int(m[2])}" in _DENIED or _CALLOUT.search(text[max(0, a - 20) : a]) or _ENTITY.match(text[b : b + 30]):
            continue
        if int(m[2]) and _ANCHOR.search(text[max(0, a - 50) : a] + " " + text[b : b + 50]):
            out[f"{_NAMES[m[1].lower()]}{int(m[2])}"] = None
    for m in _LONG.finditer(text or ""):
        if int(m[2]):
            out[f"{_NAMES[m[1].lower()]}{int(m[2])}"] = None
    return list(out)


_more = F.udf(spaced_and_letter_sites, ArrayType(StringType()), useArrow=True)


def sites(text: Column) -> Column:
    """Distinct modification sites of all forms as residue and position (Ser57); null and empty texts have none."""
    return F.array_union(F.coalesce(textrules.sites(text), F.array().cast("array<string>")), _more(text))
