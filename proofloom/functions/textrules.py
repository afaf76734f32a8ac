"""Text rules over evidence sentences as column expressions; every list is a parameter."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Residues by their letter.
RESIDUES = {"S": "Ser", "T": "Thr", "Y": "Tyr", "K": "Lys"}
HEDGES = ("may", "might", "could", "possibly", "hypothesise", "suggest", "suggests", "likely", "putative")
#: Relation patterns: name, sign, Java pattern, group of the agent, group of the target.
NAME = r"([A-Z][A-Z0-9]*\d[A-Z0-9]*)"
CATALOG = [
    ("activates", 1, rf"{NAME} (?:\w+ly )?activates {NAME}", 1, 2),
    ("inhibits", -1, rf"{NAME} (?:\w+ly )?inhibits {NAME}", 1, 2),
    ("blocked_by", -1, rf"{NAME} is blocked by {NAME}", 2, 1),
    ("phosphorylates", 1, rf"{NAME} (?:\w+ly )?phosphorylates {NAME}", 1, 2),
    ("phosphorylated_by", 1, rf"{NAME} is phosphorylated by {NAME}", 2, 1),
    ("binds", 0, rf"{NAME} (?:binds|docks onto|co-precipitates with) {NAME}", 1, 2),
    ("raises", 1, rf"{NAME} raises {NAME} mRNA", 1, 2),
    ("induced_by", 1, rf"{NAME} expression is induced by {NAME}", 2, 1),
    ("repressed_by", -1, rf"{NAME} expression is repressed by {NAME}", 2, 1),
]


def sites(text: Column) -> Column:
    """Distinct modification sites as residue and position (Ser57), in order; one-letter forms are spelled out."""
    full = F.regexp_extract_all(text, F.lit(r"\b((?:Ser|Thr|Tyr|Lys)-?\d{1,4})\b"), F.lit(1))
    return F.array_distinct(F.transform(full, lambda s: F.replace(s, F.lit("-"), F.lit(""))))


def site_of(residue: Column, position: Column) -> Column:
    """One spelling of a site given by a residue letter or name and a position; null without a position."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv]), F.upper(residue)), F.initcap(residue), F.lit(""))
    return F.when(position.isNotNull() & (position != ""), F.concat(name, position))


def hedged(text: Column, words: tuple[str, ...] = HEDGES) -> Column:
    """Whether a sentence holds a hedging word; null of null."""
    return F.lower(text).rlike(r"\b(?:" + "|".join(words) + r")\b")


# Markers of a hedge, the characters it may be away from a name, and what parts clauses.
HEDGE_MARKERS = (
    "may", "could", "might", "would", "is thought to", "are thought to", "is believed to", "are believed to", "appears to",
    "appear to", "appears as", "we hypothesize", "we propose", "we suggest", "we postulate", "likely", "possibly", "putatively",
    "presumably", "presumably to",
)
HEDGE_REACH = 60
CLAUSE_BREAK = r"[;:—]|--|\.\s+[A-Z(]"


def local_hedges(text: Column, names: Column) -> Column:
    """The HEDGE_MARKERS of a text that stand within HEDGE_REACH characters of one of ``names`` and in its clause, in order.

    Names under two characters are left out; null texts and names have no hedges. The test is made on Arrow batches.
    """
    marker = re.compile(r"\b(?=(" + "|".join(map(re.escape, sorted(HEDGE_MARKERS, key=len, reverse=True))) + r")\b)")
    starts = [(re.compile(rf"\b{re.escape(m)}\b"), m) for m in HEDGE_MARKERS]
    breaks = re.compile(CLAUSE_BREAK)

    def near(t: str | None, ns) -> list[str]:
        low = (t or "").lower()
        if not marker.search(low):
            return []
        spans = [m.span() for n in (ns if ns is not None else []) if n and len(n) > 1 for m in re.finditer(rf"\b{re.escape(n.lower())}\b", low)]
        if not spans:
            return []
        at = [m.start() for m in breaks.finditer(t)]

        def reaches(a: int, b: int, c: int, d: int) -> bool:
            """Whether a marker [a, b) and a name [c, d) are close and nothing parts them."""
            low, high = (b, c) if b <= c else (d, a)
            return a <= d + HEDGE_REACH and b >= c - HEDGE_REACH and bisect_left(at, low) == bisect_left(at, max(low, high))

        return [name for find, name in starts if any(reaches(*m.span(), c, d) for m in find.finditer(low) for c, d in spans)]

    @F.pandas_udf("array<string>")
    def found(t: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([near(x, y) for x, y in zip(t, ns)])

    return found(text, names)


def alias_positions(text: Column, aliases: Column) -> Column:
    """Where any of ``aliases`` stands in a text as whole words, regardless of case: places from 0, in order, each once.

    Aliases under two characters are left out; null and empty texts and null aliases have no places.
    """
    known = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.length(a) >= 2)

    def places(a: Column) -> Column:
        pieces = F.split(text, F.concat(F.lit(r"(?i)\b\Q"), a, F.lit(r"\E\b")), -1)
        ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)) + F.length(a), F.lit(0)) + F.length(p))))
        return F.when(F.size(pieces) > 1, ends).otherwise(F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(known, places))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(found)


def nominalizations(text: Column, most: int = 6) -> Column:
    """The first ``most`` distinct nouns in -ation or -ition that an ``of`` follows, in lower case."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[ (])([a-z]{4,}(?:at|it)ion) of "), F.lit(1))), 1, most)


def mediators(text: Column) -> Column:
    """Names after via, through or upstream/downstream of, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i:\b(?:via|through|upstream of|downstream of|mediated by))(?: [a-z0-9-]+){{0,4}}? {NAME}"), F.lit(1)))


def _pair(name: str, sign: int):
    return lambda x, y: F.struct(F.lit(name).alias("relation"), F.lit(sign).alias("sign"), x.alias("agent"), y.alias("target"))


def relations(texts: DataFrame, key: str, text: str, catalog: list[tuple[str, int, str, int, int]] = CATALOG) -> DataFrame:
    """(key, relation, sign, agent, target): distinct matches of every pattern; an agent that is its target is left out.

    All patterns run in one pass over the table; null and empty texts have no matches.
    """
    found = []
    for name, sign, pattern, a, b in catalog:
        agents, targets = (F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)) for g in (a, b))
        found.append(F.zip_with(agents, targets, _pair(name, sign)))
    x = texts.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("r"))
    return x.select(key, "r.*").filter("agent <> target")


def bound(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations whose both names are aliases (alias, canonical, position) of something; the first canonical by position wins."""
    first = aliases.groupBy("alias").agg(F.min_by("canonical", F.struct("position", "canonical")).alias("canonical"))
    a, b = first.select(F.col("alias").alias("agent"), F.col("canonical").alias("agent_id")), first.select(F.col("alias").alias("target"), F.col("canonical").alias("target_id"))
    return found.join(a, "agent").join(b, "target").filter("agent_id <> target_id")
