"""Scalar functions of the scoring and audit queries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score of each verdict and confidence.
SCORES = {
    ("correct", "high"): 0.95,
    ("correct", "medium"): 0.80,
    ("correct", "low"): 0.65,
    ("incorrect", "low"): 0.35,
    ("incorrect", "medium"): 0.20,
    ("incorrect", "high"): 0.05,
}
# Greek letters and their Latin names.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega"}

# The name and the short form of every Greek letter, in the order in which names are replaced.
GREEK_SHORT = {
    "alpha": ("α", "a"), "beta": ("β", "b"), "gamma": ("γ", "g"), "delta": ("δ", "d"), "epsilon": ("ε", "e"), "zeta": ("ζ", "z"),
    "eta": ("η", "h"), "theta": ("θ", "q"), "iota": ("ι", "i"), "kappa": ("κ", "k"), "lambda": ("λ", "l"), "mu": ("μ", "m"),
    "nu": ("ν", "n"), "omicron": ("ο", "o"), "pi": ("π", "p"), "rho": ("ρ", "r"), "sigma": ("σ", "s"), "tau": ("τ", "t"),
    "phi": ("φ", "f"), "chi": ("χ", "c"), "psi": ("ψ", "y"), "omega": ("ω", "w"),
}
# Tokens of names that tell nothing, and the Greek letters that are spelled out before names are cut.
GENERIC_TOKENS = """protein proteins factor factors receptor receptors ligand ligands phosphatase phosphatases kinase kinases
enzyme enzymes subunit family complex domain binding inhibitor activator substrate type alpha beta gamma delta 1 2 3 4 5
the of and a an for to by or""".split()
TOKEN_GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa", "ε": "epsilon", "ζ": "zeta", "η": "eta"}
# Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[.?!])\s+(?=[A-Z(])"


def score_of(verdict: Column, confidence: Column) -> Column:
    """The score of a verdict; a missing confidence counts as medium, any other verdict scores 0.5."""
    c = F.coalesce(confidence, F.lit("medium"))
    out = F.lit(0.5)
    for (v, k), s in SCORES.items():
        out = F.when((verdict == v) & (c == k), s).otherwise(out)
    return out


def confidence_of(score: Column) -> Column:
    """high at 0.4 or more from one half, medium at 0.2 or more, else low; null of null."""
    far = F.round(F.abs(score - 0.5), 9)
    return F.when(far >= 0.4, "high").when(far >= 0.2, "medium").when(far.isNotNull(), "low")


def shrunk(score: Column, by: float = 0.85, edge: float = 1e-6) -> Column:
    """The logistic of the logit times ``by``, the score kept ``edge`` away from 0 and 1."""
    x = F.when(score.isNotNull(), F.least(F.lit(1 - edge), F.greatest(F.lit(edge), score)))
    return 1 / (1 + F.exp(-by * F.log(x / (1 - x))))


def plain_alias(c: Column) -> Column:
    """A name in lower case with Greek letters spelled out and nothing but ASCII letters and digits."""
    x = F.lower(c)
    for g, name in GREEK.items():
        x = F.replace(x, F.lit(g), F.lit(name))
    return F.regexp_replace(x, "[^a-z0-9]", "")


def mentions(text: Column, symbol: Column) -> Column:
    """Whether a text holds a symbol regardless of case; one of up to 4 letters must not touch other letters."""
    quoted = F.concat(F.lit(r"(?<![a-z])\Q"), F.lower(symbol), F.lit(r"\E(?![a-z])"))
    return F.when(F.length(symbol) <= 4, F.regexp_like(F.lower(text), quoted)).otherwise(F.contains(F.lower(text), F.lower(symbol)))


def folded_alias(c: Column) -> Column:
    """A name in lower case with Greek letters and their names in short form and nothing but letters and digits.

    p38\u03b1, p38-alpha and P38a are all p38a. Null if nothing is left.
    """
    x = F.lower(c)
    for name, (letter, short) in GREEK_SHORT.items():
        x = F.replace(F.replace(x, F.lit(name), F.lit(short)), F.lit(letter), F.lit(short))
    return F.nullif(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""), F.lit(""))


def specific_tokens(c: Column) -> Column:
    """The distinct letter runs and digit runs of a name in lower case, without GENERIC_TOKENS; none for null."""
    x = F.lower(F.coalesce(c, F.lit("")))
    for letter, name in TOKEN_GREEK.items():
        x = F.replace(x, F.lit(letter), F.lit(name))
    return F.array_except(F.regexp_extract_all(x, F.lit(r"[a-z]+|\d+"), F.lit(0)), F.array(*map(F.lit, GENERIC_TOKENS)))


def clauses(text: Column, least: int = 12, most: int = 4) -> Column:
    """The first ``most`` sentences of at least ``least`` characters; a text with fewer than two of them is one clause.

    Null and blank texts have none.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda p: F.length(p) >= least)
    found = F.when(F.size(parts) < 2, F.array(text)).otherwise(F.slice(parts, 1, most))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(found)


def last_verdict(text: Column) -> Column:
    """The verdict of the last "verdict": "..." in a free text; null without one."""
    found = F.regexp_extract_all(text, F.lit(r'"verdict"\s*:\s*"(correct|incorrect|abstain)"'), F.lit(1))
    return F.get(F.reverse(found), F.lit(0))
