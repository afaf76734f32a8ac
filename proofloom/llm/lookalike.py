"""Visually identical text: one consistent spelling per look-alike class.

Tokens (runs between blanks) are looked up in tries of the corpus's own well-formed vocabulary by an edit automaton
that reads the raw token. Its free moves skip an ignorable character, take a look-alike or presentation form for its
letters, and take a letter with its loose accents for the composed one; every other edit costs 1. The budget is 0, so
only visually identical spellings are accepted. A token takes the accepted spelling that equals its table spelling,
else the most frequent one, else (no vocabulary entry) its table spelling. Equality at cost 0 is an equivalence
relation, so all members of a class take the same spelling.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.lineage import cut
from proofloom.operators.skew import product_join

# Look-alike letters and the letter each one is read as.
CYRILLIC = "АВЕЅІЈКМНОРСТХаеорсухѕіј"
CYRILLIC_AS = "ABESIJKMHOPCTXaeopcyxsij"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"
GREEK_AS = "ABEZHIKMNOPTYXvo"
MORE = "ԚԜӀһԁԛԝӏϹϳϲͿՕՏօսհո"
MORE_AS = "QWIhdqwlCjcJOSouhn"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHGZSLCPKB"
# Code points that are ignored by default when text is shown (first and last of each range).
IGNORABLE_RANGES = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Hyphens that look like the ordinary one.
HYPHENS = "‐‑"

_AS = dict(zip(CYRILLIC + GREEK + MORE + CHEROKEE, CYRILLIC_AS + GREEK_AS + MORE_AS + CHEROKEE_AS)) | dict.fromkeys(HYPHENS, "-")
_GONE = {i: None for a, b in IGNORABLE_RANGES for i in range(a, b + 1)}
#: Characters from which runs of suspects are merged, and the gap that is.
MERGE_FROM, MERGE_GAP = 0x0600, 0x1000
#: Planes from here on hold nothing that the table changes, but for the tags and selectors from TAGS to TAGS_END.
PLANES, TAGS, TAGS_END = 0x30000, 0xE0000, 0xE1000
#: Tokens per trie.
BUCKET = 20_000


@lru_cache(200_000)
def fold(c: str) -> str:
    """What one composed character is read as: blanks as a blank, wide and presentation forms as their letters."""
    if c in _AS:
        return _AS[c]
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    how = unicodedata.decomposition(c).partition(" ")[0]
    if how in ("<wide>", "<narrow>", "<noBreak>") or how == "<compat>" and (kind[0] == "L" or kind == "Nl"):
        return "".join(_AS.get(x, x) for x in unicodedata.normalize("NFKC", c))
    return c


def table_spelling(text: str) -> str:
    """The spelling by the table alone: ignorables dropped, accents composed, every character folded."""
    x = unicodedata.normalize("NFC", text.translate(_GONE))
    return unicodedata.normalize("NFC", "".join(map(fold, x)))


def well_formed(token: str) -> bool:
    """True for a composed token without ignorables or presentation forms whose letters are of one script."""
    if token != unicodedata.normalize("NFC", token.translate(_GONE)):
        return False
    own = any(c not in _AS and unicodedata.category(c)[0] == "L" for c in token)
    scripts = {unicodedata.name(c, "?").partition(" ")[0] for c in token if unicodedata.category(c)[0] == "L"}
    return own and len(scripts) == 1 and all(c in _AS or fold(c) == c for c in token)


class Trie:
    """Vocabulary trie searched by the edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        at = self.root
        for c in word:
            at = at.setdefault(c, {})
        at[""] = at.get("", 0) + count

    def search(self, token: str, budget: int = 0) -> dict[tuple[str, int], int]:
        """Accepted (word, count) with their costs, at most ``budget``, for a raw token."""
        units = list(readings(token))
        found: dict[tuple[str, int], int] = {}
        todo = [(self.root, 0, 0, 0, "")]
        seen: dict[tuple[int, int, int], int] = {}
        while todo:
            node, i, j, cost, word = todo.pop()
            if seen.get((id(node), i, j), budget + 1) <= cost:
                continue
            seen[id(node), i, j] = cost
            while i < len(units) and j >= len(units[i]):  # a unit read to its end, or an ignorable one: free
                i, j = i + 1, 0
            left = units[i][j] if i < len(units) else None
            if left is None and "" in node:
                k = (word, node[""])
                found[k] = min(cost, found.get(k, cost))
            for c, child in node.items():
                if not c:
                    continue
                if left is not None and fold(c) == left:
                    todo.append((child, i, j + 1, cost, word + c))
                if cost < budget:
                    todo.append((child, i, j, cost + 1, word + c))
                    if left is not None:
                        todo.append((child, i, j + 1, cost + 1, word + c))
            if cost < budget and left is not None:
                todo.append((node, i, j + 1, cost + 1, word))
        return found


def readings(token: str) -> Iterator[str]:
    """What a raw token's units are read as: an ignorable as nothing, a letter with its loose accents as one letter."""
    at = 0
    while at < len(token):
        if ord(token[at]) in _GONE:
            yield ""
            at += 1
            continue
        end = at + 1
        while end < len(token) and (ord(token[end]) in _GONE or unicodedata.category(token[end])[0] == "M" or "\u1161" <= token[end] <= "\u11ff"):
            end += 1
        yield table_spelling(token[at:end])
        at = end


def best(token: str, found: dict[tuple[str, int], int]) -> str:
    """The canonical spelling: the table spelling if accepted, else the most frequent, else the table spelling."""
    table = table_spelling(token)
    words = dict(found)
    if not words or any(w == table for w, _ in words):
        return table
    return min(words, key=lambda x: (words[x], -x[1], x[0]))[0]


@lru_cache(1)
def suspects() -> str:
    """Java character class of all characters that folding, composing or dropping can change.

    Runs above MERGE_FROM that lie close together are merged, so the class has few ranges; a character that is
    caught without need only costs its token a look-up.
    """
    assigned = [*range(128, 0xD800), *range(0xE000, PLANES), *range(TAGS, TAGS_END)]
    odd = [i for i in assigned if table_spelling(chr(i)) != chr(i)]
    runs: list[list[int]] = []
    for i in odd:
        if runs and i - runs[-1][1] <= (MERGE_GAP if i >= MERGE_FROM else 1):
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return r"[\p{M}ᄀ-ᇿ" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def suspect(c: Column | str) -> Column:
    """Whether a text holds a character of ``suspects``; ASCII texts are told by a plain scan."""
    x = F.col(c) if isinstance(c, str) else c
    return x.rlike(r"[^\x00-\x7F]") & x.rlike(suspects())


def spellings(texts: DataFrame) -> DataFrame:
    """(token, spelling) for every distinct token of ``texts.text`` that holds a character which may be disguised.

    Tokens and vocabulary are counted with partial aggregation, so frequent ones cost one row per task. Tokens meet
    the vocabulary they could match in one trie by a hash of the whole table spelling, which loses nothing at budget 0
    and parts tokens with a common beginning; tries hold about BUCKET tokens. Only vocabulary with the table spelling
    of some suspect token enters a trie.
    """
    tokens = texts.select(F.explode(F.split(F.regexp_replace("text", r"\p{Zs}", " "), " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    tokens = cut(tokens.withColumn("odd", suspect("token")))

    @F.pandas_udf("table string, well boolean")
    def read(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"table": t.map(table_spelling), "well": t.map(well_formed)})

    odd = cut(tokens.filter("odd").withColumn("r", read("token")).select("token", "n", "r.table", F.col("r.well").alias("vocabulary"), F.lit(True).alias("ask")))
    plain = tokens.filter("not odd").select("token", "n", F.col("token").alias("table"), F.lit(True).alias("vocabulary"), F.lit(False).alias("ask"))
    both = cut(odd.unionByName(plain.join(odd.select("table").distinct(), "table", "left_semi").select(odd.columns)))
    buckets = max(1, both.count() // BUCKET)
    both = both.withColumn("bucket", F.pmod(F.xxhash64("table"), F.lit(buckets)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for token, n in pdf.loc[pdf["vocabulary"], ["token", "n"]].itertuples(index=False):
            trie.add(token, n)
        ask = pdf.loc[pdf["ask"], "token"]
        return pd.DataFrame({"token": ask, "spelling": [best(t, trie.search(t)) for t in ask]})

    return both.select("bucket", "token", "n", "vocabulary", "ask").groupBy("bucket").applyInPandas(search, "token string, spelling string")


def consistent(texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (with a column text) and ``form``, the consistent spelling of the text.

    Null stays null and the empty text empty. Blanks of every kind become ordinary ones; tabs, line breaks, the number
    of blanks, letter case, accents, digits and punctuation stay. Texts with no suspect character keep their spelling
    and take no part in any shuffle but the count of tokens. Repeated rows stay and other columns pass through,
    whatever their names (a column ``form`` is replaced).
    """
    some = texts.filter("text is not null").select("text")
    digest = F.md5(F.col("text").cast("binary")).alias("__id")
    odd = cut(some.filter(suspect("text")).distinct().select("text", digest))
    pieces = odd.withColumn("tokens", F.split(F.regexp_replace("text", r"\p{Zs}", " "), " "))
    words = cut(spellings(some))
    asked = pieces.select("__id", F.explode(F.array_distinct(F.filter("tokens", suspect))).alias("token"))
    maps = asked.join(words, "token").groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("m"))
    put = F.transform("tokens", lambda t: F.coalesce(F.element_at("m", t), t))
    spelled = F.when(F.col("m").isNull(), F.array_join("tokens", " ")).otherwise(F.array_join(put, " "))
    forms = pieces.join(maps, "__id", "left").select("__id", spelled.alias("form"))
    keep = texts.drop("form")
    clean = keep.filter(F.col("text").isNull() | ~suspect("text")).withColumn("form", F.col("text"))
    back = keep.filter(suspect("text")).withColumn("__id", digest).join(forms, "__id").drop("__id")
    return clean.unionByName(back)


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct (table_name, key, t, f) with t the digest of the text and f that of its form, of classes with several texts."""
    r = rows.filter("key is not null and text <> ''").select("table_name", "key", "text")
    x = consistent(r).filter("form <> ''")
    x = cut(x.select("table_name", "key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"), F.unhex(F.md5(F.col("form").cast("binary"))).alias("f")).distinct())
    groups = x.groupBy("table_name", "f").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").select("table_name", "f")
    return cut(x.join(groups, ["table_name", "f"], "left_semi"))


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """(table_name, key_a, key_b) for rows (table_name, key, text) of one table that look the same but differ.

    Rows are first made distinct by key and text; only classes with several texts are joined, on their form and in
    blocks, so no class fills a task. Null keys and texts that are null, empty or look empty are never cases.
    """
    m = _classes(rows)
    both = product_join(m.select("table_name", "f", F.col("key").alias("key_a"), F.col("t").alias("ta")), m.select("table_name", "f", F.col("key").alias("key_b"), F.col("t").alias("tb")), ["table_name", "f"])
    return both.filter("key_a < key_b and ta <> tb").select("table_name", "key_a", "key_b").distinct()


def lookalike_classes(rows: DataFrame) -> DataFrame:
    """(table_name, first_key, keys, spellings, links) of every class with several texts, nothing expanded.

    links is the number of pairs of a class's distinct (key, text) that differ in both. Rows as in ``lookalike_pairs``.
    """
    m = _classes(rows)
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    size = m.groupBy("table_name", "f").agg(F.min("key").alias("first_key"), F.count_distinct("key").alias("keys"), F.count_distinct("t").alias("spellings"), F.count("*").alias("n"))
    alike = [m.groupBy("table_name", "f", c).agg(F.count("*").alias("k")).groupBy("table_name", "f").agg(pairs(F.col("k")).alias(f"by_{c}")) for c in ("t", "key")]
    x = size.join(alike[0], ["table_name", "f"]).join(alike[1], ["table_name", "f"])
    links = F.col("n") * (F.col("n") - 1) / 2 - F.col("by_t") - F.col("by_key")
    return x.select("table_name", "first_key", "keys", "spellings", links.cast("bigint").alias("links"))
