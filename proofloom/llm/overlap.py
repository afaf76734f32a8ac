"""Same or near-same records across splits: a weighted cosine join with maximum-weight and residual-norm pruning.

A text is a vector of word occurrences ("the" the second time is another term). A term's weight falls with the number
of texts that hold it, the same in every text, so a dot product is the sum of the squared weights of the shared terms.
If two texts differ by at most EDITS of the longer one's words, each lacks at most k terms of the other (``_edits``), so
their dot product is at least each one's bound: its squared norm without its k largest squares.

Terms are taken in one global order, from the largest weight on. The first shared terms of two texts in reach are
found by growing sets of shared terms: a set whose inverted lists are short gives its pairs at once, one whose lists
are long is grown by a later term, which leaves shorter lists. A text enters the list of a set only while what it has
skipped so far fits its bound (the accumulated partial dot product plus the residual norm must reach it, and it can
skip no more than k terms). A pair of a list is kept only if the partial dot product, plus the least that the two
residual norms and the largest remaining weight allow, reaches both bounds. Then come the exact dot product and the
exact word edit distance. No pair within the distance is lost: its first m shared terms always form a set that both
texts enter, for every m up to the number of shared terms; texts that may share no more than m terms give their pairs
of a long list as well, since no larger set holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.text import words
from proofloom.lineage import cut, drop
from proofloom.operators.skew import join_keyed, product_join

#: Share of the longer text's words that may differ, in percent.
EDITS = 15
#: Pairs that the two inverted lists of a set may give before the set is grown, and the terms up to which sets grow.
LIST_PAIRS, SET_TERMS = 64, 8
#: What floating sums may be off by.
SLACK = 1e-6


def _edits(n: Column) -> Column:
    """The most edits between a text of ``n`` words and any text within the distance."""
    longest = F.floor(n * 100 / (100 - EDITS))
    return F.floor(longest * EDITS / 100)


def _shared(n: Column) -> Column:
    """The fewest terms that a text of ``n`` words shares with any text within the distance."""
    return n - F.floor(n * EDITS / 100)


def distance_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether the word edit distance is at most ``most``, by a band of the dynamic programme."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a:
        return len(b) <= most
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        left = i if low == 1 and i <= most else far
        diagonal = row[low - 1]
        row[low - 1] = left
        least = left
        for j in range(low, high + 1):
            up = row[j] if j < i + most else far
            left = min(diagonal + (x != b[j - 1]), up + 1, left + 1)
            diagonal, row[j] = row[j], left
            least = min(least, left)
        if least > most:
            return False
    return row[len(b)] <= most


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for ws in b.column(1).to_pylist():
            seen: dict[str, int] = {}
            for w in ws:
                seen[w] = seen.get(w, 0) + 1
            again = dict.fromkeys(seen, 0)
            mine = []
            for w in ws:
                again[w] += 1
                mine.append(again[w])
            out.append(mine)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["f", "words", "o"])


def vectors(texts: DataFrame) -> DataFrame:
    """(f, size, words, h, w2, cum) for distinct texts (f, words).

    ``h`` and ``w2`` are the hashes and squared weights of the terms in the global order (rarest first), ``cum`` the
    sums of ``w2``. Equal hashes of different terms can only add candidates.
    """
    x = texts.select("f", "words").mapInArrow(_occurrences, "f binary, words array<string>, o array<int>")
    hashed = cut(x.select("f", "words", F.zip_with("words", "o", lambda w, o: F.xxhash64(w, o)).alias("h")))
    terms = hashed.select("f", F.explode("h").alias("h"))
    counts = cut(terms.groupBy("h").agg(F.count("*").alias("n")))
    total = float(hashed.count())
    square = F.pow(F.log(1 + F.lit(total) / F.col("df")), 2.0)
    weighed = join_keyed(terms, counts.withColumn("df", F.col("n")), "h", "n")
    rows = weighed.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("df", "h", square.alias("w2")))).alias("t"))
    summed = rows.select("f", F.col("t.h").alias("h"), F.col("t.w2").alias("w2")).mapInArrow(_sums, "f binary, h array<bigint>, w2 array<double>, cum array<double>")
    return summed.join(hashed.select("f", "words", F.size("words").alias("size")), "f")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cum = [np.cumsum(w).tolist() for w in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cum, pa.list_(pa.float64()))], names=["f", "h", "w2", "cum"])


#: What a text brings to the list of a set: the term's place, the partial dot product, the residual norm behind it, and
#: the largest squared weight of its later terms. ``acc`` is the partial dot product of the set before its term i.
_ENTRY = "struct({sig} AS sig, i AS at, {acc} + w2[i - 1] AS acc, norm - cum[i - 1] AS rest, coalesce(get(w2, i), 0D) AS top)"
_KEPT = ["f", "size", "k", "left", "right", "bound"]


def _fits(m: Column | int) -> Column:
    """Whether a text may still be in reach: its partial dot product and residual norm reach its bound, m terms shared."""
    return (F.col("acc") + F.col("rest") >= F.col("bound") - SLACK) & (F.col("at") - m <= F.col("k"))


def candidates(v: DataFrame, sides: DataFrame, limit: int = LIST_PAIRS, most: int = SET_TERMS) -> DataFrame:
    """Pairs (a, b) of the texts ``v`` (see ``vectors``) that pass all bounds, written; ``sides`` has f, left and right.

    Lists with more than ``limit`` pairs are grown term by term up to sets of ``most`` terms. Of a list that is grown,
    the texts that may share no further term give their pairs before; these lists and those of ``most`` terms are
    taken whatever their length (``product_join`` deals long ones out), so nothing is dropped.
    """
    k = _edits(F.col("size")).cast("int")
    t = v.join(sides, "f").withColumn("k", k).withColumn("norm", F.element_at("cum", -1))
    t = cut(t.withColumn("bound", F.col("norm") - F.when(F.col("k") > 0, F.element_at("cum", F.least("k", "size"))).otherwise(0.0)).drop("words"))
    first = F.expr("transform(sequence(1, least(k + 1, size)), i -> " + _ENTRY.format(sig="h[i - 1]", acc="0D") + ")")
    cur = cut(t.select(*_KEPT, F.explode(first).alias("e")).select(*_KEPT, "e.*").filter(_fits(1)))
    out, done = [], [t, cur]
    for m in range(1, most + 1):
        ends = F.lit(m == most) | ((_shared(F.col("size")) <= m) & (F.col("k") > 0))
        counts = [F.count_if(x).alias(n) for x, n in ((F.col("left"), "l"), (F.col("right"), "r"), (F.col("left") & ends, "le"), (F.col("right") & ends, "re"))]
        sizes = cur.groupBy("sig").agg(*counts).filter("l > 0 and r > 0")
        lists = cut(sizes.select("sig", (F.col("l") * F.col("r") <= limit).alias("short"), F.expr("le > 0 and re > 0").alias("ended")))
        here = cur.join(lists, "sig")
        out.append(_pairs(here.filter("short"), lambda a, b: a.join(b, ["sig"])))
        done.append(lists)
        long, ended = lists.filter("not short").agg(F.count("*"), F.count_if("ended")).first()
        if ended:
            last = cut(here.filter(F.expr("not short and ended") & ends).drop("short", "ended"))
            out.append(_pairs(last, lambda a, b: product_join(a, b, ["sig"])))
            done.append(last)
        if not long or m == most:
            break
        grow = F.expr(f"CASE WHEN at < size AND at < k + {m + 1} THEN transform(sequence(at + 1, least(k + {m + 1}, size)), i -> " + _ENTRY.format(sig="xxhash64(sig, h[i - 1])", acc="acc") + ") ELSE array() END")
        grown = here.filter("not short").select("f", "sig", "at", "acc").join(t, "f")
        cur = cut(grown.select(*_KEPT, F.explode(grow).alias("e")).select(*_KEPT, "e.*").filter(_fits(m + 1)))
        done.append(cur)
    pairs = cut(reduce(DataFrame.unionByName, out).distinct())
    for x in done:
        drop(x)
    return pairs


def _pairs(entries: DataFrame, joined: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("f", "size", "bound", "at", "acc", "rest", "top")]
    a = entries.filter("left").select("sig", *side("a"))
    b = entries.filter("right").select("sig", *side("b"))
    longest, shortest = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    by_norm = F.least("rest_a", "rest_b")
    by_weight = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) * F.least("top_a", "top_b")
    reach = F.least("acc_a", "acc_b") + F.least(by_norm, by_weight) >= F.greatest("bound_a", "bound_b") - 2 * SLACK
    ok = (F.col("f_a") != F.col("f_b")) & ((longest - shortest) * 100 <= longest * EDITS) & reach
    return joined(a, b).filter(ok).select(F.col("f_a").alias("a"), F.col("f_b").alias("b"))


_NEAR = "a binary, b binary, cosine double"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for a, b, wa, ha, sa, bound_a, wb, hb, sb, bound_b in zip(*(c.to_pylist() for c in batch.columns)):
            mine = dict(zip(ha, sa))
            dot = sum(mine[t] for t in hb if t in mine)
            if dot >= max(bound_a, bound_b) - SLACK and distance_within(wa, wb, max(len(wa), len(wb)) * EDITS // 100):
                out.append((a, b, dot / (sum(sa) * sum(sb)) ** 0.5))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.float64())], names=["a", "b", "cosine"])


def near_texts(texts: DataFrame) -> DataFrame:
    """(a, b, cosine) for distinct texts (f, words, left, right): a is on the left, b on the right, a and b differ.

    The pairs of ``candidates`` by their exact dot product and then by their exact word edit distance. A text may be
    on both sides. Texts without words have no row.
    """
    v = cut(vectors(texts.filter(F.size("words") > 0)))
    pairs = candidates(v, texts.select("f", "left", "right"))
    k = F.least(_edits(F.col("size")).cast("int"), F.col("size"))
    bound = F.element_at("cum", -1) - F.when(k > 0, F.element_at("cum", k)).otherwise(0.0)
    both = v.select("f", "words", "h", "w2", bound.alias("bound"))
    full = pairs.join(both.toDF("a", "wa", "ha", "sa", "ba"), "a").join(both.toDF("b", "wb", "hb", "sb", "bb"), "b")
    return full.select("a", "b", "wa", "ha", "sa", "ba", "wb", "hb", "sb", "bb").mapInArrow(_near, _NEAR)


def _records(rows: DataFrame) -> DataFrame:
    r = rows.filter("id is not null and train is not null").select("id", "source", "train", words("text").alias("words"))
    return cut(r.withColumn("f", F.unhex(F.md5(F.array_join("words", " ").cast("binary")))))


def _texts(r: DataFrame) -> DataFrame:
    """The distinct texts of records, with their smallest record as representative and the sides they are on."""
    worded = r.filter(F.size("words") > 0)
    return cut(worded.groupBy("f").agg(F.first("words").alias("words"), F.min("id").alias("representative"), F.count_distinct("id").alias("records"), F.max(F.col("train")).alias("left"), F.max(~F.col("train")).alias("right")))


def split_overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, how) for records (id, text, source, train): a in train, b elsewhere, with a common source or near texts.

    how is source, same (equal word sequences) or near. Texts are compared as word sequences regardless of letter
    case; texts without words take part by source only, null sources link nothing, null ids and rows whose train is
    null are left out, repeated rows count once. Equal texts are compared once as one text and expanded to records
    at the end, in blocks, where the pairs of records are the result asked for. An empty table gives an empty result.
    """
    r = _records(rows)
    by_source = cut(r.filter("source is not null").select("id", "source", "train").distinct())
    same_source = product_join(by_source.filter("train").select(F.col("id").alias("a"), "source"), by_source.filter("not train").select(F.col("id").alias("b"), "source"), ["source"])
    texts = _texts(r)
    members = cut(r.filter(F.size("words") > 0).select("f", "id", "train").distinct())
    left, right = (members.filter(F.col("train") == side).select("f", F.col("id").alias(x)) for side, x in ((True, "a"), (False, "b")))
    same = product_join(left, right, ["f"]).select("a", "b", F.lit("same").alias("how"))
    links = cut(near_texts(texts).select(F.col("a").alias("f"), F.col("b").alias("fb")))
    near = product_join(product_join(links, left, ["f"]).select(F.col("fb").alias("f"), "a"), right, ["f"]).select("a", "b", F.lit("near").alias("how"))
    return same_source.select("a", "b", F.lit("source").alias("how")).unionByName(same).unionByName(near)


def text_links(rows: DataFrame) -> DataFrame:
    """(a, b, cosine): the near texts by the representatives (smallest ids) of their copies, nothing expanded.

    ``text_members`` tells which record has which representative. Rows are treated as in ``split_overlaps``.
    """
    texts = _texts(_records(rows))
    who = texts.select("f", "representative")
    x = near_texts(texts).join(who.toDF("a", "ra"), "a").join(who.toDF("b", "rb"), "b")
    return x.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "cosine")


def text_members(rows: DataFrame) -> DataFrame:
    """(id, representative, records) of every record with words: its class of equal texts and the class's size."""
    r = _records(rows)
    keyed = _texts(r).select("f", "representative", "records", F.col("records").alias("n"))
    members = cut(r.filter(F.size("words") > 0).select("f", "id").distinct())
    return join_keyed(members, keyed, "f", "n").select("id", "representative", "records")
