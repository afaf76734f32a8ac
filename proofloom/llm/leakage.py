"""Evaluation texts in training text: rare n-gram seeds, then local alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions.text import words, words_of
from proofloom.lineage import cut
from proofloom.operators.skew import bounded_broadcast, spread_out

#: Words of a seed.
SEED = 5
#: Consecutive words that make a passage.
PASSAGE = 15
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -2, -2
#: Of edited copies: words of a seed, item words to a seed that must be there, the score of an edit, and the share of the
#: item's perfect score that makes a leak.
SHORT_SEED, WORDS_A_SEED, EDIT, EDITED_SHARE = 3, 6, -1, 0.5
#: Items that one pass over the documents looks for.
ITEM_BLOCK = 5_000


def local_alignment(a: np.ndarray, b: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """(score, run): the best Smith-Waterman score of two word id arrays and the longest run of equal words.

    Row by row; the dependency along a row is resolved by a running maximum.
    """
    if not len(a) or not len(b):
        return 0, 0
    steps = -gap * np.arange(1, len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    run = np.zeros(len(b) + 1, np.int64)
    best = longest = 0
    for x in a:
        same = b == x
        score = np.maximum(np.where(same, MATCH, mismatch) + row[:-1], np.maximum(row[1:] + gap, 0))
        score = np.maximum(score, np.maximum.accumulate(score + steps) - steps)
        row[1:] = score
        run[1:] = np.where(same, run[:-1] + 1, 0)
        best, longest = max(best, int(score.max())), max(longest, int(run.max()))
    return best, longest


def _grams(c: str) -> str:
    hashed = ", ".join(f"element_at({c}, i + {k})" for k in range(SEED))
    return f"CASE WHEN size({c}) >= {SEED} THEN transform(sequence(1, size({c}) - {SEED - 1}), i -> xxhash64({hashed})) ELSE array() END"


_SCHEMA = "doc_id bigint, item_id bigint, score int, run int, item_words int"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, item, at, dw, iw in zip(*(c.to_pylist() for c in batch.columns)):
            ids: dict[str, int] = {}
            b = np.array([ids.setdefault(w, len(ids)) for w in iw])
            reach = 2 * len(iw)
            spans: list[list[int]] = []
            for p in sorted(at):
                low, high = max(0, p - reach), min(len(dw), p + SEED + reach)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            score = run = 0
            for low, high in spans:
                s, r = local_alignment(np.array([ids.get(w, -1) for w in dw[low:high]]), b)
                score, run = max(score, s), max(run, r)
            out.append((doc, item, score, run, len(iw)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.int32()) for i in range(5)], names=["doc_id", "item_id", "score", "run", "item_words"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, run, item_words) for documents and items (id, text) that share a seed.

    Of every PASSAGE consecutive words of an item the SEED-gram that the fewest places of the corpus hold is a seed,
    so a document with such a passage unbroken shares at least one seed with its item. Around all its seeds in a
    document the item is aligned locally; ``score`` is the best alignment's and ``run`` the longest run of common
    words. Documents with a passage that is edited too often to hold a seed are out of reach; whole texts are read.

    The items' grams are broadcast if they are few, else joined by a shuffle. Documents send on only the places of
    grams that some item holds. Items under PASSAGE words use all their grams as seeds; documents and items without
    SEED words, with null or empty texts or null ids have no row. Repeated rows count once.
    """
    d = docs.filter("id is not null").select(F.col("id").alias("doc_id"), words("text").alias("dw"))
    i = cut(items.filter("id is not null").select(F.col("id").alias("item_id"), words("text").alias("iw")).distinct().filter(F.size("iw") >= SEED))
    grams = cut(i.select("item_id", F.size("iw").alias("n"), F.posexplode(F.expr(_grams("iw"))).alias("at", "gram")))
    known = bounded_broadcast(cut(grams.select("gram").distinct()))
    places = cut(d.select("doc_id", F.posexplode(F.expr(_grams("dw"))).alias("at", "gram")).join(known, "gram"))
    rare = bounded_broadcast(cut(places.groupBy("gram").agg(F.count("*").alias("df"))))
    wide = PASSAGE - SEED + 1
    weighed = grams.join(rare, "gram", "left").na.fill(0, ["df"])
    rows = weighed.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "df", "gram"))).alias("g"))
    window = f"transform(sequence(1, greatest(1, size(g) - {wide - 1})), s -> array_min(transform(slice(g, s, {wide}), x -> struct(x.df, x.gram))).gram)"
    all_of = f"CASE WHEN size(g) < {wide} THEN transform(g, x -> x.gram) ELSE {window} END"
    seeds = cut(rows.select("item_id", F.explode(F.array_distinct(F.expr(all_of))).alias("gram")))
    hits = places.join(bounded_broadcast(seeds), "gram").groupBy("doc_id", "item_id").agg(F.collect_set("at").alias("at"))
    hits = cut(hits)
    pairs = hits.join(d, "doc_id").join(bounded_broadcast(i), "item_id").select("doc_id", "item_id", "at", "dw", "iw")
    return pairs.mapInArrow(_align, _SCHEMA).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.max("item_words").alias("item_words"))


class Items:
    """A block of items by their seeds: every SHORT_SEED-gram of an item."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.words = dict(items)
        self.at: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for i, ws in items:
            for p, g in seeds(ws):
                self.at.setdefault(g, []).append((i, p))

    def spans(self, words: list[str]) -> dict[int, list[list[int]]]:
        """The parts of a document to align with each item: where enough of its seeds stand at about the same shift.

        Enough is one for every WORDS_A_SEED words of the item; a copy with a fifth of its words edited keeps about half
        of its seeds.
        """
        found = [(p, at) for p, g in seeds(words) if (at := self.at.get(g))]
        count = Counter(i for _, at in found for i, _ in at)
        near = {i for i, n in count.items() if n >= max(2, len(self.words[i]) // WORDS_A_SEED)}
        hits: dict[int, dict[int, int]] = {}
        for p, at in found if near else ():
            for i, q in at:
                if i in near:
                    hits.setdefault(i, {}).setdefault(p, q)
        out: dict[int, list[list[int]]] = {}
        for i, places in hits.items():
            n = len(self.words[i])
            shift = max(3, n // 4)
            parts: list[list[int]] = []
            starts = sorted(p - q for p, q in places.items())
            first = 0
            for last, at in enumerate(starts):
                while at - starts[first] > shift:
                    first += 1
                if last - first + 1 >= max(2, n // WORDS_A_SEED):
                    low, high = max(0, starts[first] - shift), min(len(words), at + n + shift)
                    if parts and low <= parts[-1][1]:
                        parts[-1][1] = high
                    else:
                        parts.append([low, high])
            if parts:
                out[i] = parts
        return out


def seeds(words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(place, gram) of every run of SHORT_SEED words."""
    return ((p, tuple(words[p : p + SHORT_SEED])) for p in range(len(words) - SHORT_SEED + 1))


def edited_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, share) for documents and items (id, text): copies of items, edited or in part.

    An item is aligned with a document where enough of its seeds lie near each other
    (Smith-Waterman with EDIT for a replaced, dropped or added word); see ``Items.spans``. A pair is a leak if the score is at least
    EDITED_SHARE of what a perfect copy of the item gets; ``share`` is that share. Documents are read once for every
    ITEM_BLOCK items, which are handed to the tasks; nothing is shuffled but the result. Whole texts are read; null and
    empty texts, texts under SHORT_SEED words and null ids have no row. Repeated rows count once.
    """
    known = items.filter("id is not null and text is not null").select(F.col("id").cast("bigint").alias("id"), "text").distinct()
    texts = spread_out(docs.filter("id is not null and text is not null").select(F.col("id").cast("bigint").alias("id"), "text"))
    out = []
    for block in blocks(known, ITEM_BLOCK):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = Items([(i, words_of(t)) for i, t in shared.value])
            for b in batches:
                found = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _edited(words_of(t), mine)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "score", "share"])

        out.append(texts.mapInArrow(rows, _EDITED))
    if not out:
        return docs.sparkSession.createDataFrame([], _EDITED)
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"))


_EDITED = "doc_id bigint, item_id bigint, score int, share double"


def blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The rows of ``items`` in lists of ``size``, brought to the driver part by part."""
    block: list[tuple[int, str]] = []
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _edited(words: list[str], items: Items) -> Iterator[tuple[int, int, float]]:
    for i, spans in items.spans(words).items():
        own = items.words[i]
        ids: dict[str, int] = {}
        b = np.array([ids.setdefault(w, len(ids)) for w in own])
        score, count = 0, Counter(own)
        for low, high in spans:
            part = words[low:high]
            if sum((Counter(part) & count).values()) >= EDITED_SHARE * len(own):  # else no alignment can score enough
                score = max(score, local_alignment(np.array([ids.get(w, -1) for w in part]), b, EDIT, EDIT)[0])
        share = score / (MATCH * len(own))
        if share >= EDITED_SHARE:
            yield i, score, share
