"""Duplicates hidden by formatting: recursive radix partitioning of canonical bytes, counted in tries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.lineage import cut
from proofloom.operators.skew import bounded_broadcast, join_keyed

#: Canonical bytes (and NODE per string) that a bucket may hold before it is split by further bytes.
BUCKET_BYTES = 16 << 20
NODE = 200
#: Strings that a task combines before it sends them on.
COMBINE = 50_000


def stripped(c: Column) -> Column:
    """Without letter case, white space and punctuation; symbols such as < or = stay."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[\p{P}\p{Z}\s\x1c-\x1f\x85]+", "")


def canonical(text: Column | str) -> Column:
    """The canonical form of a text: stripped; the fields of a text made of name=value fields are sorted first."""
    t = F.col(text) if isinstance(text, str) else text
    pieces = F.filter(F.split(t, ";"), lambda p: stripped(p) != "")
    is_fields = (F.size(pieces) > 0) & F.forall(pieces, lambda p: p.rlike(r"^[\s\p{P}\p{Z}]*[\p{L}\p{N}_-]+[\s\p{Z}]*="))
    return F.when(F.locate("=", t) == 0, stripped(t)).when(is_fields, F.array_join(F.array_sort(F.transform(pieces, stripped)), ";")).otherwise(stripped(t))


class CountTrie:
    """Path-compressed byte trie; a terminal holds the number of copies and their smallest key."""

    def __init__(self) -> None:
        self.root: list = [{}, None]
        self.size = 0

    def add(self, word: bytes, count: int, first: str) -> None:
        node, i = self.root, 0
        while i < len(word):
            edge = node[0].get(word[i])
            if edge is None:
                leaf: list = [{}, None]
                node[0][word[i]] = [word[i:], leaf]
                node, i = leaf, len(word)
                break
            label, child = edge
            if word.startswith(label, i):
                node, i = child, i + len(label)
                continue
            k, end = 1, min(len(label), len(word) - i)
            while k < end and label[k] == word[i + k]:
                k += 1
            middle: list = [{label[k]: [label[k:], child]}, None]
            node[0][word[i]] = [label[:k], middle]
            node, i = middle, i + k
        if node[1] is None:
            node[1] = [count, first]
            self.size += 1
        else:
            node[1][0] += count
            node[1][1] = min(node[1][1], first)

    def __iter__(self) -> Iterator[tuple[bytes, int, str]]:
        todo: list = [(b"", self.root)]
        while todo:
            word, (edges, end) = todo.pop()
            if end:
                yield word, end[0], end[1]
            todo.extend((word + label, child) for label, child in edges.values())


_OUT = pa.schema([("canon", pa.binary()), ("n", pa.int64()), ("first", pa.string())])


def _table(trie: CountTrie) -> pa.RecordBatch:
    rows = list(trie)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _OUT.field(i).type) for i in range(3)], schema=_OUT)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = CountTrie()
    for b in batches:
        for word, n, first in zip(*(c.to_pylist() for c in b.columns)):
            trie.add(word, n, first)
        if trie.size >= COMBINE:
            yield _table(trie)
            trie = CountTrie()
    yield _table(trie)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, trie = None, CountTrie()
    for b in batches:
        for at, word, n, first in zip(*(c.to_pylist() for c in b.columns)):
            if at != bucket:
                if trie.size:
                    yield _table(trie)
                bucket, trie = at, CountTrie()
            trie.add(word, n, first)
    if trie.size:
        yield _table(trie)


def radix_buckets(rows: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` with a column ``bucket``: a prefix of the bytes ``canon`` short enough, and long enough to fit ``limit``.

    Prefixes double in length from one byte; only the strings of buckets that are still too large enter the next
    level. A bucket whose strings all end within its prefix can't be split and needs no split: it holds one string.
    """
    parts, open_, depth = [], rows, 1
    while True:
        x = open_.withColumn("bucket", F.substring("canon", 1, depth))
        size = x.groupBy("bucket").agg(F.sum(F.length("canon") + NODE).alias("size"), F.max(F.length("canon")).alias("longest"))
        over = cut(size.filter((F.col("size") > limit) & (F.col("longest") > depth)).select("bucket", F.lit(True).alias("over")))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, x])
        over = bounded_broadcast(over)
        parts.append(x.join(over, "bucket", "left_anti"))
        open_, depth = cut(x.join(over, "bucket", "left_semi").drop("bucket")), depth * 2


def count_copies(rows: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """(canon, n, first) for rows (key, canon): the number of rows of each canonical string and their smallest key.

    Every task first combines its rows in a trie, so a string that a third of all rows share is sent on once per task
    and COMBINE strings; the rest goes to radix buckets and is counted in one trie per bucket. Null keys and null
    strings are left out; an empty table gives an empty result.
    """
    x = rows.filter("key is not null and canon is not null").select(F.col("canon").cast("binary").alias("canon"), F.lit(1).cast("bigint").alias("n"), F.col("key").alias("first"))
    some = cut(x.mapInArrow(_combine, "canon binary, n bigint, first string"))
    placed = radix_buckets(some, limit).select("bucket", "canon", "n", "first")
    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, "canon binary, n bigint, first string")


def formatting_copies(rows: DataFrame) -> DataFrame:
    """(key, first, n) for rows (key, source, text): the group's smallest key and its number of distinct keys.

    Rows are the same if source and text are, apart from white space, letter case, punctuation and the order of
    name=value fields. Null texts and texts without a letter, digit or symbol have no row; a null source counts as an
    empty one. A key with several texts is in each one's group. Repeated rows count once.
    """
    canon = F.concat(stripped(F.coalesce("source", F.lit(""))), F.lit("\u0001"), canonical("text"))
    x = rows.filter("key is not null and text is not null").select("key", canonical("text").alias("c"), canon.alias("canon")).filter("c <> ''").select("key", "canon")
    x = cut(x.distinct())
    groups = cut(count_copies(x).select(F.md5("canon").alias("f"), "first", "n"))
    keys = x.select("key", F.md5(F.col("canon").cast("binary")).alias("f"))
    many = groups.filter("n > 1")
    return join_keyed(keys, many.withColumn("copies", F.col("n")), "f", "n").select("key", "first", F.col("copies").alias("n")).unionByName(groups.filter("n = 1").select(F.col("first").alias("key"), "first", "n"))
