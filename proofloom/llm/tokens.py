"""Encoding a corpus with a byte-level BPE vocabulary: greedy proposals, vectorised verification, exact merging.

Words are cut into the longest vocabulary tokens from left to right. A sequence is the BPE encoding if no adjacent pair
of tokens would have been merged differently across its boundary; that test depends on the two tokens only and is made
for all adjacent pairs of a batch at once, by undoing merges on both sides of the boundary. Only words with a failing
pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators.skew import spread_out

#: Where the rank files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that parts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered per task, and the longest one that is.
REMEMBER, REMEMBER_BYTES = 300_000, 64
_OVER = np.int64(1) << 40


class Bpe:
    """A vocabulary of byte strings by rank, with the merge that made each token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        n = max(ranks.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        keys, made = [], []
        for word, rank in ranks.items():
            if len(word) > 1:
                parts = self.merge(word, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                    keys.append((parts[0] << 20) | parts[1])
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, text: bytes) -> Bpe:
        """From the contents of a rank file: a base64 token and its rank a line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a})

    def merge(self, word: bytes, below: int = 1 << 40) -> list[int]:
        """The exact encoding: the pair of the lowest rank (under ``below``) is merged first, the leftmost of equals."""
        n = len(word)
        start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (r := self.ranks.get(word[i : i + 2], below)) < below:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(word[i : end[after[i]]], below)) < below:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := self.ranks.get(word[h:stop], below)) < below:
                heapq.heappush(heap, (r, h, stop))
        return [self.ranks[word[i : end[i]]] for i in start if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from left to right."""
        out, i, n = [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (r := self.ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of adjacent tokens, whether merging their bytes gives just these two tokens.

        The merges of both tokens are undone in the reverse order of their making; if at some point the two tokens at
        the boundary would merge into one of a lower rank than the merge just undone, that merge came first.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _OVER)
        while len(live):
            key = (x << 20) | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            clash = (self.keys[at] == key) & (self.made[at] < limit)
            good[live[clash]] = False
            go = ~clash
            live, x, y, limit = live[go], x[go], y[go], limit[go]
            left_first = x > y
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            undo_x = (left_first & ~whole_x) | (~left_first & whole_y & ~whole_x)
            undo_y = (~left_first & ~whole_y) | (left_first & whole_x & ~whole_y)
            limit = np.where(undo_x, x, np.where(undo_y, y + 1, limit))
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            go = undo_x | undo_y
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return good

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The encodings of distinct words."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(inner)
        pairs, back = np.unique((flat[at] << 20) | flat[at + 1], return_inverse=True) if len(at) else (flat[:0], at)
        ok = self.compatible(pairs >> 20, pairs & 0xFFFFF)[back]
        bad = np.unique(np.searchsorted(ends, at[~ok], "right"))
        for i in bad.tolist():
            proposed[i] = self.merge(raw[i])
        return dict(zip(words, map(tuple, proposed)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of every text; null and empty texts have none."""
        parted = [self.find(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(parted)) - self.words.keys())
        known = self.learn(new)
        if len(self.words) + len(known) > REMEMBER:
            known |= {w: self.words[w] for w in set(chain.from_iterable(parted)) & self.words.keys()}
            self.words = {}
        if len(known) <= REMEMBER:
            self.words |= {w: v for w, v in known.items() if len(w) <= REMEMBER_BYTES}
            rest = {w: v for w, v in known.items() if len(w) > REMEMBER_BYTES}
        else:
            rest = known
        get = self.words.get
        return [list(chain.from_iterable(get(w) or rest[w] for w in ws)) for ws in parted]


_vocabularies: dict[int, Bpe] = {}


def encode_corpus(docs: DataFrame, rank_file: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text), without special tokens.

    Null and empty texts have the empty list; a special token's name in a text is ordinary text; texts are encoded
    whole. The rank file (under a megabyte) is read by the driver and broadcast; a scan with fewer partitions than
    cores is dealt out first. Repeated rows
    and null ids stay, other columns are ignored.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from proofloom.llm import tokens

        bpe = tokens._vocabularies.get(hash(shared.value))
        if bpe is None:
            bpe = tokens._vocabularies[hash(shared.value)] = Bpe.load(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = bpe.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return spread_out(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(rows, "doc_id bigint, ids array<int>")
