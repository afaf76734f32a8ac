"""Keyword-stuffed and link-list pages: suffix automata over page tokens, against clause structure.

Clause structure is told by how the classes of tokens are distributed, without word lists: in clauses short words (in
Japanese the hiragana between other letters) stand before ever new words, words vary, and separators are few. Runs of
lines without a sentence mark are judged together as one block, so a list is never taken for many small sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators.skew import spread_out

#: A page is junk if more than this share of its characters is.
SHARE = 2 / 3
#: Pages with fewer words are never cases.
LEAST_WORDS = 15
#: A repeated substring has at least so many tokens and occurrences; of token classes, so many tokens.
REPEAT_TOKENS, REPEAT_TIMES, REPEAT_CLASSES = 2, 3, 4
#: A clause has at least so many words, and so many distinct contexts (short word, next word) a word.
CLAUSE_WORDS, CLAUSE_RATE = 5, 0.05
#: Letters of a short word.
SHORT = 3
#: Words of a window, and the share of different ones that clauses have in windows on average.
WINDOW, VARIETY = 50, 0.5
#: A block without sentence marks is no clause if repeated substrings cover more than this share of its words.
REPEATED = 0.8
#: A sentence without short words: different words, and words to a separator, at least.
PLAIN_VARIETY, PLAIN_RUN = 0.8, 4
#: Unrepeated tokens between two junk tokens are junk up to this many.
GAP = 4

# Ranges of hiragana, katakana, and letters written without blanks (Thai to Khmer, Han).
_HIRAGANA, _KATAKANA, _DENSE = "\u3041-\u309f", "\u30a0-\u30ff\uff66-\uff9f", "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3400-\u9fff"
_LINK = r"(?:https?://|www\.)[^\s\])>|]+"
_RUNS = rf"[{_HIRAGANA}]+|[{_KATAKANA}]+|[{_DENSE}]+|[^\W{_HIRAGANA}{_KATAKANA}{_DENSE}]+"
_TOKEN = re.compile(rf"({_LINK})|(#\w+)|([$€£¥]\s?\d[\d.,]*)|({_RUNS})|([^\w\s])")
_SEGMENT = re.compile(r"(?<=[.!?])(?=\s|$)|(?<=[。！？])|\n")
_ENDS = re.compile(r"[.!?。！？][\"'”’)\]]*\s*$")
_WORD = re.compile(r"[^\W_]+")
_DIGIT, _MARKED = re.compile(r"\d"), re.compile(r"://|www\.|#|[$€£¥]")
_PLAIN = re.compile(rf"({_RUNS})|[^\w\s]")
_IS_DENSE = re.compile(f"[{_DENSE}]")
#: Letters that link nothing however short their word is: katakana, letters written without blanks, and hangul.
_LONE = re.compile(f"[{_KATAKANA}{_DENSE}\uac00-\ud7a3]")


class SuffixAutomaton:
    """Suffix automaton of a token sequence with the number of occurrences and the first end of every state."""

    def __init__(self, tokens: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long, self.count = [-1], [0], [0]
        last = 0
        for t in tokens:
            cur = self._state({}, -1, self.long[last] + 1, 1)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][t]
                if self.long[p] + 1 == self.long[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(dict(self.next[q]), self.link[q], self.long[p] + 1, 0)
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur
        for s in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def _state(self, edges: dict[int, int], link: int, long: int, count: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.long.append(long)
        self.count.append(count)
        return len(self.long) - 1

    def covered(self, tokens: list[int], least: int, times: int) -> list[bool]:
        """For every token, whether a substring of at least ``least`` tokens that occurs ``times`` times covers it."""
        out = [False] * len(tokens)
        state = size = done = 0
        for i, t in enumerate(tokens):
            state = self.next[state].get(t, 0)
            size += 1
            while state and self.count[state] < times:
                state = self.link[state]
                size = self.long[state]
            if not state:
                size = 0
            if size >= least:
                for j in range(max(done, i - size + 1), i + 1):
                    out[j] = True
                done = i + 1
        return out


def symbol(token: re.Match) -> str:
    """What a token counts as in repeats: links, tags, prices, numbers and names with digits are one symbol each."""
    link, tag, price, word, mark = token.groups()
    return "<link>" if link else "<tag>" if tag else "<price>" if price else spelled(word) if word else mark


def spelled(word: str) -> str:
    if word.isalpha():
        return word.lower()
    return "<number>" if word.isdigit() else "<name>" if _DIGIT.search(word) else word.lower()


def kind(symbol: str, token: re.Match) -> str:
    """The class of a token: its symbol if that is a mark or stands for many, else how its letters are written."""
    word = token.group(4)
    if not word or symbol[0] == "<":
        return symbol
    return "<Word>" if word[0].isupper() else "<word>"


def short(word: str) -> bool:
    """Whether a word is of the class that links others: few small letters, or hiragana."""
    c = word[0]
    if c > "\u0dff" and ("\u3041" <= c <= "\u309f" or _LONE.match(c)):
        return c <= "\u309f" and c >= "\u3041"
    return len(word) <= SHORT and word.isalpha() and (word.islower() or word.lower() == word.upper())


def variety(symbols: list[str]) -> float:
    """The share of different symbols in a window, on average over all windows."""
    parts = [symbols[i : i + WINDOW] for i in range(0, len(symbols), WINDOW)]
    if len(parts) > 1 and len(parts[-1]) < WINDOW:
        parts.pop()
    return sum(len(set(p)) / len(p) for p in parts) / len(parts)


def is_clause(tokens: list[str], ends: bool) -> bool:
    """Whether a segment's tokens (words as they are, all else empty) read as sentences; ``ends``: it has a sentence mark."""
    words = [w for w in tokens if w]
    dense = sum(len(w) // 2 for w in words if w > "\u0dff" and _IS_DENSE.match(w))
    if not words or len(words) + dense < CLAUSE_WORDS:
        return False
    varied = variety([spelled(w) for w in words])
    if varied < VARIETY:
        return False
    need = max(1, CLAUSE_RATE * len(words))
    contexts = set()
    before = ""
    for w in tokens:
        if before and w and short(before):
            contexts.add((before, spelled(w)))
            if len(contexts) >= need:
                return True
        before = w
    return ends and varied >= PLAIN_VARIETY and len(words) + dense >= PLAIN_RUN * (len(tokens) - len(words))


def segments(text: str) -> list[tuple[str, bool]]:
    """The sentences of a text, and its runs of lines without a sentence mark as blocks: (text, ends with a mark)."""
    out: list[tuple[str, bool]] = []
    block: list[str] = []
    at = 0
    for m in [*_SEGMENT.finditer(text), None]:
        piece, at = text[at : m.end() if m else len(text)], m.end() if m else 0
        if not piece.strip():
            continue
        if _ENDS.search(piece):
            if block:
                out.append(("".join(block), False))
                block = []
            out.append((piece, True))
        else:
            block.append(piece if piece[-1].isspace() else piece + " ")
    if block:
        out.append(("".join(block), False))
    return out


def _covered(keys: list, least: int) -> list[bool]:
    ids = {s: i for i, s in enumerate(dict.fromkeys(keys))}
    tokens = [ids[s] for s in keys]
    return SuffixAutomaton(tokens).covered(tokens, least, REPEAT_TIMES)


def junk_share(text: str | None) -> float:
    """The share of a page's characters (white space aside) that is junk.

    Junk are links, hash tags and prices, and in segments without clause structure the tokens that repeated maximal
    substrings cover, of token symbols or of token classes, with the short gaps between them. A block of lines without
    sentence marks that repeated substrings cover nearly whole has no clause structure. Substrings are sought in the
    segments without clause structure and in such blocks; sentences with clause structure take no part.
    """
    text = text or ""
    total = len("".join(text.split()))
    if not total:
        return 0.0
    junk = 0
    loose: list[tuple[list[re.Match], bool]] = []
    for piece, ends in segments(text):
        found = list(_TOKEN.finditer(piece)) if _MARKED.search(piece) else None
        clause = is_clause(_PLAIN.findall(piece) if found is None else [x.group(4) or "" for x in found], ends)
        if not clause or not ends:
            loose.append((list(_TOKEN.finditer(piece)) if found is None else found, not clause))
        elif found:
            junk += sum(map(_size, filter(_marked, found)))
    return (junk + _loose_junk(loose)) / total if loose else junk / total


def _size(x: re.Match) -> int:
    return len("".join(x.group().split())) if x.group(3) else x.end() - x.start()


def _marked(x: re.Match) -> bool:
    return bool(x.group(1) or x.group(2) or x.group(3))


def _loose_junk(segments: list[tuple[list[re.Match], bool]]) -> int:
    """Characters of junk in segments (tokens, without clause structure) that have no clause or no sentence mark."""
    flat = [x for s, _ in segments for x in s]
    symbols = [symbol(x) for x in flat]
    cover = _covered(symbols, REPEAT_TOKENS)
    free: list[bool] = []
    for s, f in segments:
        spots = [j for j, x in enumerate(s, len(free)) if x.group(4)]
        f = f or (len(spots) >= LEAST_WORDS and sum(cover[j] for j in spots) > REPEATED * len(spots))
        free += [f] * len(s)
    alike = _covered([kind(y, x) if f else i for i, (x, y, f) in enumerate(zip(flat, symbols, free))], REPEAT_CLASSES)
    junk = [_marked(x) or (f and (c or k)) for x, f, c, k in zip(flat, free, cover, alike)]
    last = None
    for i, j in enumerate(junk[:]):
        if j:
            if last is not None and 1 < i - last <= GAP + 1 and all(free[last + 1 : i]):
                junk[last + 1 : i] = [True] * (i - last - 1)
            last = i
    return sum(_size(x) for x, j in zip(flat, junk) if j)


def junk_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, words, junk) of every row of ``docs`` (doc_id, text): its number of words and its share of junk.

    Null, empty and blank texts have 0 words and no junk. The texts are read whole, in Arrow batches; a scan with
    fewer partitions than cores is dealt out first. Time is linear in a text's length. Repeated rows stay, other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, junk = [], []
            for t in b.column(1).to_pylist():
                n = len(_WORD.findall(t or ""))
                words.append(n)
                junk.append(junk_share(t) if n else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int32()), pa.array(junk, pa.float64())], names=["doc_id", "words", "junk"])

    return spread_out(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(rows, "doc_id bigint, words int, junk double")
