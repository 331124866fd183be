"""Evaluation passages inside training text.

A generalised suffix automaton over the words of all evaluation items is built once per block of items; every document
streams through it, the longest match is tracked at each word, and wherever it reaches ``least`` words all items that hold
those words are reported; ``cleaned`` takes the matched spans out where they exceed limits of length or coverage. A vectorised filter hands only stretches of word pairs known from the items to the automaton;
every run of ``least`` words consists of such pairs, so it loses nothing.

Words are maximal runs of letters and digits, lower-cased. Null and empty texts match nothing. The items' texts are broadcast in blocks of
at most ``block_words`` words, each worker process builds the automaton of a block once, and one scan of the documents passes all of
them. What a worker holds grows with the evaluation texts, which are held out of training and small beside the corpus, never with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, BLOCK_WORDS = 12, 400_000
#: Spans go if the longest run of an item has more words than this, or if the item makes up more than this share of the words.
LONGEST, COVERAGE = 25, 0.3
WORD = re.compile(r"[^\W_]+")


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each matched passage."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs, ends = set(), []
        for item, text in items:
            numbers = [self.words.setdefault(w, len(self.words)) for w in WORD.findall(text.lower())]
            pairs.update(zip(numbers, numbers[1:], strict=False))
            last = 0
            for n in numbers:
                last = self._extend(last, n)
                ends.append((item, last))
        self.base = len(self.words) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.anchor = self._anchors()
        self.items: dict[int, set[int]] = {}
        for item, state in ends:  # an item is in every state on its way to the root
            while state > 0 and self.length[state] >= least and item not in self.items.setdefault(state, set()):
                self.items[state].add(item)
                state = self.link[state]

    def _clone(self, p: int, q: int, n: int) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        new = len(self.next) - 1
        while p != -1 and self.next[p].get(n) == q:
            self.next[p][n] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, n: int) -> int:
        if n in self.next[last]:
            q = self.next[last][n]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, n)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, p = len(self.next) - 1, last
        while p != -1 and n not in self.next[p]:
            self.next[p][n] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][n]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, n)
        return new

    def _anchors(self) -> list[int]:
        """For each state the suffix state that holds its last ``least`` words."""
        out = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= self.least:
                up = self.link[s]
                out[s] = s if self.length[up] < self.least else out[up]
        return out

    def stretches(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the parts whose word pairs all occur in the items, at least ``least`` words each."""
        if len(numbers) < self.least or not len(self.pairs):
            return []
        keys = numbers[:-1] * self.base + numbers[1:]
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        known = (self.pairs[at] == keys) & (numbers[:-1] >= 0) & (numbers[1:] >= 0)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + 1
        if self.least == 1:
            return [(0, len(numbers))]
        return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= self.least]

    def matches(self, found: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each item the [start, end) spans of the words of a text that it shares, merged."""
        get = self.words.get
        if len(found) < self.least:
            return {}
        numbers = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        spans: dict[int, list[tuple[int, int]]] = {}
        for a, b in self.stretches(numbers):
            state = size = 0
            for i in range(a, b):
                n = int(numbers[i])
                while state and n not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if n in self.next[state]:
                    state, size = self.next[state][n], size + 1
                while state and size <= self.length[self.link[state]]:
                    state = self.link[state]
                if size >= self.least:
                    for item in self.items.get(self.anchor[state], ()):
                        own = spans.setdefault(item, [])
                        start = i + 1 - self.least
                        if own and own[-1][1] >= start:
                            own[-1] = (own[-1][0], i + 1)
                        else:
                            own.append((start, i + 1))
        return spans


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> list[list[tuple[int, str]]]:
    blocks: list[list[tuple[int, str]]] = []
    words = block_words
    for row in items.select(F.col(key), F.col(text)).na.drop().distinct().orderBy(key, text).toLocalIterator():
        size = len(WORD.findall(row[1].lower()))
        if words + size > block_words:
            blocks.append([])
            words = 0
        blocks[-1].append((row[0], row[1]))
        words += size
    return blocks


#: Automata of this worker process, by the number of their broadcast.
_BUILT: dict[int, list[Automaton]] = {}


def _automata(shared: Broadcast, number: int) -> list[Automaton]:
    if number not in _BUILT:
        _BUILT.clear()
        least, blocks = shared.value
        _BUILT[number] = [Automaton(b, least) for b in blocks]
    return _BUILT[number]


def _all_matches(automata: list[Automaton], found: list[str]) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for a in automata:
        for item, spans in a.matches(found).items():
            out.setdefault(item, []).extend(spans)
    return out


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_key, item_key, words (shared), longest, coverage (share of the document's words): one row per document and leaked item.

    Rows without key are left out. Repeated document rows give repeated rows.
    """
    doc_type, item_type = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    out = f"`{doc_key}` {doc_type}, `{item_key}` {item_type}, words int, longest int, coverage double"
    source = docs.filter(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("__key"), F.col(doc_text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast((least, _blocks(items, item_key, item_text, block_words)))
    number = id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(shared, number)
        for batch in batches:
            rows, hits = [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                found = WORD.findall(t.lower())
                for item, spans in _all_matches(automata, found).items():
                    sizes = [b - a for a, b in spans]
                    rows.append(r)
                    hits.append((item, sum(sizes), max(sizes), sum(sizes) / len(found)))
            c = list(zip(*hits, strict=True)) if hits else [()] * 4
            types = (pa.int64() if item_type == "bigint" else None, pa.int32(), pa.int32(), pa.float64())
            arrays = [batch.column(0).take(pa.array(rows, pa.int32()))] + [pa.array(x, t) for x, t in zip(c, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[doc_key, item_key, "words", "longest", "coverage"])

    return source.mapInArrow(run, out)


def _places(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of a text, positions in the text as it is."""
    low = text.lower()
    if len(low) == len(text):
        return [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
    at = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]  # some letters grow when lowered
    return [(m[0], at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def without_spans(text: str, automata: list[Automaton], longest: int, coverage: float) -> tuple[str, int, int]:
    """(text, spans removed, words removed): the spans of every item whose longest run or whose share of the text's words is above the limits."""
    places = _places(text)
    found = [p[0] for p in places]
    cut = []
    for spans in _all_matches(automata, found).values():
        sizes = [b - a for a, b in spans]
        if max(sizes) > longest or sum(sizes) > coverage * len(found):
            cut += spans
    if not cut:
        return text, 0, 0
    merged: list[list[int]] = []
    for a, b in sorted(cut):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at : places[a][1]])
        at = places[b - 1][2]
    return "".join([*kept, text[at:]]), len(merged), sum(b - a for a, b in merged)


def cleaned(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, longest: int = LONGEST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_key, doc_text, spans, words: every document without the passages it shares beyond the limits, and how much was taken out.

    A passage goes from its first to its last word; what stands around it stays. A null text stays null; rows without key stay.
    """
    doc_type = docs.schema[doc_key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((least, _blocks(items, item_key, item_text, block_words)))
    number = id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(shared, number)
        for batch in batches:
            rows = [(None, 0, 0) if t is None else without_spans(t, automata, longest, coverage) for t in batch.column(1).to_pylist()]
            c = list(zip(*rows, strict=True)) if rows else [()] * 3
            arrays = [batch.column(0), pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[doc_key, doc_text, "spans", "words"])

    return docs.select(doc_key, doc_text).mapInArrow(run, f"`{doc_key}` {doc_type}, `{doc_text}` string, spans int, words int")
