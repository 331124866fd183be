"""Filling containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Bin completion, branch and bound: the largest document left opens a container, and the search branches over the undominated
fillings of the rest of its capacity, least waste first. The incumbent is the best-fit-decreasing packing.

* Which sums the stock can reach is kept as one bit set per size, so ``fillings`` knows the least waste of a container before it
  looks for the documents, and no branch is entered that cannot end at the sum it aims for.
* A filling is dominated if a document left out could take the place of some in it (their sum at most its size, and it fits): what
  is set free can only help later containers. Dominated fillings are skipped.
* A branch is cut when its waste exceeds what the incumbent less one container may waste in all (a true bound).
* The search ends with a proof as soon as the number of containers equals the lower bound (the Martello-Toth bound L2) or the tree is
  exhausted. Bin packing is NP-hard, so after ``NODES`` further containers the incumbent is returned unproved; ``pack`` says which
  (``proved``). No document is ever left out.

Tokens are counted and containers filled in one pass over each partition, without a shuffle: a window of documents
(``window``, a bound on memory) is packed, its containers below ``FULL`` are carried into the next window, and the last
window of a partition closes all. At most ``CARRY`` documents are carried: beyond it the fullest carried containers are
closed as they are, so documents that find no partners cost space but neither memory nor the result. Every document is placed; one above
the capacity is cut into full containers and a rest that is packed like any document. Documents without tokens take no space and go
into the next container; null text counts as empty; rows without key are left out. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents packed together in a task: a bound on memory.
WINDOW = 8192
#: Containers tried beyond the first packing before a search without proof ends.
NODES = 4000
#: Documents and parts carried from one window to the next at most; containers at least this full are closed at once.
CARRY, FULL = 4 * WINDOW, 0.98
_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer, made once per Python worker."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


class Stock:
    """Sizes in stock with their numbers, and the sums that they can reach."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = dict(counts)
        self.sizes = sorted(counts)
        self.mask = (1 << (capacity + 1)) - 1
        self.refresh()

    def refresh(self) -> None:
        """reach[i]: bit s is set if some of the i smallest sizes, each as often as in stock, sum to s.

        Removing from the stock leaves the bits a superset of the truth, so they stay a true bound until the next refresh.
        """
        self.known = list(self.sizes)
        bits, self.reach = 1, [1]
        for s in self.known:
            left, step = self.counts[s], 1
            while left > 0 and step * s <= self.mask.bit_length():
                take = min(step, left)
                bits |= bits << (take * s) & self.mask
                left -= take
                step *= 2
            self.reach.append(bits)

    def take(self, size: int, n: int = 1) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def put(self, size: int, n: int = 1) -> None:
        if not self.counts.get(size):
            insort(self.sizes, size)
        self.counts[size] = self.counts.get(size, 0) + n

    def best(self, room: int) -> list[int] | None:
        """The filling of least waste, among those the one with the largest documents; None if the bits are out of date.

        It is undominated: a document that could replace others would waste less or be larger.
        """
        top = bisect_right(self.known, room)
        left = (self.reach[top] & ((1 << (room + 1)) - 1)).bit_length() - 1
        out: list[int] = []
        while left:
            top = min(top, bisect_right(self.known, left))
            if not top:
                return None
            size = self.known[top - 1]
            n = min(self.counts.get(size, 0), left // size)
            while n and not self.reach[top - 1] >> (left - n * size) & 1:
                n -= 1
            if not n and not self.reach[top - 1] >> left & 1:
                return None
            out += [size] * n
            left -= n * size
            top -= 1
        return out

    def fillings(self, room: int, waste: int) -> Iterator[list[int]]:
        """Every undominated filling that wastes at most ``waste``, least waste first, larger documents first. The bits must be fresh."""
        known, counts, reach = self.known, dict(self.counts), self.reach
        top = bisect_right(known, room)

        def parts(left: int, top: int) -> Iterator[list[int]]:
            if not left:
                yield []
                return
            top = min(top, bisect_right(known, left))
            if not top:
                return
            size = known[top - 1]
            for n in range(min(counts[size], left // size), -1, -1):
                if reach[top - 1] >> (left - n * size) & 1:
                    for rest in parts(left - n * size, top - 1):
                        yield [size] * n + rest

        sums = reach[top]
        for total in range(room, max(-1, room - waste - 1), -1):
            if sums >> total & 1:
                for filling in parts(total, top):
                    if not _dominated(filling, counts, known[:top], room - total):
                        yield filling


def _dominated(filling: list[int], counts: dict[int, int], sizes: list[int], free: int) -> bool:
    """Whether a document left out could replace some of the filling."""
    used = Counter(filling)
    out = 0
    for s in sizes:
        if counts[s] > used[s]:
            out |= 1 << s
    several, single = 0, 0
    for s in filling:
        several |= (several | single) << s
        single |= 1 << s
    if not out >> 1:
        return False
    # One larger document for one of the filling; or one as large as several together, or larger.
    if any(out >> (s + 1) & ((1 << free) - 1) for s in used) or (not filling and out & ((1 << (free + 1)) - 1)):
        return True
    if out & ((1 << (free + 1)) - 1):  # a document that still fits
        return True
    span, width = several, 1
    while width < free + 1:
        step = min(width, free + 1 - width)
        span |= span << step
        width += step
    return bool(span & out)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer containers (Martello and Toth's L2)."""
    number, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for s, n in counts.items():
        number[s], total[s] = n, n * s
    number, total = np.cumsum(number), np.cumsum(total)  # up to each size
    half = capacity // 2
    k = np.arange(0, half + 1)
    large = number[capacity] - number[capacity - k]
    middle, held = number[capacity - k] - number[half], total[capacity - k] - total[half]
    small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(small - (middle * capacity - held)) // capacity))
    return int((large + middle + more).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each size, largest first, goes where it leaves least room."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for s in sorted(counts, reverse=True):
        if 2 * s > capacity:  # no two of these share a container
            rooms += [(capacity - s, len(out) + i) for i in range(counts[s])]
            out += [[s] for _ in range(counts[s])]
            continue
        for _ in range(counts[s]):
            at = bisect_left(rooms, (s, -1))
            room, i = rooms.pop(at) if at < len(rooms) else (capacity, len(out))
            if i == len(out):
                out.append([])
            out[i].append(s)
            insort(rooms, (room - s, i))
    return out


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """(containers as lists of sizes, whether their number is proved least)."""
    least = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    if len(incumbent) == least:
        # Equal in number, but the first descent below fills the containers that come first completely, which carries less.
        nodes = 0
    total = sum(s * n for s, n in counts.items())
    stock = Stock(counts, capacity)
    path: list[list[int]] = []
    more: list[Iterator[list[int]] | None] = []  # the other fillings of each container on the path, once asked for
    wasted: list[int] = [0]

    def enter(filling: list[int]) -> None:
        for s in filling:
            stock.take(s)
        path.append(filling)
        wasted.append(wasted[-1] + capacity - sum(filling))

    def leave() -> list[int]:
        wasted.pop()
        filling = path.pop()
        for s in filling:
            stock.put(s)
        return filling

    def descend(budget: int) -> int:
        """Best fillings down to the last document, or until the waste is more than a better packing may have."""
        spare = (len(incumbent) - 1) * capacity - total
        while stock.sizes and (not first or wasted[-1] <= spare):
            largest = stock.sizes[-1]
            stock.take(largest)
            filling = stock.best(capacity - largest)
            if filling is None:
                stock.refresh()
                filling = stock.best(capacity - largest)
            stock.put(largest)
            enter([largest, *filling])
            more.append(None)
            budget -= 1
        return budget

    first = False
    descend(0)
    if len(path) <= len(incumbent):
        incumbent = list(path)
    first = True
    while path and len(incumbent) > least:
        if nodes <= 0:
            return incumbent, False
        filling = leave()
        others = more.pop()
        spare = (len(incumbent) - 1) * capacity - total - wasted[-1]
        if spare < 0:
            continue
        if others is None:
            largest = filling[0]
            stock.take(largest)
            stock.refresh()
            others = stock.fillings(capacity - largest, spare)
            stock.put(largest)
            next(others, None)  # the one just left
        found = next(others, None)
        nodes -= 1
        if found is None or capacity - filling[0] - sum(found) > spare:
            continue
        enter([filling[0], *found])
        more.append(others)
        stock.refresh()
        nodes = descend(nodes)
        if not stock.sizes and len(path) < len(incumbent):
            incumbent = list(path)
    return incumbent, len(incumbent) == least or not path


def pack(items: list[tuple[int, object]], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[list[tuple[int, object]]], bool]:
    """(containers of (size, item) for items of 1..capacity, proved): proved if there is no packing with fewer containers."""
    stock: dict[int, list] = {}
    for size, item in items:
        stock.setdefault(size, []).append(item)
    containers, proved = bin_completion({s: len(x) for s, x in stock.items()}, capacity, nodes)
    return [[(s, stock[s].pop()) for s in c] for c in containers], proved


def _assign(keys: list, counts: list[int], carry: list, capacity: int, final: bool, most: int = CARRY) -> tuple[list, list]:
    """Rows (container, key, part_no, tokens, filled) of the closed containers, and the items carried on, ``most`` of them at most."""
    items = list(carry)
    rows = []
    empties = []
    for key, n in zip(keys, counts, strict=True):
        if n == 0:
            empties.append((0, (key, 0)))
        part = 0
        while n > capacity:
            rows.append((f"{key}:{part}", key, part, capacity, capacity))
            n -= capacity
            part += 1
        if n:
            items.append((n, (key, part)))
    # Every window is searched: what it closes at FULL can't be mended by a later one.
    containers, _ = pack(items, capacity)
    if empties:
        if containers:
            containers[-1] += empties
        else:
            containers = [empties]
    kept = []

    def close(c: list) -> None:
        filled = sum(s for s, _ in c)
        key, part = c[0][1]
        rows.extend((f"{key}:{part}", k, p, s, filled) for s, (k, p) in c)

    for c in containers:
        if not final and sum(s for s, _ in c) < capacity * FULL and all(s for s, _ in c):
            kept.append(c)
        else:
            close(c)
    carried = sum(map(len, kept))
    if carried > most:
        kept.sort(key=lambda c: sum(s for s, _ in c))
        while carried > most:
            carried -= len(kept[-1])
            close(kept.pop())
    return rows, [x for c in kept for x in c]


def fill_containers(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """container, key, part_no, tokens, filled: the container of every document, and how many tokens that container holds.

    A container is named by the document and part that opened it, so names are unique as far as keys are.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        key_type = pa.int64()
        carry: list = []
        keys: list = []
        counts: list[int] = []

        def emit(rows: list) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.string(), key_type, pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["container", key, "part_no", "tokens", "filled"])

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                counts.append(len(encode(t)) if t else 0)
                if len(keys) >= window:
                    rows, carry = _assign(keys, counts, carry, capacity, final=False)
                    keys, counts = [], []
                    yield emit(rows)
        if keys or carry:
            yield emit(_assign(keys, counts, carry, capacity, final=True)[0])

    source = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return source.mapInArrow(run, f"container string, `{key}` {kind}, part_no int, tokens int, filled int")


def check(placed: DataFrame, docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row of invariants: documents, documents placed, containers above the capacity or with a wrong sum, documents cut without need."""
    sums = placed.groupBy("container").agg(F.sum("tokens").alias("n"), F.max("filled").alias("filled"))
    whole = placed.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("n"), F.countDistinct("part_no").alias("different"))
    bad = sums.agg(F.count_if((F.col("n") > capacity) | (F.col("n") != F.col("filled"))).alias("wrong_containers"))
    cut = whole.agg(F.count(F.lit(1)).alias("placed"), F.count_if((F.col("parts") > 1) & (F.col("parts") != F.ceil(F.col("n") / capacity))).alias("cut_without_need"), F.count_if(F.col("parts") != F.col("different")).alias("placed_twice"))
    return docs.filter(F.col(key).isNotNull()).agg(F.countDistinct(key).alias("documents")).crossJoin(cut).crossJoin(bad)
