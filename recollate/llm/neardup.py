"""Near-duplicate records: all pairs of word sets with Jaccard similarity of at least a threshold.

Odd sketches of MinHash samples verify banded candidates:
* the MinHash sample of a record is its ``SAMPLE`` words with the least hashes (a bottom-k sample; a smaller set is its own sample); the odd
  sketch folds it into 256 parity bits, and the population count of the XOR of two sketches estimates how much the samples differ.
  Where both samples are whole sets, that count never exceeds the difference, so the test loses nothing; for larger sets a candidate is
  discarded if its estimated similarity is ``SLACK`` below the threshold, which is beyond eight standard deviations;
* the bands are words of the records taken in one global order that puts rare words first; by the prefix principle two sets at the
  threshold share at least ``l`` of their first n - ceil(t n) + l words, so bands of that prefix meet without loss (``bands``);
* what is left is compared exactly.

Bands. Sets up to ``LONG`` words use all combinations of two words of the prefix with l = 2. Longer sets split the words by hash into
G groups, a power of two that grows with the size, and combine two words of a group: with l = G + 1 some group holds two of the shared
words. A set near the size where G doubles, or where the two ways meet, uses both, so that no pair falls between.

Skew. Copies (equal word sets) are one class before anything else. Bands of two words whose bucket is crowded are replaced by bands of three,
in short sets these by bands of four, so that no common phrase makes a bucket of all pairs. Buckets are counted in full over all
data, each task sending its counts as compressed runs, in a table of slots that grows with the number of classes (``slots_for``), so the number of
bands a class has doesn't depend on how many classes there are; a collision of slots only lengthens a band.
Words are ordered by counts over all data in a table of ``WORD_SLOTS`` counters; any order is lossless.

A word is a maximal run of letters and digits, lower-cased. Null texts and texts without words have no links. Words are
compared by 32-bit hashes (within a pair of sets a false match has odds below one in ten million), sets by 64-bit ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollate.session import cut

THRESHOLD = 0.8
WORD_SLOTS = 1 << 18
#: A bucket with more bands than this is crowded: one band more costs as much to shuffle as some hundred comparisons inside a bucket. Slots that count buckets: 64 for each class, within these powers of two.
CROWDED, LEAST_SLOTS, MOST_SLOTS = 256, 22, 28
#: Sets above this size are banded by groups of words; sets above THRESHOLD times it by both, so that no pair falls between.
LONG = 48
#: Words of a MinHash sample, bits of its odd sketch, and how far below the threshold an estimate from samples must be to discard.
SAMPLE, BITS, SLACK = 256, 256, 0.25
#: Classes of copies up to this size are written out as pairs; larger ones as links to their least record.
EXPAND = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_sets(records: DataFrame, key: str, text: str) -> DataFrame:
    """rec, words (distinct hashes, sorted), class, size of every record with a word."""
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.hash(w))))
    sets = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("rec"), F.inline(F.array(F.struct(words.alias("words"))))).filter(F.size("words") > 0)
    return sets.select("rec", "words", F.xxhash64("words").alias("class"), F.size("words").alias("size"))


def word_counts(sets: DataFrame) -> np.ndarray:
    """How often each slot's words occur, over all records; at most WORD_SLOTS rows reach the driver."""
    counted = sets.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(WORD_SLOTS)).cast("int").alias("slot")).count()
    out = np.zeros(WORD_SLOTS, np.int64)
    got = counted.toArrow()
    out[got.column("slot").to_numpy()] = got.column("count").to_numpy()
    return out


def sample_size(n: int | np.ndarray, words: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Length of the prefix in which two sets at the threshold share at least that many words."""
    return np.minimum(n, n - np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64) + words)


def minhash_sample(flat: np.ndarray, sizes: np.ndarray, k: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(words, sizes) of the sets' samples: of each set its k words with the least hashes; flat holds the sets one after the other."""
    if not (sizes > k).any():
        return flat, sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    mixed = flat.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
    order = np.lexsort((mixed, row))
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[order][rank < k], np.minimum(sizes, k)


def odd_sketch(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """256 parity bits of each set, as four words; flat holds the sets' hashes one after the other, none of them empty."""
    bit = np.uint64(1) << (flat.astype(np.int64) & 63).astype(np.uint64)
    part = (flat.astype(np.int64) >> 6) & 3
    return [np.bitwise_xor.reduceat(np.where(part == j, bit, np.uint64(0)), starts).view(np.int64) for j in range(4)]


_SKETCH = ("s0", "s1", "s2", "s3")


def group_numbers(n: int, threshold: float = THRESHOLD) -> list[int]:
    """In how many groups the words of a set of n words fall: one number, two where a slightly larger set has twice as many."""
    own = 1 << int(math.log2(max(n, 5) / 5) + 1e-9)
    return [own, 2 * own] if n >= threshold * 10 * own - 1e-9 else [own]


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its rarest words a set of n words needs at most."""
    most = np.array([2 * group_numbers(int(x), threshold)[-1] + 1 if x > threshold * LONG else 4 for x in range(int(n.max(initial=0)) + 1)])
    return sample_size(n, most[n], threshold)


def samples(sets: DataFrame, counts: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """class, size, s0 to s3 (the sketch), sample: one row per class, its rarest words first, as many as its bands need."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("words").flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column("size").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            order = np.lexsort((flat, table[flat % len(table)], row))
            rank = np.arange(len(flat)) - np.repeat(starts, sizes)
            keep = rank < np.repeat(_prefix(sizes, threshold), sizes)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(sizes)))))
            sample = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[order][keep], pa.int32()))
            least, held = minhash_sample(flat, sizes)
            sketch = [pa.array(x) for x in odd_sketch(least, np.cumsum(held) - held)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("size"), *sketch, sample], names=["class", "size", *_SKETCH, "sample"])

    rows = sets.select("class", "size", "words").mapInArrow(run, "class long, size int, s0 long, s1 long, s2 long, s3 long, sample array<int>")
    return rows.groupBy("class", "size", *_SKETCH, "sample").agg(F.lit(1).alias("__one")).drop("__one")


def _hash(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(parts[0].shape, len(parts), np.uint64)
    for p in parts:
        out = (out ^ p.view(np.uint64)) * _ODD
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    # 48 bits: two bands that meet by chance only make a candidate more.
    return (out >> np.uint64(16)).view(np.int64)


class Crowd:
    """Which slots are crowded, one bit each, for bands of two words, of three and so on."""

    def __init__(self, power: int, found: list[np.ndarray] = ()):
        self.power, self.bits = power, []
        for slots in found:
            self.add(slots)

    def add(self, slots: np.ndarray) -> None:
        bits = np.zeros(1 << (self.power - 3), np.uint8)
        np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        self.bits.append(bits)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return keys & ((1 << self.power) - 1)

    def hot(self, keys: np.ndarray, words: int) -> np.ndarray:
        if len(self.bits) <= words - 2:
            return np.zeros(keys.shape, bool)
        at = self.slot(keys)
        return (self.bits[words - 2][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _within_groups(rows: np.ndarray, words: np.ndarray, groups: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, band key) of all combinations of ``number`` words of a row that fall in one group; the words of a row stand together in global order."""
    group = (words * np.int64(2654435761) >> np.int64(7)) & np.int64(groups - 1)
    order = np.lexsort((group, rows))  # stable: the global order stays within a group
    r, w, g = rows[order], words[order], group[order]
    cell = np.cumsum(np.concatenate(([True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])))) if len(r) else np.zeros(0, int)
    most = int(np.bincount(cell).max(initial=0)) if len(cell) else 0
    out_rows, out_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for steps in combinations(range(1, most), number - 1):
        first = np.arange(len(r) - steps[-1])
        first = first[cell[first] == cell[first + steps[-1]]]
        if len(first):
            out_rows.append(r[first])
            out_keys.append(_hash([w[first], *(w[first + d] for d in steps), np.full(len(first), groups, np.int64)]))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def bands(sizes: np.ndarray, values: np.ndarray, offsets: np.ndarray, crowd: Crowd, level: int | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band key, number of groups or 0 for the bands of short sets) of sets given as samples. level: only the bands of that many words (for counting), else the final ones."""
    rows_out, keys_out, groups_out = [], [], []

    def emit(rows: np.ndarray, keys: np.ndarray, groups: int) -> None:
        rows_out.append(rows)
        keys_out.append(keys)
        groups_out.append(np.full(len(rows), groups))

    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if n > threshold * LONG and level in (None, 2):
            for groups in group_numbers(int(n), threshold):
                take = lambda l: (np.repeat(rows, k := int(sample_size(n, l, threshold))), (offsets[rows][:, None] + np.arange(k)).ravel())
                of, at = take(groups + 1)
                own, keys = _within_groups(of, values[at], groups, 2)
                hot = crowd.hot(keys, 2) if level is None else np.zeros(len(keys), bool)
                emit(own[~hot], keys[~hot], groups)
                if hot.any():  # a set that meets a crowd combines three words wherever a group has them
                    of, at = take(2 * groups + 1)
                    some = np.isin(of, np.unique(own[hot]))
                    emit(*_within_groups(of[some], values[at[some]], groups, 3), groups)
        if n > LONG or n < 2:
            continue
        p2 = int(sample_size(n, 2, threshold))
        combos = list(combinations(range(p2), 2))
        m = values[offsets[rows][:, None] + np.arange(min(int(n), p2 + 2))]
        live = np.ones((len(rows), len(combos)), bool)
        for words in (2, 3, 4):
            index = np.array(combos)
            keys = _hash([m[:, index[:, j]] for j in range(words)])
            hot = live & crowd.hot(keys, words)
            chosen = live & ~hot if level is None else live
            if level in (None, words):
                emit(np.broadcast_to(rows[:, None], keys.shape)[chosen], keys[chosen], 0)
            if level == words or words == 4 or not hot.any():
                break
            some = hot.any(axis=1)
            rows, m, hot = rows[some], m[some], hot[some]
            p = int(sample_size(n, words + 1, threshold))
            if p < words + 1:  # such small sets can only be linked if equal
                break
            larger = list(combinations(range(p), words + 1))
            at = {c: i for i, c in enumerate(combos)}
            live = np.zeros((len(rows), len(larger)), bool)
            for k, c in enumerate(larger):
                for sub in combinations(c, words):
                    if sub in at:
                        live[:, k] |= hot[:, at[sub]]
            combos = larger
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(keys_out), np.concatenate(groups_out)


def slots_for(classes: int) -> int:
    """The power of two of slots that count the buckets of so many classes."""
    return min(max(math.ceil(math.log2(64 * max(classes, 1))), LEAST_SLOTS), MOST_SLOTS)


PARTS = 64


def _crowded(sampled: DataFrame, level: int, power: int, found: list[np.ndarray], threshold: float) -> np.ndarray:
    """The slots that hold more than CROWDED bands of ``level`` words, counted in full over all classes.

    A task sends the slots it met as compressed differences, about two bytes for a band; they are added up by ranges of slots.
    """
    shared = sampled.sparkSession.sparkContext.broadcast((power, found))
    width = (1 << power) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = Crowd(*shared.value)
        met = []
        for batch in batches:
            lists = batch.column("sample")
            met.append(crowd.slot(bands(batch.column("size").to_numpy().astype(np.int64), _values(lists), _offsets(lists), crowd, level, threshold)[1]))
        slots, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *met]), return_counts=True)
        edges = np.searchsorted(slots, np.arange(PARTS + 1) * width)
        for part in range(PARTS):
            s, c = slots[edges[part] : edges[part + 1]], counts[edges[part] : edges[part + 1]]
            if len(s):
                raw = np.diff(s, prepend=part * width).astype(np.uint32).tobytes() + np.minimum(c, 65535).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(s)], pa.int32()), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], names=["part", "n", "met"])

    def total(table: pa.Table) -> pa.Table:
        count = np.zeros(width, np.int64)
        part = table.column("part")[0].as_py()
        for n, met in zip(table.column("n").to_pylist(), table.column("met").to_pylist(), strict=True):
            raw = pa.decompress(met, decompressed_size=6 * n, codec="zstd", asbytes=True)
            count[np.cumsum(np.frombuffer(raw, np.uint32, n).astype(np.int64))] += np.frombuffer(raw, np.uint16, n, 4 * n)
        return pa.table({"slot": pa.array(np.flatnonzero(count > CROWDED) + part * width, pa.int64())})

    counted = sampled.select("size", "sample").mapInArrow(run, "part int, n int, met binary").groupBy("part").applyInArrow(total, "slot long")
    return np.sort(counted.toArrow().column("slot").to_numpy())


def _values(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    o = lists.offsets.to_numpy().astype(np.int64)
    return o[:-1] - o[0]


def _banded(sampled: DataFrame, power: int, found: list[np.ndarray], threshold: float) -> DataFrame:
    shared = sampled.sparkSession.sparkContext.broadcast((power, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = Crowd(*shared.value)
        for batch in batches:
            lists = batch.column("sample")
            rows, keys, groups = bands(batch.column("size").to_numpy().astype(np.int64), _values(lists), _offsets(lists), crowd, None, threshold)
            take = pa.array(rows.astype(np.int32))
            s = [batch.column(c).to_numpy() for c in _SKETCH]
            # The larger the sets of a band, the more parity bits: 32 (a fold of all), 64 up to 8 groups, 128 up to 16, else 256. Both sides of a band have the same.
            two = [s[0] ^ s[2], s[1] ^ s[3]]
            one = two[0] ^ two[1]
            width = np.select([groups == 0, groups <= 8, groups <= 16], [0, 1, 2], 4)
            first = np.select([width == 0, width == 1, width == 2], [((one ^ (one >> 32)) & 0xFFFFFFFF)[rows], one[rows], two[0][rows]], s[0][rows])
            second = np.select([width == 2, width == 4], [two[1][rows], s[1][rows]], 0)
            sketch = [pa.array(x) for x in (first, second, np.where(width == 4, s[2][rows], 0), np.where(width == 4, s[3][rows], 0))]
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("class").take(take), batch.column("size").take(take), *sketch], names=["band", "class", "size", *_SKETCH])

    return sampled.mapInArrow(run, "band long, class long, size int, s0 long, s1 long, s2 long, s3 long")


def may_be_alike(size_a: Column, size_b: Column, differing: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the population count of the XOR of two sketches leaves a pair a candidate.

    Whole sets: |A xor B| <= (|A| + |B|)(1 - t)/(1 + t) at the threshold, and the count never exceeds |A xor B|. Samples: the count estimates their
    difference as d = -BITS/2 ln(1 - 2 count / BITS), and so the similarity as (2 SAMPLE - d)/(2 SAMPLE + d).
    """
    whole = differing <= (size_a + size_b) * ((1 - threshold) / (1 + threshold)) + 1e-9
    low = threshold - SLACK
    most = BITS / 2 * (1 - math.exp(-2 / BITS * 2 * SAMPLE * (1 - low) / (1 + low)))
    return F.when(F.greatest(size_a, size_b) <= SAMPLE, whole).otherwise(differing <= most)


def class_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """class_a < class_b and similarity of all pairs of different word sets at or above the threshold."""
    sampled = cut(samples(sets, word_counts(sets), threshold))
    power, found = slots_for(sampled.count()), []
    for level in (2, 3):
        found.append(_crowded(sampled, level, power, found, threshold))
    rows = _banded(sampled, power, found, threshold)
    a, b = rows.alias("a"), rows.alias("b")
    differing = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    near = (
        (F.col("a.band") == F.col("b.band"))
        & (F.col("a.class") < F.col("b.class"))
        & (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - 1e-9)
        & may_be_alike(F.col("a.size"), F.col("b.size"), differing, threshold)
    )
    pairs = cut(a.join(b, near).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).distinct())
    wanted = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    words = cut(sets.select("class", "words").join(wanted, "class", "left_semi").groupBy("class", "words").agg(F.lit(1).alias("__one")).drop("__one"))
    left = words.select(F.col("class").alias("class_a"), F.col("words").alias("words_a"))
    right = words.select(F.col("class").alias("class_b"), F.col("words").alias("words_b"))
    both = pairs.join(left, "class_a").join(right, "class_b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    exact = both.select("class_a", "class_b", common.alias("common"), (F.size("words_a") + F.size("words_b")).alias("total"))
    similarity = F.col("common") / (F.col("total") - F.col("common"))
    return exact.select("class_a", "class_b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def near_duplicates(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """key_a < key_b of all pairs of records at or above the threshold.

    A record is a key; it may come in several copies. Classes of more than EXPAND copies aren't written out as all pairs: each copy is
    linked to the least key of its class, and that key stands for the class in links to others, so no link between
    different texts is lost.
    """
    sets = word_sets(records, key, text)
    members = cut(sets.select("rec", "class").distinct())
    links = class_links(sets, threshold)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("least"))
    ranked = members.join(sizes.filter("n > 1"), "class", "left")
    speakers = ranked.filter(f"n IS NULL OR n <= {EXPAND} OR rec = least").select("class", "rec")
    across = links.join(speakers.select(F.col("class").alias("class_a"), F.col("rec").alias("x")), "class_a").join(speakers.select(F.col("class").alias("class_b"), F.col("rec").alias("y")), "class_b").select("x", "y")
    copies = ranked.filter("n > 1")
    few = copies.filter(F.col("n") <= EXPAND).select("class", "rec")
    within = few.select("class", F.col("rec").alias("x")).join(few.select("class", F.col("rec").alias("y")), "class").select("x", "y").filter("x < y")
    many = copies.filter((F.col("n") > EXPAND) & (F.col("rec") != F.col("least"))).select(F.col("least").alias("x"), F.col("rec").alias("y"))
    every = across.filter("x <> y").unionByName(within).unionByName(many)
    return every.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def groups(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """rec, class, links: the class of equal word sets of every record, and how many other classes its own is linked to."""
    sets = word_sets(records, key, text)
    members = cut(sets.select("rec", "class").distinct())
    links = class_links(sets, threshold)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class", "left").select("rec", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
