"""Near duplicates by 64-bit SimHash: Hamming distance at most 8 and Jaccard similarity of terms at least 0.6."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollate.operators.graph import components
from recollate.session import cut

MOST_DISTANT, LEAST_SIMILAR, LEAST_TERMS = 8, 0.6, 4
#: 64 bits in ten blocks: eight changed bits leave at least two of them alone, so two equal blocks find every pair.
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
#: Hashes that count as a short run, and pairs that are looked at in one step.
SHORT, MOST_AT_ONCE = 128, 1 << 20


def term_hash(term: Column) -> Column:
    """The first 64 bits of the MD5 of a term."""
    return F.conv(F.substring(F.md5(term), 1, 16), 16, -10).cast("long")


def simhash(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit i is set if more than half of a set's hashes have it; hashes holds the sets one after the other, none of them empty."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def band_keys(sims: np.ndarray) -> np.ndarray:
    """For each hash one key per pair of blocks: the pair's number above the values of both blocks."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [(sims.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(starts, BLOCKS, strict=True)]
    pairs = combinations(range(len(BLOCKS)), 2)
    return np.stack([(np.uint64(n) << np.uint64(16)) | (block[i] << np.uint64(BLOCKS[j])) | block[j] for n, (i, j) in enumerate(pairs)], 1).view(np.int64)


def signatures(records: DataFrame) -> DataFrame:
    """class, terms, size, sim: one row per different set of terms with enough of them."""
    return _hashed(records).select(F.sha2("joined", 256).alias("class"), F.split("joined", " ").alias("terms"), "size", "sim")


def _hashed(records: DataFrame) -> DataFrame:
    """joined, size, sim: each set of terms as one text, which takes a third of the room of an array."""
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    sets = records.select(F.inline(F.array(F.struct(terms.alias("terms"))))).filter(F.size("terms") >= LEAST_TERMS)
    classes = sets.select(F.array_join("terms", " ").alias("joined")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("hashes")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            sims = simhash(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)), np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("joined"), pa.array(sizes.astype(np.int32)), pa.array(sims)], names=["joined", "size", "sim"])

    hashed = classes.select("joined", F.transform(F.split("joined", " "), term_hash).alias("hashes"))
    return hashed.mapInArrow(run, "joined string, size int, sim long")


def class_of(records: DataFrame) -> DataFrame:
    """doc_id, class of every record with enough terms."""
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    sets = records.select("doc_id", F.inline(F.array(F.struct(terms.alias("terms"))))).filter(F.size("terms") >= LEAST_TERMS)
    return sets.select("doc_id", F.sha2(F.array_join("terms", " "), 256).alias("class"))


def bands(sims: DataFrame) -> DataFrame:
    """sim, band: every hash under each of its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            keys = band_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, keys.shape[1])), pa.array(keys.ravel())], names=["sim", "band"])

    return sims.mapInArrow(run, "sim long, band long")


def blocks(sims: DataFrame) -> DataFrame:
    """block, sims: hashes that share the value of a block, as one binary of 64-bit numbers; of two equal blocks the first is never the last of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(len(BLOCKS) - 1 if len(own) else 0):
                values = _block(own, i)
                order = np.argsort(values, kind="stable")
                value, starts = np.unique(values[order], return_index=True)
                places = pa.py_buffer(np.append(starts, len(own)).astype(np.int32) * 8)
                packed = pa.Array.from_buffers(pa.binary(), len(value), [None, places, pa.py_buffer(own[order])])
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32) | (i << max(BLOCKS))), packed], names=["block", "sims"])

    return sims.mapInArrow(run, "block int, sims binary")


def near_hashes(sims: DataFrame) -> DataFrame:
    """sim_a, sim_b of all hashes within MOST_DISTANT, each pair once, in either order; a hash that comes more than once is a pair with itself.

    Hashes travel under the first of two equal blocks only; those that share it meet here under the second.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [(x.column("block")[0].as_py(), y) for x in batches if x.num_rows for y in x.column("sims").to_pylist()]
        first = packed[0][0] >> max(BLOCKS)
        own, times = np.unique(np.frombuffer(b"".join(y for _, y in packed), np.uint64), return_counts=True)
        same = own[times > 1] if first == 0 else own[:0]
        met, n = [(same, same)], len(same)
        for pairs in _close(own, first):
            met.append(pairs)
            n += len(pairs[0])
            if n >= MOST_AT_ONCE:
                yield _paired(met)
                met, n = [], 0
        if met:
            yield _paired(met)

    return blocks(sims).groupBy("block").applyInArrow(meet, "sim_a long, sim_b long")


def _paired(met: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(side).view(np.int64)) for side in zip(*met, strict=True)], names=["sim_a", "sim_b"])


def _block(sims: np.ndarray, i: int) -> np.ndarray:
    return ((sims >> np.uint64(sum(BLOCKS[:i]))) & np.uint64((1 << BLOCKS[i]) - 1)).astype(np.uint8)


def _close(own: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs among different hashes with an equal block first, where no block before it is equal, so that a pair comes out in one place only."""
    masks = [np.uint64(((1 << w) - 1) << sum(BLOCKS[:i])) for i, w in enumerate(BLOCKS)]
    for second in range(first + 1, len(BLOCKS)):
        values = _block(own, second)
        order = np.argsort(values, kind="stable")
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _within(own[order], np.bincount(values)):
            met.append((a, b))
            if len(met) == 1000 or len(a) >= MOST_AT_ONCE // 8:
                yield _first_met(met, first, second, masks)
                met = []
        if met:
            yield _first_met(met, first, second, masks)


def _within(hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of each run of hashes, runs of the given sizes one after the other; pairs of two runs may be among them."""
    own = np.repeat(sizes, sizes)
    short = hashes[own <= SHORT]
    for d in range(1, int(own[own <= SHORT].max(initial=1))):  # each hash meets the one after it, the next but one, and so on
        at = np.flatnonzero(np.bitwise_count(short[d:] ^ short[:-d]) <= MOST_DISTANT)
        if len(at):
            yield short[at], short[at + d]
    starts = np.cumsum(sizes) - sizes
    for n in np.flatnonzero(sizes > SHORT):  # some hashes at a time meet all from there on
        run = hashes[starts[n] : starts[n] + sizes[n]]
        rows = max(1, MOST_AT_ONCE // 8 // len(run))
        for start in range(0, len(run), rows):
            rest = run[start:]
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(rest[:rows, None] ^ rest[None, :]).ravel() <= MOST_DISTANT), len(rest))
            i, j = i[i < j], j[i < j]
            if len(i):
                yield rest[i], rest[j]


def _first_met(met: list[tuple[np.ndarray, np.ndarray]], first: int, second: int, masks: list[np.uint64]) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose first two equal blocks are first and second."""
    a, b = (np.concatenate(side) for side in zip(*met, strict=True))
    right = np.logical_and.reduce([((a ^ b) & masks[i] == 0) == (i in (first, second)) for i in range(second + 1)])
    return a[right], b[right]


def near_pairs(records: DataFrame) -> DataFrame:
    """class_a < class_b, distance, similarity of all pairs of different term sets within both limits; nothing is missed.

    Candidates are pairs of hashes, two numbers a row; the sets come in for those that are near, and for sets of one hash. Spark takes the sets for
    small, as it knows nothing of the length of texts; without the hints it would gather all of them in the driver to broadcast them.
    """
    classes = cut(_hashed(records))
    near = near_hashes(classes.select("sim"))
    left, right = (classes.select(F.col("sim").alias(f"sim_{x}"), F.col("size").alias(f"size_{x}"), F.col("joined").alias(x)) for x in "ab")
    met = near.join(left.hint("merge"), "sim_a").join(right.hint("merge"), "sim_b").filter((F.col("sim_a") != F.col("sim_b")) | (F.col("a") < F.col("b")))
    met = met.filter(F.least("size_a", "size_b") >= LEAST_SIMILAR * F.greatest("size_a", "size_b"))
    common = F.size(F.array_intersect(F.split("a", " "), F.split("b", " ")))
    similarity = common / (F.col("size_a") + F.col("size_b") - common)
    one, other = F.sha2("a", 256), F.sha2("b", 256)
    apart = F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b"))).cast("long")
    return met.select(F.least(one, other).alias("class_a"), F.greatest(one, other).alias("class_b"), apart.alias("distance"), similarity.alias("similarity")).filter(F.col("similarity") >= LEAST_SIMILAR)


def near_groups(records: DataFrame) -> DataFrame:
    """component, doc_id, adapter of groups of alike records that cross adapters (copies belong together as well)."""
    return cross_source(grouped(records, near_pairs(records)))


def grouped(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """component, doc_id, adapter, class of every record with enough terms."""
    linked = components(pairs, "class_a", "class_b").withColumnRenamed("node", "class")
    own = class_of(records).join(linked, "class", "left").select("doc_id", "class", F.coalesce("component", "class").alias("component"))
    return own.join(records.select("doc_id", "adapter"), "doc_id")


def cross_source(members: DataFrame) -> DataFrame:
    several = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("adapter").alias("adapters")).filter("n > 1 AND adapters > 1")
    return members.join(several.select("component"), "component", "left_semi").select("component", "doc_id", "adapter")


def group_report(records: DataFrame, limit: int = 20) -> DataFrame:
    """component, members, adapters, min_similarity, max_distance of the groups that cross adapters: largest first, then the least alike; limit is clamped to 1..100.

    Similarity and distance are those of the pairs that hold the group together; a group of copies alone has 1 and 0.
    """
    pairs = cut(near_pairs(records))
    members = cut(grouped(records, pairs))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("adapter").alias("adapters")).filter("members > 1 AND adapters > 1")
    of = members.select(F.col("class").alias("class_a"), "component").distinct()
    links = pairs.join(of, "class_a").groupBy("component").agg(F.min("similarity").alias("s"), F.max("distance").alias("d"))
    full = sizes.join(links, "component", "left").select("component", "members", "adapters", F.round(F.coalesce("s", F.lit(1.0)), 6).alias("min_similarity"), F.coalesce("d", F.lit(0).cast("long")).alias("max_distance"))
    return full.orderBy(F.col("members").desc(), "min_similarity", "component").limit(min(max(limit, 1), 100))
