"""Full-text, vector and fused search, context packing and evaluation, each for a set of queries at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollate.functions.text import STOP_PAIRS, STOP_WORDS, index_terms, project_root
from recollate.session import cut

K1, B, FUSION = 1.2, 0.75, 60
BOOST, BOOSTED = 0.05, ("preference", "feedback", "fact", "skill", "reference")
#: Vectors that stand in one block of queries and in one of the index: they bound what a task holds.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Records that stand in one block of the text index, and pairs of a rare term's queries and records spread out at a time.
TEXT_BLOCK, SPREAD = 4096, 1 << 22


def pool_size(limit: int) -> int:
    """Candidates to take from each list: eight times the limit, at least 64, at most 512, never below the limit."""
    return 0 if limit <= 0 else max(limit, min(max(8 * limit, 64), 512))


def resolve_mode(mode: str | None, has_vectors: bool) -> str:
    """fulltext, vector or hybrid (the default); keyword is another name of fulltext. Without vectors everything is fulltext."""
    name = {"keyword": "fulltext", None: "hybrid"}.get(mode, mode)
    if name not in ("fulltext", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    return name if has_vectors else "fulltext"


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, strict (how many terms the query has), relaxed (whether the term counts when not all are met); queries: query_id, text."""
    stop = F.col("term").isin(*sorted(STOP_WORDS | STOP_PAIRS))
    each = queries.select("query_id", F.inline(F.array(F.struct(index_terms(F.col("text")).alias("terms"))))).select("query_id", F.size("terms").alias("strict"), "terms")
    meant = F.size(F.array_except("terms", F.array(*[F.lit(w) for w in sorted(STOP_WORDS | STOP_PAIRS)])))
    return each.select("query_id", "strict", meant.alias("meant"), F.explode("terms").alias("term")).select("query_id", "term", "strict", (~stop | (F.col("meant") == 0)).alias("relaxed"))


def _index(records: DataFrame, key: str, text: str) -> DataFrame:
    """keys, lengths, vocabulary, counts, items: records in blocks of at most TEXT_BLOCK.

    lengths: distinct terms of each record, null without a text; counts: how many records of the block have each word of its vocabulary; items: the records' terms
    one record after the other as numbers of the vocabulary (uint32, zlib).
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_BLOCK):
                part = batch.slice(at, TEXT_BLOCK)
                lengths = pc.list_value_length(part.column(1))
                coded = part.column(1).flatten().dictionary_encode()
                items, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32), coded.dictionary
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
                columns = [one(part.column(0), part.column(0).type), one(lengths, pa.int32()), one(words, pa.string()), one(pa.array(np.bincount(items, minlength=len(words))), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([zlib.compress(items.tobytes(), 1)], pa.binary())], names=["keys", "lengths", "vocabulary", "counts", "items"])

    terms = records.select(key, F.inline(F.array(F.struct(index_terms(F.col(text)).alias("terms")))))
    return terms.mapInArrow(run, f"keys array<{kind}>, lengths array<int>, vocabulary array<string>, counts array<bigint>, items binary")


def _query_blocks(asked: DataFrame, number: int) -> DataFrame:
    """query_ids, strict, sizes, terms, relaxed, idf, mean: the queries of ``asked`` in blocks of at most QUERY_BLOCK; sizes: how many of the terms belong to each."""
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                lists = part.column(3)
                each = lists.flatten()
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = [one(part.column(0)), one(part.column(1)), one(pc.list_value_length(lists)), *(one(each.field(i)) for i in range(3)), part.column(2).slice(0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_ids", "strict", "sizes", "terms", "relaxed", "idf", "mean"])

    each = asked.groupBy("query_id").agg(F.first("strict").alias("strict"), F.first("mean").alias("mean"), F.collect_list(F.struct("term", "relaxed", "idf")).alias("terms"))
    return each.repartition(number).mapInArrow(run, f"query_ids array<{kind}>, strict array<int>, sizes array<int>, terms array<string>, relaxed array<boolean>, idf array<double>, mean double")


class _Texts:
    """A block of the index with the records of each word."""

    def __init__(self, row: pa.StructScalar | dict):
        self.keys = row["keys"].values.to_numpy(zero_copy_only=False)
        self.lengths = pc.fill_null(row["lengths"].values, 0).to_numpy(zero_copy_only=False)
        self.words = row["vocabulary"].values
        self.counts = row["counts"].values.to_numpy(zero_copy_only=False)
        items = np.frombuffer(zlib.decompress(row["items"].as_py()), np.uint32)
        self.docs = np.repeat(np.arange(len(self.keys)), self.lengths)[np.argsort(items, kind="stable")]
        self.starts = np.cumsum(self.counts) - self.counts

    def having(self, word: int) -> np.ndarray:
        return self.docs[self.starts[word] : self.starts[word] + self.counts[word]]


class _Asked:
    """A block of queries with the best records that each has met so far."""

    def __init__(self, row: pa.StructScalar | dict, limit: int):
        self.ids = row["query_ids"].values
        self.strict, self.sizes, self.idf = (row[c].values.to_numpy(zero_copy_only=False) for c in ("strict", "sizes", "idf"))
        self.terms, self.relaxed, self.mean, self.limit = row["terms"].values, row["relaxed"].values.to_numpy(zero_copy_only=False), row["mean"].as_py(), limit
        self.of = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.total = np.bincount(self.of, self.idf, len(self.ids))
        self.loose = np.bincount(self.of[self.relaxed], self.idf[self.relaxed], len(self.ids))
        self.best: tuple[np.ndarray, ...] | None = None  # query, tier, rounded score, key, score
        self.bar = np.zeros(len(self.ids))

    def sums(self, texts: _Texts, word: np.ndarray) -> np.ndarray:
        """For each query and record the idf of the relaxed terms that both have: frequent terms in a matrix product, rare ones one by one."""
        n, m = len(self.ids), len(texts.keys)
        use = np.flatnonzero(self.relaxed & (word >= 0))
        asking = np.bincount(word[use], minlength=len(texts.words))
        dense = np.flatnonzero(asking * texts.counts > n * m // 40)
        place = np.full(len(texts.words), -1)
        place[dense] = np.arange(len(dense))
        out = np.zeros((n, m))
        for at in range(0, len(dense), 512):
            some = dense[at : at + 512]
            mine = use[(place[word[use]] >= at) & (place[word[use]] < at + 512)]
            left, right = np.zeros((n, len(some))), np.zeros((len(some), m))
            np.add.at(left, (self.of[mine], place[word[mine]] - at), self.idf[mine])
            for i, w in enumerate(some):
                right[i, texts.having(w)] = 1.0
            out += left @ right
        rare = use[place[word[use]] < 0]
        many = texts.counts[word[rare]]
        ends = np.cumsum(many)
        at = 0
        while at < len(rare):  # so many at a time that what is spread out stays bounded
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPREAD, "right")))
            mine, size = rare[at:to], many[at:to]
            places = np.arange(size.sum()) + np.repeat(texts.starts[word[mine]] - (np.cumsum(size) - size), size)
            out += np.bincount(np.repeat(self.of[mine], size) * m + texts.docs[places], np.repeat(self.idf[mine], size), n * m).reshape(n, m)
            at = to
        return out

    def all_met(self, texts: _Texts, word: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, records) of all pairs in which the record has every term of the query."""
        known = np.bincount(self.of[word >= 0], minlength=len(self.ids)) == self.strict
        queries, docs = [], []
        for q in np.flatnonzero(known):
            some = np.flatnonzero(sums[q] >= self.loose[q] * (1 - 1e-9))  # a little too many, never too few
            if not len(some):
                continue
            met = np.zeros(len(texts.keys), np.int64)
            for w in word[self.starts[q] : self.starts[q] + self.sizes[q]]:
                met[texts.having(w)] += 1
            some = some[met[some] == self.strict[q]]
            queries.append(np.full(len(some), q))
            docs.append(some)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *queries]), np.concatenate([none, *docs])

    def meet(self, texts: _Texts) -> None:
        word = pc.fill_null(pc.index_in(self.terms, value_set=texts.words), -1).to_numpy(zero_copy_only=False)
        norm = (K1 + 1) / (1 + K1 * (1 - B + B * texts.lengths / self.mean))
        sums = self.sums(texts, word)
        first, docs = self.all_met(texts, word, sums)
        sums *= norm
        score = np.round(sums, 9)
        score[first, docs] = np.inf
        bar = self.bar
        if self.limit < score.shape[1]:
            bar = np.maximum(bar, np.partition(score, score.shape[1] - self.limit, axis=1)[:, score.shape[1] - self.limit])
        q, d = np.nonzero((score >= bar[:, None]) & (score > 0))
        strict = np.isinf(score[q, d])
        exact = np.where(strict, self.total[q] * norm[d], sums[q, d])
        found = (q, np.where(strict, 0, 1), np.round(exact, 9), texts.keys[d], exact)
        if self.best is not None:
            found = tuple(np.concatenate(x) for x in zip(self.best, found, strict=True))
        order = np.lexsort((np.unique(found[3], return_inverse=True)[1], -found[2], found[1], found[0]))
        q = found[0][order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.limit]
        self.best = tuple(x[order] for x in found)
        q, tier, rounded = self.best[:3]
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.limit - 1)
        self.bar = np.zeros(len(self.ids))
        self.bar[q[last]] = np.where(tier[last] == 0, np.inf, rounded[last])


def _in_blocks(index: DataFrame, asked: DataFrame, limit: int, key: str, kind: str, number: int) -> DataFrame:
    """query_id, key, tier, score: each block of queries against each block of the index; of every query the best ``limit`` records of a task come out."""
    blocks = cut(_query_blocks(asked, number))
    id_kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, _Asked] = {}
        names = key_type = id_type = None
        for batch in batches:
            id_type, key_type = batch.schema.field("query_ids").type.value_type, batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                name = row["query_ids"].values[0].as_py()
                if name not in held:
                    held[name] = _Asked(row, limit)
                if (now := row["keys"].values[0].as_py()) != names:
                    names, texts = now, _Texts(row)
                held[name].meet(texts)
        for block in held.values():
            q, tier, _, keys, score = block.best
            for at in range(0, len(q), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(q[part])).cast(id_type), pa.array(keys[part], key_type), pa.array(tier[part], pa.int32()), pa.array(score[part])], names=["query_id", key, "tier", "score"])

    return index.crossJoin(blocks).mapInArrow(run, f"query_id {id_kind}, `{key}` {kind}, tier int, score double")


def _joined(records: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, key, tier, score by a join on the term, which adds up what rows of the same key or the same query have."""
    docs = records.select(key, F.inline(F.array(F.struct(index_terms(F.col(text)).alias("terms")))))
    postings = docs.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    weight = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = postings.join(asked, "term").groupBy("query_id", key).agg(
        F.sum(weight).alias("score"), F.count(F.lit(1)).alias("found"), F.max("strict").alias("strict"), F.sum(F.when(F.col("relaxed"), weight).otherwise(0.0)).alias("loose")
    )
    all_met = F.col("found") == F.col("strict")
    return scored.select("query_id", key, F.when(all_met, 0).otherwise(1).alias("tier"), F.when(all_met, F.col("score")).otherwise(F.col("loose")).alias("score"))


def _doubtful(keys: DataFrame) -> DataFrame:
    """The keys that are null or occur more than once."""
    key = keys.columns[0]
    return keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).select(F.col(key).alias("__key"))


def full_text(records: DataFrame, queries: DataFrame, limit: int, key: str = "doc_id", text: str = "content", allowed: DataFrame | None = None) -> DataFrame:
    """query_id, key, tier, score, rank: BM25 over distinct terms; records with all terms (tier 0) come before those with any meaningful one.

    queries: query_id, text, any number of them. Statistics are those of the whole index; the texts are cut into terms once. allowed: the keys that
    a filter admits, applied before the ranks and so before any limit. Blocks of queries meet blocks of the index, and only the best
    ``limit`` of a task are shuffled, never the pairs of a query and a record. Keys and queries that aren't unique go through a join.
    """
    kind = records.schema[key].dataType.simpleString()
    index = cut(_index(records, key, text))
    total = index.select(F.explode("lengths").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean"))
    df = index.select(F.inline(F.arrays_zip(F.col("vocabulary").alias("term"), F.col("counts").alias("df")))).groupBy("term").agg(F.sum("df").alias("df"))
    wanted = query_terms(queries).join(df, "term").crossJoin(F.broadcast(total))  # one row of totals
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    asked = wanted.select("query_id", "term", "strict", "relaxed", idf.alias("idf"), "mean")
    if allowed is not None:
        records = records.join(allowed.select(key).distinct(), key, "left_semi")
    parts = []
    odd_queries = cut(_doubtful(queries.select("query_id")))
    if not odd_queries.isEmpty():
        odd = F.col("query_id").eqNullSafe(F.col("__key"))
        parts.append(_joined(records, asked.join(odd_queries, odd, "left_semi"), key, text))
        asked, queries = asked.join(odd_queries, odd, "left_anti"), queries.join(odd_queries, odd, "left_anti")
    odd_keys = cut(_doubtful(index.select(F.explode("keys").alias(key))))
    if not odd_keys.isEmpty():
        odd = F.col(key).eqNullSafe(F.col("__key"))
        parts.append(_joined(records.join(odd_keys, odd, "left_semi"), asked, key, text))
        records = records.join(odd_keys, odd, "left_anti")
    if allowed is not None or not odd_keys.isEmpty():
        index = cut(_index(records, key, text))
    tiered = reduce(DataFrame.unionByName, parts, _in_blocks(index, asked, limit, key, kind, max(1, -(-queries.count() // QUERY_BLOCK))))
    order = Window.partitionBy("query_id").orderBy("tier", F.round("score", 9).desc(), key)
    return tiered.filter("tier = 0 OR score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _blocks(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """ids, matrix (unit vectors of float64, row after row), dim: the vectors of df in blocks of at most ``size``; those of another length than the first of a block get one of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            x = np.concatenate(rows)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=["ids", "matrix", "dim"])

        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            items = batch.column(0).to_numpy()
            for dim in np.unique(sizes):
                if dim == 0:
                    continue
                rows = np.flatnonzero(sizes == dim)
                ids, parts = held.setdefault(int(dim), ([], []))
                ids.append(items[rows])
                parts.append(flat[at[rows][:, None] + np.arange(dim)].astype(np.float64))
                if sum(map(len, ids)) >= size:
                    yield emit(int(dim))
        for dim in list(held):
            yield emit(dim)

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).na.drop().mapInArrow(run, "ids array<long>, matrix binary, dim int")


def nearest(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank: exact cosine neighbours of every query among all vectors of its length.

    queries: (query_id, vector), any number. Both sides are packed into blocks on the executors; each block of queries meets each block of
    vectors in one matrix product that keeps the best ``limit``, so nothing passes the driver and only those are shuffled. Vectors without length score 0.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select(key), key, "left_semi")
    q = _blocks(queries, queries.columns[0], queries.columns[1], QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), "dim")
    v = _blocks(vectors, key, vector, VECTOR_BLOCK).select("ids", "matrix", F.col("dim").alias("v_dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_matrix, ids, matrix, dim in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_matrix", "ids", "matrix", "dim")), strict=True):
                names = np.array(ids)
                score = np.frombuffer(q_matrix).reshape(-1, dim) @ np.frombuffer(matrix).reshape(-1, dim).T
                keep = np.lexsort((np.broadcast_to(names, score.shape), -np.round(score, 12)), axis=1)[:, :limit]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(q_ids), keep.shape[1])), pa.array(names[keep].ravel()), pa.array(np.take_along_axis(score, keep, 1).ravel())], names=["query_id", "item", "score"])

    pairs = v.crossJoin(q).filter("dim = v_dim").select("q_ids", "q_matrix", "ids", "matrix", "dim")  # blocks of the stated queries against blocks of all vectors
    found = pairs.mapInArrow(run, "query_id long, item long, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumnRenamed("item", key)


def best_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_id, score, place, tokens: the matched chunks of each record, best first (ties by chunk)."""
    full = hits.select("query_id", "chunk_id", "score").join(chunks.select("chunk_id", "doc_id", F.col("token_estimate").alias("tokens")), "chunk_id")
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return full.select("query_id", "doc_id", "chunk_id", "score", F.row_number().over(order).alias("place"), "tokens")


def fuse(text: DataFrame, vector: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over both lists, ties by key; raw scores and ranks stay."""
    a = text.select("query_id", key, F.col("rank").alias("text_rank"), F.col("score").alias("text_score"))
    b = vector.select("query_id", key, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    both = a.join(b, ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("text_rank") + part("vector_rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def explain(matched: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, doc_id, record_score, best_chunk, best_score, boost: how the score of each matched record comes about."""
    best = matched.filter("place = 1").select("query_id", "doc_id", F.col("chunk_id").alias("best_chunk"), F.col("score").alias("best_score"))
    boost = F.when(F.col("kind").isin(*BOOSTED), BOOST).otherwise(0.0)
    return best.join(records.select("doc_id", "kind"), "doc_id").select("query_id", "doc_id", (F.col("best_score") + boost).alias("record_score"), "best_chunk", "best_score", boost.alias("boost"))


def _budget(max_tokens: int) -> Column:
    """The chunks kept of the ordered records: a record comes in while the budget isn't used up, its first chunk always, others until one doesn't fit."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<doc_id:bigint,place:int,score:double,chunk_id:string,tokens:bigint>>").alias("kept"))

    def record(acc: Column, r: Column) -> Column:
        start = F.struct(acc["used"].alias("used"), F.lit(True).alias("open"), F.array().cast("array<struct<chunk_id:string,tokens:bigint>>").alias("own"))

        def chunk(a: Column, c: Column) -> Column:
            fits = a["open"] & ((F.size(a["own"]) == 0) | (a["used"] + c["tokens"] <= max_tokens))
            taken = F.concat(a["own"], F.array(F.struct(c["chunk_id"].alias("chunk_id"), c["tokens"].alias("tokens"))))
            return F.struct((a["used"] + F.when(fits, c["tokens"]).otherwise(0)).alias("used"), fits.alias("open"), F.when(fits, taken).otherwise(a["own"]).alias("own"))

        done = F.aggregate(r["chunks"], start, chunk)
        rows = F.transform(done["own"], lambda c: F.struct(r["doc_id"].alias("doc_id"), r["place"].alias("place"), r["score"].alias("score"), c["chunk_id"].alias("chunk_id"), c["tokens"].alias("tokens")))
        return F.when(acc["used"] >= max_tokens, acc).otherwise(F.struct(done["used"].alias("used"), F.concat(acc["kept"], rows).alias("kept")))

    return F.aggregate("records", zero, record, lambda acc: acc["kept"])


def pack(matched: DataFrame, records: DataFrame, max_records: int = 20, max_tokens: int = 4000, per_source: int = 5, per_project: int = 3) -> DataFrame:
    """query_id, place, doc_id, score, chunk_id, tokens: matched chunks (as of best_chunks) as context.

    A record scores as its best chunk; kinds that agents care for are boosted, scores compared in bands of 0.01 with the newest first
    inside a band, then at most ``per_source`` of a source, ``per_project`` of a project among the survivors, ``max_records`` in all, and chunks
    within the token budget. What is folded in one value is at most ``max_records`` records of a query.
    """
    best = matched.filter("place = 1").select("query_id", "doc_id", "score")
    full = best.join(records.select("doc_id", "id", "adapter", "instance", "kind", "created_at", "updated_at", "native_path"), "doc_id")
    boosted = full.select(
        "query_id", "doc_id", "id", "adapter", "instance",
        project_root(F.col("native_path")).alias("project"),
        (F.col("score") + F.when(F.col("kind").isin(*BOOSTED), BOOST).otherwise(0.0)).alias("score"),
        F.greatest(F.coalesce("updated_at", "created_at"), "created_at").alias("newest"),
    )
    order = [F.round(F.col("score") * 100).desc(), F.col("newest").desc(), F.col("id")]
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(*order))
    capped = boosted.withColumn("of_source", place("adapter", "instance")).filter(F.col("of_source") <= per_source)
    capped = capped.withColumn("of_project", place("adapter", "instance", "project")).filter(F.col("of_project") <= per_project)
    first = capped.withColumn("place", place()).filter(F.col("place") <= max_records).select("query_id", "doc_id", "score", "place")
    chunks = matched.select("query_id", "doc_id", F.col("place").alias("at"), "chunk_id", F.col("tokens").cast("long").alias("tokens")).join(first, ["query_id", "doc_id"])
    by_record = chunks.groupBy("query_id", "doc_id", "place", "score").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "tokens"))).alias("chunks"))
    by_query = by_record.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("doc_id").cast("long").alias("doc_id"), "score", "chunks"))).alias("records"))
    return by_query.select("query_id", F.inline(_budget(max_tokens))).select("query_id", "place", "doc_id", "score", "chunk_id", "tokens")


def trace(**stages: DataFrame) -> DataFrame:
    """stage, rows: how many rows each stage of a search holds; no text of a user is in it."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, df in stages.items()))


def evaluate(ranked: DataFrame, judged: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """query_id, reciprocal_rank, ndcg, relevant_in_topk, judged_relevant of every judged query (judged: query_id, key, grade)."""
    good = judged.filter("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1.0
    hits = ranked.filter(F.col("rank") <= k).join(good, ["query_id", key])
    got = hits.groupBy("query_id").agg(F.max(1.0 / F.col("rank")).alias("reciprocal_rank"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count(F.lit(1)).alias("relevant_in_topk"))
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), key)
    placed = good.withColumn("at", F.row_number().over(best))
    ideal = placed.groupBy("query_id").agg(F.sum(F.when(F.col("at") <= k, gain / F.log2(F.col("at") + 1.0))).alias("idcg"), F.count(F.lit(1)).alias("judged_relevant"))
    every = judged.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.select(
        "query_id", zero("reciprocal_rank").cast("double").alias("reciprocal_rank"), F.when(zero("idcg") > 0, zero("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        zero("relevant_in_topk").cast("long").alias("relevant_in_topk"), zero("judged_relevant").cast("long").alias("judged_relevant"),
    )


def quality(evaluated: DataFrame) -> DataFrame:
    """Mean reciprocal rank over all queries, nDCG over those with a judged record."""
    return evaluated.agg(F.count(F.lit(1)).alias("queries"), F.avg("reciprocal_rank").alias("mrr"), F.coalesce(F.avg(F.when(F.col("judged_relevant") > 0, F.col("ndcg"))), F.lit(0.0)).alias("ndcg"))
