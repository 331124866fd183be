import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollate.functions import seconds, text
from recollate.operators import chunking, duplicates, extraction, graph, retrieval, selection, similar, state


def test_components_on_a_path_and_a_clique(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    clique = list(combinations(["q1", "q2", "q3"], 2))
    got = dict(graph.components(spark.createDataFrame([*path, *clique, ("q1", "q2")], "a string, b string")).collect())
    assert {got[x] for x, _ in path} == {"p000"} and {got[x] for x, _ in clique} == {"q1"}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_lineage_marks_missing_parents_and_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 99), (6, 5), (7, 8), (8, 7)], "doc_id long, derived_from long")
    got = {r["key"]: (r["root"], r["depth"], r["broken"], r["cycle"]) for r in graph.ancestors(df).collect()}
    assert got[3] == (1, 2, False, False) and got[6] == (5, 1, True, False)
    assert got[7][3] and got[8][3]
    assert {(r["key"], r["depth"]) for r in graph.descendants(df, 1).collect()} == {(2, 1), (3, 2)}
    assert {r["key"] for r in graph.descendants(df, 7).collect()} == {8}


def test_deep_walks_keep_their_plans_small(spark):
    """The parent is computed from the key, as in the record store; levels must not nest that expression."""
    df = spark.range(512).selectExpr("id AS doc_id", "CASE WHEN id > 0 THEN CAST(floor(id / 2) AS BIGINT) END AS derived_from")
    down = graph.descendants(df, 1)
    assert {(r["key"], r["depth"]) for r in down.collect()} == {(n, n.bit_length() - 1) for n in range(2, 512)}
    every = state.with_descendants(df.filter("doc_id = 1"), df)
    assert {r[0] for r in every.collect()} == set(range(1, 512))
    for walk in (down, every):
        assert len(walk._jdf.queryExecution().analyzed().constraints().toString()) < 1000


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, 24) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(3):
            t = b[:]
            t[rng.randrange(24)] = rng.choice(words)
            texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t), f"a{i % 2}") for i, t in enumerate(texts)] + [(900, None, "a0"), (901, "", "a1")], "doc_id long, content string, adapter string")
    sims = {r["class"]: (r["sim"], set(r["terms"])) for r in similar.signatures(df).collect()}
    want = set()
    for a, b in combinations(sorted(sims), 2):
        (s, x), (t, y) = sims[a], sims[b]
        if bin((s ^ t) & (2**64 - 1)).count("1") <= 8 and len(x & y) / len(x | y) >= 0.6:
            want.add((a, b))
    assert want and {(r[0], r[1]) for r in similar.near_pairs(df).collect()} == want


def test_near_candidates_are_numbers(spark):
    """What the bands multiply is two numbers a row; sets of one hash are pairs as well."""
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(0, text, "a"), (1, f"{text} x1", "b"), (2, f"{text} x2", "b")] + [(10 + i, f"{text} y{i}", "a") for i in range(60)], "doc_id long, content string, adapter string")
    sims = {r["class"]: (r["sim"], set(r["terms"])) for r in similar.signatures(df).collect()}
    want = {(a, b, bin((sims[a][0] ^ sims[b][0]) & (2**64 - 1)).count("1")) for a, b in combinations(sorted(sims), 2) if len(sims[a][1] & sims[b][1]) / len(sims[a][1] | sims[b][1]) >= 0.6}
    want = {x for x in want if x[2] <= 8}
    assert any(d == 0 for *_, d in want) and {tuple(r)[:3] for r in similar.near_pairs(df).collect()} == want
    assert set(similar.signatures(df).columns) == {"class", "terms", "size", "sim"}
    assert similar.bands(similar.signatures(df).select("sim")).dtypes == [("sim", "bigint"), ("band", "bigint")]


def test_near_hashes_against_brute_force(spark):
    """Hashes far apart, crowds that share blocks, equal ones: every pair once."""
    rng = np.random.default_rng(2)
    crowd = np.uint64(0x9234_0000_0000_0000) | (rng.integers(0, 2**63, 600, dtype=np.uint64) & np.uint64(0xFFFF_00FF))
    sims = np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2), crowd])
    for _ in range(8):
        sims = np.append(sims, sims[-300:] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    sims = np.unique(sims)
    want = {tuple(sorted((int(a), int(b)))) for n, a in enumerate(sims.view(np.int64)) for b in sims.view(np.int64)[n + 1 :][np.bitwise_count(sims[n] ^ sims[n + 1 :]) <= 8]}
    df = spark.createDataFrame([(int(x),) for x in np.append(sims, sims[:5]).view(np.int64)], "sim long")
    got = [tuple(sorted(r)) for r in similar.near_hashes(df).collect()]
    assert len(want) > 10_000 and len(got) == len(set(got)) and set(got) == want | {(int(x), int(x)) for x in sims[:5].view(np.int64)}
    assert similar.near_hashes(df.limit(0)).count() == 0


def test_near_pairs_broadcast_no_sets(spark):
    """Spark's guess of the size of texts is far too low, so no join may depend on it: the driver would gather the whole table."""
    text = " ".join(f"w{i}" for i in range(40))
    pairs = similar.near_pairs(spark.createDataFrame([(0, text, "a"), (1, f"{text} x1", "b")], "doc_id long, content string, adapter string"))
    assert pairs.count() == 1 and pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(90, None), (91, [0.0] * 8), (92, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.filter("vec_id IN (0, 50)").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    got = [(r["query_id"], r["vec_id"]) for r in retrieval.nearest(df, queries, 5).orderBy("query_id", "rank").collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == [(q, int(i)) for q in (0, 50) for i in np.argsort(-(unit @ unit[q]))[:5]]
    assert retrieval.nearest(df, queries.limit(0), 5).count() == 0


def test_full_text_tiers(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "red car"), (3, None), (4, "blue sky"), (5, "")], "doc_id long, content string")
    queries = spark.createDataFrame([(0, "the red apple"), (1, "zzz"), (2, ""), (3, None)], "query_id long, text string")
    got = [(r["doc_id"], r["tier"]) for r in retrieval.full_text(df, queries, 5).orderBy("rank").collect()]
    assert got[0] == (1, 1) and {d for d, _ in got} == {1, 2}
    # a filter holds before the limit: the admitted record comes out although another one scores higher
    admitted = df.filter("doc_id = 2")
    assert [r["doc_id"] for r in retrieval.full_text(df, queries, 1, allowed=admitted).collect()] == [2]
    assert retrieval.full_text(df.limit(0), queries, 5).count() == 0
    terms = {(r["query_id"], r["term"]): r["relaxed"] for r in retrieval.query_terms(spark.createDataFrame([(0, "the red"), (1, "the of")], "query_id long, text string")).collect()}
    assert terms == {(0, "the"): False, (0, "red"): True, (1, "the"): True, (1, "of"): True}
    assert retrieval.pool_size(0) == 0 and retrieval.pool_size(5) == 64 and retrieval.pool_size(1000) == 1000


def test_chunks_cover_the_boundaries(spark):
    assert chunking.chunk_text("") == [""]
    parts = ["word " * 300, "next " * 300, "x" * 100]
    text_ = "\n\n".join(p.strip() for p in parts)
    got = chunking.chunk_text(text_)
    assert len(got) > 1 and all(chunking.tokens_of(c) <= 512 for c in got) and "\n\n".join(got) == text_
    assert [len(c) for c in chunking.chunk_text("y" * 5000)] == [512] * 9 + [392]
    df = spark.createDataFrame([(1, text_), (2, None), (3, "漢" * 600)], "doc_id long, content string")
    rows = chunking.chunks(df).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3} and [r["seq"] for r in rows if r["doc_id"] == 3] == [0, 1]
    est = spark.createDataFrame([(t,) for t in (text_, "漢字ab", "")], "t string").select(text.estimate_tokens(F.col("t"))).collect()
    assert [r[0] for r in est] == [chunking.tokens_of(t) for t in (text_, "漢字ab", "")]


def naive_chunks(text, most, least):
    """Piece by piece, as the rule says."""
    if chunking.tokens_of(text) <= most:
        return [text]
    for separator, glue in chunking.BOUNDARIES:
        pieces = chunking._pieces(text, separator)
        if all(chunking.tokens_of(p) <= most for p in pieces):
            out, run = [], []
            need = lambda r: sum(map(chunking.tokens_of, r)) + (len(r) - 1) * chunking.tokens_of(glue)
            for p in pieces:
                if run and need([*run, p]) > most:
                    if need(run) < least:
                        out.append(glue.join([*run, p]))
                        run = []
                        continue
                    out.append(glue.join(run))
                    run = []
                run.append(p)
            return out + ([glue.join(run)] if run else []) or [""]
    return [text[i : i + most] for i in range(0, len(text), most)]


def test_chunks_against_the_rule():
    rng = random.Random(5)
    for _ in range(400):
        text_ = "".join(rng.choice(["word", "a", "漢", "\n\n", "\n", ". ", " ", " ", "longerword"]) for _ in range(rng.randint(0, 120)))
        most = rng.randint(4, 30)
        assert chunking.chunk_text(text_, most, most // 3) == naive_chunks(text_, most, most // 3)


def test_packing_keeps_the_budget(spark):
    rng = random.Random(9)
    records = spark.createDataFrame([(i, f"id{i}", f"a{i % 9}", "x", "fact", i, None, None) for i in range(12)], "doc_id long, id string, adapter string, instance string, kind string, created_at long, updated_at long, native_path string")
    hits = [(0, i, f"{i}:{j}", 1.0 - i / 50 - j / 1000, j + 1, rng.randint(1, 60)) for i in range(12) for j in range(rng.randint(1, 4))]
    matched = spark.createDataFrame(hits, "query_id long, doc_id long, chunk_id string, score double, place int, tokens int")
    got = [(r["doc_id"], r["chunk_id"]) for r in retrieval.pack(matched, records, 10, 150, 5, 3).orderBy("place", "chunk_id").collect()]
    used, want = 0, []
    for i in range(10):
        if used >= 150:
            break
        for n, h in enumerate(h for h in hits if h[1] == i):
            if n and used + h[5] > 150:
                break
            used += h[5]
            want.append((i, h[2]))
    assert got == want
    assert {r["boost"] for r in retrieval.explain(matched, records).collect()} == {0.05}
    assert {r["stage"]: r["rows"] for r in retrieval.trace(a=matched, b=records.limit(0)).collect()} == {"a": len(hits), "b": 0}


def test_modes():
    assert [retrieval.resolve_mode(m, True) for m in (None, "keyword", "vector")] == ["hybrid", "fulltext", "vector"] and retrieval.resolve_mode("vector", False) == "fulltext"
    with pytest.raises(ValueError):
        retrieval.resolve_mode("nope", True)


def test_outcome_and_snapshot_agree(spark):
    cols = "id string, content string, raw_hash string, created_at long, updated_at long"
    cur = spark.createDataFrame([("a", "1", "h1", 1, None)], cols)
    inc = spark.createDataFrame([("a", "2", "zz", 3, None), ("a", "1", "h1", 9, None)], cols)  # the later version is the known one
    none = spark.createDataFrame([], "id string")
    assert [r["outcome"] for r in state.upsert_outcome(cur, inc, none).collect()] == ["unchanged"] and state.upsert(cur, inc, none).first()["content"] == "1"


def test_drain_and_repair(spark):
    queue = spark.createDataFrame([("1:0", "h", "x"), ("2:0", "g", None)], "chunk_id string, content_hash string, content string")
    done, failed = state.drain(queue, "m", lambda c: F.when(c.isNotNull(), state.hashed_vector(c)))
    assert [r["chunk_id"] for r in done.collect()] == ["1:0"] and [(r["chunk_id"], r["error"]) for r in failed.collect()] == [("2:0", "length 0")]
    chunks = spark.createDataFrame([(1, "1:0", "h"), (2, "2:0", "g")], "doc_id long, chunk_id string, content_hash string")
    kept, vectors = state.repair(chunks, spark.createDataFrame([("1:0", "h"), ("2:0", "g"), ("1:0", "old")], "chunk_id string, content_hash string"), spark.createDataFrame([(1,)], "doc_id long"))
    assert [r["chunk_id"] for r in kept.collect()] == ["1:0"] and [tuple(r) for r in vectors.collect()] == [("1:0", "h")]
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, None)], "doc_id long, derived_from long")
    assert {r[0] for r in state.with_descendants(loop.filter("doc_id = 1"), loop).collect()} == {1, 2, 3}


def test_reconcile_by_content_where_there_is_no_native_id(spark):
    rows = [("1", "a", "i", None, "h"), ("2", "b", "i", "", "h"), ("3", "b", "j", "n", "k"), ("4", "a", "i", "n", "z")]
    df = spark.createDataFrame(rows, "id string, adapter string, instance string, native_id string, raw_hash string")
    assert sorted((r["bucket"], r["left_id"], r["right_id"]) for r in duplicates.reconcile(df, ("a", None), ("b", None)).collect()) == [("conflict", "4", "3"), ("same", "1", "2")]
    assert sorted(r["bucket"] for r in duplicates.reconcile(df, ("a", None), ("b", "i")).collect()) == ["only_left", "same"]


def test_state_changes(spark):
    cols = "id string, content string, raw_hash string, created_at long, updated_at long"
    cur = spark.createDataFrame([("a", "1", "h1", 1, None), ("b", "2", "h2", 2, None)], cols)
    inc = spark.createDataFrame([("a", "1x", "h1x", 9, None), ("a", "old", "h0", 8, None), ("b", "2", "h2", 9, 9), ("c", "3", "h3", 3, None), ("d", "4", "h4", 4, None)], cols)
    dead = spark.createDataFrame([("d",), ("d",)], "id string")
    got = {r["id"]: (r["content"], r["created_at"], r["updated_at"]) for r in state.upsert(cur, inc, dead).collect()}
    assert got == {"a": ("1x", 1, None), "b": ("2", 2, None), "c": ("3", 3, None)}
    records, stones = state.forget(cur, spark.createDataFrame([], "id string, reason string, forgotten_at long"), spark.createDataFrame([("a",), ("zz",)], "id string"), 7, "why")
    assert [r["id"] for r in records.collect()] == ["b"] and [(r["id"], r["reason"], r["forgotten_at"]) for r in stones.collect()] == [("a", "why", 7)]
    assert state.unforget(stones, spark.createDataFrame([("a",)], "id string")).count() == 0
    with pytest.raises(ValueError):
        state.tag(spark.createDataFrame([], "doc_id long, tag string"), cur.select(F.lit(1).alias("doc_id")), ["x"] * 33, "add")


def test_conflict_plan(spark):
    df = spark.createDataFrame([("n", "1", "a", "i", "x", "hx"), ("n", "2", "b", "i", "y", "hy"), ("n", "3", "c", "i", "x", "hx"), ("m", "4", "a", "i", "z", "hz")], "native_id string, id string, adapter string, instance string, content string, raw_hash string")
    plan = {r["id"]: (r["variant"], r["decision"]) for r in duplicates.accept_variant(df, "n", 1).collect()}
    assert plan == {"1": (1, "keep"), "2": (2, "forget"), "3": (1, "keep")}
    assert {r["id"]: r["decision"] for r in duplicates.accept_variant(df, "n", record_id="2").collect()} == {"1": "forget", "2": "keep", "3": "forget"}
    assert duplicates.accept_variant(df, "n", 9).count() == 0


def test_small_things(spark):
    assert selection.csv_values(" a, ,b ") == ["a", "b"] and selection.csv_values(None) == []
    assert seconds.parse_duration("2h") == 7200 and seconds.humanize(90000) == "1d ago" and seconds.backoff(10) == 30.0
    with pytest.raises(ValueError):
        seconds.parse_duration("-3d")
    assert text.plan_query("what is it") == (["what", "is", "it"], ["what", "is", "it"]) and text.plan_query("rust") == (["rust"], [])
    assert extraction.parse_items('["a", {"content": "b"}, 3]') == ["a", "b"] and extraction.parse_items("plain") == ["plain"] and extraction.parse_items('"x"') == ["x"]
    tags = spark.createDataFrame([(" A ",), ("",), (None,), ("ü" * 40,), ("a\x01b",)], "t string").select(text.normalize_tag(F.col("t"))).collect()
    assert [r[0] for r in tags] == ["a", None, None, None, None]


def test_derived_records_keep_failures(spark):
    def provider(t):
        if "bad" in t:
            raise RuntimeError("no")
        return '["one", "two"]'

    df = spark.createDataFrame([("r1", "good"), ("r2", "bad")], "id string, content string")
    rows = extraction.derive(df, provider).collect()
    assert sorted((r["derived_from"], r["content"], r["error"]) for r in rows if r["content"]) == [("r1", "one", None), ("r1", "two", None)]
    assert [r["error"] for r in rows if r["error"]] == ["no"]


def test_full_text_ranks_inside_blocks(spark, monkeypatch):
    """Ties, stop words, queries without a term of the index, keys and queries that occur twice or are null; and no pair of a query and a record is shuffled."""
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rng = random.Random(5)
    words = ["the", "and", *(f"w{i}" for i in range(40))]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(150)]
    docs += [(i + 1000, t) for i, t in docs[:40]] + [(5, "w1 w2 the"), (None, "w3 w4"), (2000, ""), (2001, None)]
    asked = [(i, docs[i * 3][1]) for i in range(20)] + [(50, "the and"), (51, "nowhere"), (52, "w1 nowhere"), (53, "w1 w2"), (53, "w2 w3"), (None, "w5 the"), (54, "")]
    table, queries = spark.createDataFrame(docs, "doc_id long, content string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")

    sets = [(k, set((t or "").split())) for k, t in docs]
    mean = sum(len(t) for _, t in sets) / sum(t is not None for _, t in docs)
    df = {w: sum(w in t for _, t in sets) for w in words}
    idf = {w: max(np.log((len(sets) - n + 0.5) / (n + 0.5)), 1e-6) for w, n in df.items()}

    def ranked(keys):
        pairs = {}
        for q, text in asked:
            terms = set(text.split())
            meant = terms - {"the", "and"}
            for k, own in sets:
                if keys is not None and k not in keys:
                    continue
                for w in terms & own:
                    x = idf[w] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(own) / mean))
                    all_, loose, found, strict = pairs.get((q, k), (0.0, 0.0, 0, 0))
                    pairs[q, k] = (all_ + x, loose + x * (not meant or w in meant), found + 1, max(strict, len(terms)))
        best = {}
        for (q, k), (all_, loose, found, strict) in pairs.items():
            if found == strict or loose > 0:
                best.setdefault(q, []).append((int(found != strict), -round(all_ if found == strict else loose, 9), -1 if k is None else k))
        return {(q, k, tier, rank) for q, rows in best.items() for rank, (tier, _, k) in enumerate(sorted(rows)[:7], 1)}

    def got(found):
        return {(r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["tier"], r["rank"]) for r in found.collect()}

    assert got(retrieval.full_text(table, queries, 7)) == ranked(None)
    some = set(range(0, 2000, 2))
    assert got(retrieval.full_text(table, queries, 7, allowed=spark.createDataFrame([(k,) for k in some], "doc_id long"))) == ranked(some)
    plain = retrieval.full_text(table.filter("doc_id <> 5"), queries.filter("query_id < 50"), 7)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#", plain._jdf.queryExecution().executedPlan().toString())
