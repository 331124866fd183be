import random
import re
from itertools import combinations

import numpy as np

from recollate.llm import neardup
from recollate.llm.neardup import groups, near_duplicates, odd_sketch

WORD = re.compile(r"[^\W_]+")
SCHEMA = "key string, text string"


def brute(rows, t=0.8):
    sets = {k: frozenset(WORD.findall(x.lower())) for k, x in rows if k is not None and x}
    sets = {k: s for k, s in sets.items() if s}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(rng, sizes, copies):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in sizes:
        base = rng.sample(words, n)
        rows.append((f"r{len(rows):04}", " ".join(base)))
        for _ in range(copies):
            t = base[:]
            for _ in range(rng.randint(0, max(1, n // 7))):
                t[rng.randrange(n)] = rng.choice(words)
            rng.shuffle(t)
            rows.append((f"r{len(rows):04}", " ".join(t)))
    return rows


def test_every_size_against_brute_force(spark):
    rng = random.Random(11)
    rows = corpus(rng, [*range(1, 70, 3), 38, 39, 40, 47, 48, 49, 50, 60, 61, 63, 64, 65, 79, 80, 81, 90, 128, 150, 159, 161, 200, 300], 4)
    rows += [("n", None), ("e", ""), ("p", "... !"), (None, "w1 w2"), rows[0], ("long", "long " * 50_000)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), "key", "text").collect()}
    assert got == brute(rows) and len(got) > 50


def test_crowded_phrases_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWDED", 2)
    rng = random.Random(12)
    phrase = "always the very same long phrase in each text of this kind"
    rows = [(k, f"{phrase} {t}") for k, t in corpus(rng, [6] * 25 + [9] * 25 + [40] * 10 + [70] * 10, 3)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), "key", "text").collect()}
    assert got == brute(rows)


def test_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 3)
    words = "a b c d e f g h i j"
    rows = [(f"c{i}", words) for i in range(6)] + [("x", words + " k"), ("y1", "q r s"), ("y2", "s r q")]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), "key", "text").collect()}
    assert got == {("c0", f"c{i}") for i in range(1, 6)} | {("c0", "x"), ("y1", "y2")}
    per = {r["rec"]: r["links"] for r in groups(spark.createDataFrame(rows, SCHEMA), "key", "text").collect()}
    assert per["c3"] == 1 and per["x"] == 1 and per["y1"] == 0
    assert near_duplicates(spark.createDataFrame([], SCHEMA), "key", "text").count() == 0


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(-(2**31), 2**31, rng.integers(1, 300)).astype(np.int32))
        b = np.unique(np.concatenate([a[: len(a) // 2 + 1], rng.integers(-(2**31), 2**31, 20).astype(np.int32)]))
        bits = lambda x: sum(bin(int(w) & (2**64 - 1)).count("1") for w in x)
        flat, starts = np.concatenate([a, b]), np.array([0, len(a)])
        s = odd_sketch(flat, starts)
        assert bits([w[0] ^ w[1] for w in s]) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_groups_share_a_band():
    """Any two sets at the threshold meet in a band of two words, whatever their sizes, and in one of three if all of two are crowded."""
    rng = random.Random(21)
    sizes = [39, 40, 44, 48, 49, 55, 63, 64, 66, 79, 80, 99, 127, 128, 160, 170, 255, 330]
    for n in sizes * 4:
        a = rng.sample(range(1, 10**9), n)
        b = a[:]
        for _ in range(int(n / 9)):  # an edit replaces a word: similarity (n - n/9)/(n + n/9) = 0.8
            b[rng.randrange(n)] = rng.randrange(1, 10**9)
        if rng.random() < 0.5:
            b = b[: int(len(a) * 0.9)]
        if len(set(a) & set(b)) < 0.8 * len(set(a) | set(b)):
            continue
        lists = [sorted(set(a)), sorted(set(b))]
        held = np.array([len(x) for x in lists])
        flat, at = np.concatenate(lists).astype(np.int64), np.array([0, held[0]])
        every = neardup.Crowd(8, [np.arange(256)])  # all of two words are crowded
        for crowd in (neardup.Crowd(8), every):
            rows, keys, groups = neardup.bands(held, flat, at, crowd, None)
            assert set(keys[(rows == 0) & (groups > 0)]) & set(keys[(rows == 1) & (groups > 0)]) or held.min() <= 38, (n, held)


def test_estimates():
    rng = np.random.default_rng(5)
    def count(x, y):
        x, y = (neardup.minhash_sample(v, np.array([len(v)]))[0] for v in (x, y))
        s = odd_sketch(np.concatenate([x, y]), np.array([0, len(x)]))
        return sum(bin((int(w[0]) ^ int(w[1])) & (2**64 - 1)).count("1") for w in s)
    low = 0.8 - neardup.SLACK
    most = neardup.BITS / 2 * (1 - np.exp(-2 / neardup.BITS * 2 * neardup.SAMPLE * (1 - low) / (1 + low)))
    for n in (300, 1000, 5000):
        for _ in range(40):
            base = rng.integers(-(2**31), 2**31, 2 * n).astype(np.int32)
            a = base[:n]
            alike = np.concatenate([a[n // 9 :], base[n : n + n // 9]])
            assert count(a, alike) <= most < count(a, base[n:])


def test_slots_grow_with_the_data():
    assert neardup.slots_for(0) == neardup.slots_for(1000) == 22 and neardup.slots_for(10**6) == 26 and neardup.slots_for(10**12) == 28
