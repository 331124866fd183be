import random
from collections import Counter

from recollate.llm.packing import CARRY, WINDOW, Stock, _assign, _dominated, bin_completion, check, encoder, fill_containers, lower_bound, pack


def least_containers(sizes, capacity):
    """By trying every place of every item."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_least_number_against_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        capacity = rng.choice([20, 50, 100, 1000])
        sizes = [rng.randint(max(1, rng.choice([1, capacity // 5])), rng.choice([capacity, capacity // 2, capacity // 3])) for _ in range(rng.randint(0, 12))]
        got, proved = bin_completion(dict(Counter(sizes)), capacity)
        assert sorted(x for c in got for x in c) == sorted(sizes) and all(sum(c) <= capacity for c in got)
        assert proved and len(got) == least_containers(sizes, capacity) >= lower_bound(dict(Counter(sizes)), capacity), (capacity, sizes)


def test_fillings_are_those_that_nothing_dominates():
    stock = Stock({990: 1, 100: 12}, 1000)
    assert stock.best(1000) == [100] * 10
    assert list(stock.fillings(1000, 20)) == [[100] * 10, [990]]
    assert _dominated([30, 20], {30: 1, 20: 1, 50: 1}, [20, 30, 50], 0)  # 50 alone leaves 30 and 20 for later
    assert _dominated([40], {40: 1, 45: 1}, [40, 45], 7) and not _dominated([40], {40: 1, 48: 1}, [40, 48], 7)
    assert _dominated([40], {40: 1, 5: 1}, [5, 40], 7)  # something still fits


def test_containers_are_full_and_whole():
    rng = random.Random(2)
    for _ in range(20):
        items = [(min(100, max(1, int(rng.expovariate(1 / 25)))), i) for i in range(rng.randint(0, 400))]
        got, _ = pack(items, 100)
        assert sorted(x for c in got for x in c) == sorted(items)
        assert all(sum(s for s, _ in c) <= 100 for c in got)
        bound = -(-sum(s for s, _ in items) // 100)
        assert len(got) <= max(bound + 1, sum(1 for s, _ in items if s > 50))
    assert len(pack([(60, 1), (40, 2), (50, 3), (50, 4)], 100)[0]) == 2
    # first fit decreasing needs four here, three do
    assert len(pack([(s, i) for i, s in enumerate((44, 44, 28, 28, 28, 28, 42, 30, 28))], 100)[0]) == 3


def test_operator(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["alpha", "bet,", "x9", "漢字"]) for _ in range(rng.randint(1, 400)))) for i in range(300)]
    texts += [(900, "word " * 9000), (901, None), (902, ""), (903, texts[0][1]), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    placed = fill_containers(docs, "doc_id", "text")
    rows = placed.collect()
    count = lambda t: len(encoder().encode_ordinary(t or ""))
    total, filled = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
        filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
    assert total == {k: count(t) for k, t in texts if k is not None}
    assert all(r["filled"] == filled[r["container"]] <= 2048 for r in rows)
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r["part_no"])
    assert all(len(p) == 1 or total[k] > 2048 for k, p in parts.items())
    assert len(filled) == -(-sum(filled.values()) // 2048)
    assert check(placed, docs).first().asDict() == {"documents": 304, "placed": 304, "cut_without_need": 0, "placed_twice": 0, "wrong_containers": 0}
    assert fill_containers(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_documents_without_partners():
    # 200,000 documents of 1,100 tokens: no two share a container, so all that isn't closed early is carried
    carry, rows, number = [], [], 200_000
    for i in range(0, number, WINDOW):
        keys = list(range(i, min(i + WINDOW, number)))
        got, carry = _assign(keys, [1100] * len(keys), carry, 2048, final=keys[-1] == number - 1)
        assert len(carry) <= CARRY
        rows += got
    assert sorted(r[1] for r in rows) == list(range(number)) and not carry
    assert len({r[0] for r in rows}) == number and all(r[3] == r[4] == 1100 for r in rows)
    # past the bound the fullest are closed, the emptiest wait for partners
    got, carry = _assign(list(range(6)), [1100, 1300, 1200, 1500, 1400, 1600], [], 2048, final=False, most=2)
    assert sorted(s for s, _ in carry) == [1100, 1200] and sorted(r[4] for r in got) == [1300, 1400, 1500, 1600]


def test_every_window_is_searched():
    """What a window before the last closes as full can cost a container if it was packed without a search."""
    cases = {(44, 24, 30, 53, 60, 22, 18, 54, 41, 44, 22, 28, 18, 37): 5, (41, 38, 48, 23, 33, 23, 30, 45, 22, 47, 34, 47, 54): 5, (38, 24, 47, 40, 21, 20, 15, 25, 56, 59, 54): 4}
    for sizes, least in cases.items():
        closed, carry = _assign(list(range(len(sizes))), sizes, [], 100, final=False)
        rest, _ = _assign([], [], carry, 100, final=True)
        assert sorted(r[3] for r in closed + rest) == sorted(sizes)
        assert len({r[0] for r in closed + rest}) == least
