import random

from recollate.llm.splitting import LIMIT, OVERLAP, piece_bounds, split_long


def check(text, limit=LIMIT, overlap=OVERLAP):
    bounds = piece_bounds(text, limit, overlap)
    if not text:
        assert bounds == []
        return bounds
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in bounds)
    assert all(bounds[i + 1][0] == bounds[i][1] - overlap for i in range(len(bounds) - 1))
    least = 1 if len(text) <= limit else -(-(len(text) - overlap) // (limit - overlap))
    assert least <= len(bounds) <= least + 1
    return bounds


def test_limits_hold_for_any_text():
    rng = random.Random(4)
    for size in (0, 1, 1999, 2000, 2001, 3800, 3801, 20_000, 300_000):
        check("x" * size)
        check("".join(rng.choice("ab .\n#") for _ in range(size)))
        check("漢" * size)
    for _ in range(200):
        limit = rng.randint(2, 60)
        check("".join(rng.choice("ab. \n") for _ in range(rng.randint(0, 400))), limit, rng.randint(0, limit - 1))


def test_strongest_boundary_wins():
    text = "word " * 190 + "end. " + "Next " * 20 + "\n\n" + "more " * 12 + "\n# Head\n" + "tail " * 180
    a, b = check(text, 1200, 100)[0]
    assert text[b:].startswith("# Head")
    text = "One sentence here. " * 150
    assert all(text[b - 2 : b] == ". " for _, b in check(text)[:-1])


def test_operator(spark):
    texts = [("a", "y" * 2000), ("b", "y" * 2001), ("c", None), ("d", ""), ("e", "z z " * 1000), ("e", "z z " * 1000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "k string, t string, piece_no int")
    rows = split_long(df, ["k"], "t").collect()
    assert {r["k"] for r in rows} == {"b", "e"} and len([r for r in rows if r["k"] == "e"]) == 2 * 3
    assert all(r["piece"] == dict(texts)[r["k"]][r["start_pos"] : r["end_pos"]] for r in rows)
    assert split_long(df.limit(0), ["k"], "t").count() == 0
