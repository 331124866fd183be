import random

from recollate.llm.subjects import assign, fit, tokens, train

SUBJECTS = {"law": ["judge", "court", "appeal", "statute", "witness"], "sport": ["goal", "match", "coach", "league", "penalty"], "食": ["面粉", "烤箱", "酱油"]}
FILLER = "the old folder of {0} was moved by the planner again".split()


def sentence(rng, subject):
    if subject is None:
        return " ".join(FILLER).format(rng.choice("abcdef")) + "."
    if subject == "食":
        return "关于" + rng.choice(SUBJECTS[subject]) + "：" + rng.choice(SUBJECTS[subject]) + "记在本子。"
    a, b = rng.choice(SUBJECTS[subject]), rng.choice(SUBJECTS[subject])
    return f"the {a} meets every {b} again."


def document(rng):
    subjects = rng.sample(list(SUBJECTS), rng.choice([0, 1, 1, 2]))
    n = rng.randint(6, 14)
    parts = [sentence(rng, s) for s in subjects for _ in range(max(2, -(-n // 3)))]
    parts += [sentence(rng, None) for _ in range(n - len(parts))]
    stray = [s for s in SUBJECTS if s not in subjects]
    if stray and rng.random() < 0.4:
        parts.append(sentence(rng, rng.choice(stray)))
    rng.shuffle(parts)
    return "---\nname: goal\n---\n\n# Court\n" + rng.choice([" ", "\n\n"]).join(parts), set(subjects)


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    docs = [document(rng) for _ in range(700)]
    rows = [(i, t, rng.choice(["en", None]), "a:b", rng.choice(["note", None])) for i, (t, _) in enumerate(docs)]
    labels = [(i, s) for i, (_, own) in enumerate(docs[:400]) for s in (own or {"none"})]
    extra = [(9000, None, None, None, None), (9001, "", "en", "x", "note"), (None, "x", "en", "x", "note"), (9002, "judge " * 50_000, "en", "x", "note")]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, doc_kind string")
    names = spark.createDataFrame([(s, "") for s in SUBJECTS], "subject string, description string")
    chain = train(d, spark.createDataFrame(labels, "doc_id long, subject string"), names)
    got = {}
    for r in assign(d, chain).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    hit = sum(len(got.get(i, set()) & docs[i][1]) for i in range(400, 700))
    false = sum(len(got.get(i, set()) - docs[i][1]) for i in range(400, 700))
    miss = sum(len(docs[i][1] - got.get(i, set())) for i in range(400, 700))
    assert hit / (hit + false) > 0.95 and hit / (hit + miss) > 0.95, (hit, false, miss)
    assert 9000 not in got and 9001 not in got and None not in got
    assert assign(d.limit(0), chain).count() == 0


def test_terms():
    assert tokens("Go on. 关于星系 x") == ["go", "on", ".", "关于", "于星", "星系", "x"]
    assert tokens("---\na: b\n---\n# Head\n**user** — 1\n\nHi there") == ["\n", "\n", "\n", "\n", "\n", "\n", "hi", "there"] or "head" not in tokens("# Head\nHi")


def test_no_labels():
    chain = fit([("some text here", set(), None, None, None)], ["law"])
    assert chain.decode(["some text here", ""], [None] * 2, [None] * 2, [None] * 2) == [[], []]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text. more text.", "en", "a", "note")], "doc_id long, text string, lang string, source string, doc_kind string")
    labels, names = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law", "")], "subject string, description string")
    assert assign(d, train(d, labels, names)).count() == 0
    assert assign(d, train(d.limit(0), labels, names.limit(0))).count() == 0
