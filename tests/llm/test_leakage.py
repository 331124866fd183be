import random

from recollate.llm.leakage import WORD, Automaton, cleaned, leaks, without_spans


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_automaton_against_grams():
    rng = random.Random(6)
    for n in (2, 3, 5):
        for _ in range(40):
            items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(4)]
            doc = " ".join(rng.choice("abcde") for _ in range(40))
            got = {(0, i) for i in Automaton(items, n).matches(doc.split())}
            assert got == brute([(0, doc)], items, n), (n, items, doc)


def test_operator_in_blocks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, item), (2, "start " + item.upper().replace(" ", ", ")), (3, "short text"), (4, None), (5, "")]
    docs = [(10, "intro. " + item.replace(" ", "\n* ") + " outro"), (11, " ".join(item.split()[:11])), (12, None), (13, ""), (14, " ".join(item.split()[1:]) * 1), (10, "intro. " + item.replace(" ", "\n* ") + " outro")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20, 10_000):
        found = leaks(d, "doc_id", "text", i, "item_id", "text", block_words=block)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute(docs, items, 12) == {(10, 1), (10, 2), (14, 1), (14, 2)}
        assert max(r["longest"] for r in found.collect()) == 13
    clean = [(r["doc_id"], r["text"], r["spans"], r["words"]) for r in cleaned(d, "doc_id", "text", i, "item_id", "text", block_words=20).collect()]
    assert sorted(clean, key=str) == sorted([(10, "intro.  outro", 1, 13), (11, docs[1][1], 0, 0), (12, None, 0, 0), (13, "", 0, 0), (14, "", 1, 12), (10, "intro.  outro", 1, 13)], key=str)
    assert leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_spans_within_the_limits_stay():
    item = " ".join(f"w{i}" for i in range(40))
    automata = [Automaton([(1, item)])]
    doc = " ".join(f"x{i}" for i in range(100)) + ". " + " ".join(item.split()[:20]) + "! " + " ".join(f"y{i}" for i in range(100))
    assert without_spans(doc, automata, 25, 0.3) == (doc, 0, 0)
    short, spans, words = without_spans(doc, automata, 19, 0.3)
    assert (spans, words) == (1, 20) and short == " ".join(f"x{i}" for i in range(100)) + ". ! " + " ".join(f"y{i}" for i in range(100))
    assert without_spans(doc, automata, 25, 0.05)[1:] == (1, 20)
    # letters that grow when lowered keep their places
    odd = "İİ " + item + " İ end"
    assert without_spans(odd, automata, 25, 0.3) == ("İİ  İ end", 1, 40)
