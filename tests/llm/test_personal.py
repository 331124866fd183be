import sys
from pathlib import Path

import pytest

from recollate.llm import personal
from recollate.llm.boosting import fit_trees

sys.path.insert(0, str(Path(__file__).parent))
import pii_cases  # noqa: E402


@pytest.fixture(scope="module")
def detector():
    return personal.train()


def test_held_out_accuracy(detector):
    """Mentions in wording that the training sample doesn't have."""
    texts, want = zip(*pii_cases.cases(), strict=True)
    got = [set() for _ in texts]
    for i, *span in detector.find(list(texts)):
        got[i].add(tuple(span))
    hit = sum(len(g & w) for g, w in zip(got, want, strict=True))
    assert sum(map(len, want)) >= 200
    assert hit / sum(map(len, want)) >= 0.9 and hit / sum(map(len, got)) >= 0.9, [(t, sorted(w - g), sorted(g - w)) for t, g, w in zip(texts, got, want, strict=True) if g != w]


CASES = [
    ("Contact Anna Delmont at anna.delmont+x@mail.example.org about it.", {("person_name", "Anna Delmont"), ("email", "anna.delmont+x@mail.example.org")}),
    ("send it to jo [at] mail [dot] example [dot] com pls", {("email", "jo [at] mail [dot] example [dot] com")}),
    ("Call +1 (529) 555-0191 and ask for Dr. Kelmont.", {("phone", "+1 (529) 555-0191"), ("person_name", "Kelmont")}),
    ("HR record for Kelmont, Jo, SSN 967-67-9410, Flat 3, 180 Juniper Ave., Karsholm.", {("person_name", "Kelmont, Jo"), ("id_number", "967-67-9410"), ("street_address", "Flat 3, 180 Juniper Ave., Karsholm")}),
    ("The form wants the NI number QQ 47 48 85 D, filed today.", {("id_number", "QQ 47 48 85 D")}),
    ("Ship the parcel to Lindenallee 19, 01695 Brackwell.", {("street_address", "Lindenallee 19, 01695 Brackwell")}),
    ("Order 544-67-38 holds 982 items for tahol. Version 3.36.9 runs on port 8077.", set()),
    ("Use name@host style for these remotes. Ticket 5822-888 mentions @vabao twice.", set()),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_known_forms(detector, text, want):
    assert {(k, text[a:b]) for _, k, a, b in detector.find([text])} == want


def test_operators(spark, detector):
    text = "ü😀 Contact Anna Delmont at a@b.example."
    df = spark.createDataFrame([("1", text, 0), ("2", None, 0), ("3", "", 0), ("4", "plain " * 20_000, 0), ("1", text, 0)], "id string, t string, kind int")
    rows = personal.mentions(df, ["id"], "t", detector).collect()
    assert {text[r["start_pos"] : r["end_pos"]] for r in rows} == {"Anna Delmont", "a@b.example"} and len(rows) == 4
    out = {r["id"]: r["redacted"] for r in personal.redacted(df, ["id"], "t", detector).collect()}
    assert out["1"] == "ü😀 Contact <PERSON_NAME> at <EMAIL>." and out["2"] is None and out["3"] == ""
    assert personal.mentions(df.limit(0), ["id"], "t", detector).count() == 0


def test_trees_learn_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit_trees(x[:1500], y[:1500], rounds=60)
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.88
