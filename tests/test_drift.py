import random

from recollate.operators import drift
from recollate.operators.drift import canonical_names, correspondences, drift_report, field_rows, flood, unified, union_rows

SCHEMA = "id string, metadata_ string, label string, instance string, export_no int, value string"


def report(spark, data):
    rows = field_rows(spark.createDataFrame(data, SCHEMA), "block", "metadata_", "metadata_", "label")
    return rows, {(r["instance"], r["export_no"], r["field"], r["change"], r["former"]) for r in drift_report(rows).collect()}


def test_each_change(spark):
    data = [
        ("1", '{"a":1,"b":"x","c":[1],"same":true}', "L", "i", 1, "v"),
        ("2", '{"a":2,"b":"y"}', None, "i", 1, "v"),
        ("2", '{"a":2,"b":"y"}', None, "i", 1, "v"),  # a repeated row
        ("1", '{"alpha":1,"b":5,"d":null,"same":true}', "[1]", "i", 2, "v"),
        ("2", '{"alpha":2}', None, "i", 2, "v"),
        ("3", "not json", None, "i", 2, "v"),
    ]
    _, got = report(spark, data)
    assert got == {
        ("i", 2, "metadata_.alpha", "renamed", "metadata_.a"),
        ("i", 2, "metadata_.c", "removed", ""),
        ("i", 2, "metadata_.d", "added", ""),
        ("i", 2, "metadata_.b", "retyped", ""),
        ("i", 2, "label", "retyped", ""),
    }


def test_a_rename_needs_every_record(spark):
    base = [("1", '{"a":1}', None, "i", 1, ""), ("2", '{"a":2}', None, "i", 1, "")]
    _, got = report(spark, [*base, ("1", '{"z":1}', None, "i", 2, ""), ("2", '{"z":9}', None, "i", 2, "")])
    assert got == {("i", 2, "metadata_.a", "removed", ""), ("i", 2, "metadata_.z", "added", "")}
    _, got = report(spark, [*base, ("1", '{"z":1}', None, "i", 2, ""), ("2", "[]", None, "i", 2, "")])
    assert ("i", 2, "metadata_.z", "renamed", "metadata_.a") in got


def test_label_moves_into_metadata(spark):
    _, got = report(spark, [("1", "{}", "human", "i", 1, ""), ("1", '{"block_label":"human"}', None, "i", 4, "")])
    assert got == {("i", 4, "metadata_.block_label", "renamed", "label")}


def test_nulls_and_empty(spark):
    _, got = report(spark, [(None, None, None, None, None, None), (None, '{"a":1}', None, None, 1, None), (None, '{"b":1}', None, None, 2, None)])
    assert got == {(None, 2, "metadata_.a", "removed", ""), (None, 2, "metadata_.b", "added", "")}
    empty = spark.createDataFrame([], SCHEMA)
    assert drift_report(field_rows(empty, "block", "metadata_", "metadata_", "label")).count() == 0


def test_one_table_of_all_exports(spark):
    rows, _ = report(spark, [("1", '{"a":1}', "L", "i", 1, ""), ("1", '{"b":1}', "L", "i", 2, ""), ("2", '{"c":[1]}', None, "i", 2, "")])
    changes = drift_report(rows)
    assert {(r["field"], r["canonical"]) for r in canonical_names(changes).collect()} == {("metadata_.a", "metadata_.a"), ("metadata_.b", "metadata_.a")}
    table = unified(rows, changes)
    assert dict(table.dtypes[4:]) == {"label": "string", "metadata_.a": "double", "metadata_.c": "string"}
    got = {(r["id"], r["export_no"]): tuple(r)[4:] for r in table.collect()}
    assert got == {("1", 1): ("L", 1.0, None), ("1", 2): ("L", 1.0, None), ("2", 2): (None, None, "[1]")}
    assert union_rows([rows, rows]).count() == 2 * rows.count()


def test_flooding_prefers_like_fields():
    gone, new = {"m.session_id": ("string",), "m.size": ("number",)}, {"m.session": ("string",), "m.bytes": ("number",)}
    scores = flood(gone, new, {})
    assert scores["m.session_id", "m.session"] > scores["m.session_id", "m.bytes"]
    assert scores["m.size", "m.bytes"] > scores["m.size", "m.session"]


def test_flooding_decides_the_unified_table(spark):
    # size becomes bytes with another type; in one of five records the value of session_id is another one in session
    old = [(str(i), f'{{"size":{i},"session_id":"s{i}"}}', None, "i", 1, "") for i in range(5)]
    new = [(str(i), f'{{"bytes":"{i}","session":"{"x" if i == 4 else "s"}{i}"}}', None, "i", 2, "") for i in range(5)]
    rows, got = report(spark, old + new)
    assert {c for _, _, _, c, _ in got} == {"removed", "added"}
    names = {(r["field"], r["canonical"]) for r in canonical_names(drift_report(rows, proposed=True)).collect()}
    size, session = "metadata_.bytes", "metadata_.session"
    assert names == {(size, size), ("metadata_.size", size), (session, session), ("metadata_.session_id", session)}
    # two new fields have full evidence: both are renames, the name decides which one continues the old field
    rows, got = report(spark, [("1", '{"user_id":7}', None, "i", 1, ""), ("1", '{"age":7,"user":7}', None, "i", 2, "")])
    assert {(f, c) for _, _, f, c, _ in got} == {("metadata_.age", "renamed"), ("metadata_.user", "renamed")}
    names = {(r["field"], r["canonical"]) for r in canonical_names(drift_report(rows, proposed=True)).collect()}
    assert names == {("metadata_.user", "metadata_.user"), ("metadata_.user_id", "metadata_.user")}
    # fields that agree by chance in few records stay apart
    rows, _ = report(spark, [(str(i), f'{{"a":{i % 2}}}', None, "i", 1, "") for i in range(4)] + [(str(i), '{"z":1}', None, "i", 2, "") for i in range(4)])
    assert canonical_names(drift_report(rows, proposed=True)).count() == 0


def test_unified_rows_stay_apart(spark):
    data = [
        ("1", '{"a":1}', None, "i", 1, "v"),
        ("2", '{"a":3}', None, "i", 1, "v"),
        ("2", '{"b":3}', None, "i", 2, "v"),
        ("2", '{"b":4}', None, "i", 2, "v"),  # a key with two values
        ("2", '{"b":4}', None, "i", 2, "w"),  # and with two values of another column
        ("2", '{"b":4}', None, "i", 2, "w"),  # an exact copy
        (None, '{"a":5}', None, "i", 1, "x"),
        (None, '{"a":6,"label":null}', "L", "i", 1, None),
        (None, "torn {", None, "i", 1, "y"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    changes = spark.createDataFrame([("block", "metadata_.b", "metadata_.a", True)], "origin string, field string, former string, chosen boolean")
    table = unified(field_rows(df, "block", "metadata_", "metadata_", "label", others=True), changes)
    assert table.columns == ["origin", "instance", "export_no", "id", "value", "unread", "label", "metadata_.a", "metadata_.label"]
    want = [("1", 1, "v", None, None, 1.0), ("2", 1, "v", None, None, 3.0), ("2", 2, "v", None, None, 3.0), ("2", 2, "v", None, None, 4.0), ("2", 2, "w", None, None, 4.0),
            (None, 1, "x", None, None, 5.0), (None, 1, None, None, "L", 6.0), (None, 1, "y", "torn {", None, None)]
    assert sorted(((r[3], r[2], *tuple(r)[4:8]) for r in table.collect()), key=str) == sorted(want, key=str)


def test_a_rename_elsewhere_never_merges_two_fields(spark):
    # in instance A the field x is renamed to y; in B both stand side by side, in C only y occurs
    data = [("1", '{"x":"k"}', None, "A", 1, ""), ("1", '{"y":"k"}', None, "A", 2, ""), ("1", '{"x":"p","y":7}', None, "B", 1, ""), ("2", '{"y":8}', None, "B", 1, ""), ("1", '{"y":"c"}', None, "C", 1, "")]
    rows, _ = report(spark, data)
    table = unified(rows, drift_report(rows, proposed=True))
    assert {(r["instance"], r["export_no"], r["id"], r["metadata_.x"], r["metadata_.y"]) for r in table.collect()} == {
        ("A", 1, "1", "k", None), ("A", 2, "1", "k", None), ("B", 1, "1", "p", 7.0), ("B", 1, "2", None, 8.0), ("C", 1, "1", "c", None)
    }


def test_types_widen_to_text(spark):
    data = [("1", '{"n":1,"m":5,"t":true,"o":{"k":[1]}}', None, "i", 1, ""), ("2", '{"n":2.5,"m":"five","t":null}', None, "i", 1, "")]
    rows, _ = report(spark, data)
    got = {r["id"]: (r["metadata_.n"], r["metadata_.m"], r["metadata_.t"], r["metadata_.o"]) for r in unified(rows, drift_report(rows)).collect()}
    assert got == {"1": (1.0, "5", True, '{"k":[1]}'), "2": (2.5, "five", None, None)}


def test_without_flooding_there_is_no_rename(monkeypatch):
    assert correspondences({"f.a": ("number",)}, {"f.z": ("number",)}, {("f.a", "f.z"): 1}, {"f.a": 1}, {("f.a", "f.z"): 1})[0][3:] == (True, True)
    monkeypatch.setattr(drift, "flood", lambda gone, new, agreement: {(g, n): 0.0 for g in gone for n in new})
    assert drift.correspondences({"f.a": ("number",)}, {"f.z": ("number",)}, {("f.a", "f.z"): 1}, {"f.a": 1}, {("f.a", "f.z"): 1}) == []


def test_flooding_proposes_every_full_evidence():
    rng = random.Random(4)
    kinds = ["string", "number", "array", "object"]
    for _ in range(300):
        gone = {f"m.g{i}": tuple(rng.sample(kinds, rng.randint(0, 2))) for i in range(rng.randint(1, 5))}
        new = {f"m.{rng.choice('xyz')}{i}": tuple(rng.sample(kinds, rng.randint(0, 2))) for i in range(rng.randint(1, 5))}
        pairs = [(g, n) for g in gone for n in new]
        full = rng.sample(pairs, min(2, len(pairs)))
        scores = flood(gone, new, {p: 1.0 for p in full})
        assert all(scores[p] >= drift.PROPOSED - 1e-9 for p in full) and all(0 <= x <= 1 + 1e-9 for x in scores.values())
