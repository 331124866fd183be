import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recollate.operators.nested import flatten_records

SCHEMA = "k string, text string"


def opened(v):
    if isinstance(v, str) and re.match(r"\s*[\[{]", v):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        return w if isinstance(w, (dict, list)) else v
    return v


def walk(v, path, anc, elem, out):
    v = opened(v)
    if isinstance(v, dict):
        if elem:
            out.add((path, anc))
            anc = path
        for k, x in v.items():
            walk(x, f"{path}.{k}", anc, False, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            walk(x, f"{path}[{i}]", anc, True, out)


def brute(texts):
    want = set()
    for k, t in texts:
        out = set()
        walk(json.loads(t), "$", "$", False, out)
        want |= {(k, *x) for x in out}
    return want


def found(spark, texts):
    got = [tuple(r) for r in flatten_records(spark.createDataFrame(texts, SCHEMA), ["k"], "text").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_paths_and_parents(spark):
    texts = [("a", '{"x":[{"y":[{"z":1},2]},"[{\\"q\\":{}}]"]}'), ("b", '[{"a":[[{"b":1}]]}]'), ("c", json.dumps('{"p":[{}]}'))]
    assert found(spark, texts) == brute(texts)
    assert ("b", "$[0].a[0][0]", "$[0]") in found(spark, texts)


def test_no_depth_limit(spark):
    deep = '{"a":[' * 40 + '{"end":1}' + "]}" * 40
    assert len(found(spark, [("d", deep)])) == 40


def test_unreadable_null_empty_repeated(spark):
    bad = ["", None, "null", "{", '{"a":[{}]} x', "{'a':[{}]}", '{"a":NaN,"b":[{}]}', '{"a":[{}]}{"b":1}', '{"a":1},{"b":[{}]}']
    assert found(spark, [(str(i), b) for i, b in enumerate(bad)]) == set()
    assert found(spark, [("a", '[{"b":1}]')] * 3 + [(None, "[{}]")]) == {("a", "$[0]", "$")}
    assert flatten_records(spark.createDataFrame([], SCHEMA), ["k"], "text").count() == 0


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("a", "[{}]", 1, 2)], "k string, text string, node_path int, __texts int")
    assert flatten_records(df, ["k"], "text").columns == ["k", "node_path", "parent_path"]


leaf = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text("ab[{\"", max_size=4))
tree = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.sampled_from("abc"), c, max_size=3), st.builds(lambda v: json.dumps(v), st.lists(c, max_size=2))), max_leaves=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(tree, min_size=25, max_size=25))
def test_against_brute_force(spark, values):
    texts = [(str(i), json.dumps(v)) for i, v in enumerate(values)]
    assert found(spark, texts) == brute(texts)
