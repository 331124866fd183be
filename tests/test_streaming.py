from datetime import datetime

from recollate.streaming import watch


def at(s):
    return datetime(2024, 1, 1, 0, 0, s)


def test_bursts_settle_after_the_last_change(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(2)), ("a", at(9)), ("b", at(1))], "source string, ts timestamp")
    got = {(r["source"], r["settled_at"], r["changes"]) for r in watch.debounce(df).collect()}
    assert got == {("a", at(4), 3), ("a", at(11), 1), ("b", at(3), 1)}


def test_catch_up_stream_absorbs_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("1", "h", at(0)), ("1", "h", at(1)), ("1", "h2", at(2)), ("2", "h", at(3))], "id string, raw_hash string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = watch.follow(watch.without_repeats(stream, ["id", "raw_hash"]), lambda df, _: seen.extend(tuple(r)[:2] for r in df.collect()), str(tmp_path / "cp"), catch_up=True)
    query.awaitTermination(60)
    assert sorted(seen) == [("1", "h"), ("1", "h2"), ("2", "h")] and watch.heartbeat(query, 0) == "stopped"


def test_longest_root_wins(spark):
    changes = spark.createDataFrame([("/a/b/c.md",), ("/a/x",), ("/z",), ("/ab/c",)], "path string")
    roots = spark.createDataFrame([("/a", "s1"), ("/a/b", "s2")], "root string, source string")
    assert dict(watch.route(changes, roots).collect()) == {"/a/b/c.md": "s2", "/a/x": "s1", "/z": None, "/ab/c": None}
