"""Every catalogue query against its SQL on the 0.01 tables, where none is empty."""

import pytest

from recollate.plans import catalog, verbs  # noqa: F401  verbs adds to the catalogue


def cells(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLE if not n.startswith("near_")))
def test_against_sql(spark, folder, duck, name):
    df = catalog.QUERIES[name](spark, folder)
    got = cells(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(catalog.ORACLE[name])
    assert got == cells([c[0] for c in rel.description], rel.fetchall())


def test_near_duplicates_of_the_record_store(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(0, text, "mem0"), (1, f"{text} more", "letta"), (2, f"{text} other", "mem0"), (3, "nothing of it is alike here", "letta"), (4, text.upper(), "codex")]
    fill = "'i' AS instance, 'note' AS doc_kind, 'en' AS lang, 'x' AS source, CAST(length(text) AS BIGINT) AS n_chars"
    spark.createDataFrame(rows, "doc_id long, text string, adapter string").selectExpr("*", *fill.split(", ")).write.parquet(str(tmp_path / "documents.parquet"))
    groups = catalog.QUERIES["near_duplicate_groups"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["adapter"]) for r in groups) == [(0, "mem0"), (1, "letta"), (2, "mem0"), (4, "codex")]
    assert len({r["component"] for r in groups}) == 1
    pairs = catalog.QUERIES["near_duplicate_record_pairs"](spark, str(tmp_path)).collect()
    assert sorted(r["similarity"] for r in pairs) == [0.990099, 0.995025, 0.995025]
