"""Every source, sink and watch query against its SQL on the smallest tables."""

import pytest
from test_catalog import cells

from recollate.plans import stores


@pytest.mark.parametrize("name", sorted(stores.QUERIES))
def test_against_sql(spark, small, duck_small, name):
    df = stores.QUERIES[name](spark, small)
    got = cells(df.columns, [tuple(r) for r in df.collect()])
    rel = duck_small.execute(stores.ORACLE[name])
    assert got == cells([c[0] for c in rel.description], rel.fetchall()) and got[1]
