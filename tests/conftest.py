import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from recollate.session import build_session  # noqa: E402

DATA = Path("/root/testdata/sf0.01")
SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)


@pytest.fixture(scope="session")
def small():
    if not SMALL.exists():
        pytest.skip("no test data here")
    return str(SMALL)


def _views(place):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(place):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{place}/{f}'")
    return c


@pytest.fixture(scope="session")
def duck(folder):
    return _views(folder)


@pytest.fixture(scope="session")
def duck_small(small):
    return _views(small)


@pytest.fixture()
def rows():
    return lambda df: sorted(tuple(r) for r in df.collect())
