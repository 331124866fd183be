from datetime import UTC, datetime

import pytest

from recollate.operators.timestamps import with_instant


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000


CASES = [
    ("2024-02-29T10:20:30Z", "UTC", "DMY", us(2024, 2, 29, 10, 20, 30)),
    ("2024-02-29 10:20:30.1234567+05:30", "UTC", "DMY", us(2024, 2, 29, 4, 50, 30) + 123456),
    ("2023-02-29", "UTC", "DMY", None),
    ("2024-03-10 02:30:00", "America/New_York", "MDY", us(2024, 3, 10, 7, 30)),  # skipped: offset before
    ("2024-11-03 01:30:00", "America/New_York", "MDY", us(2024, 11, 3, 5, 30)),  # repeated: offset before
    ("2024-06-01", "Asia/Tokyo", "DMY", us(2024, 5, 31, 15)),
    ("03/04/2024 7:05 PM", "UTC", "DMY", us(2024, 4, 3, 19, 5)),
    ("03/04/2024 7:05 PM", "UTC", "MDY", us(2024, 3, 4, 19, 5)),
    ("03/04/2024 12:05 AM", "UTC", "MDY", us(2024, 3, 4, 0, 5)),
    ("03/04/2024 7:05", "UTC", "???", None),
    ("13/13/2024", "UTC", "DMY", None),
    ("Thu, 26 Oct 2023 17:37:00 +1100", "UTC", "DMY", us(2023, 10, 26, 6, 37)),
    ("8 Feb 2023 07:44", "Europe/Berlin", "DMY", us(2023, 2, 8, 6, 44)),
    ("2024年7月29日 09:46", "Asia/Tokyo", "DMY", us(2024, 7, 29, 0, 46)),
    ("20230925T004626Z", "UTC", "DMY", us(2023, 9, 25, 0, 46, 26)),
    ("2025-04-25 10:00:00 PST", "Asia/Tokyo", "DMY", us(2025, 4, 25, 18)),
    ("2025-04-25 10:00:00 XYZ", "Asia/Tokyo", "DMY", None),
    ("1696363218", "Asia/Tokyo", "DMY", 1696363218_000000),
    ("1691236828.3839", "UTC", "DMY", 1691236828_383900),
    ("1686373287811", "UTC", "DMY", 1686373287_811000),
    ("1749112014812132", "UTC", "DMY", 1749112014_812132),
    ("0000-00-00 00:00:00", "UTC", "DMY", None),
    ("2025-13-45T99:00:00Z", "UTC", "DMY", None),
    ("2024-01-01 25:00:00", "UTC", "DMY", None),
    ("soon", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    (None, "UTC", "DMY", None),
    ("2024-06-01 10:00", "Nowhere/Land", "DMY", None),
    ("2024-06-01 10:00", None, None, None),
    ("x" * 100_000, "UTC", "DMY", None),
]


def test_every_notation(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "n int, v string, tz string, o string")
    got = {r["n"]: r["epoch_us"] for r in with_instant(df, "v", "tz", "o").collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[3], case


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "v string, tz string, o string")
    assert with_instant(empty, "v", "tz", "o").count() == 0
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "UTC", "DMY", 5, "x")], "v string, tz string, o string, epoch_us long, `a.b` string")
    row = with_instant(df, "v", "tz", "o").first()
    assert row["epoch_us"] == us(2024, 1, 1) and row["a.b"] == "x"


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2024-06-01 10:00:00", "Europe/Berlin", "DMY")], "v string, tz string, o string")
        assert with_instant(df, "v", "tz", "o").first()["epoch_us"] == us(2024, 6, 1, 8)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
