import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tapeglass.operators.stamps import normalise_stamps


def us(*a, tz="UTC", micro=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(tz)).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-05-14", None, us(2024, 5, 14, tz="America/New_York"), "ok"),
    (" 2023-02-26T12:00:00,123456789+00:00\n", None, us(2023, 2, 26, 12, micro=123456), "ok"),
    ("2024-01-01 10:00:00z", "Asia/Tokyo", us(2024, 1, 1, 10), "ok"),
    ("2024-07-01 10:00:00 EST", None, us(2024, 7, 1, 15), "ok"),
    ("2024-07-01 10:00:00 ET", "UTC", us(2024, 7, 1, 14), "ok"),
    ("2024-07-01 10:00", "Europe/London", us(2024, 7, 1, 9), "ok"),
    ("20240701", "UTC", us(2024, 7, 1), "ok"),
    ("20240701123005", "Asia/Tokyo", us(2024, 7, 1, 3, 30, 5), "ok"),
    ("1/4/2016", "UTC", us(2016, 1, 4), "ok"),
    ("6/21/2021 12:08 AM", "UTC", us(2021, 6, 21, 0, 8), "ok"),
    ("6/21/2021 13:08 PM", "UTC", None, "unreadable"),
    ("14.03.2021 16:37:56", "UTC", us(2021, 3, 14, 16, 37, 56), "ok"),
    ("04-apr-2018", "UTC", us(2018, 4, 4), "ok"),
    ("Fri, 02 Aug 2019 09:22:00 -0500", None, us(2019, 8, 2, 14, 22), "ok"),
    ("Mon, 02 Aug 2019 09:22:00 -0500", None, None, "unreadable"),
    ("Dec 23, 2018 11:57:18 PM EDT", None, us(2018, 12, 24, 3, 57, 18), "ok"),
    ("1541792700", "Asia/Tokyo", 1541792700_000000, "ok"),
    ("1541792700.1234567", None, 1541792700_123456, "ok"),
    ("1576570080001", None, 1576570080_001000, "ok"),
    ("1723684560000001", None, 1723684560_000001, "ok"),
    ("1653558540123456789", None, 1653558540_123456, "ok"),
    ("1.614761700E+09", None, 1614761700_000000, "ok"),
    ("2019-02-29T12:00:00Z", None, None, "no_such_date"),
    ("2021-13-04", None, None, "no_such_date"),
    ("2021-12-04 24:00:00", None, None, "unreadable"),
    ("2024-03-10 02:30:00", None, None, "skipped"),
    ("2024-11-03 01:30:00", None, None, "ambiguous"),
    ("2024-11-03 01:30:00 EDT", None, us(2024, 11, 3, 5, 30), "ok"),
    ("2024-11-03 02:00:00", None, us(2024, 11, 3, 7), "ok"),
    ("2024-03-31 01:30:00", "Europe/London", None, "skipped"),
    ("2024-01-01 00:00:00", "Nowhere/Land", None, "unknown_zone"),
    ("tomorrow", None, None, "unreadable"),
    ("09:30", None, None, "unreadable"),
    ("2024-01-01 00:00:00+99:00", None, None, "unreadable"),
    ("", None, None, "missing"),
    ("  ", "UTC", None, "missing"),
    (None, "UTC", None, "missing"),
    ("1" * 5000, None, None, "unreadable"),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r.i: (r.utc_micros, r.stamp_status) for r in normalise_stamps(df, "v", "z").collect()}
    for i, (v, z, micros, status) in enumerate(CASES):
        assert got[i] == (micros, status), (v, z)


def test_policies_and_empty(spark):
    df = spark.createDataFrame([("2024-11-03 01:30:00",), ("2024-03-10 02:30:00",)], "v string")
    early = [r.utc_micros for r in normalise_stamps(df, "v", None, policy="earlier").collect()]
    late = [r.utc_micros for r in normalise_stamps(df, "v", None, policy="later").collect()]
    assert early == [us(2024, 11, 3, 5, 30), us(2024, 3, 10, 6, 30)] and late == [us(2024, 11, 3, 6, 30), us(2024, 3, 10, 7, 30)]
    assert normalise_stamps(df.limit(0), "v", None).count() == 0
    with pytest.raises(ValueError):
        normalise_stamps(df, "v", None, policy="guess")


def test_quick_form_equals_the_cascade(spark):
    """The form that is read at once gives what the cascade gives for the same value with a blank before it."""
    days, times = ["2024-02-29", "2023-02-29", "1999-12-31", "2024-13-01"], ["00:00:00", "23:59:59.999999", "24:00:00", "12:30:60", "07:08:09.5"]
    values = [f"{d}{sep}{t}{z}" for d in days for sep in "T " for t in times for z in ("", "Z", "+00:00", "-05:30", "+18:00", "+18:30", "+25:00")]
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    for default in ("UTC", "America/New_York"):
        one = normalise_stamps(df, "raw", None, default).collect()
        two = normalise_stamps(df.selectExpr("concat(' ', raw) as raw"), "raw", None, default).collect()
        assert [(r.raw, r.utc_micros, r.stamp_status) for r in one] == [(r.raw.strip(), r.utc_micros, r.stamp_status) for r in two]
