import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeglass.sources import archives, market

BARS = "display_symbol string, security_id string, t timestamp, open double, high double, low double, close double, volume double, transactions bigint, day date"


def bars(spark):
    at = lambda d, m: dt.datetime(2024, 1, d, 15, m)
    return spark.createDataFrame([("A", "s1", at(d, m), 1.0, 2.0, 0.5, 1.5, 10.0, 1, dt.date(2024, 1, d)) for d in (2, 3, 5) for m in (9, 1, 5)] + [("B", None, at(3, 0), 1.0, 1.0, 1.0, 1.0, 1.0, None, dt.date(2024, 1, 3))], BARS)


def test_days_point_scans_and_stamps(spark, tmp_path):
    path = str(tmp_path / "bars")
    market.write_days(bars(spark), path, {f"k{i}": str(i) for i in range(1500)})
    assert market.read_stamped(spark, path, {"k1499": "1499", "k3": None}).count() == 10
    with pytest.raises(ValueError):
        market.read_stamped(spark, path, {"k3": "4"})
    with pytest.raises(ValueError):
        market.read_stamped(spark, path, {"absent": None})
    window = market.read_days(spark, path, "2024-01-03", "2024-01-04")
    assert window.count() == 4 and "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().toString()
    assert [r.t.minute for r in market.session_bars(spark, path, "s1", "2024-01-05").collect()] == [1, 5, 9]
    with pytest.raises(market.MissingBars):
        market.session_bars(spark, path, "s1", "2024-01-04")
    f = market.footers(spark, path).collect()
    assert sum(r.rows for r in f) == 10 and len({r.columns for r in f}) == 1
    again = bars(spark).where("day = date'2024-01-03'").limit(1)
    market.write_days(again, path)
    assert market.read_days(spark, path).count() == 7  # the day written again was replaced, the others stay


def test_declared_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    df = spark.createDataFrame([("x", 1, 2.0)], "a string, b int, extra double")
    market.write_table(df, str(tmp_path / "t"), schema, {"snapshot": "d"})
    back = market.read_stamped(spark, str(tmp_path / "t"), {"snapshot": "d"})
    assert back.dtypes == [("b", "bigint"), ("a", "string")] and back.count() == 1
    with pytest.raises(ValueError):
        market.write_table(df.drop("a"), str(tmp_path / "u"), schema)


def test_cursor_and_bulk_conversion(spark, tmp_path):
    csv = bars(spark).select(F.col("display_symbol").alias("ticker"), "volume", "open", "close", "high", "low", (F.unix_micros("t") * 1000).alias("window_start"), "transactions", "day")
    for d in ("2024-01-02", "2024-01-03", "2024-01-05"):
        csv.where(F.col("day") == d).drop("day").coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / f"raw-{d}"))
        part = next((tmp_path / f"raw-{d}").glob("*.csv.gz"))
        (tmp_path / "staging").mkdir(exist_ok=True)
        part.rename(tmp_path / "staging" / f"{d}.csv.gz")
    (tmp_path / "staging" / "2024-01-09.csv.gz").touch()
    cursor = market.DayCursor(spark, str(tmp_path / "cursor"))
    assert not cursor.is_done("bars", dt.date(2024, 1, 2))
    args = (spark, str(tmp_path / "staging"), None, str(tmp_path / "out"), cursor)
    assert market.convert_all(*args) == 3 and market.convert_all(*args) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    rows = [(r.display_symbol, r.t) for r in spark.read.parquet(str(tmp_path / "out" / "day=2024-01-03")).collect()]
    assert len(rows) == 4
    cursor.clear("bars", [dt.date(2024, 1, 3)])
    assert cursor.is_done("bars", dt.date(2024, 1, 2)) and not cursor.is_done("bars", dt.date(2024, 1, 3))
    assert market.convert_all(*args) == 1


def test_pages_are_followed_and_tried_again(spark):
    from collections import Counter

    def fetch(url):
        import json
        import os
        import tempfile

        name = os.path.join(tempfile.gettempdir(), f"tapeglass-page-{os.getppid()}-{url}")
        if url.endswith("1") and not os.path.exists(name):
            open(name, "w").close()
            raise OSError("busy")
        if os.path.exists(name):
            os.unlink(name)
        key, n = url.split("_")
        return json.dumps({"n": int(n), "next_url": f"{key}_{int(n) + 1}" if int(n) < 3 else None})

    starts = spark.createDataFrame([("a_0",), ("b_2",)], "start string")
    got = archives.pages(spark, starts, fetch).collect()
    assert Counter(r.start for r in got) == {"a_0": 4, "b_2": 2}
    with pytest.raises(Exception, match="more than 2 pages"):
        archives.pages(spark, starts, fetch, most_pages=2).collect()


def test_zip_members_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("q/A.tsv", "X\tY\r\n1\tu\n2\n"), ("q/b.json", "{}")], "m string, x string")
    assert archives.write_zips(df.repartition(1), "m", "x", str(tmp_path / "z")) == 1
    m = archives.zip_members(spark, str(tmp_path / "z"), ".tsv")
    assert [r.member for r in m.collect()] == ["q/A.tsv"]
    rows = archives.tsv(m, "A.tsv", ["Y", "X", "Z"]).collect()
    assert {(r.X, r.Y, r.Z) for r in rows} == {("1", "u", None), ("2", None, None)}
    with pytest.raises(Exception, match="bytes"):
        archives.zip_members(spark, str(tmp_path / "z"), ".tsv", most_bytes=3).collect()
