import datetime as dt
import math
import random
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from tapeglass.operators import forward as W
from tapeglass.operators.adjust import cash_so_far, days_ahead, split_factor
from tapeglass.operators.ranking import global_ntile, global_rank

DAYS = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10)]
BAR = "display_symbol string, t timestamp, open double, high double, low double, close double, volume double, blk string, ends int"


def bar(sym, day, minute, o, h=None, l=None, c=None, v=10.0, second=0):
    t = dt.datetime.combine(day, dt.time(minute // 60, minute % 60, second), ZoneInfo("America/New_York"))
    return (sym, t, *[float(o if x is None else x) for x in (o, h, l, c)], v, "clash", 1)


def tables(spark, rows):
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(DAYS)], "day date, day_idx bigint")
    ctx = spark.createDataFrame([("A", DAYS[0], 2.0), ("C", DAYS[0], None)], "sym string, day date, atr double")
    return spark.createDataFrame(rows, BAR), ctx, cal


@pytest.fixture(scope="module")
def tape():
    """Symbol A on four days, the third of which is missing; B has premarket bars and nothing else; C has one bar late in the day."""
    rows = [bar("A", DAYS[0], m, 100 + m - 575, 101 + m - 575, 99 + m - 575, 100.5 + m - 575) for m in (575, 576, 577, 590)]
    rows += [bar("A", DAYS[0], 576, 1, 1, 1, 1), bar("A", DAYS[0], 576, 101, 102, 100, 101.5, second=30)]  # several rows for a minute: the later one stands
    rows += [bar("A", DAYS[1], 570, 120, 130, 80, 90), bar("A", DAYS[1], 605, 90, 95, 85, 95)]
    rows += [bar("A", DAYS[3], 571, 50, 55, 45, 52)]
    rows += [bar("B", DAYS[0], 500, 7), bar("C", DAYS[0], 940, 5, 5, 5, 5), bar(None, DAYS[0], 600, 5)]
    rows += [("A", None, 1.0, 1.0, 1.0, 1.0, 1.0, "x", 1), bar("A", DAYS[0], 580, 500, v=0.0), bar("A", DAYS[0], 581, 500, v=None)]
    return rows


def test_states_follow_the_days_that_are_there(spark, tape):
    b, ctx, cal = tables(spark, tape)
    got = {(r.sym, r.day, r.entry, r.name): r for r in W.path_states(b, ctx, cal, [*W.HORIZONS, "1d_open", "1d_30m", "3d_close"]).collect()}
    first = lambda n: got["A", DAYS[0], "0935", n]
    assert (first("10min").idx, first("10min").c, first("10min").hi, first("10min").hi_at) == (2, 102.5, 103.0, 2)
    assert (first("EOD").idx, first("EOD").pause, first("EOD").volume) == (3, 13, 40.0)
    assert (first("1d").idx, first("1d").lo, first("1d").lo_at, first("1d").c) == (5, 80.0, 4, 95.0) and first("1d").pause == 35
    assert first("2d").idx is None and first("2d").price is None and first("3d").idx == 6 and first("3d_close").c == 52.0
    assert (first("1d_open").idx, first("1d_30m").idx) == (4, 4)
    assert (first("3d").n_over, first("3d").n_under, first("3d").longest_over, first("3d").longest_under, first("3d").recovery) == (4, 3, 4, 3, 0)
    late = got["A", DAYS[0], "0945", "EOD"]
    assert (late.idx, late.price, late.atr) == (0, 115.0, 2.0)
    assert ("A", DAYS[0], "0955", "EOD") not in got and {k[0] for k in got} == {"A", "C"}
    assert got["A", DAYS[1], "0935", "EOD"].atr is None and got["A", DAYS[1], "0935", "2d"].c == 52.0


def test_lines_equal_a_loop(spark):
    rnd = random.Random(3)
    rows = []
    for day in DAYS[:4]:
        price = 100.0
        for m in sorted(rnd.sample(range(570, 960), 60)):
            o, c = price, price * (1 + rnd.gauss(0, 0.01))
            rows.append(bar("A", day, m, o, max(o, c) * (1 + abs(rnd.gauss(0, 0.003))), min(o, c) * (1 - abs(rnd.gauss(0, 0.003))), c))
            price = c
    b, ctx, cal = tables(spark, rows)
    got = [r for r in W.path_lines(b, ctx, cal).collect() if r.day == DAYS[0]]
    assert len(got) >= 15
    order = sorted(((r[1].date(), r[1]), r) for r in rows)
    for r in got:
        t = [x for (_, x) in order if (x[1].date(), x[1].hour * 60 + x[1].minute) >= (DAYS[0], W.minute_of(r.entry))]
        price = t[0][2]
        touch = lambda f, t=t: next((i for i, x in enumerate(t) if f(x)), None)
        want = []
        for x in W.PCT:
            want += [touch(lambda y: y[3] / price - 1 >= float(x) / 100), touch(lambda y: y[4] / price - 1 <= -float(x) / 100)]
        for x in W.ATR:
            want += [touch(lambda y: y[3] >= price + float(x) * 2.0), touch(lambda y: y[4] <= price - float(x) * 2.0)]
        assert r.lines == want
        assert r.ends[3] == sum(x[1].date() == DAYS[0] for x in t) - 1
    assert W.path_lines(b.limit(0), ctx, cal).count() == 0 == W.path_states(b.limit(0), None, cal, ["EOD"]).count()


def test_entries_and_the_day_tape(spark, tape):
    b, ctx, cal = tables(spark, tape)
    t = W.day_tape(b, ctx, cal, W.OFFSETS)
    f = {e.entry: e.f.mod for e in t.where("sym = 'A' and k = 0").orderBy("D").first().fills}
    assert f == {"0935": 575, "0940": 590, "0945": 590, "0950": 590}
    x = W.follow(t).where("entry = '0935' and sym = 'A'").orderBy("D", "idx").collect()
    assert [r.idx for r in x if r.day == DAYS[0]] == list(range(7)) and x[1].c == 101.5
    assert t.where("sym = 'B' and size(fills) > 0").count() == 0


def test_split_factor_prefers_the_id(spark):
    splits = spark.createDataFrame([("s", None, DAYS[3], 1.0, 2.0), ("s", None, DAYS[5], 1.0, 5.0), ("s", None, DAYS[4], 1.0, 0.0), (None, "A", DAYS[3], 1.0, 3.0), (None, None, DAYS[3], 1.0, 9.0)], "security_id string, symbol string, execution_date date, split_from double, split_to double")
    rows = spark.createDataFrame([("s", "A", DAYS[0]), ("s", "A", DAYS[3]), ("u", "A", DAYS[0]), (None, "A", DAYS[3]), ("v", None, DAYS[0]), ("s", "A", None)], "id string, sym string, day date").selectExpr("*", "'clash' as factor")
    got = sorted((str(r.id), str(r.sym), str(r.day), round(r.factor, 6)) for r in split_factor(rows, splits, "2024-01-08", "id", "sym", "day").collect())
    assert got == sorted([("s", "A", "2024-01-02", 0.5), ("s", "A", "2024-01-05", 1.0), ("u", "A", "2024-01-02", round(1 / 3, 6)), ("None", "A", "2024-01-05", 1.0), ("v", "None", "2024-01-02", 1.0), ("s", "A", "None", 1.0)])
    assert split_factor(rows, splits.limit(0), "2024-01-08", "id", "sym", "day").count() == 6


def test_cash_and_days_ahead(spark):
    cash = spark.createDataFrame([("s", DAYS[1], 0.5), ("s", DAYS[1], 0.25), ("s", DAYS[3], 1.0), ("t", DAYS[0], None), (None, DAYS[0], 3.0)], "k string, ex_date date, amount double")
    rows = spark.createDataFrame([("s", d) for d in DAYS[:5]] + [("t", DAYS[0]), (None, DAYS[0])], "k string, day date")
    got = {(r.k, r.day): r.cash for r in cash_so_far(rows, cash, "k", "day").collect()}
    assert [got["s", d] for d in DAYS[:5]] == [0.0, 0.75, 0.75, 1.75, 1.75] and got["t", DAYS[0]] == got[None, DAYS[0]] == 0.0
    daily = spark.createDataFrame([("s", i, float(i)) for i in range(25)], "k string, i bigint, x double")
    starts = spark.createDataFrame([("s", 3, "a"), ("s", 22, "b"), ("s", 24, "c"), ("u", 0, "d")], "k string, i bigint, name string")
    out = days_ahead(starts, daily, "k", "i", 7).collect()
    by = {n: sorted((r.ahead, r.x) for r in out if r.name == n and r.ahead is not None) for n in "abcd"}
    assert by["a"] == [(j, 3.0 + j) for j in range(1, 8)] and by["b"] == [(1, 23.0), (2, 24.0)] and by["c"] == by["d"] == [] and len(out) == 11


def test_ranks_over_all_rows(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), i) for i in range(1003)]
    df = spark.createDataFrame(rows, "x int, id int").repartition(6)
    want = {i: r for r, (_, i) in enumerate(sorted(rows), 1)}
    assert {r.id: r["rank"] for r in global_rank(df, ["x", "id"], "rank").collect()} == want
    buckets = {r.id: r.b for r in global_ntile(df, ["x", "id"], 10, "b").collect()}
    sizes = np.bincount(list(buckets.values()))[1:]
    assert sizes.tolist() == [101, 101, 101] + [100] * 7 and all(buckets[i] == (1 + (r - 1) // 101 if r <= 303 else 4 + (r - 304) // 100) for i, r in want.items())
    assert global_rank(df.limit(0), ["x"], "rank").count() == 0 and global_ntile(df.limit(3), ["x", "id"], 10, "b").count() == 3


def test_normal_tail(spark):
    from pyspark.sql import functions as F

    from tapeglass.operators.resampling import normal_tail

    got = spark.createDataFrame([(0.0,), (1.96,), (6.0,), (None,), (float("nan"),)], "x double").select(normal_tail(F.col("x")).alias("p")).collect()
    assert got[0].p == 0.5 and abs(got[1].p - 0.0249979) < 1e-7 and abs(got[2].p / 9.8659e-10 - 1) < 1e-4
    assert got[3].p is None and (got[4].p is None or math.isnan(got[4].p))
