import datetime as dt
import random

from pyspark.sql import functions as F

from tapeglass.operators.asof import asof_backward, asof_forward, latest_within
from tapeglass.operators.identity import resolve, step_factors, validity_windows


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_asof_both_ways_and_within(spark):
    rnd = random.Random(2)
    left = sorted({(rnd.choice("ab"), day(rnd.randrange(60))) for _ in range(40)})
    right = [(rnd.choice("ab"), day(rnd.randrange(60)), float(i)) for i in range(25)]
    l, r = spark.createDataFrame(left, "k string, d date"), spark.createDataFrame(right, "k string, e date, x double")
    back = {(a.k, a.d): a.f and a.f.x for a in asof_backward(l, r, "k", "d", "e", F.struct("x"), "f").collect()}
    ahead = {(a.k, a.d): a.n for a in asof_forward(l, r, "k", "d", "e", "n").collect()}
    later = {(a.k, a.d): a.n for a in asof_forward(l, r, "k", "d", "e", "n", strict=True).collect()}
    near = {(a.k, a.d): a.e for a in latest_within(l, r, "k", "d", "e", 10, ["x"]).collect()}
    for k, d in left:
        old = [(e, x) for kk, e, x in right if kk == k and e <= d]
        assert back[k, d] == (max(old)[1] if old else None)
        assert ahead[k, d] == min((e for kk, e, _ in right if kk == k and e >= d), default=None)
        assert later[k, d] == min((e for kk, e, _ in right if kk == k and e > d), default=None)
        close = [e for e, _ in old if (d - e).days <= 10]
        assert near.get((k, d)) == (max(close) if close else None)


def test_windows_resolve_gaps_and_claims(spark):
    w = spark.createDataFrame([("S1", "OLD", None, day(0)), ("S2", "NEW", day(100), None), ("S1", "DUP", day(50), None), ("S2", "DUP", day(80), None)], "security_id string, symbol string, valid_from date, valid_to date")
    ask = spark.createDataFrame([("OLD", day(-5)), ("OLD", day(0)), ("NEW", day(99)), ("NEW", day(100)), ("DUP", day(60)), ("DUP", day(90)), (None, day(1)), ("NEW", None)], "s string, day date")
    got = {(r.s, r.day): r.resolved_id for r in resolve(ask, w, "s", "day").collect()}
    assert got == {("OLD", day(-5)): "S1", ("OLD", day(0)): None, ("NEW", day(99)): None, ("NEW", day(100)): "S2", ("DUP", day(60)): "S1", ("DUP", day(90)): None, (None, day(1)): None, ("NEW", None): None}
    e = spark.createDataFrame([("A", "FB", day(0)), ("A", "META", day(10)), ("A", "META", day(10))], "security_id string, symbol string, day date")
    li = spark.createDataFrame([("A", "FB"), ("B", "XYZ")], "security_id string, symbol string")
    assert {tuple(r) for r in validity_windows(e, li).collect()} == {("A", "FB", day(0), day(10)), ("A", "META", day(10), None), ("B", "XYZ", None, None)}


def test_step_factors(spark):
    s = spark.createDataFrame([("A", day(10), 1.0, 4.0), ("A", day(20), 1.0, 2.0), ("A", day(90), 1.0, 5.0), ("A", day(15), 1.0, 0.0)], "key string, execution_date date, split_from double, split_to double")
    got = {(r.from_day, r.until_day): r.factor for r in step_factors(s, "2024-02-15").collect()}
    assert got == {(None, day(10)): 0.125, (day(10), day(20)): 0.5}
