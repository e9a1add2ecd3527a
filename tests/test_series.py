import random

from pyspark.sql import functions as F

from tapeglass.operators.regular_grid import gaps, regular_grid
from tapeglass.operators.trailing import trailing_totals


def test_grid_carries_then_marks_across_blocks(spark):
    rnd = random.Random(1)
    rows = [("a", b, float(i)) for i, b in enumerate(sorted(rnd.sample(range(-50, 200), 40)))] + [("b", 5, 1.0), ("b", 5, 2.0), (None, 1, 1.0), ("c", None, 1.0), ("d", 0, None), ("d", 9, 3.0)]
    df = spark.createDataFrame(rows, "s string, b bigint, x double").withColumn("bucket", F.lit("clash"))
    g = regular_grid(df, ["s"], F.col("b"), {"x": F.max("x"), "n": F.count(F.lit(1))}, ["x"], max_gap=3, block=16)
    got = {(r.s, r.bucket): r for r in g.collect()}
    for s in "abd":
        read = {}
        for k, b, x in rows:
            if k == s and b is not None:
                read[b] = x if read.get(b) is None else max(x, read[b])
        last = None
        for b in range(min(read), max(read) + 1):
            r = got.pop((s, b))
            assert r.previous == last
            if b in read:
                last = b
            assert r.since == b - last
            assert r.state == ("read" if b in read else "carried" if b - last <= 3 else "missing")
            assert r.x == (read[last] if b - last <= 3 else None)
    assert not got
    assert {(r.s, r.gap_from, r.gap_to) for r in gaps(g, ["s"], 9).collect() if r.s == "d"} == {("d", 0, 9)}
    assert regular_grid(df.limit(0), ["s"], F.col("b"), {}, [], 3).count() == 0


def test_trailing_totals_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(-20, 90), rnd.choice([None, float("nan"), 0.0, 1.0, 2.5])) for _ in range(80)] + [(None, 3, 1.0), ("a", None, 1.0), ("z", 4, None)]
    df = spark.createDataFrame(rows, "k string, d int, x double").select("k", F.date_from_unix_date("d").alias("day"), "x", F.lit(1).alias("a"), F.lit(2).alias("_b"))
    out = trailing_totals(df, ["k"], "day", {"x": F.col("x")}, [7, 30]).withColumn("d", F.unix_date("day")).collect()
    got = {(r.k, r.d): r for r in out}
    assert len(got) == len(out)
    for k in "abz":
        days = [d for kk, d, _ in rows if kk == k and d is not None]
        for d in range(min(days), max(days) + 1):
            r = got.pop((k, d))
            for n in (7, 30):
                v = [x for kk, dd, x in rows if kk == k and dd is not None and d - n < dd <= d and x is not None and x == x]
                assert abs(r[f"x_{n}d_total"] - sum(v)) < 1e-9 and abs(r[f"x_{n}d_mean"] - sum(v) / n) < 1e-9
    assert not got
    assert trailing_totals(df.limit(0), ["k"], "day", {"x": F.col("x")}, [7]).count() == 0


def test_grid_bounds_mark_what_lies_outside_the_readings(spark):
    df = spark.createDataFrame([("a", 5), ("a", 40), ("a", 999), ("b", 63)], "s string, b bigint")
    out = regular_grid(df, ["s"], F.col("b"), {"n": F.count(F.lit(1))}, [], max_gap=3, block=16, bounds=(F.lit(0), F.lit(63))).collect()
    assert sorted((r.s, r.bucket) for r in out) == [(s, b) for s in "ab" for b in range(64)]
    state = {(r.s, r.bucket): (r.state, r.since) for r in out}
    assert state["a", 4] == ("missing", None) and state["a", 5] == ("read", 0) and state["a", 8] == ("carried", 3) and state["a", 9] == ("missing", 4)
    assert state["a", 63] == ("missing", 23) and state["b", 0] == ("missing", None) and state["b", 63] == ("read", 0)
