import math
import random

from pyspark.sql import functions as F

from tapeglass.operators.multiselect import percentiles, sorted_runs

PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]


def test_exact_with_ties_infinities_and_a_hot_group(spark):
    rnd = random.Random(9)
    value = lambda: rnd.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.0, rnd.random(), rnd.random() * 1e12, -rnd.random() * 1e-9])
    rows = [("hot" if rnd.random() < 0.4 else str(rnd.randrange(30)), value()) for _ in range(6000)] + [(None, 1.0)] * 5 + [("same", 7.0)] * 900 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    half = df.where(F.rand(1) < 0.5)
    runs = sorted_runs(df, {"g": F.col("g")}, {"x": F.col("x")}, run_rows=300)
    out = percentiles(runs, PROBS, run_rows=200).collect()
    got = {r.grp: (r.n, list(r["values"])) for r in out}
    rounds = {r.grp: r.rounds for r in out}
    assert min(rounds.values()) >= 1 and rounds["same"] <= 2 and 4 <= rounds["hot"] <= 2 * math.log2(got["hot"][0])
    one = {r.grp: (r.n, list(r["values"])) for r in percentiles(runs, PROBS).collect()}
    assert one == got
    by = {}
    for g, x in rows:
        if g is not None and x is not None and not math.isnan(x):
            by.setdefault(g, []).append(x)
    assert got.keys() == by.keys()
    for g, v in by.items():
        v.sort()
        assert got[g][0] == len(v)
        assert got[g][1] == [v[max(1, len(v) - math.floor(len(v) - p * len(v))) - 1] for p in PROBS], g
    assert percentiles(sorted_runs(half.limit(0), {"g": F.col("g")}, {"x": F.col("x")}), PROBS).count() == 0


def test_runs_of_days_combine(spark):
    a = spark.range(0, 500).select(F.lit("k").alias("g"), F.col("id").cast("double").alias("x"))
    b = spark.range(500, 1000).select(F.lit("k").alias("g"), F.col("id").cast("double").alias("x"))
    runs = [sorted_runs(t, {"g": F.col("g")}, {"x": F.col("x")}) for t in (a, b)]
    r = percentiles(runs[0].unionByName(runs[1]), [0.5], run_rows=10).collect()
    assert [(x.n, x["values"]) for x in r] == [(1000, [499.0])]


def test_rounds_in_one_run_halve_what_is_possible():
    import numpy as np

    from tapeglass.operators.multiselect import decide, select_sorted

    flat = np.array([1.0, 2.0, 2.0, 2.0, 9.0, 1.0, 1.0])
    begins = np.array([0, 5])
    value, rounds = select_sorted(flat, begins, np.array([0, 0, 0, 5]), np.array([5, 5, 5, 7]), np.array([0, 2, 4, 1]))
    assert value.tolist() == [1.0, 2.0, 9.0, 1.0] and rounds.max() <= 3
    n = 1 << 17
    value, rounds = select_sorted(np.arange(n) * 1.0, np.array([0]), np.array([0]), np.array([n]), np.array([77]))
    assert value[0] == 77 and rounds[0] <= 18
    t = {"j": 0, "k": 5, "lo": None, "hi": None, "pivot": 4.0, "value": None, "rounds": 1, "cnt": 9}
    told = [{"j": 0, "lt": 1, "eq": 1, "gt": 3, "med_lt": 1.0, "med_gt": 8.0}, {"j": 0, "lt": 2, "eq": 0, "gt": 2, "med_lt": 2.0, "med_gt": 6.0}]
    (after,) = decide([t], told)
    assert (after["lo"], after["hi"], after["k"], after["pivot"], after["cnt"], after["rounds"]) == (4.0, None, 1, 8.0, 5, 2)
