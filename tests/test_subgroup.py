import random

import numpy as np

from tapeglass.operators.subgroup import peel


def test_peel_goes_on_until_the_least_share_is_left(spark):
    rnd = random.Random(4)
    rows = [(rnd.random(), float(rnd.randrange(40)), rnd.gauss(0, 1)) for _ in range(2000)]
    rows = [(a, b, e + (a > 0.8) + (b > 30)) for a, b, e in rows] + [(None, 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, None)]
    got = peel(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    box, want = np.array([r for r in rows if None not in r]), []
    while True:
        cands = []
        for k, f in ((0, "a"), (1, "b")):
            lo, hi = np.quantile(box[:, k], [0.05, 0.95])
            low, high = box[box[:, k] > lo], box[box[:, k] < hi]
            cands += [(f, "low", box[box[:, k] <= lo][:, k].max(), low), (f, "high", high[:, k].max(), high)]
        cands = [c for c in cands if len(c[3]) >= 200]
        if not cands:
            break
        f, side, x, box = max(cands, key=lambda c: c[3][:, 2].mean())
        want.append((f, side, x, len(box), box[:, 2].mean()))
    assert len(want) > 20 and [r["step"] for r in got] == list(range(len(want)))
    for r, (f, side, x, n, m) in zip(got, want):
        assert (r["feature"], r["side"], r["n"]) == (f, side, n) and abs(r["bound"] - x) < 1e-9 and abs(r["mean"] - m) < 1e-9
    assert peel(spark.createDataFrame([], "a double, b double, y double"), ["a", "b"], "y") == []
    one = spark.createDataFrame([(1.0, 2.0)] * 30, "a double, y double")
    assert peel(one, ["a"], "y") == []
