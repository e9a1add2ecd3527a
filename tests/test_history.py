import datetime as dt
import random

from tapeglass.operators.history import ewma


def test_ewma_runs_on_over_years_and_gives_every_day(spark):
    rnd = random.Random(5)
    first = dt.date(2020, 11, 2)
    rows = [(s, first + dt.timedelta(days=k), None if k % 17 == 3 else rnd.random() ** 4) for s, share in (("a", 1.0), ("b", 0.1)) for k in range(1200) if rnd.random() < share]
    rows += [("c", dt.date(2021, 12, 31), 1.0), ("c", dt.date(2023, 1, 1), 0.0), ("d", first, None)]
    rnd.shuffle(rows)
    got = {(r.security_id, r.day): r.ewma for r in ewma(spark.createDataFrame(rows, "security_id string, day date, x double"), "x", 10).collect()}
    decay, state, want = 0.5 ** (1 / 10), {}, {}
    for s, day, x in sorted(r for r in rows if r[2] is not None):
        state[s] = decay * state.get(s, x) + (1 - decay) * x
        want[s, day] = state[s]
    assert set(got) == set(want)
    assert all(abs(got[k] - v) <= 1e-12 * max(v, 1e-9) for k, v in want.items())


def test_ewma_vol_has_every_day_with_a_return(spark, folder):
    from tapeglass.plans.panel import panel
    from tapeglass.plans.research import ewma_vol

    days = panel(spark, folder).where("lret is not null").selectExpr("security_id", "date_format(day, 'yyyy-MM-dd') as day")
    got = ewma_vol(spark, folder)
    assert got.where("vol is null").count() == 0
    assert sorted(map(tuple, got.select("security_id", "day").collect())) == sorted(map(tuple, days.collect()))
