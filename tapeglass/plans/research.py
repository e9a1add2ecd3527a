"""Research queries: drift after events, persistence, placebos, weights, resampling, models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.operators import history as H
from tapeglass.operators import ranking as R
from tapeglass.operators import resampling, subgroup
from tapeglass.plans.panel import _P, panel
from tapeglass.plans.forward import _T, intraday_returns
from tapeglass.session import cut
from tapeglass.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def _forward(spark, d) -> DataFrame:
    p = panel(spark, d)
    return p.withColumn("fwd", F.lead("ret").over(H.by_security())).where(F.col("ret").isNotNull() & F.col("fwd").isNotNull())


_F = _P + ", f as (select * from (select *, lead(ret) over (partition by security_id order by day) as fwd from p) where ret is not null and fwd is not null)"


@query(_P + f"select security_id, strftime(day, '%Y-%m-%d') as day, " + ", ".join(f"round(lag(c, 1) over w / nullif(lag(c, {n + 1}) over w, 0) - 1, 6) as mom_{n}" for n in (5, 21, 63)) + " from p window w as (partition by security_id order by day)")
def momentum_returns(spark, d):
    w = H.by_security()
    cols = [_r(F.when(F.lag("c", n + 1).over(w) != 0, F.lag("c", 1).over(w) / F.lag("c", n + 1).over(w)) - 1).alias(f"mom_{n}") for n in (5, 21, 63)]
    return panel(spark, d).select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *cols)


@query(_F + ", t as (select security_id, day, row_number() over (partition by day order by ret desc, security_id) <= greatest(1, round(count(*) over (partition by day) * 0.1)) as top from f), x as (select top, lead(top, 1) over w as a, lead(top, 5) over w as b from t window w as (partition by security_id order by day)) select 'next_1' as lag, round(avg(a::int), 9) as p_top, count(a) as n from x where top and a is not null union all select 'next_5', round(avg(b::int), 9), count(b) from x where top and b is not null")
def signal_persistence(spark, d):
    """Chance that a name in the day's top decile is there again one and five of its days later."""
    g = Window.partitionBy("day")
    t = _forward(spark, d).withColumn("top", F.row_number().over(g.orderBy(F.desc("ret"), "security_id")) <= F.greatest(F.lit(1), F.round(F.count(F.lit(1)).over(g) * 0.1)))
    x = t.select("top", *[F.lead("top", k).over(H.by_security()).alias(f"next_{k}") for k in (1, 5)]).where(F.col("top"))
    long = x.select(F.inline(F.array(*[F.struct(F.lit(f"next_{k}").alias("lag"), F.col(f"next_{k}").alias("v")) for k in (1, 5)]))).where(F.col("v").isNotNull())
    return long.groupBy("lag").agg(F.round(F.avg(F.col("v").cast("int")), 9).alias("p_top"), F.count(F.lit(1)).alias("n"))


_MD5 = "md5(security_id || '|' || strftime(day, '%Y-%m-%d') || '|7')"


def _md5():
    return F.md5(F.concat_ws("|", "security_id", F.date_format("day", "yyyy-MM-dd"), F.lit("7")))


@query(_F + f", a as (select day, fwd, row_number() over (partition by day order by ret desc, security_id) as rk, row_number() over (partition by day order by {_MD5}) as sh, count(*) over (partition by day) as n from f) select 'top' as cell, round(avg(fwd), 6) as mean_fwd, count(*) as n from a where rk <= greatest(1, round(n * 0.05)) union all select 'shuffled', round(avg(fwd), 6), count(*) from a where sh <= greatest(1, round(n * 0.05))")
def score_tail_vs_shuffle(spark, d):
    """The extreme tail of a score against the same number of names drawn by a seeded shuffle inside each day."""
    g = Window.partitionBy("day")
    most = F.greatest(F.lit(1), F.round(F.count(F.lit(1)).over(g) * 0.05))
    a = _forward(spark, d).withColumns({"top": F.row_number().over(g.orderBy(F.desc("ret"), "security_id")) <= most, "shuffled": F.row_number().over(g.orderBy(_md5())) <= most})
    long = a.select("fwd", F.explode(F.filter(F.array(F.when(F.col("top"), F.lit("top")), F.when(F.col("shuffled"), F.lit("shuffled"))), lambda x: x.isNotNull())).alias("cell"))
    return long.groupBy("cell").agg(_r(F.avg("fwd")).alias("mean_fwd"), F.count(F.lit(1)).alias("n"))


@query(_F + f" select security_id, strftime(day, '%Y-%m-%d') as day, round(ret, 6) as ret from f order by {_MD5} limit 500")
def seeded_sample(spark, d):
    """A sample of fixed size that depends on the seed and the rows' keys alone."""
    return _forward(spark, d).orderBy(_md5()).limit(500).select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), _r("ret").alias("ret"))


@query(_F + ", m as (select day, row_number() over (order by day) as i from (select distinct day from f)), ss as (select f.*, m.i from f join m using (day)) select cast(k as bigint) as shift, round(corr(a.ret, b.fwd), 6) + 0.0 as correlation, count(*) as n from ss a cross join (select unnest([0, 5, 21]) as k) join ss b on b.security_id = a.security_id and b.i = a.i + k group by k")
def placebo_shift(spark, d):
    """The signal moved by positions of the trading calendar; only the true place should predict."""
    f = _forward(spark, d)
    days = f.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")))  # a row per trading day
    s = f.join(days, "day").select("security_id", "i", "ret", "fwd")
    a = s.select("security_id", "ret", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("shift"), (F.col("i") + k).alias("at")) for k in (0, 5, 21)])).alias("k")).select("security_id", "ret", "k.*")
    b = s.select(F.col("security_id").alias("s2"), F.col("i").alias("i2"), "fwd")
    j = a.join(b, (F.col("security_id") == F.col("s2")) & (F.col("at") == F.col("i2")))
    return j.groupBy("shift").agg((_r(F.corr("ret", "fwd")) + 0.0).alias("correlation"), F.count(F.lit(1)).alias("n"))


@query(_F + ", x as (select security_id, count(*) as n from f where ret > 0.03 group by 1), y as (select n, row_number() over (order by n desc, security_id) as r, sum(n) over () as tot from x) select round(sum(case when r <= 5 then n end) / max(tot), 9) as top5_share, cast(max(tot) as bigint) as flags, count(*) as names from y")
def name_concentration(spark, d):
    x = _forward(spark, d).where(F.col("ret") > 0.03).groupBy("security_id").agg(F.count(F.lit(1)).alias("n"))
    top = x.orderBy(F.desc("n"), "security_id").limit(5).agg(F.sum("n").alias("five"))
    return x.agg(F.sum("n").alias("flags"), F.count(F.lit(1)).alias("names")).join(top, F.lit(True)).select(F.round(F.col("five") / F.col("flags"), 9).alias("top5_share"), "flags", "names")


@query(_P + ", e as (select distinct security_id, filing_date from financials where security_id is not null and timeframe = 'quarterly'), q as (select security_id, day, ret, lead(c, 5) over w / nullif(c, 0) - 1 as drift from p window w as (partition by security_id order by day)), j as (select e.security_id, e.filing_date, arg_min(struct_pack(r := q.ret, d := q.drift), q.day) as x from e join q on q.security_id = e.security_id and q.day > e.filing_date group by all), k as (select x.r as r, x.d as d, ntile(5) over (order by x.r, security_id, filing_date) as bucket from j where x.r is not null and x.d is not null) select bucket, count(*) as events, round(avg(r), 6) as reaction, round(avg(d), 6) as drift from k group by bucket")
def post_event_drift(spark, d):
    """Return over the five days after the first session past each quarterly filing, by quintile of that session's reaction."""
    from tapeglass.operators.asof import asof_forward

    e = table(spark, d, "financials").where(F.col("security_id").isNotNull() & (F.col("timeframe") == "quarterly")).select("security_id", "filing_date").distinct()
    p = panel(spark, d)
    q = p.select(F.col("security_id").alias("s2"), F.col("day").alias("d2"), "ret", (F.when(F.col("c") != 0, F.lead("c", 5).over(H.by_security()) / F.col("c")) - 1).alias("drift"))
    j = asof_forward(e, p, "security_id", "filing_date", "day", "first_day", strict=True).join(q, (F.col("security_id") == F.col("s2")) & (F.col("first_day") == F.col("d2"))).where(F.col("ret").isNotNull() & F.col("drift").isNotNull())
    k = R.global_ntile(j.select("ret", "drift", "security_id", "filing_date"), ["ret", "security_id", "filing_date"], 5, "bucket")
    return k.groupBy("bucket").agg(F.count(F.lit(1)).alias("events"), _r(F.avg("ret")).alias("reaction"), _r(F.avg("drift")).alias("drift"))


@query(_P + ", e as (select distinct security_id, filing_id, filing_date from financials where security_id is not null), x as (select p.day, p.security_id, lead(p.ret) over (partition by p.security_id order by p.day) as fwd, (select count(*) from e where e.security_id = p.security_id and p.day - e.filing_date between 1 and 30) as n from p) select strftime(day, '%Y-%m-%d') as day, round(avg(fwd), 6) as portfolio_ret, count(*) as names from x where n >= 1 and fwd is not null group by day having count(*) >= 3")
def event_cluster_portfolio(spark, d):
    """Next-day return of the names with a filing in the 30 days before, days of three names or more."""
    e = table(spark, d, "financials").where(F.col("security_id").isNotNull()).select("security_id", "filing_id", "filing_date").distinct()
    days = e.select("security_id", F.explode(F.sequence(F.date_add("filing_date", 1), F.date_add("filing_date", 30))).alias("day")).distinct()
    p = panel(spark, d).withColumn("fwd", F.lead("ret").over(H.by_security())).where(F.col("fwd").isNotNull()).join(days, ["security_id", "day"], "left_semi")
    g = p.groupBy("day").agg(F.avg("fwd").alias("r"), F.count(F.lit(1)).alias("names")).where(F.col("names") >= 3)
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("day"), _r("r").alias("portfolio_ret"), "names")


@query(_F + ", x as (select case when day < date '2024-01-01' then 'train' else 'test' end as split, s.k as signal, case when s.k = 'up' then ret > 0.02 when s.k = 'down' then ret < -0.02 else abs(ret) < 0.005 end as fired, fwd from f cross join (select unnest(['up', 'down', 'flat']) as k) s), g as (select signal, split, count(*) as n, avg(fwd) as m from x where fired group by all), b as (select signal from g where split = 'train' order by round(m, 9) desc, signal limit 1) select g.signal, g.split, g.n, round(g.m, 6) as mean_fwd, g.signal = b.signal as chosen from g, b")
def config_search_train_oos(spark, d):
    """Signals ranked on the training years, the best one marked, all reported on both."""
    fired = F.filter(F.array(F.when(F.col("ret") > 0.02, F.lit("up")), F.when(F.col("ret") < -0.02, F.lit("down")), F.when(F.abs("ret") < 0.005, F.lit("flat"))), lambda x: x.isNotNull())
    x = _forward(spark, d).select(F.when(F.col("day") < F.lit("2024-01-01").cast("date"), "train").otherwise("test").alias("split"), F.explode(fired).alias("signal"), "fwd")
    g = x.groupBy("signal", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("m"))
    best = g.where(F.col("split") == "train").orderBy(F.round("m", 9).desc(), "signal").limit(1).select(F.col("signal").alias("best"))
    return g.crossJoin(F.broadcast(best)).select("signal", "split", "n", _r("m").alias("mean_fwd"), (F.col("signal") == F.col("best")).alias("chosen"))  # one row


_IDX = _P + ", m as (select day, avg(ret) as r from p where ret is not null group by day), v as (select day, r, stddev_samp(r) over w as sd, count(r) over w as n from m window w as (order by day rows between 21 preceding and 1 preceding)), k as (select *, case when n = 21 and sd > 0 then least(2.0, 0.01 / sd) else 1.0 end as wt from v), t as (select *, abs(wt - lag(wt, 1, 1.0) over (order by day)) * 0.0005 as cost from k)"


@query(_IDX + " select strftime(day, '%Y-%m-%d') as day, round(wt, 6) as weight, round(wt * r - cost, 8) as net_ret from t")
def vol_target_weights(spark, d):
    """Index returns scaled to a target volatility by the 21 days before, less the cost of changing the weight."""
    m = panel(spark, d).where(F.col("ret").isNotNull()).groupBy("day").agg(F.avg("ret").alias("r"))
    w = Window.orderBy("day")  # a row per trading day
    f = w.rowsBetween(-21, -1)
    k = m.withColumns({"sd": F.stddev_samp("r").over(f), "n": F.count("r").over(f)})
    k = k.withColumn("wt", F.when((F.col("n") == 21) & (F.col("sd") > 0), F.least(F.lit(2.0), F.lit(0.01) / F.col("sd"))).otherwise(1.0))
    net = F.col("wt") * F.col("r") - F.abs(F.col("wt") - F.lag("wt", 1, 1.0).over(w)) * 0.0005
    return k.select(F.date_format("day", "yyyy-MM-dd").alias("day"), _r("wt").alias("weight"), F.round(net, 8).alias("net_ret"))


_CP = (1, 5, 10, 30, 60, 120)


@query(_T + f", k as (select unnest({list(_CP)}) as cp), z as (select t.sym, t.day, t.entry, k.cp, round(arg_max(c, idx) / any_value(price) - 1, 9) as r from t join k on t.mod <= t.f.mod + k.cp where t.k = 0 group by all), ee as (select sym, day, entry, round(arg_max(c, idx) / any_value(price) - 1, 9) as eod from t where k = 0 group by all), x as (select z.*, ee.eod, min(r) over (partition by sym, day, entry order by cp rows between 1 following and unbounded following) as later from z join ee using (sym, day, entry)) select cp as checkpoint, case when r >= 0.005 then 'ahead' when r >= 0 then 'green' else 'red' end as state, count(*) as n, round(avg((eod > 0)::int), 9) as p_green, round(avg((later >= 0)::int), 9) as p_stays, round(avg(eod - r), 6) as remaining from x group by 1, 2")
def survival_conditions(spark, d):
    """By checkpoint and state: chance of a green close, of never turning red later, and what return remains."""
    t = intraday_returns(spark, d, _CP)
    later = lambda j: F.least(*[F.col(f"r{i}") for i in range(j + 1, len(_CP))], F.lit(float("inf"))) if j + 1 < len(_CP) else F.lit(None).cast("double")
    x = t.select("eod", F.inline(F.array(*[F.struct(F.lit(k).alias("cp"), F.col(f"r{j}").alias("r"), later(j).alias("later")) for j, k in enumerate(_CP)])))
    state = F.when(F.col("r") >= 0.005, "ahead").when(F.col("r") >= 0, "green").otherwise("red")
    return x.groupBy(F.col("cp").alias("checkpoint"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("eod") > 0).cast("int")), 9).alias("p_green"), F.round(F.avg((F.col("later") >= 0).cast("int")), 9).alias("p_stays"), _r(F.avg(F.col("eod") - F.col("r"))).alias("remaining"))


# without SQL: seeded numpy, driver loops, models ---------------------------------------------------


_CELL = "case when ret > 0.01 then 'up' when ret < -0.01 then 'down' else 'flat' end"


def _bootstrap_sql(length: int) -> str:
    h = resampling.draw_sql("b", f"(i // least({length}, n))", 11)
    return _F + f""", ser as (select {_CELL} as cell, day, avg(fwd) as x from f group by 1, 2), num as (select cell, x, row_number() over (partition by cell order by day) - 1 as pos, count(*) over (partition by cell) as n from ser),
    dr as (select cell, n, b, unnest(range(0, n)) as i from (select distinct cell, n from num) cross join (select unnest(range(0, 1000)) as b)),
    pk as (select cell, b, ({h} % n + i % least({length}, n)) % n as pos from dr), mm as (select pk.cell, b, avg(x) as m from pk join num on num.cell = pk.cell and num.pos = pk.pos group by pk.cell, b)
    select mm.cell, any_value(s.days) as days, round(any_value(s.mean), 8) as mean, round(stddev_pop(m), 8) as se, round(quantile_cont(m, 0.05), 8) as lower, round(quantile_cont(m, 0.95), 8) as upper, round(avg((m <= 0)::int), 6) as p
    from mm join (select cell, count(*) as days, avg(x) as mean from num group by cell) s on s.cell = mm.cell group by mm.cell"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cell_series(spark, d) -> DataFrame:
    f = _forward(spark, d).withColumn("cell", F.when(F.col("ret") > 0.01, "up").when(F.col("ret") < -0.01, "down").otherwise("flat"))
    return f.groupBy("cell", "day").agg(F.avg("fwd").alias("x"))


@query(_bootstrap_sql(1))
def bootstrap_lb(spark, d):
    """Day bootstrap of next-day returns after up, flat and down days."""
    return _rounded(resampling.bootstrap(_cell_series(spark, d), "cell", "day", "x"))


@query(_bootstrap_sql(5))
def block_bootstrap_ci(spark, d):
    """The same with circular blocks of five days."""
    return _rounded(resampling.bootstrap(_cell_series(spark, d), "cell", "day", "x", length=5))


@query(_F + f""", ser as (select day, avg(fwd) as b, avg(case when ret > 0 then fwd end) as a from f group by day), num as (select a, b, row_number() over (order by day) - 1 as pos, count(*) over () as n from ser where a is not null and b is not null),
    dr as (select n, b as draw, unnest(range(0, n)) as i from (select distinct n from num) cross join (select unnest(range(0, 1000)) as b)), pk as (select draw, ({resampling.draw_sql("draw", "(i // 5)", 11)} % n + i % 5) % n as pos from dr),
    mm as (select draw, avg(a) / stddev_samp(a) * sqrt(252.0) - avg(b) / stddev_samp(b) * sqrt(252.0) as x from pk join num using (pos) group by draw)
    select 'up_less_all' as cell, any_value(s.days) as days, round(any_value(s.d), 8) as difference, round(quantile_cont(x, 0.05), 8) as lower, round(quantile_cont(x, 0.95), 8) as upper from mm, (select count(*) as days, avg(a) / stddev_samp(a) * sqrt(252.0) - avg(b) / stddev_samp(b) * sqrt(252.0) as d from num) s""")
def paired_sharpe_difference(spark, d):
    """Difference of annual Sharpe ratios of the days' risers and of all names, the same blocks drawn for both."""
    f = _forward(spark, d).groupBy("day").agg(F.avg("fwd").alias("a"), F.avg(F.when(F.col("ret") > 0, F.col("fwd"))).alias("b")).withColumn("cell", F.lit("up_less_all"))
    return _rounded(resampling.paired_sharpe(f, "cell", "day", "b", "a"))


@query()
def prim_peel_step(spark, d):
    f = cut(_forward(spark, d).withColumns({"size": F.log1p("q"), "spread": F.when(F.col("c") > 0, (F.col("h") - F.col("l")) / F.col("c"))}).select("ret", "size", "spread", "fwd"))
    return spark.createDataFrame([tuple(r.values()) for r in subgroup.peel(f, ["ret", "size", "spread"], "fwd")], "step int, feature string, side string, bound double, n bigint, mean double")


_DECAY = 0.5 ** (1 / 10)


@query(_P + f", n as (select security_id, day, lret * lret as x, row_number() over (partition by security_id order by day) as k, first_value(lret * lret) over (partition by security_id order by day) as x1 from p where lret is not null), c as (select *, sum(x * {1 - _DECAY!r} * power({_DECAY!r}, -k)) over (partition by security_id order by day) as s from n) select security_id, strftime(day, '%Y-%m-%d') as day, round(sqrt(power({_DECAY!r}, k) * (x1 + s) * 252), 6) as vol from c")
def ewma_vol(spark, d):
    """Exponentially weighted volatility (half-life 10 days) of each security, one recursion over its whole series, on every day with a return.

    Over squared log returns, begun with the first; the reference begins its one series with the variance of the first twenty, which looks ahead.
    """
    v = H.ewma(panel(spark, d).withColumn("sq", F.col("lret") * F.col("lret")), "sq", 10)
    return v.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.sqrt(F.col("ewma") * 252), 6).alias("vol"))


def _features(spark, d) -> DataFrame:
    p = panel(spark, d).withColumns({"vol": F.stddev_samp("lret").over(H.prior(10)), "gap0": F.coalesce("gap", F.lit(0.0)), "spread": F.when(F.col("c") > 0, (F.col("h") - F.col("l")) / F.col("c")), "fwd": F.lead("ret").over(H.by_security())})
    return p.where(F.col("ret").isNotNull() & F.col("vol").isNotNull() & F.col("spread").isNotNull()).select("security_id", "day", "ret", "vol", "gap0", "spread", "fwd")


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["ret", "vol", "gap0", "spread"], outputCol="raw").transform(df)


@query()
def kmeans_states(spark, d):
    """Six states from standardised features, centroids fitted before 2024 and frozen, and how often each occurs before and after."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    f = _vector(_features(spark, d)).withColumn("split", F.when(F.col("day") < F.lit("2024-01-01").cast("date"), "train").otherwise("test"))
    train = f.where(F.col("split") == "train")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = KMeans(k=6, seed=3, maxIter=20).fit(scale.transform(train))
    return model.transform(scale.transform(f)).groupBy("split", F.col("prediction").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean_fwd"))


def walk_forward(f: DataFrame, embargo: int = 2) -> list[tuple[int, DataFrame, DataFrame]]:
    """Expanding folds: year, train and test, for each year of ``f`` but the first; training ends ``embargo`` days before the last day of the years before."""
    last = sorted(f.groupBy(F.year("day").alias("y")).agg(F.max("day").alias("z")).collect())  # a row per year
    ends = [(y, z - dt.timedelta(days=embargo)) for (y, _), (_, z) in zip(last[1:], last)]
    return [(y, f.where(F.col("day") <= F.lit(z)), f.where(F.year("day") == y)) for y, z in ends]


@query()
def gbt_walk_forward(spark, d):
    """Boosted trees fitted for each year on the years before less two days, rank correlation with the year's returns by day, beside a logistic baseline."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import vector_to_array

    f = cut(_features(spark, d).where(F.col("fwd").isNotNull()).withColumn("label", (F.col("fwd") > 0).cast("double")))
    f = _vector(f).withColumnRenamed("raw", "features")
    out = spark.createDataFrame([], "model string, test_year int, days bigint, mean_ic double")
    for year, train, test in walk_forward(f):
        if train.select("label").distinct().count() < 2:
            continue
        for name, model in (("gbt", GBTClassifier(maxIter=10, maxDepth=3, seed=5)), ("logistic", LogisticRegression(maxIter=20))):
            s = model.fit(train).transform(test).withColumn("score", vector_to_array("probability")[1])
            rn = lambda c: F.row_number().over(Window.partitionBy("day").orderBy(c, "security_id")).cast("double")
            ic = s.select("day", rn("score").alias("a"), rn("fwd").alias("b")).groupBy("day").agg(F.corr("a", "b").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 10)
            out = out.unionByName(ic.agg(F.lit(name).alias("model"), F.lit(year).alias("test_year"), F.count(F.lit(1)).alias("days"), F.avg("ic").alias("mean_ic")))
    return out


def stopping(trades: DataFrame, checkpoints: tuple[int, ...]) -> list[tuple]:
    """Cross-fitted optimal stopping: fold, checkpoint, state, drawdown, n, stay, leave, exit, held_n, held_value.

    ``trades``: fold (0 or 1), the returns r0, r1, ... at the checkpoints, and v at the end.  ``state`` is the return
    in nine bins and ``drawdown`` the fall from the best of entry and checkpoints in three, both of 0.5 %.  The rule
    for the days of ``fold`` is learned on the other one (n, stay, leave, exit); ``held_value`` is what following
    it from there on gave on the fold's own days.  A state the other fold never had is held.
    """
    x, v = trades.withColumn("f", F.explode(F.array(F.lit(0), F.lit(1)))), F.col("v")
    held, out = F.col("fold") == F.col("f"), []
    for k in reversed(range(len(checkpoints))):
        r = F.col(f"r{k}")
        s = F.least(F.greatest(F.floor(r / 0.005), F.lit(-4)), F.lit(4)).cast("int")
        b = F.least(F.floor((F.greatest(F.lit(0.0), *[F.col(f"r{i}") for i in range(k + 1)]) - r) / 0.005), F.lit(2)).cast("int")
        means = [F.count_if(~held), F.avg(F.when(~held, v)), F.avg(F.when(~held, r)), F.count_if(held), F.avg(F.when(held, v)), F.avg(F.when(held, r))]
        g = x.groupBy("f", s.alias("s"), b.alias("b")).agg(*[m.alias(f"m{i}") for i, m in enumerate(means)]).collect()  # at most 54 rows
        leaves = {(q.f, q.s, q.b) for q in g if q.m0 and q.m2 >= q.m1}
        for q in g:
            go = (q.f, q.s, q.b) in leaves
            out.append((q.f, checkpoints[k], q.s, q.b, q.m0, q.m1, q.m2, go, q.m3, q.m5 if go else q.m4))
        v = F.when((F.col("f") * 27 + (s + 4) * 3 + b).isin([f * 27 + (i + 4) * 3 + j for f, i, j in sorted(leaves)]), r).otherwise(v)
    return out


@query()
def exit_policy_dp(spark, d):
    """Optimal stopping on checkpoints by backward induction: stay or leave by return and drawdown, learned on every other day and valued on the rest."""
    t = cut(intraday_returns(spark, d, _CP).select("day", F.col("eod").alias("v"), *[f"r{i}" for i in range(len(_CP))]))
    folds = t.select("day").distinct().withColumn("fold", F.row_number().over(Window.orderBy("day")) % 2)  # a row per trading day
    return spark.createDataFrame(stopping(cut(t.join(folds, "day")), _CP), "fold int, checkpoint int, state int, drawdown int, n bigint, stay double, leave double, exit boolean, held_n bigint, held_value double")
