"""Queries over the daily panel of day_session: trailing figures, ranks, the cross-section, cohorts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.operators import history as H
from tapeglass.operators import ranking as R
from tapeglass.plans.problems import standing_sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_P = """
with s as (select security_id, day, arg_max(struct_pack(sym := display_symbol, o := rth_open, h := rth_high, l := rth_low, c := rth_close, v := volume, q := dollar_volume),
        row(ingested_at, display_symbol, rth_open, rth_high, rth_low, rth_close, volume, dollar_volume)) as r
      from day_session where security_id is not null group by all),
p0 as (select security_id, day, r.sym as sym, r.o as o, r.h as h, r.l as l, r.c as c, coalesce(r.v, 0) as v, coalesce(r.q, 0) as q,
        row_number() over w - 1 as idx, lag(r.c) over w as pc from s window w as (partition by security_id order by day)),
p as (select *, case when pc > 0 then c / pc end - 1 as ret, case when pc > 0 and c > 0 then ln(c / pc) end as lret,
        case when pc is not null then greatest(h - l, abs(h - pc), abs(l - pc)) end as tr, case when pc > 0 then o / pc end - 1 as gap,
        case when pc > 0 and o > 0 and h > 0 and l > 0 and c > 0 then ln(o / pc) end as non,
        case when o > 0 and h > 0 and l > 0 and c > 0 then ln(c / o) end as oc,
        case when o > 0 and h > 0 and l > 0 and c > 0 then ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) end as rs from p0)
"""
_W = "over (partition by security_id order by day rows between {} preceding and 1 preceding)"
_ALL = "over (partition by security_id order by day rows between unbounded preceding and 1 preceding)"


def panel(spark: SparkSession, d: str) -> DataFrame:
    s = standing_sessions(spark, d)
    p = s.select("security_id", "day", F.col("display_symbol").alias("sym"), F.col("rth_open").alias("o"), F.col("rth_high").alias("h"), F.col("rth_low").alias("l"), F.col("rth_close").alias("c"), F.coalesce("volume", F.lit(0.0)).alias("v"), F.coalesce("dollar_volume", F.lit(0.0)).alias("q"))
    return H.with_returns(p)


def _day() -> list:
    return [F.col("security_id"), F.date_format("day", "yyyy-MM-dd").alias("day")]


_D = "security_id, strftime(day, '%Y-%m-%d') as day"


def _r(c, n: int = 6):
    return F.round(c, n)


@query(_P + f"select {_D}, idx as days_since_first, pc as prior_close, round(gap, 6) as overnight_gap, (l <= pc and pc <= h) as gap_filled from p")
def prior_day(spark, d):
    """Prior traded close, overnight gap, whether today's range covers it, traded days so far."""
    return panel(spark, d).select(*_day(), F.col("idx").alias("days_since_first"), F.col("pc").alias("prior_close"), _r("gap").alias("overnight_gap"), ((F.col("l") <= F.col("pc")) & (F.col("pc") <= F.col("h"))).alias("gap_filled"))


@query(_P + f"select {_D}, " + ", ".join(f"round(case when count(tr) {_W.format(n)} = {n} then avg(tr) {_W.format(n)} end, 6) as atr_{n}" for n in (5, 14, 42)) + " from p")
def trailing_atr(spark, d):
    return panel(spark, d).select(*_day(), *[_r(H.atr(n)).alias(f"atr_{n}") for n in (5, 14, 42)])


@query(_P + f"select {_D}, round(case when count(lret) {_W.format(21)} = 21 then stddev_samp(lret) {_W.format(21)} end * sqrt(252.0), 6) as realized_vol_21 from p")
def trailing_realized_vol(spark, d):
    return panel(spark, d).select(*_day(), _r(H.realized_vol(21)).alias("realized_vol_21"))


@query(_P + f"select {_D}, " + ", ".join(f"round(case when count({v}) {_W.format(n)} = {n} then avg({v}) {_W.format(n)} end, 5) as {a}_{n}" for v, a in (("v", "adv"), ("q", "addv")) for n in (5, 20, 60)) + " from p")
def trailing_adv(spark, d):
    return panel(spark, d).select(*_day(), *[_r(H.average(v, n), 5).alias(f"{a}_{n}") for v, a in (("v", "adv"), ("q", "addv")) for n in (5, 20, 60)])


def _yz(n: int) -> str:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    w = _W.format(n)
    var = f"(var_samp(non) {w} + {k!r} * var_samp(oc) {w} + {1 - k!r} * avg(rs) {w})"
    return f"round(case when count(non) {w} = {n} and count(oc) {w} = {n} and count(rs) {w} = {n} and {var} >= 0 then sqrt({var} * 252) end, 6) as yz_{n}"


@query(_P + f"select {_D}, " + ", ".join(_yz(n) for n in (5, 14, 21, 42)) + " from p")
def trailing_yang_zhang(spark, d):
    return panel(spark, d).select(*_day(), *[_r(H.yang_zhang(n)).alias(f"yz_{n}") for n in (5, 14, 21, 42)])


@query(_P + f"select {_D}, max(h) {_W.format(252)} as high_252, min(l) {_W.format(252)} as low_252 from p")
def range_252(spark, d):
    """High and low of up to 252 traded days before; a shorter history is served."""
    return panel(spark, d).select(*_day(), F.max("h").over(H.prior(252)).alias("high_252"), F.min("l").over(H.prior(252)).alias("low_252"))


@query(_P + f", m as (select *, case when count(v) {_W.format(20)} = 20 then quantile_cont(v, 0.5) {_W.format(20)} end as med from p) select {_D}, round(med, 6) as median_volume_20, round(case when med > 0 then v / med end, 6) as volume_ratio, (case when med > 0 then v / med end) > 5 as volume_spike from m")
def trailing_median_ratio(spark, d):
    p = panel(spark, d).withColumn("med", H.median_of_prior("v", 20))
    ratio = F.when(F.col("med") > 0, F.col("v") / F.col("med"))
    return p.select(*_day(), _r("med").alias("median_volume_20"), _r(ratio).alias("volume_ratio"), (ratio > 5).alias("volume_spike"))


@query(_P + f"select {_D}, " + ", ".join(f"idx - last_value(case when abs(ret) >= {x} then idx end ignore nulls) {_ALL} as since_{n}pct" for x, n in ((0.05, 5), (0.1, 10), (0.2, 20))) + " from p")
def days_since_move(spark, d):
    return panel(spark, d).select(*_day(), *[H.days_since_move(x).alias(f"since_{n}pct") for x, n in ((0.05, 5), (0.1, 10), (0.2, 20))])


@query(_P + f"select {_D}, idx - 1 - last_value(case when not coalesce(ret > 0, false) then idx end ignore nulls) {_ALL} as up_streak from p")
def consecutive_up(spark, d):
    return panel(spark, d).select(*_day(), H.up_streak().alias("up_streak"))


@query(_P + f"select {_D}, " + ", ".join(f"case when not (ret > 0.02) then false when ret > 0.02 then not case when count(*) {_W.format(n)} = {n} then bool_or(coalesce(ret > 0.02, false)) {_W.format(n)} end end as first_in_{n}" for n in (5, 10, 20)) + " from p")
def signal_first_in_n(spark, d):
    return panel(spark, d).select(*_day(), *[H.first_in(F.col("ret") > 0.02, n).alias(f"first_in_{n}") for n in (5, 10, 20)])


_MKT = ", m as (select day, avg(lret) as mret from p group by day), j as (select p.*, m.mret from p join m on m.day = p.day)"


@query(_P + _MKT + f"select {_D}, round(case when count(case when lret is not null and mret is not null then mret end) {_W.format(60)} >= 45 and var_samp(case when lret is not null then mret end) {_W.format(60)} > 0 then covar_samp(case when lret is not null then mret end, lret) {_W.format(60)} / var_samp(case when lret is not null then mret end) {_W.format(60)} end, 5) as beta_60 from j")
def beta_aligned(spark, d):
    """60-day beta to the equal-weight market, from at least 45 shared days."""
    p = panel(spark, d)
    m = p.groupBy("day").agg(F.avg("lret").alias("mret"))
    return p.join(m, "day").select(*_day(), _r(H.beta("mret", "lret", 60, 45), 5).alias("beta_60"))


@query(_P + _MKT.split(", j as")[0] + ", y as (select day, row_number() over (order by day) as n, round(sum(mret) over (order by day), 6) as index_cumlog from m) select strftime(y.day, '%Y-%m-%d') as day, y.index_cumlog, round(y.index_cumlog - b.index_cumlog, 6) as index_ret_63 from y left join y b on b.n = y.n - 63")
def index_cumlog(spark, d):
    """Cumulative log return of the equal-weight market, one row per day, and its change over 63 days."""
    w = Window.orderBy("day")  # one row per trading day
    m = panel(spark, d).groupBy("day").agg(F.avg("lret").alias("mret")).withColumn("x", F.round(F.sum("mret").over(w), 6))
    return m.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("x").alias("index_cumlog"), F.round(F.col("x") - F.lag("x", 63).over(w), 6).alias("index_ret_63"))


# ranks and the cross-section -----------------------------------------------------------------------


@query(_P + f", k as (select *, case when ret is not null then row_number() over (partition by day order by ret desc nulls last, security_id) end as rk, count(ret) over (partition by day) as m from p) select {_D}, rk as ret_rank, round((m - rk) / m, 9) as ret_pct from k")
def rank_desc_bijective(spark, d):
    r = R.rank_desc(panel(spark, d), ["day"], "ret", ["security_id"], "ret")
    return r.select(*_day(), "ret_rank", F.round("ret_pct", 9).alias("ret_pct"))


@query(_P + f"select {_D}, round((rank() over (partition by day order by v) + (count(*) over (partition by day, v) - 1) / 2) / count(*) over (partition by day), 9) as volume_rank, round(row_number() over (partition by day order by v, security_id) / count(*) over (partition by day), 9) as volume_ordinal from p")
def rank_average(spark, d):
    return panel(spark, d).select(*_day(), F.round(R.rank_average(["day"], "v"), 9).alias("volume_rank"), F.round(R.rank_ordinal(["day"], "v", ["security_id"]), 9).alias("volume_ordinal"))


@query(_P + ", q as (select day, " + ", ".join(f"quantile_cont(ret, {i / 5}) as q{i}" for i in range(1, 5)) + f" from p where ret is not null group by day) select p.security_id, strftime(p.day, '%Y-%m-%d') as day, cast(1 + (ret >= q1)::int + (ret >= q2)::int + (ret >= q3)::int + (ret >= q4)::int as bigint) as quintile from p join q on q.day = p.day where ret is not null")
def quantile_buckets(spark, d):
    return R.quantile_bucket(panel(spark, d).where(F.col("ret").isNotNull()), ["day"], "ret", 5, "quintile").select(*_day(), "quintile")


@query(_P + f", k as (select *, row_number() over (partition by day order by ret desc, security_id) as rk, count(*) over (partition by day) as m from p where ret is not null) select {_D}, round(ret, 6) as ret from k where rk <= greatest(1, round(m * 0.05))")
def topq_per_group(spark, d):
    return R.top_share(panel(spark, d), ["day"], "ret", 0.05, ["security_id"]).select(*_day(), _r("ret").alias("ret"))


@query(_P + ", f as (select *, lead(ret) over (partition by security_id order by day) as fwd from p), q as (select day, quantile_cont(ret, 0.9) as hi, quantile_cont(ret, 0.1) as lo from f where ret is not null and fwd is not null group by day having count(*) >= 10) select strftime(f.day, '%Y-%m-%d') as day, round(avg(case when ret >= hi then fwd end) - avg(case when ret <= lo then fwd end), 6) as spread, count(*) as names from f join q on q.day = f.day where ret is not null and fwd is not null group by f.day")
def decile_spread(spark, d):
    """Next-day return of the top decile less the bottom decile by today's return, days of ten names or more."""
    p = panel(spark, d).withColumn("fwd", F.lead("ret").over(H.by_security())).where(F.col("ret").isNotNull() & F.col("fwd").isNotNull())
    q = p.groupBy("day").agg(F.percentile("ret", F.lit(0.9)).alias("hi"), F.percentile("ret", F.lit(0.1)).alias("lo"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 10)
    s = p.join(q, "day").groupBy("day").agg((F.avg(F.when(F.col("ret") >= F.col("hi"), F.col("fwd"))) - F.avg(F.when(F.col("ret") <= F.col("lo"), F.col("fwd")))).alias("s"), F.count(F.lit(1)).alias("names"))
    return s.select(F.date_format("day", "yyyy-MM-dd").alias("day"), _r("s").alias("spread"), "names")


@query(_P + ", k as (select *, row_number() over (partition by day order by ret, security_id) as a, row_number() over (partition by day order by fwd, security_id) as b from (select *, lead(ret) over (partition by security_id order by day) as fwd from p) where ret is not null and fwd is not null) select strftime(day, '%Y-%m-%d') as day, round(corr(a, b), 6) + 0.0 as ic, count(*) as names from k group by day having count(*) >= 10")
def rank_ic(spark, d):
    """Rank correlation of a day's returns with the next day's."""
    p = panel(spark, d).withColumn("fwd", F.lead("ret").over(H.by_security())).where(F.col("ret").isNotNull() & F.col("fwd").isNotNull())
    rn = lambda c: F.row_number().over(Window.partitionBy("day").orderBy(c, "security_id")).cast("double")
    k = p.select("day", rn("ret").alias("a"), rn("fwd").alias("b")).groupBy("day").agg(F.corr("a", "b").alias("ic"), F.count(F.lit(1)).alias("names"))
    return k.where(F.col("names") >= 10).select(F.date_format("day", "yyyy-MM-dd").alias("day"), (_r("ic") + 0.0).alias("ic"), "names")


@query(_P + "select strftime(day, '%Y-%m-%d') as day, count(*) as names, round(avg((ret > 0)::int), 9) as green_share, coalesce(cast(count_if(ret > 0) as bigint), 0) as up, coalesce(cast(count_if(ret < 0) as bigint), 0) as down, round(case when count_if(ret < 0) > 0 then count_if(ret > 0) / count_if(ret < 0) end, 6) as advance_decline, coalesce(cast(count_if(abs(ret) >= 0.05) as bigint), 0) as movers_5pct, round(stddev_pop(ret), 6) as dispersion, round(quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25), 6) as iqr, round(quantile_cont(q, 0.5), 3) as median_dollars, round(sum(q), 2) as total_dollars from p group by day")
def breadth_share(spark, d):
    """Breadth, advances against declines, dispersion and liquidity of each day."""
    up, down = F.count_if(F.col("ret") > 0), F.count_if(F.col("ret") < 0)
    g = panel(spark, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("names"), F.round(F.avg((F.col("ret") > 0).cast("int")), 9).alias("green_share"), up.alias("up"), down.alias("down"), _r(F.when(down > 0, up / down)).alias("advance_decline"),
        F.count_if(F.abs("ret") >= 0.05).alias("movers_5pct"), _r(F.stddev_pop("ret")).alias("dispersion"), _r(F.percentile("ret", F.lit(0.75)) - F.percentile("ret", F.lit(0.25))).alias("iqr"),
        F.round(F.median("q"), 3).alias("median_dollars"), F.round(F.sum("q"), 2).alias("total_dollars"),
    )
    return g


@query(_P + ", f as (select *, greatest(ret, 0) as pos, sum(greatest(ret, 0)) over (partition by day) as tot from p where ret is not null), h as (select day, round(sum((pos / tot) * (pos / tot)), 9) as hhi, round(avg((ret > 0)::int), 9) as share from f where tot > 0 group by day) select strftime(a.day, '%Y-%m-%d') as day, a.hhi, a.share, round(avg((b.share < a.share)::int), 9) as share_percentile from h a left join h b on b.day < a.day group by a.day, a.hhi, a.share")
def concentration_percentile(spark, d):
    """Herfindahl index of positive returns, share of names up, and the part of all days before with a lower share."""
    w = Window.partitionBy("day")
    f = panel(spark, d).where(F.col("ret").isNotNull()).withColumn("pos", F.greatest("ret", F.lit(0.0))).withColumn("tot", F.sum("pos").over(w)).where(F.col("tot") > 0)
    h = f.groupBy("day").agg(F.round(F.sum((F.col("pos") / F.col("tot")) * (F.col("pos") / F.col("tot"))), 9).alias("hhi"), F.round(F.avg((F.col("ret") > 0).cast("int")), 9).alias("share"))
    before = F.collect_list("share").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a number per trading day
    h = h.withColumn("b", before)
    return h.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "hhi", "share", F.round(F.when(F.size("b") > 0, F.size(F.filter("b", lambda x: x < F.col("share"))) / F.size("b")), 9).alias("share_percentile"))


_TYPES = "t as (select security_id, max(ticker_type) as sector from tickers where security_id is not null group by security_id)"


# cohorts and statistics ----------------------------------------------------------------------------


@query(_P + f", {_TYPES}, f as (select *, lead(ret) over (partition by security_id order by day) as fwd from p) select strftime(day, '%Y-%m-%d') as day, round(avg(fwd), 6) as portfolio_ret, count(*) as names from f join t using (security_id) where sector = 'CS' and ret > 0 and fwd is not null group by day having count(*) >= 5")
def daily_portfolio(spark, d):
    """Next-day return of an equal-weight portfolio of common stocks that rose, days of five names or more."""
    from tapeglass.sources.tables import table

    t = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.max("ticker_type").alias("sector")).where(F.col("sector") == "CS")
    p = panel(spark, d).withColumn("fwd", F.lead("ret").over(H.by_security())).join(t, "security_id").where((F.col("ret") > 0) & F.col("fwd").isNotNull())
    g = p.groupBy("day").agg(F.avg("fwd").alias("r"), F.count(F.lit(1)).alias("names")).where(F.col("names") >= 5)
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("day"), _r("r").alias("portfolio_ret"), "names")


_SIG = {"up": "ret > 0", "big_up": "ret > 0.03", "gap_up": "gap > 0.01", "near_high": "c >= 0.98 * hi", "quiet": "abs(ret) < 0.005", "volume": "v > 2 * av"}


@query(_P + f", f as (select *, max(h) {_W.format(20)} as hi, avg(v) {_W.format(20)} as av from p), g as (select *, " + ", ".join(f"lead(c, {k}) over (partition by security_id order by day) / nullif(c, 0) - 1 as f{k}" for k in (1, 5, 21)) + " from f), x as (" + " union all ".join(f"select '{n}' as signal, {k} as horizon, f{k} as r from g where {e}" for n, e in _SIG.items() for k in (1, 5, 21)) + ") select signal, cast(horizon as bigint) as horizon, count(r) as n, round(avg(r), 6) as mean_ret, round(avg((r > 0)::int), 9) as hit_rate, round(avg(r) / stddev_samp(r) * sqrt(count(r)), 5) as t_stat from x where r is not null group by signal, horizon")
def factor_scan(spark, d):
    """Named signals against forward horizons in one pass: signals and horizons are unpivoted, then grouped once."""
    w = H.by_security()
    p = panel(spark, d).withColumns({"hi": F.max("h").over(H.prior(20)), "av": F.avg("v").over(H.prior(20)), **{f"f{k}": F.when(F.col("c") != 0, F.lead("c", k).over(w) / F.col("c")) - 1 for k in (1, 5, 21)}})
    fired = F.filter(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in _SIG.items()]), lambda x: x.isNotNull())
    ahead = F.array(*[F.struct(F.lit(k).cast("bigint").alias("horizon"), F.col(f"f{k}").alias("r")) for k in (1, 5, 21)])
    x = p.select(F.explode(fired).alias("signal"), ahead.alias("a")).select("signal", F.inline("a")).where(F.col("r").isNotNull())
    return x.groupBy("signal", "horizon").agg(F.count("r").alias("n"), _r(F.avg("r")).alias("mean_ret"), F.round(F.avg((F.col("r") > 0).cast("int")), 9).alias("hit_rate"), F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.count("r")), 5).alias("t_stat"))


@query(_P + f", {_TYPES}, x as (select coalesce(sector, 'Unknown') as sector, year(day) as yr, ret, security_id, day from p left join t using (security_id) where ret is not null) select sector, yr, count(distinct day) as days, count(distinct security_id) as names, round(1.96 / sqrt(count(distinct day) / 252.0), 6) as detectable_sharpe from x group by grouping sets ((sector, yr), (sector), (yr), ())")
def mde_ladder_grouping_sets(spark, d):
    """Detectable Sharpe ratio at each granularity, by grouping sets."""
    from tapeglass.sources.tables import table

    t = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.max("ticker_type").alias("sector"))
    x = panel(spark, d).where(F.col("ret").isNotNull()).join(t, "security_id", "left").select(F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.year("day").cast("bigint").alias("yr"), "security_id", "day")
    return x.groupingSets([["sector", "yr"], ["sector"], ["yr"], []], "sector", "yr").agg(F.countDistinct("day").alias("days"), F.countDistinct("security_id").alias("names"), _r(1.96 / F.sqrt(F.countDistinct("day") / 252.0)).alias("detectable_sharpe"))


@query(_P + ", f as (select *, ntile(10) over (partition by day order by ret, security_id) as x, (lead(ret) over (partition by security_id order by day) > 0)::int as y from p where ret is not null), n as (select x, y, count(*) as c from f where y is not null group by x, y), t as (select *, sum(c) over () as tot, sum(c) over (partition by x) as cx, sum(c) over (partition by y) as cy from n) select round(sum(c / tot * log2(c * tot / (cx * cy))), 6) as mutual_information, cast(max(tot) as bigint) as n from t")
def mutual_information(spark, d):
    """Mutual information, in bits, of a day's return decile and the sign of the next return; as it is, biased upwards."""
    n = _cells(spark, d)
    t = n.withColumns({"tot": F.sum("count").over(Window.partitionBy()), "cx": F.sum("count").over(Window.partitionBy("x")), "cy": F.sum("count").over(Window.partitionBy("y"))})
    return t.agg(_r(F.sum(F.col("count") / F.col("tot") * F.log2(F.col("count") * F.col("tot") / (F.col("cx") * F.col("cy"))))).alias("mutual_information"), F.max("tot").alias("n"))


def _cells(spark, d) -> DataFrame:
    w = Window.partitionBy("day").orderBy("ret", "security_id")
    f = panel(spark, d).where(F.col("ret").isNotNull()).withColumns({"x": F.ntile(10).over(w), "y": (F.lead("ret").over(H.by_security()) > 0).cast("int")}).where(F.col("y").isNotNull())
    return f.groupBy("x", "y").count()  # twenty cells


def corrected_information(cells: np.ndarray, times: int = 200, seed: int = 20260620) -> tuple[float, float, float]:
    """Mutual information in bits of a table of counts with two columns, the 95th percentile of its permutation null, and what is left above that.

    Shuffled labels keep both margins, so a shuffled table is a multivariate hypergeometric draw; none of the rows is needed.
    """
    def bits(c: np.ndarray) -> np.ndarray:
        both = c / max(cells.sum(), 1)
        apart = both.sum(-1, keepdims=True) * both.sum(-2, keepdims=True)
        return np.where(both > 0, both * np.log2(np.where(both > 0, both, 1) / np.where(apart > 0, apart, 1)), 0.0).sum((-2, -1))

    ones = np.random.default_rng(seed).multivariate_hypergeometric(cells.sum(1), cells[:, 1].sum(), size=times, method="marginals")
    null = float(np.quantile(bits(np.stack([cells.sum(1) - ones, ones], -1)), 0.95))
    return float(bits(cells)), null, max(0.0, float(bits(cells)) - null)


@query()
def mutual_information_corrected(spark, d):
    """The mutual information less the 95th percentile of its permutation null."""
    cells = np.zeros((10, 2), dtype=np.int64)
    for r in _cells(spark, d).collect():
        cells[r.x - 1, r.y] = r["count"]
    return spark.createDataFrame([(*corrected_information(cells), int(cells.sum()))], "mutual_information double, null_95 double, corrected double, n bigint")


@query(_P + ", f as (select *, lead(ret) over (partition by security_id order by day) > 0 as y from p where ret is not null), k as (select year(day) as yr, y, row_number() over (partition by year(day) order by ret, security_id, day) as r from f where y is not null) select yr, count(*) as n, round((sum(case when y then r end) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(not y)), 6) as auc from k group by yr having count_if(y) > 0 and count_if(not y) > 0")
def auc_rank(spark, d):
    """Area under the curve of today's return as a score for a rise tomorrow, by year, from the rank sum."""
    f = panel(spark, d).where(F.col("ret").isNotNull()).withColumn("y", F.lead("ret").over(H.by_security()) > 0).where(F.col("y").isNotNull()).select(F.year("day").cast("bigint").alias("yr"), "ret", "security_id", "day", "y")
    # ranks over all years at once; a year's own begin after the rows of the years before
    k = R.global_rank(f, ["yr", "ret", "security_id", "day"], "all")
    w = Window.orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)  # a row per year
    years = F.broadcast(k.groupBy("yr").count().select(F.col("yr").alias("_y"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before")))
    k = k.join(years, F.col("yr") == F.col("_y")).withColumn("r", F.col("all") - F.col("_before"))
    pos, neg = F.count_if("y"), F.count_if(~F.col("y"))
    g = k.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), pos.alias("a"), neg.alias("b"), F.sum(F.when(F.col("y"), F.col("r"))).alias("s")).where((F.col("a") > 0) & (F.col("b") > 0))
    return g.select("yr", "n", _r((F.col("s") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))).alias("auc"))


@query(_P + ", f as (select security_id, day, case when ret > 0.01 then 'up' when ret < -0.01 then 'down' else 'flat' end as state, lead(case when ret > 0.01 then 'up' when ret < -0.01 then 'down' else 'flat' end) over (partition by security_id order by day) as nxt from p where ret is not null) select state, nxt as next_state, count(*) as n, round(count(*) / sum(count(*)) over (partition by state), 9) as share from f where nxt is not null group by state, nxt")
def transition_matrix(spark, d):
    state = F.when(F.col("ret") > 0.01, "up").when(F.col("ret") < -0.01, "down").otherwise("flat")
    f = panel(spark, d).where(F.col("ret").isNotNull()).withColumn("state", state).withColumn("next_state", F.lead("state").over(H.by_security())).where(F.col("next_state").isNotNull())
    n = f.groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return n.select("state", "next_state", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("state")), 9).alias("share"))


@query(_P + ", f as (select *, " + ", ".join(f"max(h) over (partition by security_id order by day rows between 1 following and {k} following) as mh{k}, min(l) over (partition by security_id order by day rows between 1 following and {k} following) as ml{k}, lead(c, {k}) over (partition by security_id order by day) as e{k}" for k in (10, 21, 63)) + f" from p where c > 0) select {_D}, " + ", ".join(f"round(e{k} / c - 1, 6) as ret_{k}d, round(case when e{k} is not null then mh{k} / c - 1 end, 6) as runup_{k}d, round(case when e{k} is not null then ml{k} / c - 1 end, 6) as drawdown_{k}d" for k in (10, 21, 63)) + " from f")
def long_horizon_daily(spark, d):
    """Return, run-up and drawdown over the next 10, 21 and 63 traded days, null if the security has fewer."""
    p = panel(spark, d).where(F.col("c") > 0)
    out = []
    for k in (10, 21, 63):
        w, end = H.by_security().rowsBetween(1, k), F.lead("c", k).over(H.by_security())
        out += [_r(end / F.col("c") - 1).alias(f"ret_{k}d"), _r(F.when(end.isNotNull(), F.max("h").over(w) / F.col("c") - 1)).alias(f"runup_{k}d"), _r(F.when(end.isNotNull(), F.min("l").over(w) / F.col("c") - 1)).alias(f"drawdown_{k}d")]
    return p.select(*_day(), *out)


@query(_P + f", t as (select *, case when count(tr) {_W.format(14)} = 14 then avg(tr) {_W.format(14)} end as atr from p), j as (select a.security_id, a.day, min(case when b.h >= a.c + 3 * a.atr then b.idx - a.idx end) as up, min(case when b.l <= a.c - 1.5 * a.atr then b.idx - a.idx end) as dn, count(b.idx) as n from t a left join t b on b.security_id = a.security_id and b.idx between a.idx + 1 and a.idx + 21 where a.atr > 0 group by a.security_id, a.day) select {_D}, up as first_target, dn as first_stop, case when n < 21 then 'no_data' when dn is not null and (up is null or dn <= up) then 'stop_first' when up is not null then 'target_first' else 'neither' end as first_event from j")
def target_before_stop_21d(spark, d):
    """Whether 3 ATR up or 1.5 ATR down came first in the next 21 traded days; both on one day count as the stop."""
    p = panel(spark, d).withColumn("atr", H.atr(14))
    ahead = F.collect_list(F.struct("h", "l")).over(H.by_security().rowsBetween(1, 21))  # 21 at most
    p = p.withColumn("ahead", ahead).where(F.col("atr") > 0)
    at = lambda hit: F.array_position(F.transform("ahead", hit), True)
    some = lambda x: F.when(x > 0, x)
    p = p.withColumns({"up": some(at(lambda b: b.h >= F.col("c") + 3 * F.col("atr"))), "dn": some(at(lambda b: b.l <= F.col("c") - 1.5 * F.col("atr")))})
    event = F.when(F.size("ahead") < 21, "no_data").when(F.col("dn").isNotNull() & (F.col("up").isNull() | (F.col("dn") <= F.col("up"))), "stop_first").when(F.col("up").isNotNull(), "target_first").otherwise("neither")
    return p.select(*_day(), F.col("up").alias("first_target"), F.col("dn").alias("first_stop"), event.alias("first_event"))


@query(_P + f", m as (select day, avg(ret) as mret from p group by day) select p.security_id, strftime(p.day, '%Y-%m-%d') as day, round(p.ret - m.mret, 6) as excess from p join m on m.day = p.day")
def excess_over_index(spark, d):
    """Return over the equal-weight market's of the same day."""
    p = panel(spark, d)
    m = p.groupBy("day").agg(F.avg("ret").alias("mret"))
    return p.join(m, "day").select(*_day(), _r(F.col("ret") - F.col("mret")).alias("excess"))


_CAL = ", cal as (select day, row_number() over (order by day) as i from (select distinct day from p)), z as (select p.*, cal.i from p join cal on cal.day = p.day)"


@query(_P + _CAL + f", n as (select a.security_id, a.day, a.c as c0, b.o as o1, b.h as h1, b.l as l1, b.c as c1 from z a left join z b on b.security_id = a.security_id and b.i = a.i + 1) select {_D}, round(o1 / nullif(c0, 0) - 1, 6) as next_gap, round(c1 / nullif(o1, 0) - 1, 6) as next_rth, round(c1 / nullif(c0, 0) - 1, 6) as next_close_to_close, round(case when h1 > l1 then (c1 - l1) / (h1 - l1) end, 6) as close_location from n")
def next_period_decomposition(spark, d):
    """The next market day as gap and session; a security that misses that day has nulls, whatever came later."""
    p = panel(spark, d)
    cal = p.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")))  # a row per trading day
    z = p.join(cal, "day")
    w = Window.partitionBy("security_id").orderBy("i")
    nxt = F.when(F.lead("i").over(w) == F.col("i") + 1, F.lead(F.struct("o", "h", "l", "c")).over(w))
    z = z.withColumn("n", nxt)
    q = lambda a, b: _r(F.when(b != 0, a / b) - 1)
    loc = F.when(F.col("n.h") > F.col("n.l"), (F.col("n.c") - F.col("n.l")) / (F.col("n.h") - F.col("n.l")))
    return z.select(*_day(), q(F.col("n.o"), F.col("c")).alias("next_gap"), q(F.col("n.c"), F.col("n.o")).alias("next_rth"), q(F.col("n.c"), F.col("c")).alias("next_close_to_close"), _r(loc).alias("close_location"))


@query(_P + ", t as (select security_id, max(cast(delisted_utc as date)) as dl from tickers where security_id is not null and delisted_utc is not null group by 1), l as (select security_id, max(day) as last_day, arg_max(c, day) as last_close, count(*) as sessions from p group by 1), cal as (select distinct day from p) select l.security_id, strftime(t.dl, '%Y-%m-%d') as delisted, strftime(l.last_day, '%Y-%m-%d') as last_day, l.last_close, case when t.dl is null then 'none' when l.last_day > t.dl then 'traded_after' else 'delisting' end as terminal_event, (select count(*) from cal where cal.day > l.last_day) as missing_days from l left join t using (security_id)")
def terminal_events(spark, d):
    """Delistings that the tape confirms: no session after them; and the market days missed since the last session."""
    from tapeglass.sources.tables import table

    t = table(spark, d, "tickers").where(F.col("security_id").isNotNull() & F.col("delisted_utc").isNotNull()).groupBy("security_id").agg(F.max(F.to_date("delisted_utc")).alias("dl"))
    p = panel(spark, d)
    cal = p.select("day").distinct().withColumn("missing_days", F.count(F.lit(1)).over(Window.orderBy(F.desc("day"))) - 1)  # a row per trading day
    s = p.groupBy("security_id").agg(F.max("day").alias("day"), F.max_by("c", "day").alias("last_close")).join(cal, "day").join(t, "security_id", "left")
    event = F.when(F.col("dl").isNull(), "none").when(F.col("day") > F.col("dl"), "traded_after").otherwise("delisting")
    return s.select("security_id", F.date_format("dl", "yyyy-MM-dd").alias("delisted"), F.date_format("day", "yyyy-MM-dd").alias("last_day"), "last_close", event.alias("terminal_event"), "missing_days")


@query(_P + ", f as (select *, lead(ret) over (partition by security_id order by day) as fwd from p), g as (select case when day <= date '2023-06-30' then 'first' when day <= date '2024-03-31' then 'second' else 'third' end as era, corr(ret, fwd) as r, count(*) as n from f where ret is not null and fwd is not null group by 1) select era, round(r, 6) + 0.0 as correlation, n, sign(r) = sign(first_value(r) over (order by era)) as same_sign from g")
def era_signs(spark, d):
    """Whether a relation keeps its sign across eras."""
    era = F.when(F.col("day") <= F.lit("2023-06-30").cast("date"), "first").when(F.col("day") <= F.lit("2024-03-31").cast("date"), "second").otherwise("third")
    f = panel(spark, d).withColumn("fwd", F.lead("ret").over(H.by_security())).where(F.col("ret").isNotNull() & F.col("fwd").isNotNull())
    g = f.groupBy(era.alias("era")).agg(F.corr("ret", "fwd").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("era", (_r("r") + 0.0).alias("correlation"), "n", (F.signum("r") == F.signum(F.first("r").over(Window.orderBy("era")))).alias("same_sign"))  # three rows


@query(_P + ", m as (select day, stddev_pop(ret) as x from p group by day having count(ret) >= 2), q as (select *, quantile_cont(x, 0.8) over w as q80, count(x) over w as n from m window w as (order by day rows between 1260 preceding and 1 preceding)) select strftime(day, '%Y-%m-%d') as day, round(case when n >= 252 then q80 end, 8) as threshold, cast(case when n >= 252 and x > q80 then 0.5 else 1.0 end as double) as weight from q")
def expanding_threshold(spark, d):
    """80th percentile of up to 1,260 days before, from 252 on; full weight until then."""
    m = panel(spark, d).groupBy("day").agg(F.stddev_pop("ret").alias("x"), F.count("ret").alias("k")).where(F.col("k") >= 2)
    w = Window.orderBy("day").rowsBetween(-1260, -1)  # a row per trading day
    m = m.withColumns({"q": F.percentile("x", F.lit(0.8)).over(w), "n": F.count("x").over(w)})
    return m.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.when(F.col("n") >= 252, F.col("q")), 8).alias("threshold"), F.when((F.col("n") >= 252) & (F.col("x") > F.col("q")), 0.5).otherwise(1.0).alias("weight"))
