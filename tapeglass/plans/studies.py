"""Studies over entries, signals and events: costs, surfaces, blacklists, placebos, power, gates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.operators import history as H
from tapeglass.operators import ranking as R
from tapeglass.operators.resampling import normal_tail
from tapeglass.plans import forward
from tapeglass.plans.forward import _RET, _T
from tapeglass.plans.panel import _P, _W, panel
from tapeglass.plans.research import _F, _forward
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


def _iso(c: str = "day"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# fixed values: the catalogue of signals
SIGNALS = {
    "up": "ret > 0", "up_2pct": "ret > 0.02", "up_5pct": "ret > 0.05", "down_2pct": "ret < -0.02", "down_5pct": "ret < -0.05", "quiet": "abs(ret) < 0.005", "gap_up": "gap > 0.01", "gap_down": "gap < -0.01",
    "gap_and_go": "gap > 0.01 and c > o", "gap_fade": "gap > 0.01 and c < o", "near_high": "c >= 0.98 * hi", "near_low": "c <= 1.02 * lo", "volume_spike": "v > 2 * av", "dry": "v < 0.5 * av", "close_strong": "c - l > 0.8 * (h - l)", "close_weak": "c - l < 0.2 * (h - l)",
}
_SIGNED = _P + f", f as (select *, max(h) {_W.format(20)} as hi, min(l) {_W.format(20)} as lo, avg(v) {_W.format(20)} as av, lead(ret) over (partition by security_id order by day) as fwd from p)"


def _signed(spark, d) -> DataFrame:
    return panel(spark, d).withColumns({"hi": F.max("h").over(H.prior(20)), "lo": F.min("l").over(H.prior(20)), "av": F.avg("v").over(H.prior(20)), "fwd": F.lead("ret").over(H.by_security())})


def _fired(df: DataFrame) -> DataFrame:
    """Rows once per signal that fired."""
    fired = F.filter(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in SIGNALS.items()]), lambda x: x.isNotNull())
    return df.withColumn("signal", F.explode(fired))


_FIRED = _SIGNED + ", x as (" + " union all ".join(f"select '{n}' as signal, security_id, day, ret, fwd from f where {e}" for n, e in SIGNALS.items()) + ")"


@query(_FIRED + ", k as (select unnest([0, 2, 5, 10, 20]) as bps), pf as (select signal, day, avg(fwd) as r from x where fwd is not null group by signal, day having count(*) >= 3) select signal, bps::bigint as bps, count(*) as days, round(avg(r - bps / 10000.0), 8) as mean_net, round(avg(r - bps / 10000.0) / nullif(stddev_samp(r), 0) * sqrt(252.0), 5) as sharpe from pf cross join k group by signal, bps")
def flat_cost_sensitivity(spark, d):
    """Daily equal-weight portfolios of 16 signals, less flat costs of a grid; days of three names or more."""
    pf = _fired(_signed(spark, d)).where(F.col("fwd").isNotNull()).groupBy("signal", "day").agg(F.avg("fwd").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)
    x = pf.withColumn("bps", F.explode(F.array(*[F.lit(b).cast("bigint") for b in (0, 2, 5, 10, 20)])))
    net = F.col("r") - F.col("bps") / 10000.0
    sd = F.stddev_samp("r")
    return x.groupBy("signal", "bps").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(net), 8).alias("mean_net"), F.round(F.avg(net) / F.when(sd != 0, sd) * F.sqrt(F.lit(252.0)), 5).alias("sharpe"))


@query(_FIRED + ", h as (select signal, unnest([struct_pack(x := 0.02, y := 0.01), struct_pack(x := 0.03, y := 0.03), struct_pack(x := 0.01, y := 0.02)]) as p, fwd from x where fwd is not null) select signal, p.x::double as target, p.y::double as stop, count(*) as n, round(avg(case when fwd >= p.x then 1.0 when fwd <= -p.y then 0.0 end), 9) as hit_rate, round(avg(case when fwd >= p.x then 1.0 when fwd <= -p.y then 0.0 end) - p.y / (p.x + p.y), 9) as edge from h group by signal, p.x, p.y")
def signal_sweep(spark, d):
    """Hit rate of each signal at pairs of target X and stop Y on the next return, less the Y / (X + Y) that a fair game gives."""
    pairs = F.array(*[F.struct(F.lit(a).alias("target"), F.lit(b).alias("stop")) for a, b in ((0.02, 0.01), (0.03, 0.03), (0.01, 0.02))])
    x = _fired(_signed(spark, d)).where(F.col("fwd").isNotNull()).select("signal", "fwd", F.inline(pairs))
    hit = F.avg(F.when(F.col("fwd") >= F.col("target"), 1.0).when(F.col("fwd") <= -F.col("stop"), 0.0))
    return x.groupBy("signal", "target", "stop").agg(F.count(F.lit(1)).alias("n"), F.round(hit, 9).alias("hit_rate"), F.round(hit - F.col("stop") / (F.col("target") + F.col("stop")), 9).alias("edge"))


_FEATURES = {"ret": "ret", "gap": "gap", "range": "case when c > 0 then (h - l) / c end", "volume_ratio": "case when av > 0 then v / av end", "near_high": "case when hi > 0 then c / hi end"}
_AHEAD = (1, 5, 21)
_SCAN = _SIGNED + ", g as (select *, " + ", ".join(f"case when c <> 0 then lead(c, {k}) over (partition by security_id order by day) / c end - 1 as f{k}" for k in _AHEAD) + " from f), u as (select security_id, day, unnest([" + ", ".join(f"struct_pack(feature := '{n}', horizon := {k}, x := {e}, y := f{k})" for n, e in _FEATURES.items() for k in _AHEAD) + "]) as z from g), w as (select security_id, day, z.feature as feature, z.horizon as horizon, z.x as x, z.y as y from u where z.x is not null and z.y is not null), q as (select feature, horizon, day, quantile_cont(x, 0.9) as hi, quantile_cont(x, 0.1) as lo from w group by all having count(*) >= 10), sx as (select w.feature, w.horizon, w.day, avg(case when w.x >= q.hi then y end) - avg(case when w.x <= q.lo then y end) as s from w join q on q.feature = w.feature and q.horizon = w.horizon and q.day = w.day group by all)"


@query(_SCAN + ", m as (select feature, horizon, count(s) as days, avg(s) as m, avg(case when day < date '2024-01-01' then s end) as a, avg(case when day >= date '2024-01-01' then s end) as b from sx group by feature, horizon) select feature, horizon::bigint as horizon, days, round(m, 6) as mean_spread, round(a, 6) as before_2024, round(b, 6) as since_2024, case when a is not null and b is not null and abs(a) > 1e-9 and abs(b) > 1e-9 then sign(a) = sign(b) end as same_sign from m")
def feature_scan(spark, d):
    """Decile spread of five features at three horizons: daily spreads of days with ten names, their mean, and whether both halves agree in sign."""
    w = H.by_security()
    g = _signed(spark, d).withColumns({f"f{k}": F.when(F.col("c") != 0, F.lead("c", k).over(w) / F.col("c")) - 1 for k in _AHEAD})
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).cast("bigint").alias("horizon"), F.expr(e).alias("x"), F.col(f"f{k}").alias("y")) for n, e in _FEATURES.items() for k in _AHEAD])
    x = g.select("day", F.inline(each)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    key = ["feature", "horizon", "day"]
    q = x.groupBy(*key).agg(F.percentile("x", F.array(F.lit(0.9), F.lit(0.1))).alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 10)
    s = x.join(q, key).groupBy(*key).agg((F.avg(F.when(F.col("x") >= F.col("q")[0], F.col("y"))) - F.avg(F.when(F.col("x") <= F.col("q")[1], F.col("y")))).alias("s"))
    cut = F.col("day") < F.lit("2024-01-01").cast("date")
    m = s.groupBy("feature", "horizon").agg(F.count("s").alias("days"), F.avg("s").alias("m"), F.avg(F.when(cut, F.col("s"))).alias("a"), F.avg(F.when(~cut, F.col("s"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.select("feature", "horizon", "days", _r("m").alias("mean_spread"), _r("a").alias("before_2024"), _r("b").alias("since_2024"), F.when((F.abs(a) > 1e-9) & (F.abs(b) > 1e-9), F.signum(a) == F.signum(b)).alias("same_sign"))


# entries and horizons --------------------------------------------------------------------------------


@query(_T + _RET + " select entry, horizon, year(cast(day as date)) as yr, count(ret) as n, round(avg(ret), 6) as mean_ret, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(ret)), 4) as t_stat from st where ret is not null group by grouping sets ((entry, horizon), (entry, horizon, year(cast(day as date))))")
def surface_offset_horizon(spark, d):
    """Mean return by entry minute and horizon, over all years and year by year."""
    x = forward._returns(spark, d).where(F.col("ret").isNotNull()).withColumn("yr", F.year(F.col("day").cast("date")).cast("bigint"))
    sd = F.stddev_samp("ret")
    return x.groupingSets([["entry", "horizon"], ["entry", "horizon", "yr"]], "entry", "horizon", "yr").agg(F.count("ret").alias("n"), _r(F.avg("ret")).alias("mean_ret"), F.round(F.avg("ret") / F.when(sd != 0, sd) * F.sqrt(F.count("ret")), 4).alias("t_stat"))


@query(_T + _RET + " select entry, horizon, count(*) as n, round(avg((ret > 0)::int), 9) as green_rate, round(avg(case when ret > 0 then ret end), 6) as mean_win, round(avg(case when ret < 0 then ret end), 6) as mean_loss, round(sum(case when ret > 0 then ret end) / nullif(-sum(case when ret < 0 then ret end), 0), 5) as profit_factor, round(quantile_cont(ret, 0.5), 6) as median_ret from st where ret is not null group by entry, horizon")
def win_statistics(spark, d):
    """Green rate, mean win and loss, profit factor and median by entry and horizon."""
    x, r = forward._returns(spark, d).where(F.col("ret").isNotNull()), F.col("ret")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    lost = -F.sum(loss)
    return x.groupBy("entry", "horizon").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((r > 0).cast("int")), 9).alias("green_rate"), _r(F.avg(win)).alias("mean_win"), _r(F.avg(loss)).alias("mean_loss"), F.round(F.sum(win) / F.when(lost != 0, lost), 5).alias("profit_factor"), _r(F.percentile("ret", F.lit(0.5))).alias("median_ret"))


_PROB = "select pair, count(*) as n, round(avg((first_event = 'target_first')::int), 9) as p_target, round(avg((first_event = 'stop_first')::int), 9) as p_stop, round(avg((first_event = 'neither')::int), 9) as p_neither, round(sum((first_event = 'target_first')::int) / nullif(sum((first_event in ('target_first', 'stop_first'))::int), 0), 9) as target_share from v where first_event <> 'no_data' group by pair"


@query(forward.SQL["target_before_stop"].partition(" select *, case when first_event <> 'no_data'")[0] + " " + _PROB)
def event_probabilities(spark, d):
    """Chance of target, stop and neither for each pair, and the target's share of those decided."""
    x = forward.target_before_stop(spark, d).where(F.col("first_event") != "no_data")
    p = lambda *e: F.avg(F.col("first_event").isin(*e).cast("int"))
    decided = F.count_if(F.col("first_event").isin("target_first", "stop_first"))
    return x.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.round(p("target_first"), 9).alias("p_target"), F.round(p("stop_first"), 9).alias("p_stop"), F.round(p("neither"), 9).alias("p_neither"), F.round(F.count_if(F.col("first_event") == "target_first") / F.when(decided > 0, decided), 9).alias("target_share"))


_COST = """, cq as (select sym, day, entry, price, greatest(least((f.h - f.l) / 2 / price * 10000, 50.0), 0.005 / price * 10000) as spread, 10 * sqrt(10000 / (f.c * f.v)) as impact, price < 20 as cheap from fills where f.c * f.v > 0),
cc as (select entry, cheap, count(*) as n, round(quantile_cont(spread, 0.5), 6) as median_spread, quantile_disc(round(spread, 9), 0.75) as p75_spread, round(avg(impact), 6) as mean_impact, round(avg((spread >= 50)::int), 9) as capped, count(distinct sym) as names from cq group by entry, cheap)"""


@query(_T + _COST + " select entry, cheap, n, median_spread, round(p75_spread, 6) as p75_spread, mean_impact, capped, names from cc")
def cost_model_cells(spark, d):
    """Cost of an entry in basis points by minute and price class: half the bar's range, capped at 50 and not below half a tick, and a square-root impact; medians, upper quartile (discrete), share at the cap."""
    c = _costs(spark, d)
    return _cells(c).select("entry", "cheap", "n", "median_spread", _r("p75_spread").alias("p75_spread"), "mean_impact", "capped", "names")


def _costs(spark, d) -> DataFrame:
    t = forward.day_tape(spark, d).where((F.col("k") == 0) & (F.col("mod") == F.col("opens")))
    x = t.select("sym", "day", F.inline("fills")).where((F.col("f.o") > 0) & (F.col("f.c") * F.col("f.v") > 0))
    price = F.col("f.o")
    spread = F.greatest(F.least((F.col("f.h") - F.col("f.l")) / 2 / price * 10000, F.lit(50.0)), F.lit(0.005) / price * 10000)
    return x.select("sym", _iso(), "entry", spread.alias("spread"), (10 * F.sqrt(F.lit(10000) / (F.col("f.c") * F.col("f.v")))).alias("impact"), (price < 20).alias("cheap"))


def _cells(c: DataFrame) -> DataFrame:
    p75 = F.expr("percentile_disc(0.75) within group (order by round(spread, 9))")
    return c.groupBy("entry", "cheap").agg(F.count(F.lit(1)).alias("n"), _r(F.percentile("spread", F.lit(0.5))).alias("median_spread"), p75.alias("p75_spread"), _r(F.avg("impact")).alias("mean_impact"), F.round(F.avg((F.col("spread") >= 50).cast("int")), 9).alias("capped"), F.countDistinct("sym").alias("names"))


@query(_T + _COST + _RET + ", z as (select st.*, cq.cheap from st join cq on cq.sym = st.sym and cq.day = st.day and cq.entry = st.entry where st.ret is not null) select z.entry, z.horizon, count(*) as n, round(avg(z.ret), 6) as gross, round(avg(z.ret - coalesce(case when cc.n >= 5 then cc.median_spread + cc.mean_impact end, 0) / 10000), 6) as net from z left join cc on cc.entry = z.entry and cc.cheap = z.cheap group by z.entry, z.horizon")
def net_of_costs(spark, d):
    """Mean return by entry and horizon before and after the cost of its cell; cells of fewer than five entries cost nothing."""
    c = _costs(spark, d)
    cells = _cells(c).where(F.col("n") >= 5).select("entry", "cheap", (F.col("median_spread") + F.col("mean_impact")).alias("cost"))
    z = forward._returns(spark, d).where(F.col("ret").isNotNull()).join(c.select("sym", "day", "entry", "cheap"), ["sym", "day", "entry"]).join(cells, ["entry", "cheap"], "left")
    return z.groupBy("entry", "horizon").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("ret")).alias("gross"), _r(F.avg(F.col("ret") - F.coalesce("cost", F.lit(0.0)) / 10000)).alias("net"))


#: P(Z > x) in SQL, by the series whose terms are all positive
_TAIL = "(0.5 - sqrt(1 / (2 * pi())) * exp(-x * x / 2) * list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(greatest(x, 1e-300)) + n * ln(2.0) + lgamma(n + 1.0) - lgamma(2 * n + 2.0)))))"


def _step_up(tests: DataFrame, order: list, level: float = 0.1) -> DataFrame:
    """Benjamini-Yekutieli: ``tests`` with a column p, plus rank and rejected.  The rank is global without one task for all."""
    k = R.global_rank(tests, order, "rank")
    m = k.agg(F.count(F.lit(1)).alias("m"), F.sum(1.0 / F.col("rank")).alias("hm"))
    below = F.col("p") <= F.col("rank") * level / (F.col("m") * F.col("hm"))
    last = k.crossJoin(F.broadcast(m)).where(below).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last"))  # one row each
    return k.crossJoin(F.broadcast(last)).withColumn("rejected", F.col("rank") <= F.col("last")).drop("last")


_BY = "b0 as (select *, row_number() over (order by pk, id) as rank from tests), bm as (select count(*) as m, sum(1.0 / rank) as hm from b0), bl as (select coalesce(max(rank) filter (p <= rank * 0.1 / (m * hm)), 0) as last from b0, bm)"


@query(_P + f", g as (select security_id as id, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(ret)), 9) as t from p group by 1 having count(ret) >= 20), z as (select id, t, abs(t) as x from g where t is not null), tests as (select id, t, 2 * {_TAIL} as p, round(-x, 6) as pk from z), {_BY} select id as security_id, round(t, 6) as t, round(p, 6) as p, rank, rank <= last as rejected from b0, bl")
def by_fdr(spark, d):
    """Benjamini-Yekutieli step-up at 10 % over one two-sided test of the mean return per security."""
    sd = F.stddev_samp("ret")
    g = panel(spark, d).groupBy("security_id").agg(F.count("ret").alias("n"), F.round(F.avg("ret") / F.when(sd != 0, sd) * F.sqrt(F.count("ret")), 9).alias("t")).where((F.col("n") >= 20) & F.col("t").isNotNull())
    g = g.withColumns({"p": 2 * normal_tail(F.abs("t")), "pk": F.round(-F.abs("t"), 6)})
    return _step_up(g, ["pk", "security_id"]).select("security_id", _r("t").alias("t"), _r("p").alias("p"), "rank", "rejected")


@query(_T + _RET + f", g as (select entry || ' ' || horizon as id, count(ret) as n, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(ret)), 6) as t from st where ret is not null group by 1), z as (select id, n, t, greatest(-t, 0) as x, t < 0 as losing from g where t is not null and n >= 10), tests as (select id, n, t, case when losing then {_TAIL} else 1.0 end as p, round(t, 6) as pk from z), {_BY}, sg as (select id from b0, bl where rank <= last and t < 0), sc as (select id from g where n < 10) select id as cell, 'structural' as reason from sc union all select id, 'losing' from sg")
def blacklist(spark, d):
    """Cells of entry and horizon to keep out of: those with too few entries, and those whose mean is significantly below zero after the step-up."""
    x = forward._returns(spark, d).where(F.col("ret").isNotNull())
    sd = F.stddev_samp("ret")
    g = x.groupBy(F.concat_ws(" ", "entry", "horizon").alias("cell")).agg(F.count("ret").alias("n"), F.round(F.avg("ret") / F.when(sd != 0, sd) * F.sqrt(F.count("ret")), 6).alias("t"))
    t = g.where(F.col("t").isNotNull() & (F.col("n") >= 10)).withColumns({"p": F.when(F.col("t") < 0, normal_tail(-F.col("t"))).otherwise(1.0), "pk": F.round("t", 6)})
    losing = _step_up(t, ["pk", "cell"]).where(F.col("rejected") & (F.col("t") < 0)).select("cell", F.lit("losing").alias("reason"))
    return g.where(F.col("n") < 10).select("cell", F.lit("structural").alias("reason")).unionByName(losing).distinct()


@query(_T + _RET + ", tr as (select entry, horizon, avg(ret) as m, count(*) as n from st where ret is not null and day < '2024-01-01' group by 1, 2 having count(*) >= 5), te as (select entry, horizon, avg(ret) as m, count(*) as n from st where ret is not null and day >= '2024-01-01' group by 1, 2), k as (select tr.*, row_number() over (order by round(tr.m, 9) desc, tr.entry, tr.horizon) as place from tr) select k.entry, k.horizon, k.place, round(k.m, 6) as train_mean, k.n as train_n, round(te.m, 6) as test_mean, te.n as test_n from k left join te using (entry, horizon)")
def config_grid_oos(spark, d):
    """Every entry and horizon ranked by its mean before 2024, with what it gave since."""
    x = forward._returns(spark, d).where(F.col("ret").isNotNull())
    early = F.col("day") < "2024-01-01"
    g = x.groupBy("entry", "horizon").agg(F.avg(F.when(early, F.col("ret"))).alias("a"), F.count_if(early).alias("n"), F.avg(F.when(~early, F.col("ret"))).alias("b"), F.count_if(~early).alias("k")).where(F.col("n") >= 5)
    place = F.row_number().over(Window.orderBy(F.round("a", 9).desc(), "entry", "horizon")).cast("bigint")  # 136 cells
    return g.select("entry", "horizon", place.alias("place"), _r("a").alias("train_mean"), F.col("n").alias("train_n"), _r("b").alias("test_mean"), F.when(F.col("k") > 0, F.col("k")).alias("test_n"))


_GATE = _T + ", r as (select sym, day, entry, round(arg_max(c, idx) filter (mod <= f.mod + 30) / any_value(price) - 1, 9) as r30, round(arg_max(c, idx) / any_value(price) - 1, 9) as eod, max(h) filter (mod <= f.mod + 30) / any_value(price) - 1 as up from t where k = 0 group by sym, day, entry), s as (select *, least(greatest(floor(r30 / 0.005), -4), 4)::bigint as state, day < '2024-01-01' as early from r)"


@query(_GATE.replace(", s as (select *, least", ", sg as (select *, least") + ", m as (select state, avg(eod - r30) as remaining from sg where early group by state), z as (select sg.*, m.remaining, case when coalesce(m.remaining, 0) < 0 then r30 - 0.0005 else eod end as gated from sg left join m using (state) where not early) select entry, count(*) as n, round(avg((coalesce(remaining, 0) < 0)::int), 9) as left_early, round(avg(eod), 6) as held, round(avg(gated), 6) as gated, round(avg(gated - eod), 6) + 0.0 as gain from z group by entry")
def health_gated_exit(spark, d):
    """Half an hour after the entry, leave (at a cost) where the remaining return learned before 2024 for that state is below zero, else hold; valued since 2024."""
    x = forward.intraday_returns(spark, d, (30,)).withColumnRenamed("r0", "r30")
    x = x.withColumns({"state": F.least(F.greatest(F.floor(F.col("r30") / 0.005), F.lit(-4)), F.lit(4)), "early": F.col("day") < F.lit("2024-01-01").cast("date")})
    m = x.where("early").groupBy("state").agg(F.avg(F.col("eod") - F.col("r30")).alias("remaining"))
    z = x.where(~F.col("early")).join(F.broadcast(m), "state", "left")  # nine states
    out = F.coalesce("remaining", F.lit(0.0)) < 0
    gated = F.when(out, F.col("r30") - 0.0005).otherwise(F.col("eod"))
    return z.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(out.cast("int")), 9).alias("left_early"), _r(F.avg("eod")).alias("held"), _r(F.avg(gated)).alias("gated"), (_r(F.avg(gated - F.col("eod"))) + 0.0).alias("gain"))


# scores, nulls and power ------------------------------------------------------------------------------


@query(_F + ", k as (select fwd, ntile(10) over (order by ret, security_id, day) as decile from f), a as (select avg((fwd > 0)::int) as base from f) select decile, count(*) as n, round(avg((fwd > 0)::int), 9) as hit_rate, round(avg((fwd > 0)::int) / any_value(base), 6) as lift, round(avg(fwd), 6) as mean_fwd, round(sum(case when decile >= 9 then fwd when decile <= 2 then -fwd else 0 end) / count(*), 6) + 0.0 as gated_pnl from k, a group by decile")
def score_deciles(spark, d):
    """Lift of a score by its deciles over all rows and days, and what a rule pays that is long the top two and short the bottom two."""
    f = _forward(spark, d).select("ret", "fwd", "security_id", "day")
    k = R.global_ntile(f, ["ret", "security_id", "day"], 10, "decile")
    base = F.broadcast(f.agg(F.avg((F.col("fwd") > 0).cast("int")).alias("base")))  # one row
    hit = F.avg((F.col("fwd") > 0).cast("int"))
    pnl = F.sum(F.when(F.col("decile") >= 9, F.col("fwd")).when(F.col("decile") <= 2, -F.col("fwd")).otherwise(0.0)) / F.count(F.lit(1))
    return k.crossJoin(base).groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(hit, 9).alias("hit_rate"), _r(hit / F.first("base")).alias("lift"), _r(F.avg("fwd")).alias("mean_fwd"), (_r(pnl) + 0.0).alias("gated_pnl"))


_MANY = 20


@query(_F + f", seeds as (select unnest(range(0, {_MANY})) as seed), n as (select *, count(*) over (partition by day) as m, row_number() over (partition by day order by ret, security_id) as a, row_number() over (partition by day order by fwd, security_id) as b from f), x as (select seed, day, a, row_number() over (partition by seed, day order by md5(security_id || '|' || strftime(day, '%Y-%m-%d') || '|' || seed)) as p from n cross join seeds where m >= 10), i as (select seed, day, corr(a, p) as ic from x group by seed, day), g as (select seed, avg(ic) as ic from i group by seed), r as (select day, corr(a, b) as ic from n where m >= 10 group by day) select round((select avg(ic) from r), 6) as mean_ic, round(max(ic), 6) as null_max, round(avg(ic), 6) + 0.0 as null_mean, round(stddev_samp(ic), 6) as null_sd, round((1 + count_if(abs(ic) >= abs((select avg(ic) from r)))) / ({_MANY} + 1), 6) as p_value from g")
def permutation_within_day(spark, d):
    """Mean rank correlation of a signal with the next return against 20 permutations inside each day, drawn by a seeded hash."""
    n = F.count(F.lit(1)).over(Window.partitionBy("day"))
    rank = lambda c: F.row_number().over(Window.partitionBy("day").orderBy(c, "security_id")).cast("double")
    f = _forward(spark, d).withColumns({"m": n, "a": rank("ret"), "b": rank("fwd")}).where(F.col("m") >= 10).select("security_id", "day", "a", "b")
    x = f.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(_MANY - 1))))
    h = F.md5(F.concat_ws("|", "security_id", F.date_format("day", "yyyy-MM-dd"), F.col("seed").cast("string")))
    x = x.withColumn("p", F.row_number().over(Window.partitionBy("seed", "day").orderBy(h)).cast("double"))
    g = x.groupBy("seed", "day").agg(F.corr("a", "p").alias("ic")).groupBy("seed").agg(F.avg("ic").alias("ic"))
    real = F.broadcast(f.groupBy("day").agg(F.corr("a", "b").alias("ic")).agg(F.avg("ic").alias("real")))  # one row
    out = g.crossJoin(real).agg(F.first("real").alias("real"), F.max("ic").alias("most"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.count_if(F.abs("ic") >= F.abs("real")).alias("k"))
    return out.select(_r("real").alias("mean_ic"), _r("most").alias("null_max"), (_r("mean") + 0.0).alias("null_mean"), _r("sd").alias("null_sd"), _r((1 + F.col("k")) / (_MANY + 1)).alias("p_value"))


_Z = {"loose": NormalDist().inv_cdf(1 - 0.1 / 2) + NormalDist().inv_cdf(0.8), "strict": NormalDist().inv_cdf(1 - 0.1 / (16 * sum(1 / k for k in range(1, 17))) / 2) + NormalDist().inv_cdf(0.8)}


@query(_FIRED + ", pf as (select signal, day, avg(fwd) as r, count(*) as n from x where fwd is not null group by signal, day having count(*) >= 3) select signal, count(*) as days, round(quantile_cont(n, 0.5), 3) as median_names, round(stddev_samp(r) / sqrt(count(*)), 8) as se, " + ", ".join(f"round({z!r} * stddev_samp(r) / sqrt(count(*)), 8) as mde_{n}, round({z!r} / sqrt(count(*) / 252.0), 6) as sharpe_{n}" for n, z in _Z.items()) + ", count(*) >= 100 as enough_days from pf group by signal")
def power_gates(spark, d):
    """What each signal's days can show: standard error, least detectable mean and Sharpe ratio at 80 % power, at the first and the last step of the step-up over 16 tests."""
    pf = _fired(_signed(spark, d)).where(F.col("fwd").isNotNull()).groupBy("signal", "day").agg(F.avg("fwd").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)
    n, se = F.count(F.lit(1)), F.stddev_samp("r") / F.sqrt(F.count(F.lit(1)))
    ends = [c for k, z in _Z.items() for c in (F.round(z * se, 8).alias(f"mde_{k}"), _r(z / F.sqrt(n / 252.0)).alias(f"sharpe_{k}"))]
    return pf.groupBy("signal").agg(n.alias("days"), F.round(F.percentile("n", F.lit(0.5)), 3).alias("median_names"), F.round(se, 8).alias("se"), *ends, (n >= 100).alias("enough_days"))


@query(_P + ", e as (select distinct security_id, filing_date from financials where security_id is not null and timeframe = 'quarterly'), q as (select security_id, day, lead(c, 5) over w / nullif(c, 0) - 1 as drift from p window w as (partition by security_id order by day)), j as (select e.security_id, e.filing_date, arg_min(struct_pack(d := q.day, r := q.drift), q.day) as x from e join q on q.security_id = e.security_id and q.day > e.filing_date group by all), m as (select day, stddev_pop(ret) as s from p group by day having count(ret) >= 2), b as (select quantile_cont(s, 1 / 3.0) as lo, quantile_cont(s, 2 / 3.0) as hi from m where day between date '2023-01-01' and date '2023-12-31'), z as (select x.r as r, case when m.s <= lo then 'low' when m.s <= hi then 'mid' else 'high' end as state from j join m on m.day = x.d, b where x.r is not null) select state, count(*) as events, round(avg(r), 6) as mean_drift, round(stddev_samp(r) / sqrt(count(*)), 8) as se, count(*) >= 30 and abs(avg(r)) > 2.8 * stddev_samp(r) / sqrt(count(*)) as passes from z group by state")
def event_state_cells(spark, d):
    """Drift after quarterly filings by the dispersion regime of the day, with a gate on number and power."""
    from tapeglass.operators.asof import asof_forward

    e = table(spark, d, "financials").where(F.col("security_id").isNotNull() & (F.col("timeframe") == "quarterly")).select("security_id", "filing_date").distinct()
    p = panel(spark, d)
    q = p.select(F.col("security_id").alias("s2"), F.col("day").alias("d2"), (F.when(F.col("c") != 0, F.lead("c", 5).over(H.by_security()) / F.col("c")) - 1).alias("r"))
    j = asof_forward(e, p, "security_id", "filing_date", "day", "first_day", strict=True).join(q, (F.col("security_id") == F.col("s2")) & (F.col("first_day") == F.col("d2"))).where(F.col("r").isNotNull())
    m = p.groupBy("day").agg(F.stddev_pop("ret").alias("s"), F.count("ret").alias("n")).where(F.col("n") >= 2)
    b = F.broadcast(m.where(F.col("day").between(F.lit("2023-01-01").cast("date"), F.lit("2023-12-31").cast("date"))).agg(F.percentile("s", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")))  # one row
    z = j.join(m, F.col("d2") == m["day"]).crossJoin(b).withColumn("state", F.when(F.col("s") <= F.col("q")[0], "low").when(F.col("s") <= F.col("q")[1], "mid").otherwise("high"))
    se = F.stddev_samp("r") / F.sqrt(F.count(F.lit(1)))
    return z.groupBy("state").agg(F.count(F.lit(1)).alias("events"), _r(F.avg("r")).alias("mean_drift"), F.round(se, 8).alias("se"), ((F.count(F.lit(1)) >= 30) & (F.abs(F.avg("r")) > 2.8 * se)).alias("passes"))


_HASH = "cast('0x' || substr(md5(security_id || '|' || strftime(day, '%Y-%m-%d') || '|11'), 1, 8) as bigint)"


def _hash():
    return F.conv(F.substring(F.md5(F.concat_ws("|", "security_id", F.date_format("day", "yyyy-MM-dd"), F.lit("11"))), 1, 8), 16, 10).cast("bigint")


@query(_F + f", g as (select unnest([0.0, 0.001, 0.005, 0.02]::double[]) as drift), x as (select day, {_HASH} % 10 = 0 as hit, fwd from f), y as (select drift, day, avg(case when hit then fwd + drift end) - avg(case when not hit then fwd end) as s from x cross join g group by drift, day) select drift, count(s) as days, round(avg(s), 6) as recovered, round(avg(s) / stddev_samp(s) * sqrt(count(s)), 4) as t_stat, avg(s) / stddev_samp(s) * sqrt(count(s)) > 1.96 as detected from y group by drift")
def synthetic_injection(spark, d):
    """Drifts of known size put on a hashed tenth of the names, and what the daily difference of means gets back."""
    x = _forward(spark, d).select("day", (_hash() % 10 == 0).alias("hit"), "fwd").withColumn("drift", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.001, 0.005, 0.02)])))
    y = x.groupBy("drift", "day").agg((F.avg(F.when(F.col("hit"), F.col("fwd") + F.col("drift"))) - F.avg(F.when(~F.col("hit"), F.col("fwd")))).alias("s"))
    t = F.avg("s") / F.stddev_samp("s") * F.sqrt(F.count("s"))
    return y.groupBy("drift").agg(F.count("s").alias("days"), _r(F.avg("s")).alias("recovered"), F.round(t, 4).alias("t_stat"), (t > 1.96).alias("detected"))


@query(_F + f", g as (select unnest([100, 70, 50]) as coverage), x as (select coverage, ret, fwd, q from f cross join g where {_HASH} % 100 < coverage) select coverage::bigint as coverage, count(*) as n, round(corr(ret, fwd), 6) + 0.0 as correlation, round(corr(ret, ln(1 + q)), 6) + 0.0 as proxy_correlation, round(stddev_samp(fwd) / sqrt(count(*)), 8) as se from x group by coverage")
def match_rate_sensitivity(spark, d):
    """The same figures with 100, 70 and 50 in a hundred of the names, thinned by a hash, and the signal's correlation with a proxy."""
    x = _forward(spark, d).withColumn("coverage", F.explode(F.array(*[F.lit(c).cast("bigint") for c in (100, 70, 50)]))).where(_hash() % 100 < F.col("coverage"))
    return x.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"), (_r(F.corr("ret", "fwd")) + 0.0).alias("correlation"), (_r(F.corr("ret", F.ln(1 + F.col("q")))) + 0.0).alias("proxy_correlation"), F.round(F.stddev_samp("fwd") / F.sqrt(F.count(F.lit(1))), 8).alias("se"))


_IDX = _P + ", m as (select day, avg(ret) as r from p where ret is not null group by day), v as (select day, r, stddev_samp(r) over w as sd, count(r) over w as n, quantile_cont(abs(r), 0.8) over w as q from m window w as (order by day rows between 21 preceding and 1 preceding))"


@query(_IDX + ", k as (select day, r, unnest([struct_pack(scheme := 'inv_vol', w := case when n = 21 and sd > 0 then least(2.0, 0.01 / sd) else 1.0 end), struct_pack(scheme := 'inv_var', w := case when n = 21 and sd > 0 then least(2.0, 0.0001 / (sd * sd)) else 1.0 end), struct_pack(scheme := 'binary', w := case when n = 21 and lag_abs > q then 0.5 else 1.0 end)]) as z from (select *, lag(abs(r)) over (order by day) as lag_abs from v)), t as (select day, z.scheme as scheme, z.w as w, z.w * r - abs(z.w - lag(z.w, 1, 1.0) over (partition by z.scheme order by day)) * 0.0005 as net from k), c as (select *, exp(sum(ln(1 + net)) over (partition by scheme order by day)) as wealth from t), d as (select *, wealth / greatest(1.0, max(wealth) over (partition by scheme order by day)) - 1 as dd from c) select scheme, count(*) as days, round(avg(w), 6) as mean_weight, round(avg(net) / stddev_samp(net) * sqrt(252.0), 5) as sharpe, round(min(dd), 6) as worst_drawdown from d group by scheme")
def weight_schemes(spark, d):
    """Index returns under weights by inverse volatility, inverse variance and a binary rule, net of turnover, with their worst drawdown."""
    m = panel(spark, d).where(F.col("ret").isNotNull()).groupBy("day").agg(F.avg("ret").alias("r"))
    o = Window.orderBy("day")  # a row per trading day
    f = o.rowsBetween(-21, -1)
    v = m.withColumns({"sd": F.stddev_samp("r").over(f), "n": F.count("r").over(f), "q": F.percentile(F.abs("r"), F.lit(0.8)).over(f), "last": F.lag(F.abs("r")).over(o)})
    ready = (F.col("n") == 21) & (F.col("sd") > 0)
    each = {"inv_vol": F.when(ready, F.least(F.lit(2.0), 0.01 / F.col("sd"))).otherwise(1.0), "inv_var": F.when(ready, F.least(F.lit(2.0), 0.0001 / (F.col("sd") * F.col("sd")))).otherwise(1.0), "binary": F.when((F.col("n") == 21) & (F.col("last") > F.col("q")), 0.5).otherwise(1.0)}
    k = v.select("day", "r", F.inline(F.array(*[F.struct(F.lit(n).alias("scheme"), w.alias("w")) for n, w in each.items()])))
    w = Window.partitionBy("scheme").orderBy("day")
    k = k.withColumn("net", F.col("w") * F.col("r") - F.abs(F.col("w") - F.lag("w", 1, 1.0).over(w)) * 0.0005)
    k = k.withColumn("wealth", F.exp(F.sum(F.log1p("net")).over(w)))
    k = k.withColumn("dd", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)
    return k.groupBy("scheme").agg(F.count(F.lit(1)).alias("days"), _r(F.avg("w")).alias("mean_weight"), F.round(F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(252.0)), 5).alias("sharpe"), _r(F.min("dd")).alias("worst_drawdown"))


@query()
def permutation_importance(spark, d):
    """A logistic model on imputed, standardised features before 2024: its coefficients, and how much the rank measure since 2024 loses when a feature's values are shuffled over the rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    from tapeglass.session import cut

    names = list(_FEATURES)
    f = _signed(spark, d).where(F.col("fwd").isNotNull()).select("security_id", "day", *[F.expr(e).alias(n) for n, e in _FEATURES.items()], (F.col("fwd") > 0).cast("double").alias("label"))
    f = cut(f)
    early = F.col("day") < F.lit("2024-01-01").cast("date")
    train, test = f.where(early), f.where(~early)
    steps = [Imputer(inputCols=names, outputCols=[f"{n}_i" for n in names]), VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=30)]
    if train.select("label").distinct().count() < 2 or not test.limit(1).count():
        return spark.createDataFrame([], "feature string, coefficient double, auc double, auc_loss double")
    model, measure = Pipeline(stages=steps).fit(train), BinaryClassificationEvaluator()
    base = measure.evaluate(model.transform(test))
    by_hash = lambda seed: R.global_rank(test, [F.xxhash64(F.lit(seed), "security_id", "day"), "security_id", "day"], "_p")
    rows = []
    for j, n in enumerate(names):
        other = by_hash(j + 1).select(F.col("_p").alias("_q"), F.col(n).alias("_v"))
        shuffled = by_hash(0).join(other, F.col("_p") == F.col("_q")).drop(n, "_p", "_q").withColumnRenamed("_v", n)
        rows.append((n, float(model.stages[-1].coefficients[j]), float(base), float(base - measure.evaluate(model.transform(shuffled)))))
    return spark.createDataFrame(rows, "feature string, coefficient double, auc double, auc_loss double")
