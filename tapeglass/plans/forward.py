"""Queries over what followed each of 17 entry minutes: entries, horizons, crossings, labels, shapes, next days, path states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import valid_symbol
from tapeglass.operators import forward as W
from tapeglass.operators import history as H
from tapeglass.operators import ranking as R
from tapeglass.plans.panel import _P, _W, _yz, panel
from tapeglass.plans.problems import _SYMBOL
from tapeglass.sources.market import trading_days
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


def context(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the days before, by symbol and day; none where two securities bear one symbol on a day."""
    p = panel(spark, d).select(valid_symbol(F.col("sym")).alias("sym"), "day", F.round(H.atr(14), 9).alias("atr"), F.round(H.yang_zhang(14), 6).alias("yz"), F.round(H.average("v", 20), 6).alias("adv"), F.round(H.average("q", 20), 6).alias("addv"))
    one = F.struct("atr", "yz", "adv", "addv")
    return p.groupBy("sym", "day").agg(F.max(one).alias("x"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("sym", "day", "x.*")


def day_tape(spark: SparkSession, d: str, known: bool = False) -> DataFrame:
    """``known``: with the figures of ``context``."""
    return W.day_tape(table(spark, d, "bars_1m_raw"), context(spark, d) if known else None, trading_days(table(spark, d, "day_session")), W.OFFSETS)


def _sides(spark: SparkSession, d: str, known: bool) -> tuple:
    return table(spark, d, "bars_1m_raw"), context(spark, d) if known else None, trading_days(table(spark, d, "day_session"))


def states(spark: SparkSession, d: str, names: list[str], known: bool = False) -> DataFrame:
    return W.path_states(*_sides(spark, d, known), names)


def follow(spark: SparkSession, d: str, known: bool = False) -> DataFrame:
    return W.follow(day_tape(spark, d, known))


def _key() -> list:
    return [F.col("sym"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("entry")]


def _r(c, n: int = 6):
    return F.round(c, n)


_LABELS = ", ".join(f"('{e}', {W.minute_of(e)})" for e in W.OFFSETS)
_YZ14 = _yz(14).removesuffix(" as yz_14")
#: entries and tapes, put together without Spark's way of doing it: every fill joined with every bar after it
_T = _P + f""",
cx0 as (select {_SYMBOL.format("sym")} as sym, day, round(case when count(tr) {_W.format(14)} = 14 then avg(tr) {_W.format(14)} end, 9) as atr, {_YZ14} as yz,
        round(case when count(v) {_W.format(20)} = 20 then avg(v) {_W.format(20)} end, 6) as adv, round(case when count(q) {_W.format(20)} = 20 then avg(q) {_W.format(20)} end, 6) as addv from p),
cx as (select sym, day, max(atr) as atr, max(yz) as yz, max(adv) as adv, max(addv) as addv from cx0 group by sym, day having count(*) = 1),
cal as (select day as date, row_number() over (order by day) - 1 as i from (select distinct day from day_session)),
m1 as (select display_symbol as sym, epoch_us(t) // 60000000 as minute, arg_max(struct_pack(o := open, h := high, l := low, c := close, v := volume), row(t, volume, open, high, low, close)) as r
      from bars_1m_raw where volume > 0 and not isnan(volume) and display_symbol is not null group by all),
m2 as (select sym, timezone('America/New_York', make_timestamptz(minute * 60000000)) as w, r from m1),
bb as (select sym, cal.date, cal.i, cast(hour(w) * 60 + minute(w) as integer) as mod, r.o as o, r.h as h, r.l as l, r.c as c, r.v as v from m2 join cal on cal.date = cast(w as date) where hour(w) * 60 + minute(w) between 240 and 959),
rth as (select *, row_number() over (partition by sym, i order by mod) - 1 as bi, min(mod) over (partition by sym, i) as opens, first_value(o) over (partition by sym, i order by mod) as day_open from bb where mod >= 570),
e as (select * from (values {_LABELS}) as v(entry, m)),
fl as (select sym, i, any_value(date) as date, entry, any_value(m) as wanted, any_value(day_open) as day_open, arg_min(struct_pack(mod := mod, o := o, h := h, l := l, c := c, v := v, bi := bi), mod) as f from rth join e on rth.mod >= e.m group by sym, i, entry),
fills as (select fl.*, strftime(fl.date, '%Y-%m-%d') as day, f.o as price, cx.atr, cx.yz, cx.adv, cx.addv from fl left join cx on cx.sym = fl.sym and cx.day = fl.date where f.o > 0),
t as (select fills.*, rth.i - fills.i as k, rth.mod, rth.o, rth.h, rth.l, rth.c, rth.v, rth.opens, row_number() over (partition by fills.sym, fills.i, fills.entry order by rth.i, rth.mod) - 1 as idx
      from fills join rth on rth.sym = fills.sym and rth.i between fills.i and fills.i + 5 and (rth.i > fills.i or rth.mod >= f.mod)),
hz as (select sym, day, entry, unnest([{", ".join(f"struct_pack(horizon := '{h}', e := max(case when k = 0 and mod <= f.mod + {n} then idx end))" for h, n in W.MINUTES.items())}, struct_pack(horizon := 'EOD', e := max(case when k = 0 then idx end)),
      {", ".join(f"struct_pack(horizon := '{h}', e := max(case when k = {n} then idx end))" for h, n in W.DAYS.items())}]) as z from t group by sym, day, entry),
he as (select sym, day, entry, z.horizon as horizon, z.e as e from hz)
"""


@query(_T + f"select s.sym, strftime(s.date, '%Y-%m-%d') as day, e.entry, fl.f.mod as fill, case when fl.f.o > 0 then fl.f.o end as price, case when fl.f.o > 0 then fl.f.mod > e.m end as halted from (select distinct sym, i, date from rth) s cross join e left join fl on fl.sym = s.sym and fl.i = s.i and fl.entry = e.entry")
def entry_resolution(spark, d):
    """Every symbol and day with a regular bar at all 17 entries: the first bar at or after the minute, at its open; nulls without one."""
    t = day_tape(spark, d).where((F.col("k") == 0) & (F.col("mod") == F.col("opens")))
    all_of = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(W.minute_of(e)).alias("m")) for e in W.OFFSETS])
    x = t.withColumn("_f", F.map_from_entries("fills")).select("sym", "day", "_f", F.inline(all_of)).withColumn("f", F.col("_f")[F.col("entry")])
    good = F.col("f.o") > 0
    return x.select(*_key(), F.col("f.mod").alias("fill"), F.when(good, F.col("f.o")).alias("price"), F.when(good, F.col("f.mod") > F.col("m")).alias("halted"))


@query(_T + ", q as (select fills.sym, fills.day, fills.entry, fills.price, fills.day_open, fills.f, coalesce(sum(b.v), 0) as vol, coalesce(sum(b.c * b.v), 0) as dol, max(b.h) as hi, min(b.l) as lo, arg_max(b.bi, row(b.h, b.bi)) as hi_at, arg_min(b.bi, row(b.l, b.bi)) as lo_at from fills left join rth b on b.sym = fills.sym and b.i = fills.i and b.mod < fills.f.mod group by all) select sym, day, entry, round(price / day_open - 1, 6) as ret_from_open, vol as volume_from_open, round(dol, 4) as dollars_from_open, round(dol / nullif(vol, 0), 6) as vwap_from_open, round(hi / day_open - 1, 6) as high_return, round(lo / day_open - 1, 6) as low_return, f.bi - hi_at as bars_since_high, f.bi - lo_at as bars_since_low, round(price / hi - 1, 6) as ret_from_high, round(price / lo - 1, 6) as ret_from_low from q")
def pre_entry(spark, d):
    """The session before each fill; of equal highs the last counts, of equal lows the first, and bars stand for minutes."""
    return _pre(spark, d).select(
        *_key(), _r(F.col("price") / F.col("open") - 1).alias("ret_from_open"), F.col("vol").alias("volume_from_open"), F.round("dol", 4).alias("dollars_from_open"), _r(F.when(F.col("vol") > 0, F.col("dol") / F.col("vol"))).alias("vwap_from_open"),
        _r(F.col("hi.h") / F.col("open") - 1).alias("high_return"), _r(F.col("lo.l") / F.col("open") - 1).alias("low_return"), (-F.col("hi.idx")).alias("bars_since_high"), (-F.col("lo.idx")).alias("bars_since_low"),
        _r(F.col("price") / F.col("hi.h") - 1).alias("ret_from_high"), _r(F.col("price") / F.col("lo.l") - 1).alias("ret_from_low"),
    )


def _pre(spark, d, known: bool = False) -> DataFrame:
    x = W.entries(day_tape(spark, d, known)).where((F.col("k") == 0) & (F.col("idx") <= 0))
    before = (F.col("mod") >= W.OPEN) & (F.col("idx") < 0)
    some = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return x.groupBy(*W.KEY, "price", "f", *(["ctx"] if known else [])).agg(
        F.min_by("o", F.when(F.col("mod") >= W.OPEN, F.col("idx"))).alias("open"), some(F.when(before, F.col("v"))).alias("vol"), some(F.when(before, F.col("c") * F.col("v"))).alias("dol"),
        F.max(F.when(before, F.struct("h", "idx"))).alias("hi"), F.min(F.when(before, F.struct("l", "idx"))).alias("lo"),
        some(F.when(F.col("mod") < W.OPEN, F.col("v"))).alias("pre_vol"), some(F.when(F.col("mod") < W.OPEN, F.col("c") * F.col("v"))).alias("pre_dol"),
    )


@query(_T + """, q as (select fills.*, f.h - f.l as rng, f.c * f.v as dollars, (select coalesce(sum(v), 0) from bb where bb.sym = fills.sym and bb.i = fills.i and bb.mod < f.mod) as vol, (select coalesce(sum(c * v), 0) from bb where bb.sym = fills.sym and bb.i = fills.i and bb.mod < f.mod) as dol from fills)
select sym, day, entry, round(case when rng > 0 then (f.c - f.l) / rng end, 6) as location_in_bar, round(f.c / f.o - 1, 6) as open_to_close, round((f.h - greatest(f.o, f.c)) / f.o, 6) as upper_wick, round((least(f.o, f.c) - f.l) / f.o, 6) as lower_wick, round(rng / 2 / price * 10000, 4) as half_range_bps,
round(0.01 * adv * price, 2) as capacity_1pct_adv, round(0.05 * dollars, 4) as capacity_5pct_1m, f.v as volume_1m, round(rng, 6) as range_1m, round(dollars, 4) as dollars_1m, round(case when atr > 0 then rng / atr end, 6) as range_vs_atr, round(case when yz > 0 then rng / yz end, 6) as range_vs_yz, round(case when addv > 0 then dollars / addv end, 9) as dollars_vs_addv, round(vol + f.v, 2) as volume_to_entry, round(dol + dollars, 2) as dollars_to_entry from q""")
def entry_quality(spark, d):
    """The fill's own bar against what is usual, and all volume from 04:00 up to and with it."""
    p = _pre(spark, d, known=True)
    f, price = (lambda c: F.col(f"f.{c}")), F.col("price")
    rng, dollars = f("h") - f("l"), f("c") * f("v")
    ctx = lambda c: F.when(F.col(f"ctx.{c}") > 0, F.col(f"ctx.{c}"))
    return p.select(
        *_key(), _r(F.when(rng > 0, (f("c") - f("l")) / rng)).alias("location_in_bar"), _r(f("c") / f("o") - 1).alias("open_to_close"), _r((f("h") - F.greatest(f("o"), f("c"))) / f("o")).alias("upper_wick"), _r((F.least(f("o"), f("c")) - f("l")) / f("o")).alias("lower_wick"),
        F.round(rng / 2 / price * 10000, 4).alias("half_range_bps"), F.round(0.01 * F.col("ctx.adv") * price, 2).alias("capacity_1pct_adv"), F.round(0.05 * dollars, 4).alias("capacity_5pct_1m"), f("v").alias("volume_1m"), _r(rng).alias("range_1m"), F.round(dollars, 4).alias("dollars_1m"),
        _r(rng / ctx("atr")).alias("range_vs_atr"), _r(rng / ctx("yz")).alias("range_vs_yz"), F.round(dollars / ctx("addv"), 9).alias("dollars_vs_addv"), F.round(F.col("pre_vol") + F.col("vol") + f("v"), 2).alias("volume_to_entry"), F.round(F.col("pre_dol") + F.col("dol") + dollars, 2).alias("dollars_to_entry"),
    )


@query(_T + ", q as (select fills.sym, fills.day, fills.entry, round(fills.price / fills.day_open - 1, 9) as ret, round(coalesce(sum(b.c * b.v), 0), 4) as dol from fills left join rth b on b.sym = fills.sym and b.i = fills.i and b.mod < fills.f.mod group by fills.sym, fills.day, fills.entry, fills.price, fills.day_open), k as (select *, row_number() over (partition by day, entry order by ret desc, sym) as rr, row_number() over (partition by day, entry order by dol desc, sym) as dr, count(*) over (partition by day, entry) as m from q) select sym, day, entry, rr as ret_rank, round((m - rr) / m, 9) as ret_pct, dr as dollars_rank from k")
def pre_entry_ranks(spark, d):
    """Ranks across symbols at each day and entry minute, ties by symbol."""
    p = _pre(spark, d).select(*_key(), F.round(F.col("price") / F.col("open") - 1, 9).alias("ret"), F.round("dol", 4).alias("dollars"))
    k = R.rank_desc(R.rank_desc(p, ["day", "entry"], "ret", ["sym"], "ret"), ["day", "entry"], "dollars", ["sym"], "dollars")
    return k.select("sym", "day", "entry", "ret_rank", F.round("ret_pct", 9).alias("ret_pct"), "dollars_rank")


@query(_T + ", st as (select he.sym, he.day, he.entry, he.horizon, any_value(price) as p, count(t.idx) as n, arg_max(c, idx) as c, max(h) as h, arg_max(idx, row(h, -idx)) as hi, min(l) as l, arg_min(idx, row(l, idx)) as li, max(c) as cm, arg_max(idx, row(c, -idx)) as cmi, min(c) as cn, arg_min(idx, row(c, idx)) as cni from he left join t on t.sym = he.sym and t.day = he.day and t.entry = he.entry and t.idx <= he.e group by all), g as (select he.sym, he.day, he.entry, he.horizon, max(x.g) as g from he join (select *, case when k = lag(k) over w then mod - lag(mod) over w end as g from t window w as (partition by sym, day, entry order by idx)) x on x.sym = he.sym and x.day = he.day and x.entry = he.entry and x.idx <= he.e group by all) select sym, day, entry, horizon, round(c / p - 1, 6) as ret, round(h / p - 1, 6) as max_runup, hi as bars_to_max_runup, round(l / p - 1, 6) as max_drawdown, li as bars_to_max_drawdown, round(cm / p - 1, 6) as close_max_ret, cmi as bars_to_close_max, round(cn / p - 1, 6) as close_min_ret, cni as bars_to_close_min, case when n > 0 then coalesce(g, 0) end as bar_gap_max from st left join g using (sym, day, entry, horizon)")
def horizon_stats(spark, d):
    """Return, extremes, bars to them and the longest pause, from each fill to each of eight horizons; nulls where the horizon has no bars."""
    g = states(spark, d, W.HORIZONS)
    ret = lambda c, n: _r(F.col(c) / F.col("price") - 1).alias(n)
    return g.select(
        *_key(), F.col("name").alias("horizon"), ret("c", "ret"), ret("hi", "max_runup"), F.col("hi_at").alias("bars_to_max_runup"), ret("lo", "max_drawdown"), F.col("lo_at").alias("bars_to_max_drawdown"),
        ret("cmax", "close_max_ret"), F.col("cmax_at").alias("bars_to_close_max"), ret("cmin", "close_min_ret"), F.col("cmin_at").alias("bars_to_close_min"), F.col("pause").cast("int").alias("bar_gap_max"),
    )


_TOP3 = "top3 as (select sym, row_number() over (order by n desc, sym) as j from (select sym, count(distinct i) as n from rth group by sym) order by j limit 3)"
_RET = ", st as (select he.sym, he.day, he.entry, he.horizon, round(arg_max(c, idx) / any_value(price) - 1, 9) as ret from he left join t on t.sym = he.sym and t.day = he.day and t.entry = he.entry and t.idx <= he.e group by all)"


def _returns(spark, d) -> DataFrame:
    return states(spark, d, W.HORIZONS).select(*_key(), F.col("name").alias("horizon"), F.round(F.col("c") / F.col("price") - 1, 9).alias("ret"))


@query(_T + _RET + f", {_TOP3}, ix as (select st.day, st.entry, st.horizon, " + ", ".join(f"max(case when top3.j = {j} then st.ret end) as i{j}" for j in (1, 2, 3)) + " from st join top3 using (sym) group by all) select st.sym, st.day, st.entry, st.horizon, " + ", ".join(f"round(st.ret - ix.i{j}, 6) + 0.0 as excess_{j}" for j in (1, 2, 3)) + " from st left join ix on ix.day = st.day and ix.entry = st.entry and ix.horizon = st.horizon")
def excess_returns(spark, d):
    """Return over that of three index symbols at the same day, entry and horizon, null without either.  The indices are the three symbols with the most days."""
    st = _returns(spark, d)
    days = st.groupBy("sym").agg(F.countDistinct("day").alias("n")).orderBy(F.desc("n"), "sym").limit(3)
    names = days.withColumn("j", F.row_number().over(Window.orderBy(F.desc("n"), "sym")))  # three rows
    index = st.join(F.broadcast(names.select("sym", "j")), "sym").groupBy("day", "entry", "horizon").agg(*[F.max(F.when(F.col("j") == j, F.col("ret"))).alias(f"i{j}") for j in (1, 2, 3)])
    return st.join(index, ["day", "entry", "horizon"], "left").select("sym", "day", "entry", "horizon", *[(_r(F.col("ret") - F.col(f"i{j}")) + 0.0).alias(f"excess_{j}") for j in (1, 2, 3)])


_LINES = [("pct", p, float(p) / 100) for p in W.PCT] + [("atr", a, float(a)) for a in W.ATR]


def _cross_sql() -> str:
    tests = []
    for kind, _, x in _LINES:
        tests += [f"min(case when h / price - 1 >= {x!r} then idx end)", f"min(case when l / price - 1 <= -{x!r} then idx end)"] if kind == "pct" else [f"min(case when atr > 0 and h >= price + {x!r} * atr then idx end)", f"min(case when atr > 0 and l <= price - {x!r} * atr then idx end)"]
    lines = ", ".join(f"struct_pack(kind := '{kind}', threshold := '{n}', side := '{side}', first := {tests[2 * j + s]})" for j, (kind, n, _) in enumerate(_LINES) for s, side in enumerate(("up", "down")))
    return _T + f", c as (select sym, day, entry, any_value(atr) as atr, unnest([{lines}]) as z from t group by sym, day, entry) select c.sym, c.day, c.entry, he.horizon, z.kind as kind, z.threshold as threshold, z.side as side, case when he.e is null or (z.kind = 'atr' and not coalesce(atr > 0, false)) then null when z.first <= he.e then z.first + 1 else 0 end as bar from c join he on he.sym = c.sym and he.day = c.day and he.entry = c.entry"


@query(_cross_sql())
def first_crossing(spark, d):
    """Bar of the first touch of 7 percentages and 6 multiples of the true range, up by highs and down by lows, within each horizon.

    Bars count from 1; 0: the horizon was reached and the line wasn't; null: no such horizon, or no true range.
    """
    g = W.path_lines(*_sides(spark, d, True))
    ends = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col("ends")[j].alias("e")) for j, h in enumerate(W.HORIZONS)])
    names = [(k, n, side) for k, n, _ in _LINES for side in ("up", "down")]
    lines = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("threshold"), F.lit(side).alias("side"), F.col("lines")[j].alias("first")) for j, (k, n, side) in enumerate(names)])
    x = g.select("sym", "day", "entry", "atr", lines.alias("each"), F.inline(ends)).select("sym", "day", "entry", "atr", "horizon", "e", F.inline("each"))
    none = F.col("e").isNull() | ((F.col("kind") == "atr") & ~F.coalesce(F.col("atr") > 0, F.lit(False)))
    return x.select(*_key(), "horizon", "kind", "threshold", "side", F.when(none, F.lit(None)).when(F.col("first") <= F.col("e"), F.col("first") + 1).otherwise(0).cast("bigint").alias("bar"))


def _pair(kind: str, a: float, b: float, h: str) -> str:
    return f"{a:g}/{b:g} {kind} {h}"


def _pairs_sql() -> str:
    parts = []
    for kind, a, b, h in W.PAIRS:
        up, down = (f"h >= price * (1 + {a!r})", f"l <= price * (1 - {b!r})") if kind == "pct" else (f"h >= price + {a!r} * atr", f"l <= price - {b!r} * atr")
        parts.append(f"select t.sym, t.day, t.entry, '{_pair(kind, a, b, h)}' as pair, any_value(he.e) as e, {'true' if kind == 'pct' else 'coalesce(any_value(atr) > 0, false)'} as known, min(case when {up} and idx <= he.e then idx end) as ti, min(case when {down} and idx <= he.e then idx end) as si from t join he on he.sym = t.sym and he.day = t.day and he.entry = t.entry and he.horizon = '{h}' group by t.sym, t.day, t.entry")
    return _T + ", g as (" + " union all ".join(parts) + "), v as (select sym, day, entry, pair, case when e is null or not known then 'no_data' when si is not null and (ti is null or si <= ti) then 'stop_first' when ti is not null then 'target_first' else 'neither' end as first_event from g) select *, case when first_event <> 'no_data' then first_event = 'target_first' end as hit from v"


@query(_pairs_sql())
def target_before_stop(spark, d):
    """Eight pairs of target and stop within their horizons; both in one bar count as the stop, no horizon or no true range as no_data."""
    g, yes = W.path_lines(*_sides(spark, d, True)), F.lit(True)
    within = lambda c, j, e: F.when(F.col(c)[j] <= e, F.col(c)[j])
    end = {h: F.col("ends")[j] for j, h in enumerate(W.HORIZONS)}
    each = F.array(*[F.struct(F.lit(_pair(*p)).alias("pair"), end[p[3]].alias("e"), (F.coalesce(F.col("atr") > 0, F.lit(False)) if p[0] == "atr" else yes).alias("known"), within("targets", j, end[p[3]]).alias("t"), within("stops", j, end[p[3]]).alias("s")) for j, p in enumerate(W.PAIRS)])
    x = g.select("sym", "day", "entry", F.inline(each))
    stop = F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") <= F.col("t")))
    event = F.when(F.col("e").isNull() | ~F.col("known"), "no_data").when(stop, "stop_first").when(F.col("t").isNotNull(), "target_first").otherwise("neither")
    x = x.withColumn("first_event", event)
    return x.select(*_key(), "pair", "first_event", F.when(F.col("first_event") != "no_data", F.col("first_event") == "target_first").alias("hit"))


_CLOCKS = {"1030": 630, "1100": 660, "1130": 690, "1200": 720, "1300": 780, "1400": 840, "1500": 900, "1530": 930, "close": 10**6}
_SEG = (("morning", 0, 690), ("midday", 690, 840), ("afternoon", 840, 10**6))


@query(_T + "select sym, day, entry, " + ", ".join(f"round(case when {m} >= any_value(f.mod) then arg_max(c, idx) filter (mod <= {m}) / any_value(price) - 1 end, 6) as ret_to_{n}" for n, m in _CLOCKS.items()) + ", " + ", ".join(f"round(max(h) filter (idx > 0 and mod >= {a} and mod < {z}) / any_value(price) - 1, 6) as {n}_high, round(min(l) filter (idx > 0 and mod >= {a} and mod < {z}) / any_value(price) - 1, 6) as {n}_low" for n, a, z in _SEG) + ", round(arg_max(c, idx) / arg_min(o, idx) filter (idx > 0 and mod >= 900) - 1, 6) as power_hour, round(arg_max(c, idx) / max(h) filter (idx > 0) - 1, 6) as close_vs_high, round(arg_max(c, idx) / min(l) filter (idx > 0) - 1, 6) as close_vs_low from t where k = 0 group by sym, day, entry")
def day_segments(spark, d):
    """The rest of the entry day: returns to clock times, extremes of its parts after the entry bar, the last hour, the close against the extremes."""
    price, idx, mod = F.first("price"), F.col("idx"), F.col("mod")
    after = idx > 0
    part = lambda a, z: after & (mod >= a) & (mod < z)
    last = F.max_by("c", idx)
    to = [_r(F.max_by("c", F.when((mod <= m) & (F.col("f.mod") <= m), idx)) / price - 1).alias(f"ret_to_{n}") for n, m in _CLOCKS.items()]
    seg = [x for n, a, z in _SEG for x in (_r(F.max(F.when(part(a, z), F.col("h"))) / price - 1).alias(f"{n}_high"), _r(F.min(F.when(part(a, z), F.col("l"))) / price - 1).alias(f"{n}_low"))]
    rest = [_r(last / F.min_by("o", F.when(after & (mod >= 900), idx)) - 1).alias("power_hour"), _r(last / F.max(F.when(after, F.col("h"))) - 1).alias("close_vs_high"), _r(last / F.min(F.when(after, F.col("l"))) - 1).alias("close_vs_low")]
    g = follow(spark, d).where(F.col("k") == 0).groupBy(*W.KEY).agg(*to, *seg, *rest)
    return g.select(*_key(), *[c for c in g.columns if c not in W.KEY])


_UW = ["EOD", *W.DAYS]


@query(_T + ", x as (select he.horizon, he.e, t.* from t join he on he.sym = t.sym and he.day = t.day and he.entry = t.entry and t.idx <= he.e where he.horizon not in ('10min', '30min', '60min')), y as (select *, sign(c - price) as s, idx - row_number() over (partition by sym, day, entry, horizon, sign(c - price) order by idx) as island, min(case when c < price then idx end) over (partition by sym, day, entry, horizon) as fu from x), r as (select sym, day, entry, horizon, s, island, count(*) as n from y group by all), z as (select sym, day, entry, horizon, max(case when s > 0 then n end) as lo, max(case when s < 0 then n end) as lu from r group by all), w as (select sym, day, entry, horizon, avg((c > price)::int) as po, avg((c < price)::int) as pu, coalesce(min(case when c >= price and idx > fu then idx - fu end), 0) as ttr from y group by all) select he.sym, he.day, he.entry, he.horizon, round(po, 9) as profit_share, round(pu, 9) as under_share, case when po is not null then coalesce(lo, 0) end as longest_profit, case when po is not null then coalesce(lu, 0) end as longest_under, ttr as time_to_recover from he left join z using (sym, day, entry, horizon) left join w using (sym, day, entry, horizon) where he.horizon not in ('10min', '30min', '60min')")
def time_underwater(spark, d):
    """By closes to each of five horizons: shares above and below the entry, longest runs, bars until the first recovery (0 if none, or never below)."""
    n = F.col("idx") + 1
    return states(spark, d, _UW).select(*_key(), F.col("name").alias("horizon"), F.round(F.col("n_over") / n, 9).alias("profit_share"), F.round(F.col("n_under") / n, 9).alias("under_share"), F.col("longest_over").alias("longest_profit"), "longest_under", F.col("recovery").alias("time_to_recover"))


@query(_T + ", n as (select sym, i, arg_min(o, mod) as o, max(h) as h, min(l) as l, arg_max(c, mod) as c, " + ", ".join(f"arg_max(c, mod) filter (mod <= opens + {m}) as m{m}" for m in (5, 15, 30)) + " from rth group by sym, i) select fills.sym, fills.day, fills.entry, round(n.o / price - 1, 6) as open_return, round(n.o / z.c - 1, 6) as gap_return, " + ", ".join(f"round(n.m{m} / n.o - 1, 6) as first_{m}m_return" for m in (5, 15, 30)) + ", round(n.h / n.o - 1, 6) as high_return, round(n.l / n.o - 1, 6) as low_return, round(n.c / n.o - 1, 6) as close_return, round(case when n.h > n.l then (n.c - n.l) / (n.h - n.l) end, 6) as close_location, round(n.c / n.h - 1, 6) as fade_from_high, round(n.c / n.o - 1, 6) as continuation from fills join n z on z.sym = fills.sym and z.i = fills.i left join n on n.sym = fills.sym and n.i = fills.i + 1")
def next_day(spark, d):
    """The next trading day's session against its open and the entry; nulls if the symbol has no bar on it."""
    g = _days(spark, d)
    n, q = (lambda c: F.col(f"d1.{c}")), (lambda a, b: _r(F.when(b != 0, a / b) - 1))
    return g.select(
        *_key(), q(n("o"), F.col("price")).alias("open_return"), q(n("o"), F.col("d0.c")).alias("gap_return"), *[q(n(f"m{m}"), n("o")).alias(f"first_{m}m_return") for m in (5, 15, 30)],
        q(n("h"), n("o")).alias("high_return"), q(n("l"), n("o")).alias("low_return"), q(n("c"), n("o")).alias("close_return"), _r(F.when(n("h") > n("l"), (n("c") - n("l")) / (n("h") - n("l")))).alias("close_location"), q(n("c"), n("h")).alias("fade_from_high"), q(n("c"), n("o")).alias("continuation"),
    )


def _days(spark, d) -> DataFrame:
    """Each fill with the sessions d0 to d5 of its symbol, null where the symbol has no bar."""
    t = day_tape(spark, d).where(F.col("mod") >= W.OPEN)
    day = t.groupBy("sym", "blk", "D", "day", "k").agg(F.first("fills").alias("fills"), F.struct(F.min_by("o", "mod").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "mod").alias("c"), *[F.max_by("c", F.when(F.col("mod") <= F.col("opens") + m, F.col("mod"))).alias(f"m{m}") for m in (5, 15, 30)]).alias("s"))
    per = day.groupBy("sym", "blk", "D", "day").agg(F.first("fills").alias("fills"), *[F.max(F.when(F.col("k") == k, F.col("s"))).alias(f"d{k}") for k in range(6)])
    each = F.transform("fills", lambda x: F.struct(x.entry.alias("entry"), x.f.o.alias("price")))
    return per.select(*[c for c in per.columns if c != "fills"], F.inline(each)).where(F.col("price") > 0)


@query(_T + ", n as (select sym, i, arg_min(o, mod) as o, arg_max(c, mod) as c from rth group by sym, i), k as (select unnest([1, 2, 3, 4, 5]) as k) select fills.sym, fills.day, fills.entry, k.k::bigint as days, round(n.o / z.c - 1, 6) as gap, round(case when z.c is not null then n.c / n.o - 1 end, 6) as rth, round(n.c / z.c - 1, 6) as close_to_close from fills cross join k left join n on n.sym = fills.sym and n.i = fills.i + k.k left join n z on z.sym = fills.sym and z.i = fills.i + k.k - 1")
def gap_vs_rth(spark, d):
    """Gap and session of each of the five days after; a day without bars leaves itself and the day after it null."""
    q = lambda a, b: _r(F.when(b != 0, a / b) - 1)
    each = F.array(*[F.struct(F.lit(k).cast("bigint").alias("days"), q(F.col(f"d{k}.o"), F.col(f"d{k - 1}.c")).alias("gap"), F.when(F.col(f"d{k - 1}.c").isNotNull(), q(F.col(f"d{k}.c"), F.col(f"d{k}.o"))).alias("rth"), q(F.col(f"d{k}.c"), F.col(f"d{k - 1}.c")).alias("close_to_close")) for k in range(1, 6)])
    return _days(spark, d).select(*_key(), F.inline(each))


def _cp_case(c: str) -> str:
    if c == "EOD":
        return "max(case when k = 0 then idx end)"
    if c.endswith("_open"):
        return f"min(case when k = {c[0]} then idx end)"
    if c.endswith("_close"):
        return f"max(case when k = {c[0]} then idx end)"
    if c == "1d_30m":
        return "max(case when k = 1 and mod <= opens + 30 then idx end)"
    return f"max(case when k = 0 and mod <= f.mod + {c[:-1]} then idx end)"


_CPS = ", cps as (select sym, day, entry, unnest([" + ", ".join(f"struct_pack(checkpoint := '{c}', no := {j}, e := {_cp_case(c)})" for j, c in enumerate(W.CHECKPOINTS)) + "]) as z from t group by sym, day, entry), cp as (select sym, day, entry, z.checkpoint as checkpoint, z.no as no, z.e as e from cps)"


@query(_T + _CPS + ", r as (select *, case when idx > 0 then c / lag(c) over w - 1 end as r, case when k = lag(k) over w then mod - lag(mod) over w end as g from t window w as (partition by sym, day, entry order by idx)), sx as (select cp.sym, cp.day, cp.entry, cp.checkpoint, cp.no, cp.e, any_value(price) as p, any_value(atr) as atr, arg_max(c, idx) as c, max(h) as h, min(l) as l, max(c) as cm, min(c) as cn, sum(v) as v, sum(c * v) as q, avg((c > price)::int) as po, avg((c < price)::int) as pu, stddev_samp(r) as sd, bool_or(coalesce(g, 0) >= 5) as halt from cp left join r on r.sym = cp.sym and r.day = cp.day and r.entry = cp.entry and r.idx <= cp.e group by all), u as (select *, c / p - 1 as ret, last_value(case when e is not null then struct_pack(e := e, r := c / p - 1) end ignore nulls) over (partition by sym, day, entry order by no rows between unbounded preceding and 1 preceding) as b from sx) select sym, day, entry, checkpoint, e as bars_elapsed, round(ret, 6) as ret, round(h / p - 1, 6) as high_ret, round(l / p - 1, 6) as low_ret, round(cm / p - 1, 6) as close_max_ret, round(cn / p - 1, 6) as close_min_ret, v as volume, round(q, 2) as dollars, round(case when v > 0 then q / v end, 6) as vwap, round(po, 9) as profit_share, round(pu, 9) as under_share, round(sd, 6) as vol_within, round(case when e > coalesce(b.e, 0) then (ret - coalesce(b.r, 0)) / (e - coalesce(b.e, 0)) end, 8) + 0.0 as rate_of_change, round(case when atr > 0 then (c - p) / atr end, 6) as ret_over_atr, case when e is not null then halt end as halt_gap from u")
def checkpoint_path_state(spark, d):
    """State of the path from each fill at 23 checkpoints, a row each; nulls where a checkpoint has no bar."""
    g = states(spark, d, W.CHECKPOINTS, known=True).withColumn("ret", F.col("c") / F.col("price") - 1)
    before = Window.partitionBy("sym", "day", "entry").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("b", F.last(F.when(F.col("idx").isNotNull(), F.struct(F.col("idx").alias("e"), F.col("ret").alias("r"))), True).over(before))
    n, moved = F.col("idx"), F.col("idx") - F.coalesce("b.e", F.lit(0))
    var = (F.col("sr2") - F.col("sr") * F.col("sr") / n) / (n - 1)
    rel = lambda c: _r(F.col(c) / F.col("price") - 1)
    return g.select(
        *_key(), F.col("name").alias("checkpoint"), n.alias("bars_elapsed"), _r("ret").alias("ret"), rel("hi").alias("high_ret"), rel("lo").alias("low_ret"), rel("cmax").alias("close_max_ret"), rel("cmin").alias("close_min_ret"),
        "volume", F.round("dollars", 2).alias("dollars"), _r(F.when(F.col("volume") > 0, F.col("dollars") / F.col("volume"))).alias("vwap"), F.round(F.col("n_over") / (n + 1), 9).alias("profit_share"), F.round(F.col("n_under") / (n + 1), 9).alias("under_share"),
        _r(F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))).alias("vol_within"), (F.round(F.when(moved > 0, (F.col("ret") - F.coalesce("b.r", F.lit(0.0))) / moved), 8) + 0.0).alias("rate_of_change"),
        _r(F.when(F.col("atr") > 0, (F.col("c") - F.col("price")) / F.col("atr"))).alias("ret_over_atr"), (F.col("pause") >= 5).alias("halt_gap"),
    )


def intraday_returns(spark, d, checkpoints: tuple[int, ...]) -> DataFrame:
    """sym, day, entry, eod and r0, r1, ...: returns from each fill to its day's close and to so many minutes after it, in one grouped pass."""
    names = ["EOD", *[f"{k}m" for k in checkpoints]]
    x = states(spark, d, names)
    of = lambda n: F.max(F.when(F.col("name") == n, F.round(F.col("c") / F.col("price") - 1, 9)))
    return x.groupBy("sym", "day", "entry").agg(of("EOD").alias("eod"), *[of(f"{k}m").alias(f"r{j}") for j, k in enumerate(checkpoints)])


_M = (10, 30, 60)


@query(_T + "select sym, day, entry, " + ", ".join(f"round(arg_max(c, idx) filter (mod <= f.mod + {k}) / any_value(price) - 1, 6) as m{k}" for k in _M) + " from t where k = 0 group by sym, day, entry")
def pivot_paths(spark, d):
    """Long checkpoints pivoted to columns, with the values given."""
    names = [f"{k}m" for k in _M]
    x = states(spark, d, names).select(*_key(), "name", _r(F.col("c") / F.col("price") - 1).alias("ret"))
    p = x.groupBy("sym", "day", "entry").pivot("name", names).agg(F.first("ret"))
    return p.select("sym", "day", "entry", *[F.col(f"{k}m").alias(f"m{k}") for k in _M])
