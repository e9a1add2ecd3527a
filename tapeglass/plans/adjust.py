"""Queries on corporate actions and long horizons.

No table of splits or cash exists here, so a stated fixture stands for it, made by one rule from the
securities and symbols that there are, in Spark and in SQL alike:

- a security whose id ends in 1, 3 or 5 splits one into two on 2023-09-15, one that ends in 1 one into four on 2024-06-10 as well,
  one that ends in 2 or 4 ten into one on 2024-02-20; every split security has a split after the pin and one into nothing, which don't count;
- symbols that begin with X split one into three on 2024-01-10, known by symbol only;
- securities that end in A or B pay 0.5 on 2023-12-01 and 2024-05-15; symbols that begin with Z pay 0.25 on 2024-03-15, known by symbol only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.functions.timeline import valid_symbol
from tapeglass.operators import adjust, asof
from tapeglass.operators import forward as W
from tapeglass.operators import history as H
from tapeglass.plans import forward
from tapeglass.plans.panel import _P, panel
from tapeglass.plans.problems import _SYMBOL
from tapeglass.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PIN = "2024-12-31"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: fixed values of the fixture: last characters of ids, date, from, to
_BY_ID = [("135", "2023-09-15", 1.0, 2.0), ("1", "2024-06-10", 1.0, 4.0), ("24", "2024-02-20", 10.0, 1.0), ("12345", "2030-01-02", 1.0, 5.0), ("12345", "2023-03-01", 1.0, 0.0)]
_CASH = [("AB", "2023-12-01", 0.5), ("AB", "2024-05-15", 0.5)]


def _ids(spark, d) -> DataFrame:
    return table(spark, d, "day_session").select("security_id").where(F.col("security_id").isNotNull()).distinct()


def _symbols(spark, d) -> DataFrame:
    return table(spark, d, "day_session").select(valid_symbol(F.col("display_symbol")).alias("symbol")).distinct()


def splits(spark: SparkSession, d: str) -> DataFrame:
    last, day = F.substring("security_id", -1, 1), lambda x: F.lit(x).cast("date")
    each = F.array(*[F.struct(F.lit(c).alias("c"), day(x).alias("execution_date"), F.lit(a).alias("split_from"), F.lit(b).alias("split_to")) for c, x, a, b in _BY_ID])
    by_id = _ids(spark, d).select("security_id", F.lit(None).cast("string").alias("symbol"), F.inline(each)).where(F.instr(F.col("c"), last) > 0).drop("c")
    by_symbol = _symbols(spark, d).where(F.col("symbol").startswith("X")).select(F.lit(None).cast("string").alias("security_id"), "symbol", day("2024-01-10").alias("execution_date"), F.lit(1.0).alias("split_from"), F.lit(3.0).alias("split_to"))
    return by_id.unionByName(by_symbol)


def dividends(spark: SparkSession, d: str) -> DataFrame:
    last, day = F.substring("security_id", -1, 1), lambda x: F.lit(x).cast("date")
    each = F.array(*[F.struct(F.lit(c).alias("c"), day(x).alias("ex_date"), F.lit(a).alias("amount")) for c, x, a in _CASH])
    by_id = _ids(spark, d).select("security_id", F.lit(None).cast("string").alias("symbol"), F.inline(each)).where(F.instr(F.col("c"), last) > 0).drop("c")
    by_symbol = _symbols(spark, d).where(F.col("symbol").startswith("Z")).select(F.lit(None).cast("string").alias("security_id"), "symbol", day("2024-03-15").alias("ex_date"), F.lit(0.25).alias("amount"))
    return by_id.unionByName(by_symbol)


_FIX = f"""
ids as (select distinct security_id from day_session where security_id is not null), syms as (select distinct {_SYMBOL.format("display_symbol")} as symbol from day_session),
rule as (select * from (values {", ".join(f"('{c}', date '{x}', {a}, {b})" for c, x, a, b in _BY_ID)}) as v(c, ex, f, t)),
sp as (select security_id, null as symbol, ex, f, t from ids join rule on contains(c, right(security_id, 1)) union all select null, symbol, date '2024-01-10', 1.0, 3.0 from syms where symbol like 'X%'),
good as (select * from sp where ex <= date '{PIN}' and t <> 0),
dv as (select security_id, null as symbol, ex, 0.5 as amount from ids cross join (select unnest([date '2023-12-01', date '2024-05-15']) as ex) where contains('AB', right(security_id, 1)) union all select null, symbol, date '2024-03-15', 0.25 from syms where symbol like 'Z%')
"""


def adjusted(spark: SparkSession, d: str) -> DataFrame:
    """The panel with its valid symbol and split factor."""
    p = panel(spark, d).withColumn("symbol", valid_symbol(F.col("sym")))
    return adjust.split_factor(p, splits(spark, d), PIN, "security_id", "symbol", "day")


_ADJ = f"""a as (select p.*, {_SYMBOL.format("p.sym")} as symbol from p), ad as (select a.*, case when exists (select 1 from good where good.security_id = a.security_id) then coalesce((select product(f / t) from good where good.security_id = a.security_id and good.ex > a.day), 1.0)
  else coalesce((select product(f / t) from good where good.symbol = a.symbol and good.ex > a.day), 1.0) end as factor from a)"""


@query(_P + f", {_FIX}, {_ADJ} select security_id, strftime(day, '%Y-%m-%d') as day, symbol, round(factor, 9) as factor, round(c * factor, 6) as adjusted_close, round(v / factor, 4) as adjusted_volume, round(case when factor <> 0 then c * factor / factor end, 6) as recovered_close from ad")
def split_adjustment(spark, d):
    """Close and volume on the pin's basis, and the close recovered from it; splits by id outrank those by symbol."""
    x, f = adjusted(spark, d), F.col("factor")
    return x.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "symbol", F.round(f, 9).alias("factor"), F.round(F.col("c") * f, 6).alias("adjusted_close"), F.round(F.col("v") / f, 4).alias("adjusted_volume"), F.round(F.when(f != 0, F.col("c") * f / f), 6).alias("recovered_close"))


@query(_P + f", {_FIX}, s2 as (select p.security_id, p.day, {_SYMBOL.format('p.sym')} as symbol from p) select security_id, strftime(day, '%Y-%m-%d') as day, exists (select 1 from dv where dv.ex = s2.day and dv.security_id = s2.security_id) or exists (select 1 from dv where dv.ex = s2.day and dv.symbol = s2.symbol) as ex_today, exists (select 1 from good where abs(date_diff('day', good.ex, s2.day)) <= 3 and (good.security_id = s2.security_id or good.symbol = s2.symbol)) as near_split from s2")
def ex_date_flags(spark, d):
    """Sessions on an ex date and within three days of a split, by id or by symbol."""
    p = panel(spark, d).select("security_id", "day", valid_symbol(F.col("sym")).alias("symbol"))
    cash = dividends(spark, d).select("security_id", "symbol", F.col("ex_date").alias("at"), F.lit("cash").alias("what"))
    near = splits(spark, d).where((F.col("execution_date") <= F.lit(PIN).cast("date")) & (F.col("split_to") != 0)).select("security_id", "symbol", F.explode(F.sequence(F.date_sub("execution_date", 3), F.date_add("execution_date", 3))).alias("at"), F.lit("split").alias("what"))
    e = cash.unionByName(near)
    for c, name in (("security_id", "by_id"), ("symbol", "by_symbol")):
        keyed = e.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k"), F.col("at").alias("_at")).agg(F.collect_set("what").alias(name))  # two kinds
        p = p.join(keyed, (F.col(c) == F.col("_k")) & (F.col("day") == F.col("_at")), "left").drop("_k", "_at")
    has = lambda w: F.coalesce(F.array_contains("by_id", w), F.lit(False)) | F.coalesce(F.array_contains("by_symbol", w), F.lit(False))
    return p.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), has("cash").alias("ex_today"), has("split").alias("near_split"))


_LONG = (1, 2, 3, 5, 10, 21, 42, 63, 252)


@query(_P + f", {_FIX}, {_ADJ}, b as (select *, c * factor as ac from ad where c > 0), w as (select b.*, " + ", ".join(f"lead(ac, {h}) over (partition by security_id order by day) as e{h}, lead(day, {h}) over (partition by security_id order by day) as d{h}" for h in _LONG) + " from b), k as (select w.*, unnest([" + ", ".join(f"struct_pack(horizon := {h}, e := e{h}, z := d{h})" for h in _LONG) + "]) as x from w), c as (select k.security_id, k.day, k.ac, k.x.horizon as horizon, k.x.e as e, coalesce((select sum(amount) from dv where dv.security_id = k.security_id and dv.ex > k.day and dv.ex <= k.x.z), 0) as cash from k) select security_id, strftime(day, '%Y-%m-%d') as day, horizon::bigint as horizon, round(e / ac - 1, 6) as ret, round(case when e is not null then (e + cash) / ac - 1 end, 6) as total_ret, case when e is not null then cash > 0 end as ex_within from c")
def total_return_with_cash(spark, d):
    """Return over nine horizons of the security's own traded days, on the pin's basis, with and without the cash that went ex in them."""
    p = adjusted(spark, d).where(F.col("c") > 0).withColumn("ac", F.col("c") * F.col("factor"))
    p = adjust.cash_so_far(p, dividends(spark, d).where(F.col("security_id").isNotNull()), "security_id", "day")
    w = H.by_security()
    ahead = F.array(*[F.struct(F.lit(h).cast("bigint").alias("horizon"), F.col(f"x{h}.ac").alias("e"), F.col(f"x{h}.cash").alias("cash_then")) for h in _LONG])
    p = p.withColumns({f"x{h}": F.lead(F.struct("ac", "cash"), h).over(w) for h in _LONG}).select("security_id", "day", "ac", "cash", F.inline(ahead))
    paid = F.col("cash_then") - F.col("cash")
    there = F.col("e").isNotNull()
    return p.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "horizon", F.round(F.col("e") / F.col("ac") - 1, 6).alias("ret"), F.round(F.when(there, (F.col("e") + paid) / F.col("ac") - 1), 6).alias("total_ret"), F.when(there, paid > 1e-9).alias("ex_within"))


# long horizons from the entries ---------------------------------------------------------------------

LONG_DAYS = (10, 21, 42, 63, 252)
#: the entry day's path from each fill, its security, and that security's next 252 traded days
_LT = forward._T + f""",
d0 as (select sym, day, any_value(date) as date, entry, any_value(price) as price, any_value(atr) as atr, max(h) as h0, min(l) as l0, arg_max(c, idx) as c0 from t where k = 0 group by sym, day, entry),
pid as (select {_SYMBOL.format("sym")} as symbol, day, min(security_id) as security_id, count(*) as n from p group by 1, 2),
st0 as (select d0.*, p.security_id, p.idx as i0 from d0 join pid on pid.symbol = d0.sym and pid.day = d0.date and pid.n = 1 join p on p.security_id = pid.security_id and p.day = d0.date),
ah as (select st0.*, p.idx - st0.i0 as a, p.h, p.l, p.c from st0 left join p on p.security_id = st0.security_id and p.idx > st0.i0 and p.idx <= st0.i0 + 252)
"""


def _ahead(spark, d) -> DataFrame:
    """Each entry with its day's extremes and close from the fill on, joined with its security's next 252 traded days (``ahead``, h, l, c)."""
    f = forward.follow(spark, d, known=True).where(F.col("k") == 0)
    e = f.groupBy(*W.KEY).agg(F.first("price").alias("price"), F.max("ctx.atr").alias("atr"), F.max("h").alias("h0"), F.min("l").alias("l0"), F.max_by("c", "idx").alias("c0"))
    p = panel(spark, d).select(valid_symbol(F.col("sym")).alias("_sym"), F.col("day").alias("_day"), "security_id", "idx", "h", "l", "c")
    own = p.groupBy("_sym", "_day").agg(F.min(F.struct("security_id", F.col("idx").alias("i0"))).alias("x"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("_sym", "_day", "x.*")
    e = e.join(own, (F.col("sym") == F.col("_sym")) & (F.col("day") == F.col("_day"))).drop("_sym", "_day")
    return adjust.days_ahead(e, p.select("security_id", F.col("idx").alias("i0"), "h", "l", "c"), "security_id", "i0", max(LONG_DAYS))


_E = ["sym", "day", "entry", "price", "atr", "h0", "l0", "c0"]


def _iso():
    return [F.col("sym"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("entry")]


@query(_LT + ", g as (select ah.sym, ah.day, ah.entry, hh.h as hz, any_value(price) as p, any_value(h0) as h0, any_value(l0) as l0, any_value(c0) as c0, count(a) as n, arg_max(c, a) as e, max(ah.h) as mh, arg_max(a, row(ah.h, -a)) as mha, min(l) as ml, arg_min(a, row(l, a)) as mla, max(c) as mc, arg_max(a, row(c, -a)) as mca, min(c) as nc, arg_min(a, row(c, a)) as nca from ah cross join (select unnest([10, 21, 42, 63, 252]) as h) hh where a is null or a <= hh.h group by ah.sym, ah.day, ah.entry, hh.h) select sym, day, entry, hz::bigint as horizon, case when n >= hz then round(e / p - 1, 6) end as ret, case when n >= hz then round(greatest(mh, h0) / p - 1, 6) end as max_runup, case when n >= hz then case when mh > h0 then mha else 0 end end as days_to_max_runup, case when n >= hz then round(least(ml, l0) / p - 1, 6) end as max_drawdown, case when n >= hz then case when ml < l0 then mla else 0 end end as days_to_max_drawdown, case when n >= hz then round(greatest(mc, c0) / p - 1, 6) end as close_max_ret, case when n >= hz then case when mc > c0 then mca else 0 end end as days_to_close_max, case when n >= hz then round(least(nc, c0) / p - 1, 6) end as close_min_ret, case when n >= hz then case when nc < c0 then nca else 0 end end as days_to_close_min from g")
def long_horizons(spark, d):
    """Five horizons of the security's own traded days after each entry, day 0 being the rest of the entry day; null with fewer days."""
    x = _ahead(spark, d)
    a, aggs = F.col("ahead"), []
    for h in LONG_DAYS:
        i = a <= h
        back = (-a).alias("n")
        aggs.append(F.struct(F.lit(h).cast("bigint").alias("horizon"), F.count(F.when(i, a)).alias("n"), F.max_by("c", F.when(i, a)).alias("e"), F.max(F.when(i, F.struct("h", back))).alias("mh"), F.min(F.when(i, F.struct("l", a.alias("n")))).alias("ml"), F.max(F.when(i, F.struct("c", back))).alias("mc"), F.min(F.when(i, F.struct("c", a.alias("n")))).alias("nc")))
    g = x.groupBy(*_E).agg(F.array(*aggs).alias("z")).select(*_E, F.inline("z"))
    full, price = F.col("n") >= F.col("horizon"), F.col("price")
    r = lambda c: F.round(F.when(full, c / price - 1), 6)
    at = lambda better, n: F.when(full, F.when(better, n).otherwise(F.lit(0)))
    c = F.col
    return g.select(
        *_iso(), "horizon", r(c("e")).alias("ret"), r(F.greatest("mh.h", "h0")).alias("max_runup"), at(c("mh.h") > c("h0"), -c("mh.n")).alias("days_to_max_runup"), r(F.least("ml.l", "l0")).alias("max_drawdown"), at(c("ml.l") < c("l0"), c("ml.n")).alias("days_to_max_drawdown"),
        r(F.greatest("mc.c", "c0")).alias("close_max_ret"), at(c("mc.c") > c("c0"), -c("mc.n")).alias("days_to_close_max"), r(F.least("nc.c", "c0")).alias("close_min_ret"), at(c("nc.c") < c("c0"), c("nc.n")).alias("days_to_close_min"),
    )


_LINES = forward._LINES


def _line(kind: str, x: float, up: bool, sql: bool = True):
    sign = "+" if up else "-"
    return f"price * (1 {sign} {x!r})" if kind == "pct" else f"price {sign} {x!r} * atr"


_SIDES = [(k, n, x, s) for k, n, x in _LINES for s in ("up", "down")]
_hit = lambda k, x, s, zero: (f"h0 >= {_line(k, x, True)}" if zero else f"h >= {_line(k, x, True)}") if s == "up" else (f"l0 <= {_line(k, x, False)}" if zero else f"l <= {_line(k, x, False)}")


@query(_LT + ", g as (select sym, day, entry, any_value(atr) as atr, count(a) as n, unnest([" + ", ".join(f"struct_pack(kind := '{k}', threshold := '{n}', side := '{s}', first := case when any_value({_hit(k, x, s, True)}) then 0 else min(case when {_hit(k, x, s, False)} then a end) end)" for k, n, x, s in _SIDES) + "]) as z from ah group by sym, day, entry) select sym, day, entry, hh.h::bigint as horizon, z.kind as kind, z.threshold as threshold, z.side as side, case when n < hh.h or (z.kind = 'atr' and not coalesce(atr > 0, false)) then null when z.first <= hh.h then z.first + 1 else 0 end as day_no from g cross join (select unnest([10, 21, 42, 63, 252]) as h) hh")
def long_crossings(spark, d):
    """Day of the first touch of 13 lines up and down within each long horizon: the entry day is 1, 0 means never, null no such horizon or no true range."""
    price, atr, a = F.col("price"), F.col("atr"), F.col("ahead")
    first = []
    for k, n, x, s in _SIDES:
        zero = F.expr(_hit(k, x, s, True))
        later = F.min(F.when(F.expr(_hit(k, x, s, False)), a))
        first.append(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("threshold"), F.lit(s).alias("side"), F.when(F.max(zero), F.lit(0).cast("bigint")).otherwise(later).alias("first")))
    g = _ahead(spark, d).groupBy(*_E).agg(F.count("ahead").alias("n"), F.array(*first).alias("z"))
    g = g.select(*_E, "n", F.inline("z")).withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("bigint") for h in LONG_DAYS])))
    none = (F.col("n") < F.col("horizon")) | ((F.col("kind") == "atr") & ~F.coalesce(atr > 0, F.lit(False)))
    return g.select(*_iso(), "horizon", "kind", "threshold", "side", F.when(none, F.lit(None)).when(F.col("first") <= F.col("horizon"), F.col("first") + 1).otherwise(0).cast("bigint").alias("day_no"))


@query(_LT + ", g as (select sym, day, entry, any_value(atr) as atr, count(a) as n, case when any_value(h0 >= price + 3.0 * atr) then 0 else min(case when h >= price + 3.0 * atr and a <= 21 then a end) end as up, case when any_value(l0 <= price - 1.5 * atr) then 0 else min(case when l <= price - 1.5 * atr and a <= 21 then a end) end as dn from ah group by sym, day, entry), v as (select *, case when n < 21 or not coalesce(atr > 0, false) then 'no_data' when dn is not null and (up is null or dn <= up) then 'stop_first' when up is not null then 'target_first' else 'neither' end as first_event from g) select sym, day, entry, first_event, case when first_event <> 'no_data' then first_event = 'target_first' end as hit from v")
def pair_21d(spark, d):
    """Whether 3 true ranges up or 1.5 down came first from each entry within 21 traded days; both on one day count as the stop."""
    a = F.col("ahead")
    cross = lambda zero, later: F.when(F.max(F.expr(zero)), F.lit(0).cast("bigint")).otherwise(F.min(F.when(F.expr(later) & (a <= 21), a)))
    g = _ahead(spark, d).groupBy(*_E).agg(F.count("ahead").alias("n"), cross("h0 >= price + 3.0D * atr", "h >= price + 3.0D * atr").alias("up"), cross("l0 <= price - 1.5D * atr", "l <= price - 1.5D * atr").alias("dn"))
    event = F.when((F.col("n") < 21) | ~F.coalesce(F.col("atr") > 0, F.lit(False)), "no_data").when(F.col("dn").isNotNull() & (F.col("up").isNull() | (F.col("dn") <= F.col("up"))), "stop_first").when(F.col("up").isNotNull(), "target_first").otherwise("neither")
    return g.withColumn("first_event", event).select(*_iso(), "first_event", F.when(F.col("first_event") != "no_data", F.col("first_event") == "target_first").alias("hit"))


# identity -------------------------------------------------------------------------------------------


@query(_P + f", a as (select p.*, {_SYMBOL.format('p.sym')} as symbol from p), d as (select symbol, day from a group by symbol, day having count(*) > 1), f as (select a.security_id, min(a.day) as first_clash from a join d on d.symbol = a.symbol and d.day = a.day group by a.security_id), r as (select security_id, min(day) as first_multi from (select security_id, day from day_session where security_id is not null group by security_id, day having count(distinct {_SYMBOL.format('display_symbol')}) > 1) group by security_id), x as (select p.*, r.first_multi from p left join r using (security_id)), y as (select *, count(case when first_multi is null or day < first_multi then 1 end) over (partition by security_id order by day rows between 20 preceding and 1 preceding) as n, avg(case when first_multi is null or day < first_multi then q end) over (partition by security_id order by day rows between 20 preceding and 1 preceding) as m from x) select security_id, strftime(day, '%Y-%m-%d') as day, strftime(first_multi, '%Y-%m-%d') as first_collision, coalesce(day >= first_multi, false) as purged, round(case when n = 20 and (first_multi is null or day <= first_multi) then m end, 5) as addv_20 from y")
def collision_purge(spark, d):
    """Trailing figures of securities seen under two symbols on one day: history stops before that day, the day itself still reads it, all later days have none."""
    s = table(spark, d, "day_session").where(F.col("security_id").isNotNull()).groupBy("security_id", "day").agg(F.countDistinct(valid_symbol(F.col("display_symbol"))).alias("n")).where(F.col("n") > 1)
    first = s.groupBy("security_id").agg(F.min("day").alias("first_collision"))
    p = panel(spark, d).join(first, "security_id", "left")
    good = F.col("first_collision").isNull() | (F.col("day") < F.col("first_collision"))
    w = H.prior(20)
    n, m = F.count(F.when(good, 1)).over(w), F.avg(F.when(good, F.col("q"))).over(w)
    seen = F.col("first_collision").isNull() | (F.col("day") <= F.col("first_collision"))
    return p.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("first_collision", "yyyy-MM-dd").alias("first_collision"), F.coalesce(F.col("day") >= F.col("first_collision"), F.lit(False)).alias("purged"), F.round(F.when((n == 20) & seen, m), 5).alias("addv_20"))


@query("with " + _FIX + f", ev as (select distinct security_id, {_SYMBOL.format('new_ticker')} as symbol, event_date as d0 from ticker_events where security_id is not null), w as (select security_id, symbol, d0, lead(d0) over (partition by security_id order by d0, symbol) as d1 from ev), ask as (select distinct security_id, day from day_session where security_id is not null), h as (select ask.security_id, ask.day, arg_min(w.symbol, row(w.d0, w.symbol)) as symbol from ask join w on w.security_id = ask.security_id and w.d0 <= ask.day and (w.d1 is null or ask.day < w.d1) group by all) select ask.security_id, strftime(ask.day, '%Y-%m-%d') as day, coalesce(h.symbol, ask.security_id) as resolved from ask left join h on h.security_id = ask.security_id and h.day = ask.day")
def resolve_forward(spark, d):
    """The symbol a security had on each of its days, by its first covering window; without one the id itself."""
    from tapeglass.operators import identity

    e = table(spark, d, "ticker_events").where(F.col("security_id").isNotNull()).select("security_id", valid_symbol(F.col("new_ticker")).alias("symbol"), F.col("event_date").alias("day"))
    w = identity.validity_windows(e, e.select("security_id", "symbol").limit(0)).withColumnRenamed("security_id", "_s")
    ask = table(spark, d, "day_session").where(F.col("security_id").isNotNull()).select("security_id", "day").distinct()
    on = (F.col("security_id") == F.col("_s")) & (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    h = ask.join(w, on).groupBy("security_id", "day").agg(F.min_by("symbol", F.struct("valid_from", "symbol")).alias("symbol"))
    return ask.join(h, ["security_id", "day"], "left").select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("symbol", "security_id").alias("resolved"))


_L = f"l as (select security_id, {_SYMBOL.format('display_symbol')} as symbol, ticker_type, primary_exchange, as_of_date from tickers)"


@query(_P + f", {_L}, bi as (select security_id, arg_max(struct_pack(t := ticker_type, x := primary_exchange), row(as_of_date, coalesce(ticker_type, ''), coalesce(primary_exchange, ''))) as r from l where security_id is not null group by 1), bs as (select symbol, arg_min(struct_pack(t := ticker_type, x := primary_exchange), row(as_of_date, coalesce(ticker_type, ''), coalesce(primary_exchange, ''))) as r from l group by 1), s2 as (select security_id, {_SYMBOL.format('display_symbol')} as symbol, day from day_session), u as (select distinct * from s2) select u.security_id, u.symbol, strftime(u.day, '%Y-%m-%d') as day, case when bi.r is not null then bi.r.t else bs.r.t end as ticker_type, case when bi.r is not null then bi.r.x else bs.r.x end as primary_exchange, case when bi.r is not null then 'id' when bs.r is not null then 'symbol' end as found_by from u left join bi on bi.security_id = u.security_id left join bs on bs.symbol = u.symbol")
def reference_lookup(spark, d):
    """Listing of every delivered session, by id if it has one there (the newest row), else by symbol (the oldest row)."""
    t = table(spark, d, "tickers").withColumn("symbol", valid_symbol(F.col("display_symbol")))
    r, order = F.struct("ticker_type", "primary_exchange"), F.struct("as_of_date", F.coalesce("ticker_type", F.lit("")), F.coalesce("primary_exchange", F.lit("")))
    by_id = t.where(F.col("security_id").isNotNull()).groupBy(F.col("security_id").alias("_i")).agg(F.max_by(r, order).alias("a"))
    by_sym = t.groupBy(F.col("symbol").alias("_s")).agg(F.min_by(r, order).alias("b"))
    u = table(spark, d, "day_session").select("security_id", valid_symbol(F.col("display_symbol")).alias("symbol"), "day").distinct()
    j = u.join(by_id, F.col("security_id") == F.col("_i"), "left").join(by_sym, F.col("symbol") == F.col("_s"), "left")
    x = F.when(F.col("a").isNotNull(), F.col("a")).otherwise(F.col("b"))
    return j.select("security_id", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), x["ticker_type"].alias("ticker_type"), x["primary_exchange"].alias("primary_exchange"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "symbol").alias("found_by"))


@query("with s as (select distinct security_id, day from day_session where security_id is not null), e as (select security_id, coalesce(cast(timezone('America/New_York', acceptance_datetime) as date), filing_date) as day, max(case when acceptance_datetime is null then 'unknown' when hour(timezone('America/New_York', acceptance_datetime)) * 60 + minute(timezone('America/New_York', acceptance_datetime)) < 570 then 'before_open' when hour(timezone('America/New_York', acceptance_datetime)) * 60 + minute(timezone('America/New_York', acceptance_datetime)) < 960 then 'during_market' else 'after_close' end) as timing from financials where security_id is not null and timeframe = 'quarterly' group by 1, 2) select s.security_id, strftime(s.day, '%Y-%m-%d') as day, e.day is not null as earnings_today, e.timing, strftime(b.day, '%Y-%m-%d') as last_earnings, s.day - b.day as days_since from s left join e on e.security_id = s.security_id and e.day = s.day asof left join e b on b.security_id = s.security_id and b.day <= s.day")
def earnings_on_day(spark, d):
    """Whether a quarterly report came on a session's day and when in the day, and the days since the last one."""
    from tapeglass.functions.timeline import local_date, local_minute

    t = F.col("acceptance_datetime")
    m = local_minute(t)
    timing = F.when(t.isNull(), "unknown").when(m < 570, "before_open").when(m < 960, "during_market").otherwise("after_close")
    e = table(spark, d, "financials").where(F.col("security_id").isNotNull() & (F.col("timeframe") == "quarterly")).groupBy("security_id", F.coalesce(local_date(t), "filing_date").alias("at")).agg(F.max(timing).alias("timing"))
    s = table(spark, d, "day_session").where(F.col("security_id").isNotNull()).select("security_id", "day").distinct()
    j = asof.asof_backward(s, e, "security_id", "day", "at", F.struct("at", "timing"), "e")
    today = F.coalesce(F.col("e.at") == F.col("day"), F.lit(False))
    return j.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), today.alias("earnings_today"), F.when(today, F.col("e.timing")).alias("timing"), F.date_format("e.at", "yyyy-MM-dd").alias("last_earnings"), F.datediff("day", "e.at").cast("bigint").alias("days_since"))


@query("with f as (select distinct filing_id, security_id, filing_date, split_part(source_filing_url, '/', -1) as accession, acceptance_datetime as t from financials where source_filing_url is not null), b as (select accession, max(t) as t from f where t is not null group by 1), o as (select * from f where filing_id % 3 <> 0 or t is null) select f.filing_id, f.accession, epoch_us(coalesce(case when f.filing_id % 3 <> 0 then f.t end, b.t)) as accepted_us, case when f.filing_id % 3 <> 0 and f.t is not null then 'own' when b.t is not null then 'by_accession' else 'none' end as source from f left join b on b.accession = f.accession")
def acceptance_backfill(spark, d):
    """Acceptance times: a filing's own, else the one known for its accession number.  Filings with an id divisible by 3 stand for those that lost theirs."""
    f = table(spark, d, "financials").where(F.col("source_filing_url").isNotNull()).select("filing_id", F.substring_index("source_filing_url", "/", -1).alias("accession"), F.col("acceptance_datetime").alias("t"), "security_id", "filing_date").distinct()
    b = f.where(F.col("t").isNotNull()).groupBy(F.col("accession").alias("_a")).agg(F.max("t").alias("known"))
    own = F.when(F.col("filing_id") % 3 != 0, F.col("t"))
    j = f.join(b, F.col("accession") == F.col("_a"), "left")
    return j.select("filing_id", "accession", F.unix_micros(F.coalesce(own, "known")).alias("accepted_us"), F.when(own.isNotNull(), "own").when(F.col("known").isNotNull(), "by_accession").otherwise("none").alias("source"))


@query("with q as (select distinct security_id, filing_id, end_date, basic_earnings_per_share as eps from financials where security_id is not null and timeframe = 'quarterly' and end_date is not null), a as (select distinct security_id, filing_id, end_date from financials where security_id is not null and timeframe = 'annual' and end_date is not null), q1 as (select security_id, end_date, arg_min(eps, filing_id) as eps from q group by 1, 2), j as (select a.security_id, a.filing_id, a.end_date, count(*) as n, count(q1.eps) as known, sum(case when not isnan(q1.eps) then q1.eps end) as s from a join q1 on q1.security_id = a.security_id and a.end_date - q1.end_date between 60 and 340 group by all) select security_id, filing_id, strftime(end_date, '%Y-%m-%d') as end_date, round(s, 6) as three_quarters from j where n = 3")
def fiscal_year_containment(spark, d):
    """Annual filings with exactly three quarters that end 60 to 340 days before, and what these earned together."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull() & F.col("end_date").isNotNull())
    q = f.where(F.col("timeframe") == "quarterly").groupBy(F.col("security_id").alias("_s"), F.col("end_date").alias("_e")).agg(F.min_by("basic_earnings_per_share", F.struct("filing_id", "basic_earnings_per_share")).alias("eps"))
    q = q.withColumn("_b", F.explode(F.sequence(F.floor((F.unix_date("_e") + 60) / 340), F.floor((F.unix_date("_e") + 340) / 340))))
    a = f.where(F.col("timeframe") == "annual").select("security_id", "filing_id", "end_date").distinct().withColumn("_at", F.floor(F.unix_date("end_date") / 340))
    j = a.join(q, (F.col("security_id") == F.col("_s")) & (F.col("_at") == F.col("_b")) & F.datediff("end_date", "_e").between(60, 340))
    g = j.groupBy("security_id", "filing_id", "end_date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.nanvl("eps", F.lit(None))).alias("s")).where(F.col("n") == 3)
    return g.select("security_id", "filing_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.round("s", 6).alias("three_quarters"))
