"""The queries p1 to p7 on the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import MINUTE, floor_div, local_date, local_minute, midnight_micros, valid_symbol
from tapeglass.operators import bitemporal, known_at, multiselect, regular_grid, stamps, trailing, work_ledger
from tapeglass.session import cut, remove, shared_folder
from tapeglass.sources.tables import table


def standing_sessions(spark: SparkSession, d: str, rest: list[str] | None = None) -> DataFrame:
    """day_session: of each security and day the delivery ingested last (ties: the greater row), with the columns ``rest``."""
    s = table(spark, d, "day_session").where(F.col("security_id").isNotNull())
    rest = rest or ["display_symbol", "rth_open", "rth_high", "rth_low", "rth_close", "volume", "dollar_volume"]
    return s.groupBy("security_id", "day").agg(F.max(F.struct("ingested_at", *rest)).alias("r")).select("security_id", "day", "r.*")


# p1 -----------------------------------------------------------------------------------------------


def symbol_statements(spark: SparkSession, d: str) -> DataFrame:
    """What says which symbol a security has: sessions, and above them rename events.

    An event has no time of record in its table; it counts as known from its date on.
    """
    s = table(spark, d, "day_session").select("security_id", valid_symbol(F.col("display_symbol")).alias("display_symbol"), F.col("day").alias("valid_from"), F.col("ingested_at").alias("recorded_at"), F.lit(0).alias("rank"))
    e = table(spark, d, "ticker_events").select("security_id", valid_symbol(F.col("new_ticker")).alias("display_symbol"), F.col("event_date").alias("valid_from"), F.timestamp_micros(F.unix_date("event_date").cast("bigint") * 86_400_000_000).alias("recorded_at"), F.lit(1).alias("rank"))
    return s.unionByName(e).where(F.col("display_symbol").isNotNull())


def symbol_ledger(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal.bitemporal_ledger(symbol_statements(spark, d), ["security_id"], "display_symbol", "valid_from", "recorded_at", "rank")


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger of symbols, superseded rows included; recorded times in microseconds."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return symbol_ledger(spark, d).select("security_id", "display_symbol", day("valid_from"), day("valid_to"), F.unix_micros("recorded_from").alias("recorded_from_us"), F.unix_micros("recorded_to").alias("recorded_to_us"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal.standing(symbol_ledger(spark, d)).select("security_id", "display_symbol", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


_SYMBOL = "regexp_replace(upper(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '^([A-Z0-9]+)[^A-Z0-9]([A-Z])$', '\\1.\\2')"
P1_SQL = f"""
with s as (
  select security_id, day as d, {_SYMBOL.format("display_symbol")} as x, 0 as pr,
         row_number() over (partition by security_id, day order by ingested_at desc, display_symbol desc) as rn
  from day_session where security_id is not null),
t as (select security_id, d, x, pr from s where rn = 1
      union all select security_id, event_date, {_SYMBOL.format("new_ticker")}, 1 from ticker_events),
o as (select *, row_number() over (partition by security_id, d order by pr desc, x desc) as k from t),
v as (select security_id, d, x, lag(x) over (partition by security_id order by d) as px from o where k = 1)
select security_id, x as display_symbol, strftime(d, '%Y-%m-%d') as valid_from from v where px is null or px <> x
"""

#: the ledger read anew at every recorded time of a security, equal readings in a row put together
P1_HISTORY_SQL = f"""
with st as (select security_id, day as v, {_SYMBOL.format("display_symbol")} as x, epoch_us(ingested_at) as ra, 0 as pr from day_session where security_id is not null
      union all select security_id, event_date, {_SYMBOL.format("new_ticker")}, epoch_us(cast(event_date as timestamp)), 1 from ticker_events where security_id is not null and event_date is not null),
ts as (select *, lead(t) over (partition by security_id order by t) as nt, row_number() over (partition by security_id order by t) as i from (select distinct security_id, ra as t from st)),
b as (select ts.security_id, t, i, nt, v, arg_max(x, row(pr, ra, x)) as x from st join ts on st.security_id = ts.security_id and st.ra <= ts.t group by all),
c as (select *, lag(x) over (partition by security_id, t order by v) as px from b),
e as (select *, lead(v) over (partition by security_id, t order by v) as vt from c where px is null or px <> x),
g as (select *, i - row_number() over (partition by security_id, x, v, vt order by i) as island from e)
select security_id, x as display_symbol, strftime(v, '%Y-%m-%d') as valid_from, strftime(vt, '%Y-%m-%d') as valid_to, min(t) as recorded_from_us, arg_max(row(nt), i)[1] as recorded_to_us
from g group by security_id, x, v, vt, island
"""

# p2 -----------------------------------------------------------------------------------------------


def known_facts(spark: SparkSession, d: str) -> DataFrame:
    """Filings with a share count and short interest settlements, with the time each became known."""
    f = table(spark, d, "financials").where((F.col("basic_average_shares") > 0) & ~F.isnan("basic_average_shares"))
    told = F.coalesce(F.col("acceptance_datetime"), F.timestamp_micros(midnight_micros(F.date_add("filing_date", 1))))
    f = f.select("security_id", F.lit("filing").alias("kind"), F.col("filing_id").cast("string").alias("ref_key"), told.alias("valid_from"), told.alias("recorded_at"), F.struct(F.col("basic_average_shares").alias("a"), F.col("filing_id").alias("b")).alias("rank"))
    s = table(spark, d, "short_interest").where(F.col("settlement_date").isNotNull())
    s = s.select(
        "security_id", F.lit("short_interest").alias("kind"), F.date_format("settlement_date", "yyyy-MM-dd").alias("ref_key"),
        F.timestamp_micros(midnight_micros(F.col("settlement_date"))).alias("valid_from"), F.timestamp_micros(midnight_micros(F.date_add("settlement_date", 8))).alias("recorded_at"),
        F.struct(F.lit(0.0).alias("a"), F.lit(0).cast("bigint").alias("b")).alias("rank"),
    )
    return f.unionByName(s)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "per_trade_summary").select("trade_id", "security_id", "entry_t")
    found = known_at.locate(trades, known_facts(spark, d), ["security_id"], "entry_t", "ref_key", "valid_from", "recorded_at", rank="rank", extra=["kind"])
    return found.select("trade_id", "kind", "ref_key")


P2_SQL = """
with t as (select distinct trade_id, security_id, entry_t from per_trade_summary where security_id is not null and entry_t is not null),
f as (select security_id, filing_id, basic_average_shares as sh,
        coalesce(acceptance_datetime, timezone('America/New_York', cast(filing_date + 1 as timestamp))) as k
      from financials where basic_average_shares > 0 and not isnan(basic_average_shares) and security_id is not null),
f1 as (select security_id, k, filing_id from (select *, row_number() over (partition by security_id, k order by sh desc, filing_id desc) as rn from f) where rn = 1),
s as (select distinct security_id, settlement_date, timezone('America/New_York', cast(settlement_date + 8 as timestamp)) as k
      from short_interest where security_id is not null)
select t.trade_id, 'filing' as kind, cast(f1.filing_id as varchar) as ref_key from t asof join f1 on t.security_id = f1.security_id and t.entry_t >= f1.k
union all
select t.trade_id, 'short_interest', strftime(s.settlement_date, '%Y-%m-%d') from t asof join s on t.security_id = s.security_id and t.entry_t >= s.k
"""

# p3 -----------------------------------------------------------------------------------------------


def p3_grid(spark: SparkSession, d: str, values: dict | None = None, carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """One-minute series of each symbol and New York day's regular session, with ``values`` per minute; ``carry`` is held over up to 4 minutes.

    ``whole``: from 09:30 to 15:59, also where a day's readings begin later or end sooner.
    """
    b = table(spark, d, "bars_1m_raw").where((F.col("volume") > 0) & ~F.isnan("volume"))
    b = b.where(local_minute(F.col("t")).between(570, 959)).withColumn("day", local_date(F.col("t")))
    opens = floor_div(midnight_micros(F.col("day")), MINUTE) + 570
    return regular_grid.regular_grid(b, ["display_symbol", "day"], floor_div(F.unix_micros("t"), MINUTE), values or {}, carry or [], max_gap=4, bounds=(opens, opens + 389) if whole else None)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.gaps(p3_grid(spark, d), ["display_symbol", "day"], 5).select("display_symbol", "gap_from", "gap_to")


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    """Every minute of the regular session of each symbol and day with a reading: read, carried or missing."""
    newest = F.struct("t", F.coalesce("transactions", F.lit(-1)), "open", "close", "volume")
    values = {"open": F.min_by("open", newest), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", newest), "readings": F.count(F.lit(1))}
    g = p3_grid(spark, d, values, ["close"], whole=True)
    return g.select("display_symbol", F.col("bucket").alias("minute"), "state", F.col("since").cast("bigint").alias("since"), "close", F.coalesce("readings", F.lit(0)).cast("bigint").alias("readings"))


P3_SQL = """
with b as (select distinct display_symbol, epoch_us(t) // 60000000 as m, cast(timezone('America/New_York', t) as date) as day
           from bars_1m_raw where volume > 0 and not isnan(volume)
           and hour(timezone('America/New_York', t)) * 60 + minute(timezone('America/New_York', t)) between 570 and 959),
g as (select display_symbol, lag(m) over (partition by display_symbol, day order by m) as gap_from, m as gap_to from b)
select display_symbol, gap_from, gap_to from g where gap_to - gap_from >= 5
"""

P3_SERIES_SQL = """
with b as (select display_symbol, t, cast(timezone('America/New_York', t) as date) as day, epoch_us(t) // 60000000 as m, close, row(t, coalesce(transactions, -1), open, close, volume) as k
           from bars_1m_raw where volume > 0 and not isnan(volume) and display_symbol is not null
           and hour(timezone('America/New_York', t)) * 60 + minute(timezone('America/New_York', t)) between 570 and 959),
r as (select display_symbol, day, m, arg_max(close, k) as close, count(*) as n from b group by all),
g as (select display_symbol, day, epoch_us(timezone('America/New_York', cast(day as timestamp))) // 60000000 + 570 + unnest(range(390)) as m from (select distinct display_symbol, day from r)),
f as (select g.*, r.close, r.n, last_value(case when r.m is not null then struct_pack(m := r.m, c := r.close) end ignore nulls) over (partition by g.display_symbol, g.day order by g.m) as l
      from g left join r on r.display_symbol = g.display_symbol and r.day = g.day and r.m = g.m)
select display_symbol, m as minute, case when n is not null then 'read' when m - l.m <= 4 then 'carried' else 'missing' end as state, m - l.m as since, case when m - l.m <= 4 then l.c end as close, coalesce(n, 0) as readings from f
"""

# p4 -----------------------------------------------------------------------------------------------


def work_events(spark: SparkSession, d: str) -> DataFrame:
    """The work ledger's log of the flat files, by table, day and shard: offers of ready files, writes finished, and leases of runs that died.

    A write finished the version that was the last complete one when its bookmark was set.  A bookmark
    without a finish is a lease that ran out; when it was taken isn't known, so it has the lowest token.
    """
    log = table(spark, d, "download_state").select(F.col("date").alias("day"), "shard", "state_seq", "status", "bytes", "etag", "completed_at").where(F.col("day").isNotNull() & F.col("shard").isNotNull())
    marks = table(spark, d, "day_done").where(F.col("table_name").isNotNull())
    timed = lambda df, name: stamps.normalise_stamps(df, "completed_at", None, "UTC", first_year=1970, last_year=2200, micros=name)
    last = log.groupBy("day", "shard").agg(F.max(F.struct("state_seq", "status", "bytes", "etag")).alias("r")).select("day", "shard", "r.*")
    ready = last.where((F.col("status") == "done") & (F.col("bytes") > 0))
    # the kinds of tables, a handful, as one row
    names = F.broadcast(marks.agg(F.collect_set("table_name").alias("_names")))
    offers = ready.crossJoin(names).select(F.explode("_names").alias("table_name"), "day", "shard", F.lit("offer").alias("kind"), F.col("etag").alias("version"), F.col("state_seq").alias("token"))
    marked = timed(marks, "b").groupBy("table_name", "day", "shard").agg(F.max("b").alias("b"), F.max(F.col("b").isNull()).alias("died"))
    complete = timed(log.where(F.col("status") == "done"), "c").where(F.col("c").isNotNull()).groupBy("day", "shard").agg(F.sort_array(F.collect_set(F.struct("state_seq", "c", "etag"))).alias("all"))  # a file's deliveries
    at = marked.join(complete, ["day", "shard"])
    done = F.try_element_at(F.filter("all", lambda x: x.c <= F.col("b")), F.lit(-1))
    newest = F.try_element_at("all", F.lit(-1))
    event = lambda kind, r, token: F.struct(F.lit(kind).alias("kind"), r["etag"].alias("version"), token.cast("bigint").alias("token"))
    told = F.filter(F.array(F.when(done.isNotNull(), event("done", done, done["state_seq"])), F.when(F.col("died"), event("lease", newest, F.lit(-1)))), lambda e: e.isNotNull())
    told = at.select("table_name", "day", "shard", told.alias("told")).select("table_name", "day", "shard", F.inline("told"))
    return offers.unionByName(told).withColumns({"until": F.when(F.col("kind") == "lease", F.lit(0)).cast("bigint"), "worker": F.lit(None).cast("string")})


def work_state(spark: SparkSession, d: str) -> DataFrame:
    return work_ledger.fold(work_events(spark, d), ["table_name", "day", "shard"], now=1)


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """Every write a ready file asks for: pending or done, and the version it is about."""
    return work_state(spark, d).where(F.col("state") != "withdrawn").select("table_name", "day", "shard", "state", "version")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return work_state(spark, d).where(F.col("state") == "pending").select("table_name", "day", "shard")


def p4_run(spark: SparkSession, d: str) -> DataFrame:
    """The writes of ``p4_found`` taken through a stored ledger, with a run that dies and a writer that comes back too late.

    The first run leases everything and stops; its leases run out.  The second leases everything again
    and finishes the even shards, the first one then reports all of it under its old tokens, which
    changes nothing.  The ledger is compacted, and what the next run has to do is read from the snapshot.
    """
    item = F.to_json(F.struct("table_name", "day", "shard"))
    todo = cut(work_state(spark, d).where(F.col("state") == "pending").select(item.alias("item"), "version"))
    root = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger, every = work_ledger.WorkLedger(spark, root), todo.count()
    ledger.offer(todo, 0)
    first = ledger.lease("first", every, now=0, seconds=60)
    second = ledger.lease("second", every, now=100, seconds=60)
    even = F.get_json_object("item", "$.shard").cast("int") % 2 == 0
    ledger.done(second.where(even), "second", 110)
    ledger.done(first, "first", 120)
    ledger.compact()
    left = cut(ledger.state(1000))
    remove(spark, root)
    k = F.from_json("item", "table_name string, day string, shard int")
    return left.select(k.alias("k"), "state").select("k.*", "state")


P4_SQL = """
with l as (select *, cast(replace(completed_at, 'Z', '+00:00') as timestamptz) as c from download_state),
f as (select date as day, shard, arg_max(struct_pack(s := status, b := bytes, e := etag), state_seq) as r from l group by all),
m as (select table_name, day, shard, max(cast(case when completed_at ~ '(Z|[+-][0-9][0-9]:[0-9][0-9])$' then replace(completed_at, 'Z', '+00:00') else completed_at || '+00:00' end as timestamptz)) as b
      from day_done where completed_at is not null group by all),
t as (select distinct table_name from day_done),
g as (select m.table_name, m.day, m.shard, arg_max(struct_pack(e := l.etag), l.state_seq) as r
      from m join l on l.date = m.day and l.shard = m.shard and l.status = 'done' and l.c <= m.b group by all)
select t.table_name, f.day, f.shard from f cross join t left join g on g.table_name = t.table_name and g.day = f.day and g.shard = f.shard
where f.r.s = 'done' and f.r.b > 0 and (g.r is null or g.r.e is distinct from f.r.e)
"""

_P4_CASE = "where f.r.s = 'done' and f.r.b > 0 and (g.r is null or g.r.e is distinct from f.r.e)"
P4_STATE_SQL = P4_SQL.replace("select t.table_name, f.day, f.shard from", "select t.table_name, f.day, f.shard, case when g.r is null or g.r.e is distinct from f.r.e then 'pending' else 'done' end as state, f.r.e as version from").replace(_P4_CASE, "where f.r.s = 'done' and f.r.b > 0")
P4_RUN_SQL = P4_SQL.replace("select t.table_name, f.day, f.shard from", "select t.table_name, f.day, f.shard, case when f.shard % 2 = 0 then 'done' else 'pending' end as state from")

# p5 -----------------------------------------------------------------------------------------------


def p5_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Every raw stamp with its instant, or the reason why it has none."""
    return stamps.normalise_stamps(table(spark, d, "raw_stamps"), "raw_value", "feed_zone").select("record_id", "origin", "source_key", "raw_value", "feed_zone", "utc_micros", "stamp_status")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose rows agree on one instant."""
    per = stamps.normalise_stamps(table(spark, d, "raw_stamps"), "raw_value", "feed_zone").groupBy("record_id").agg(F.min("utc_micros").alias("utc_micros"), F.max("utc_micros").alias("most"))
    return per.where(F.col("utc_micros") == F.col("most")).select("record_id", "utc_micros")


# p6 -----------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = trailing.trailing_totals(standing_sessions(spark, d, ["volume"]), ["security_id"], "day", {"volume": F.col("volume")}, [7])
    return t.where(F.col("volume_7d_total") == 0).select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _digits(name: str) -> int:
    """Decimals that means of cents and hundredths of cents never split in half."""
    return 4 if name.endswith("_total") else 6 if name.startswith("spread") else 5


def p6_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals and means of volume, dollars and daily range over 7, 20 and 30 calendar days."""
    t = trailing.trailing_totals(standing_sessions(spark, d), ["security_id"], "day", {"volume": F.col("volume"), "dollars": F.col("dollar_volume"), "spread": F.col("rth_high") - F.col("rth_low")}, [7, 20, 30])
    cols = [c for c in t.columns if c not in ("security_id", "day")]
    return t.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.col(c) if c.endswith("_days") else F.round(c, _digits(c)).alias(c) for c in cols])


_STANDING = """
s as (select security_id, day, arg_max(struct_pack(v := volume, q := dollar_volume, w := rth_high - rth_low),
        row(ingested_at, display_symbol, rth_open, rth_high, rth_low, rth_close, volume, dollar_volume)) as r
      from day_session where security_id is not null group by all),
c as (select security_id, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from s group by security_id),
x as (select c.security_id, c.day, s.r.v as v, s.r.q as q, s.r.w as w from c left join s on s.security_id = c.security_id and s.day = c.day)
"""
P6_SQL = f"""
with {_STANDING},
t as (select security_id, day, sum(coalesce(v, 0)) over (partition by security_id order by day rows between 6 preceding and current row) as v7 from x)
select security_id, strftime(day, '%Y-%m-%d') as day from t where v7 = 0
"""


def _p6_trailing_sql() -> str:
    cols = []
    for v, n in (("volume", "v"), ("dollars", "q"), ("spread", "w")):
        for k in (7, 20, 30):
            over = f"over (partition by security_id order by day rows between {k - 1} preceding and current row)"
            cols += [f"round(coalesce(sum({n}) {over}, 0), 4) as {v}_{k}d_total", f"count({n}) {over} as {v}_{k}d_days", f"round(coalesce(sum({n}) {over}, 0) / {k}, {6 if v == "spread" else 5}) as {v}_{k}d_mean"]
    return f"with {_STANDING} select security_id, strftime(day, '%Y-%m-%d') as day, {', '.join(cols)} from x"


def p6_volatility(spark: SparkSession, d: str) -> DataFrame:
    """addv_20d, atr_14d and yang_zhang_vol_14d over calendar days, those without activity included, up to and with the day.

    A day without a session adds no dollars, no range and returns of zero; a figure needs its whole
    window inside the security's calendar.  The estimator's parts come as sums from the range join.
    """
    from tapeglass.operators.history import with_returns

    p = standing_sessions(spark, d).select("security_id", "day", *[F.col(f"rth_{a}").alias(a[0]) for a in ("open", "high", "low", "close")], F.coalesce("dollar_volume", F.lit(0.0)).alias("q"))
    p = with_returns(p)
    parts = {"q": F.col("q"), "tr": F.coalesce("tr", F.col("h") - F.col("l")), "on": F.col("on"), "on2": F.col("on") * F.col("on"), "oc": F.col("oc"), "oc2": F.col("oc") * F.col("oc"), "rs": F.col("rs")}
    t = trailing.trailing_totals(p, ["security_id"], "day", parts, [14, 20])
    age = F.datediff("day", F.min("day").over(Window.partitionBy("security_id"))) + 1
    n, k = 14, 0.34 / (1.34 + 15 / 13)
    x = lambda c: F.col(f"{c}_14d_total")
    var = lambda c: (x(f"{c}2") - x(c) * x(c) / n) / (n - 1)
    yz = var("on") + k * var("oc") + (1 - k) * x("rs") / n
    t = t.withColumns({"age": age, "yz": yz})
    return t.select(
        "security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("age") >= 20, F.round(F.col("q_20d_mean"), 4)).alias("addv_20d"),
        F.when(F.col("age") >= 14, F.round("tr_14d_mean", 6)).alias("atr_14d"), F.when((F.col("age") >= 14) & (F.col("yz") >= 0), F.round(F.sqrt(F.col("yz") * 252), 5)).alias("yang_zhang_vol_14d"),
    )


_K14 = 0.34 / (1.34 + 15 / 13)
P6_VOL_SQL = f"""
with s as (select security_id, day, arg_max(struct_pack(o := rth_open, h := rth_high, l := rth_low, c := rth_close, q := dollar_volume), row(ingested_at, display_symbol, rth_open, rth_high, rth_low, rth_close, volume, dollar_volume)) as r from day_session where security_id is not null group by all),
p0 as (select security_id, day, r.o as o, r.h as h, r.l as l, r.c as c, coalesce(r.q, 0) as q, lag(r.c) over (partition by security_id order by day) as pc from s),
p as (select security_id, day, q, case when pc is not null then greatest(h - l, abs(h - pc), abs(l - pc)) else h - l end as tr, case when pc > 0 and o > 0 and h > 0 and l > 0 and c > 0 then ln(o / pc) end as n, case when o > 0 and h > 0 and l > 0 and c > 0 then ln(c / o) end as oc, case when o > 0 and h > 0 and l > 0 and c > 0 then ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) end as rs from p0),
cal as (select security_id, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from p group by 1),
x as (select cal.security_id, cal.day, coalesce(q, 0) as q, coalesce(tr, 0) as tr, coalesce(n, 0) as n, coalesce(oc, 0) as oc, coalesce(rs, 0) as rs from cal left join p on p.security_id = cal.security_id and p.day = cal.day),
y as (select *, row_number() over w as age, avg(q) over (partition by security_id order by day rows between 19 preceding and current row) as addv, avg(tr) over f as atr, var_samp(n) over f + {_K14!r} * var_samp(oc) over f + {1 - _K14!r} * avg(rs) over f as yz from x window w as (partition by security_id order by day), f as (partition by security_id order by day rows between 13 preceding and current row))
select security_id, strftime(day, '%Y-%m-%d') as day, case when age >= 20 then round(addv, 4) end as addv_20d, case when age >= 14 then round(atr, 6) end as atr_14d, case when age >= 14 and yz >= 0 then round(sqrt(yz * 252), 5) end as yang_zhang_vol_14d from y
"""

# p7 -----------------------------------------------------------------------------------------------

PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def standing_trades(spark: SparkSession, d: str) -> DataFrame:
    """per_trade_summary: of each trade the delivery ingested last (ties: the greater row)."""
    t = table(spark, d, "per_trade_summary")
    kept = ["addv_20d", "realized_vol_21d", "config_id"]
    own = F.struct("ingested_at", *kept)
    return t.groupBy("trade_id", "security_id", "entry_t").agg(F.max(own).alias("r")).select("trade_id", "security_id", "entry_t", "r.config_id", "r.addv_20d", "r.realized_vol_21d")


#: values of a group in one run of the queries below
RUN_ROWS = 100_000


def trade_runs(trades: DataFrame) -> DataFrame:
    groups = {"config": F.col("config_id"), "day": local_date(F.col("entry_t")), "security": F.col("security_id")}
    return multiselect.sorted_runs(trades, groups, {"addv_20d": F.col("addv_20d"), "realized_vol_21d": F.col("realized_vol_21d")})


def _p7_columns(p: DataFrame) -> DataFrame:
    return p.select("grouping", F.col("grp").alias("group_key"), "measure", "n", *[F.col("values")[j].alias(f"p{round(100 * q)}") for j, q in enumerate(PROBS)])


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of two trailing figures by New York entry day, security and config, of the standing deliveries."""
    return _p7_columns(multiselect.percentiles(trade_runs(standing_trades(spark, d)), list(PROBS), RUN_ROWS))


def p7_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same from runs stored for each half of the trades and put together afterwards, nothing sorted anew."""
    root, trades = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}", standing_trades(spark, d)
    half = F.pmod(F.col("trade_id"), F.lit(2)) == 0
    for name, part in (("a", trades.where(half)), ("b", trades.where(~half))):
        multiselect.store_runs(trade_runs(part), f"{root}/{name}")
    out = cut(_p7_columns(multiselect.percentiles(multiselect.stored_runs(spark, [f"{root}/a", f"{root}/b"]), list(PROBS), RUN_ROWS)))
    remove(spark, root)
    return out


def _p7_sql() -> str:
    groups = {"config": "cast(config_id as varchar)", "day": "strftime(timezone('America/New_York', entry_t), '%Y-%m-%d')", "security": "security_id"}
    parts = []
    for g, e in groups.items():
        for m in ("addv_20d", "realized_vol_21d"):
            q = ", ".join(f"quantile_disc({m}, {p}) as p{round(100 * p)}" for p in PROBS)
            parts.append(f"select '{g}' as grouping, {e} as group_key, '{m}' as measure, count(*) as n, {q} from t where {m} is not null and not isnan({m}) and {e} is not null group by all")
    head = "with t as (select trade_id, security_id, entry_t, r.config_id, r.addv_20d, r.realized_vol_21d from (select trade_id, security_id, entry_t, max(struct_pack(a := ingested_at, addv_20d := addv_20d, realized_vol_21d := realized_vol_21d, config_id := config_id)) as r from per_trade_summary group by all)) "
    return head + " union all ".join(parts)


QUERIES = {
    "p1_found": p1_found, "p1_history": p1_history, "p2_found": p2_found, "p3_found": p3_found, "p3_series": p3_series, "p4_found": p4_found, "p4_state": p4_state, "p4_run": p4_run,
    "p5_found": p5_found, "p5_stamps": p5_stamps, "p6_found": p6_found, "p6_trailing": p6_trailing, "p6_volatility": p6_volatility, "p7_percentiles": p7_percentiles, "p7_combined": p7_combined,
}
SQL = {"p1_found": P1_SQL, "p1_history": P1_HISTORY_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL, "p3_series": P3_SERIES_SQL, "p4_found": P4_SQL, "p4_state": P4_STATE_SQL, "p4_run": P4_RUN_SQL, "p6_found": P6_SQL, "p6_trailing": _p6_trailing_sql(), "p6_volatility": P6_VOL_SQL, "p7_percentiles": _p7_sql(), "p7_combined": _p7_sql()}
