"""Queries over the reference tables: identity, as-of joins, filings, classification, sets and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import local_date, local_minute, valid_symbol
from tapeglass.operators import asof, identity
from tapeglass.plans.problems import _SYMBOL, standing_sessions
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


def _iso(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


_EV = f"ev as (select distinct security_id, {_SYMBOL.format('new_ticker')} as symbol, event_date as day from ticker_events)"
_LI = f"li as (select security_id, max({_SYMBOL.format('display_symbol')}) as symbol from tickers where security_id is not null group by security_id)"
_WIN = f"{_EV}, {_LI}, win as (select security_id, symbol, day as valid_from, lead(day) over (partition by security_id order by day, symbol) as valid_to from ev union all select security_id, symbol, null, null from li where security_id not in (select security_id from ev))"


def _windows(spark, d) -> DataFrame:
    e = table(spark, d, "ticker_events").select("security_id", valid_symbol(F.col("new_ticker")).alias("symbol"), F.col("event_date").alias("day"))
    li = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.max(valid_symbol(F.col("display_symbol"))).alias("symbol"))
    return identity.validity_windows(e, li)


@query(f"with {_WIN} select security_id, symbol, strftime(valid_from, '%Y-%m-%d') as valid_from, strftime(valid_to, '%Y-%m-%d') as valid_to from win")
def validity_windows(spark, d):
    return _windows(spark, d).select("security_id", "symbol", _iso("valid_from"), _iso("valid_to"))


@query(f"with {_WIN}, r as (select distinct {_SYMBOL.format('display_symbol')} as symbol, day from day_session where security_id is null), h as (select r.symbol, r.day, min(win.security_id) as a, max(win.security_id) as z from r join win on win.symbol = r.symbol and (win.valid_from is null or win.valid_from <= r.day) and (win.valid_to is null or r.day < win.valid_to) group by all) select r.symbol, strftime(r.day, '%Y-%m-%d') as day, case when h.a = h.z then h.a end as resolved_id from r left join h using (symbol, day)")
def resolve_interval_ambiguous(spark, d):
    """Sessions that lost their id, resolved through the validity windows; two claims give none."""
    r = table(spark, d, "day_session").where(F.col("security_id").isNull()).select(valid_symbol(F.col("display_symbol")).alias("symbol_"), "day").distinct()
    return identity.resolve(r, _windows(spark, d), "symbol_", "day").select(F.col("symbol_").alias("symbol"), _iso("day"), "resolved_id")


@query(f"select security_id, strftime(day, '%Y-%m-%d') as day, count(distinct {_SYMBOL.format('display_symbol')}) as symbols from day_session where security_id is not null group by security_id, day having count(distinct {_SYMBOL.format('display_symbol')}) > 1")
def identity_collisions(spark, d):
    s = table(spark, d, "day_session").select("security_id", "day", valid_symbol(F.col("display_symbol")).alias("symbol"))
    return identity.collisions(s).select("security_id", _iso("day"), "symbols")


_SES = "s as (select security_id, day, arg_max(struct_pack(c := rth_close, v := volume), row(ingested_at, display_symbol, rth_open, rth_high, rth_low, rth_close, volume, dollar_volume)) as r from day_session where security_id is not null group by all)"


@query(f"with {_SES}, f as (select security_id, filing_date, max(struct_pack(a := basic_average_shares, b := filing_id)) as r from financials where security_id is not null and basic_average_shares > 0 and not isnan(basic_average_shares) group by all) select s.security_id, strftime(s.day, '%Y-%m-%d') as day, f.r.b as filing_id, s.day - f.filing_date as days_since, round(s.r.c * f.r.a, 0) as market_cap, case when s.r.c * f.r.a >= 1e10 then 'large' when s.r.c * f.r.a >= 2e9 then 'mid' when s.r.c * f.r.a is not null then 'small' end as cap_bucket from s asof left join f on f.security_id = s.security_id and f.filing_date <= s.day")
def asof_backward(spark, d):
    """Shares as of each session's day (by filing date, ties to the larger count), market cap and its bucket."""
    s = standing_sessions(spark, d).select("security_id", "day", F.col("rth_close").alias("c"))
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull() & (F.col("basic_average_shares") > 0) & ~F.isnan("basic_average_shares"))
    j = asof.asof_backward(s, f, "security_id", "day", "filing_date", F.struct(F.col("basic_average_shares").alias("a"), F.col("filing_id").alias("b"), "filing_date"), "f")
    cap = F.col("c") * F.col("f.a")
    return j.select("security_id", _iso("day"), F.col("f.b").alias("filing_id"), F.datediff("day", "f.filing_date").cast("bigint").alias("days_since"), F.round(cap, 0).alias("market_cap"), F.when(cap >= 1e10, "large").when(cap >= 2e9, "mid").when(cap.isNotNull(), "small").alias("cap_bucket"))


@query(f"with {_SES}, f as (select distinct security_id, filing_id, filing_date from financials where security_id is not null) select f.security_id, f.filing_id, strftime(s.day, '%Y-%m-%d') as session_day from f asof left join s on s.security_id = f.security_id and s.day >= f.filing_date")
def asof_forward(spark, d):
    """First session at or after each filing."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull()).select("security_id", "filing_id", "filing_date").distinct()
    j = asof.asof_forward(f, standing_sessions(spark, d), "security_id", "filing_date", "day", "session_day")
    return j.select("security_id", "filing_id", _iso("session_day"))


@query("with f as (select distinct security_id, filing_id, filing_date from financials where security_id is not null), s as (select security_id, settlement_date, max(short_interest) as si from short_interest where security_id is not null group by all), j as (select f.*, s.settlement_date, s.si, row_number() over (partition by f.security_id, f.filing_id, f.filing_date order by s.settlement_date desc) as rn from f join s on s.security_id = f.security_id and f.filing_date - s.settlement_date between 0 and 120) select security_id, filing_id, strftime(settlement_date, '%Y-%m-%d') as settlement_date, si as short_interest from j where rn = 1")
def latest_within_lag(spark, d):
    """Newest short interest at most 120 days before each filing."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull()).select("security_id", "filing_id", "filing_date").distinct()
    s = table(spark, d, "short_interest").where(F.col("security_id").isNotNull()).groupBy("security_id", "settlement_date").agg(F.max("short_interest").alias("short_interest"))
    return asof.latest_within(f, s, "security_id", "filing_date", "settlement_date", 120, []).select("security_id", "filing_id", _iso("settlement_date"), "short_interest")


@query("with s as (select distinct security_id, day from day_session where security_id is not null), f as (select distinct security_id, filing_id, filing_date from financials where security_id is not null) select s.security_id, strftime(s.day, '%Y-%m-%d') as day, count(f.filing_id) as filings_30d from s left join f on f.security_id = s.security_id and s.day - f.filing_date between 1 and 30 group by all")
def trailing_30d_range_join(spark, d):
    """Filings in the 30 days before each session, 0 if none: filings are spread to the days they count for, then equi joined."""
    s = table(spark, d, "day_session").where(F.col("security_id").isNotNull()).select("security_id", "day").distinct()
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull()).select("security_id", "filing_id", "filing_date").distinct()
    n = f.select("security_id", F.explode(F.sequence(F.date_add("filing_date", 1), F.date_add("filing_date", 30))).alias("day")).groupBy("security_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, ["security_id", "day"], "left").select("security_id", _iso("day"), F.coalesce("n", F.lit(0)).alias("filings_30d"))


@query("with f as (select distinct filing_id, security_id, filing_date, coalesce(timeframe, '') as k from financials where security_id is not null) select distinct a.filing_id from f a join f b on b.security_id = a.security_id and a.filing_date - b.filing_date between 0 and 30 and b.k <> a.k")
def cluster_self_join(spark, d):
    """Filings with another of the security's filings, of another timeframe, in the 30 days up to them."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull()).select("filing_id", "security_id", F.unix_date("filing_date").alias("t"), F.coalesce("timeframe", F.lit("")).alias("k")).distinct()
    w = Window.partitionBy("security_id").orderBy("t").rangeBetween(-30, 0)
    return f.withColumn("kinds", F.size(F.collect_set("k").over(w))).where(F.col("kinds") > 1).select("filing_id").distinct()  # a handful of timeframes


@query(f"select distinct {_SYMBOL.format('display_symbol')} as symbol, strftime(day, '%Y-%m-%d') as day from day_session s where not exists (select 1 from bars_1m_raw b where b.display_symbol = {_SYMBOL.format('s.display_symbol')} and cast(timezone('America/New_York', b.t) as date) = s.day)")
def anti_join(spark, d):
    """Sessions of which there are no minute bars."""
    s = table(spark, d, "day_session").select(valid_symbol(F.col("display_symbol")).alias("symbol"), "day").distinct()
    b = table(spark, d, "bars_1m_raw").select(F.col("display_symbol").alias("symbol"), local_date(F.col("t")).alias("day")).distinct()
    return s.join(b, ["symbol", "day"], "left_anti").select("symbol", _iso("day"))


@query("with a as (select security_id, count(*) as filings from financials where security_id is not null group by 1), b as (select security_id, count(*) as settlements from short_interest where security_id is not null group by 1) select coalesce(a.security_id, b.security_id) as security_id, filings, settlements from a full join b on a.security_id = b.security_id")
def full_outer_coalesce(spark, d):
    a = table(spark, d, "financials").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.count(F.lit(1)).alias("filings"))
    b = table(spark, d, "short_interest").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.count(F.lit(1)).alias("settlements"))
    return a.join(b, "security_id", "full")


@query("select security_id, strftime(day, '%Y-%m-%d') as day from (select distinct security_id, day from day_session where security_id is not null) s where exists (select 1 from ticker_events e where e.security_id = s.security_id and e.event_date = s.day)")
def semi_join(spark, d):
    """Sessions on the day of a rename."""
    s = table(spark, d, "day_session").where(F.col("security_id").isNotNull()).select("security_id", "day").distinct()
    e = table(spark, d, "ticker_events").select("security_id", F.col("event_date").alias("day"))
    return s.join(e, ["security_id", "day"], "left_semi").select("security_id", _iso("day"))


_Q = "case when fiscal_period like 'Q%' then fiscal_period else 'FY' end"


@query(f"with f as (select distinct filing_id, security_id, fiscal_year || '-' || {_Q} as period, filing_date, acceptance_datetime as t from financials where security_id is not null and fiscal_year is not null and fiscal_period in ('Q1', 'Q2', 'Q3', 'Q4', 'FY')), k as (select *, row_number() over (partition by security_id, period order by filing_date, t nulls last, filing_id) as rn, count(*) over (partition by security_id, period) - 1 as revisions, hour(timezone('America/New_York', t)) * 60 + minute(timezone('America/New_York', t)) as m, cast(timezone('America/New_York', t) as date) as td from f) select security_id, period, strftime(coalesce(td, filing_date), '%Y-%m-%d') as report_date, revisions, case when t is null then 'unknown' when m < 570 then 'before_open' when m < 960 then 'during_market' else 'after_close' end as timing from k where rn = 1")
def earnings_first_and_revisions(spark, d):
    """First report of each fiscal period, how often it was filed again, and when in the day it came."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isin("Q1", "Q2", "Q3", "Q4", "FY"))
    f = f.select("filing_id", "security_id", F.concat_ws("-", "fiscal_year", "fiscal_period").alias("period"), "filing_date", F.col("acceptance_datetime").alias("t")).distinct()
    w = Window.partitionBy("security_id", "period")
    k = f.withColumns({"rn": F.row_number().over(w.orderBy("filing_date", F.col("t").asc_nulls_last(), "filing_id")), "revisions": F.count(F.lit(1)).over(w) - 1}).where(F.col("rn") == 1)
    m = local_minute(F.col("t"))
    timing = F.when(F.col("t").isNull(), "unknown").when(m < 570, "before_open").when(m < 960, "during_market").otherwise("after_close")
    return k.select("security_id", "period", F.date_format(F.coalesce(local_date(F.col("t")), "filing_date"), "yyyy-MM-dd").alias("report_date"), "revisions", timing.alias("timing"))


@query("select distinct filing_id, try_cast(json_extract_string(financials_json, '$.rev') as double) as revenue, split_part(source_filing_url, '/', -1) as accession, replace(replace(replace(ticker, '.', ''), '-', ''), '/', '') as plain_ticker, regexp_extract(source_filing_url, '([0-9]+)-([0-9]{2})-([0-9]+)$', 2) as filed_year from financials")
def json_url_text_picks(spark, d):
    """A JSON path, the last segment of a URL, a normalised symbol and a regex group."""
    f = table(spark, d, "financials")
    return f.select("filing_id", F.get_json_object("financials_json", "$.rev").try_cast("double").alias("revenue"), F.substring_index("source_filing_url", "/", -1).alias("accession"), F.regexp_replace("ticker", "[./-]", "").alias("plain_ticker"), F.regexp_extract("source_filing_url", "([0-9]+)-([0-9]{2})-([0-9]+)$", 2).alias("filed_year")).distinct()


@query("with s as (select distinct day from day_session), e as (select distinct event_date as day from ticker_events) select strftime(day, '%Y-%m-%d') as day, 'both' as kind from (select day from s intersect select day from e) union all select strftime(day, '%Y-%m-%d'), 'event_only' from (select day from e except select day from s)")
def intersect_except_days(spark, d):
    s = table(spark, d, "day_session").select("day")
    e = table(spark, d, "ticker_events").select(F.col("event_date").alias("day"))
    return s.intersect(e).select(_iso("day"), F.lit("both").alias("kind")).unionByName(e.subtract(s).select(_iso("day"), F.lit("event_only").alias("kind")))


@query("with f as (select distinct security_id, filing_id, end_date, basic_earnings_per_share as eps from financials where security_id is not null and timeframe = 'quarterly' and basic_earnings_per_share is not null and not isnan(basic_earnings_per_share) and end_date is not null), o as (select *, row_number() over (partition by security_id, end_date order by filing_id) as rn from f), u as (select security_id, end_date, eps from o where rn = 1), y as (select a.security_id, a.end_date, a.eps - b.eps as diff, row_number() over (partition by a.security_id, a.end_date order by b.end_date desc) as rn from u a join u b on b.security_id = a.security_id and a.end_date - b.end_date between 350 and 380), z as (select security_id, end_date, diff from y where rn = 1), w as (select *, count(diff) over q as n, stddev_samp(diff) over q as sd from z window q as (partition by security_id order by end_date rows between 8 preceding and 1 preceding)) select security_id, strftime(end_date, '%Y-%m-%d') as end_date, round(diff, 6) as diff, round(case when n >= 4 and sd > 0 then greatest(-6, least(6, diff / sd)) end, 6) as sue from w")
def sue_clip(spark, d):
    """Standardised surprise: change against the quarter a year ago over the deviation of up to eight changes before."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull() & (F.col("timeframe") == "quarterly") & F.col("end_date").isNotNull() & F.col("basic_earnings_per_share").isNotNull() & ~F.isnan("basic_earnings_per_share"))
    u = f.groupBy("security_id", "end_date").agg(F.min_by(F.col("basic_earnings_per_share"), F.struct("filing_id", "basic_earnings_per_share")).alias("eps"))
    b = u.select(F.col("security_id").alias("s2"), F.col("end_date").alias("e2"), F.col("eps").alias("eps2"))
    y = u.join(b, (F.col("security_id") == F.col("s2")) & F.datediff("end_date", "e2").between(350, 380))
    z = y.groupBy("security_id", "end_date", "eps").agg(F.max_by("eps2", "e2").alias("was")).withColumn("diff", F.col("eps") - F.col("was"))
    q = Window.partitionBy("security_id").orderBy("end_date").rowsBetween(-8, -1)
    sd = F.stddev_samp("diff").over(q)
    z = z.withColumns({"n": F.count("diff").over(q), "sd": sd})
    clipped = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.col("diff") / F.col("sd")))
    return z.select("security_id", _iso("end_date"), F.round("diff", 6).alias("diff"), F.round(F.when((F.col("n") >= 4) & (F.col("sd") > 0), clipped), 6).alias("sue"))
