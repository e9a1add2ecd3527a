"""Point-in-time classification: market cap, buckets, flags, tags, sectors; the market's context of a day; regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import valid_symbol
from tapeglass.operators import asof
from tapeglass.operators import bars as B
from tapeglass.operators import history as H
from tapeglass.operators import ranking as R
from tapeglass.plans import adjust as A
from tapeglass.plans.panel import _MKT, _P, _W, panel
from tapeglass.plans.problems import _SYMBOL
from tapeglass.plans.tape import _B, bars
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


# fixed values: upper edges of the buckets (below the edge), the last one open
CAP = [(300e6, "micro"), (2e9, "small"), (10e9, "mid"), (200e9, "large"), (None, "mega")]
LIQUIDITY = [(1e6, "illiquid"), (10e6, "thin"), (100e6, "normal"), (1e9, "liquid"), (None, "highly_liquid")]
PRICE = [(1.0, "sub_1"), (5.0, "1_to_5"), (20.0, "5_to_20"), (100.0, "20_to_100"), (None, "above_100")]
VOLATILITY = [(0.25, "low"), (0.50, "medium"), (1.0, "high"), (None, "extreme")]
# fixed values: industry codes, first match wins
SIC = [
    (100, 999, "Consumer Staples", "Agriculture"), (1000, 1299, "Materials", "Metals & Mining"), (1300, 1399, "Energy", "Oil & Gas"), (1400, 1499, "Materials", "Mining & Quarrying"),
    (1500, 1799, "Industrials", "Construction"), (2000, 2199, "Consumer Staples", "Food, Beverage & Tobacco"), (2200, 2399, "Consumer Discretionary", "Textiles & Apparel"),
    (2400, 2499, "Materials", "Wood Products"), (2500, 2599, "Consumer Discretionary", "Furniture"), (2600, 2699, "Materials", "Paper"), (2700, 2799, "Communication Services", "Publishing"),
    (2834, 2835, "Healthcare", "Pharmaceuticals"), (2836, 2836, "Healthcare", "Biotechnology"), (2800, 2899, "Materials", "Chemicals"), (2900, 2999, "Energy", "Petroleum Refining"),
    (3000, 3199, "Consumer Discretionary", "Rubber, Plastics & Leather"), (3200, 3299, "Materials", "Stone, Clay & Glass"), (3300, 3499, "Materials", "Metals"),
    (3570, 3579, "Technology", "Computer Hardware"), (3500, 3599, "Industrials", "Machinery"), (3674, 3674, "Technology", "Semiconductors"), (3600, 3699, "Technology", "Electronics"),
    (3711, 3716, "Consumer Discretionary", "Automobiles"), (3700, 3799, "Industrials", "Transportation Equipment"), (3841, 3851, "Healthcare", "Medical Devices"),
    (3800, 3839, "Industrials", "Instruments"), (3860, 3999, "Consumer Discretionary", "Misc Manufacturing"), (4000, 4799, "Industrials", "Transportation"),
    (4800, 4899, "Communication Services", "Telecommunications"), (4900, 4999, "Utilities", "Utilities"), (5000, 5199, "Consumer Discretionary", "Wholesale"),
    (5400, 5499, "Consumer Staples", "Food Retail"), (5200, 5999, "Consumer Discretionary", "Retail"), (6022, 6022, "Financials", "Regional Banks"), (6000, 6099, "Financials", "Banks"),
    (6100, 6199, "Financials", "Credit Services"), (6200, 6299, "Financials", "Capital Markets"), (6300, 6499, "Financials", "Insurance"), (6500, 6599, "Real Estate", "Real Estate"),
    (6798, 6798, "Real Estate", "REITs"), (6600, 6799, "Financials", "Investment Offices"), (7000, 7299, "Consumer Discretionary", "Consumer Services"),
    (7370, 7379, "Technology", "Software & IT Services"), (7300, 7399, "Industrials", "Business Services"), (7400, 7799, "Consumer Discretionary", "Consumer Services"),
    (7800, 7899, "Communication Services", "Media & Entertainment"), (7900, 7999, "Consumer Discretionary", "Entertainment & Recreation"), (8000, 8099, "Healthcare", "Healthcare Services"),
    (8731, 8731, "Healthcare", "Biotechnology"), (8100, 8999, "Industrials", "Professional Services"),
]
#: fixed values: last day and name of each era but the last
ERAS = [("2019-12-31", "zirp_bull"), ("2022-06-30", "covid_meme"), ("2024-12-31", "rate_shock_ai"), (None, "recent")]


def bucket(x: Column, edges: list) -> Column:
    """Name of the bucket below whose edge ``x`` lies; null stays null."""
    out = None
    for edge, name in edges:
        if edge is None:
            return F.when(x.isNotNull(), out.otherwise(name))
        out = F.when(x < edge, name) if out is None else out.when(x < edge, name)


def _bucket_sql(x: str, edges: list) -> str:
    return "case when " + x + " is null then null " + " ".join(f"when {x} < {e!r} then '{n}'" for e, n in edges if e is not None) + f" else '{edges[-1][1]}' end"


def sector_of(sic: Column) -> Column:
    """struct(sector, industry) of an industry code; null where it can't be read or has no range."""
    code, out = F.trim(sic).try_cast("int"), None
    for a, z, s, i in SIC:
        x = F.struct(F.lit(s).alias("sector"), F.lit(i).alias("industry"))
        out = F.when(code.between(a, z), x) if out is None else out.when(code.between(a, z), x)
    return out


def _sic_sql(c: str, k: int) -> str:
    return "case " + " ".join(f"when try_cast(trim({c}) as integer) between {r[0]} and {r[1]} then '{r[k]}'" for r in SIC) + " end"


@query(f"select distinct filing_id, sic_from_filing, {_sic_sql('sic_from_filing', 2)} as sector, {_sic_sql('sic_from_filing', 3)} as industry from financials")
def sic_range_map(spark, d):
    f = table(spark, d, "financials").withColumn("x", sector_of(F.col("sic_from_filing")))
    return f.select("filing_id", "sic_from_filing", F.col("x.sector").alias("sector"), F.col("x.industry").alias("industry")).distinct()


_NO = "coalesce({}, false)"
#: a security's listing and industry, its shares by day, what was known before the day, ranks across the day
_C = _P + f""", {A._FIX}, {A._ADJ}{_MKT.replace("from p join m on m.day = p.day", "from ad join m on m.day = ad.day").replace("select p.*", "select ad.*")},
li as (select security_id, arg_max(struct_pack(t := ticker_type, n := primary_exchange), row(as_of_date, coalesce(ticker_type, ''), coalesce(primary_exchange, ''))) as r from tickers where security_id is not null group by 1),
si as (select security_id, arg_max(sic_from_filing, row(filing_date, filing_id, sic_from_filing)) as sic from financials where security_id is not null and sic_from_filing is not null group by 1),
sh as (select security_id, filing_date, max(basic_average_shares) as shares from financials where security_id is not null and basic_average_shares > 0 and not isnan(basic_average_shares) group by 1, 2),
sn as (select security_id, arg_max(diluted_average_shares, row(filing_date, filing_id, diluted_average_shares)) as snap from financials where security_id is not null and diluted_average_shares > 0 and not isnan(diluted_average_shares) group by 1),
f0 as (select *, lag(c) over w as pu, lag(c * factor) over w as pa, case when count(q) {_W.format(20)} = 20 then avg(q) {_W.format(20)} end as addv, case when count(lret) {_W.format(21)} = 21 then stddev_samp(lret) {_W.format(21)} * sqrt(252.0) end as rv,
        case when count(tr) {_W.format(14)} = 14 then avg(tr) {_W.format(14)} end as atr, case when count(case when lret is not null and mret is not null then mret end) {_W.format(60)} >= 45 and var_samp(case when lret is not null then mret end) {_W.format(60)} > 0 then covar_samp(case when lret is not null then mret end, lret) {_W.format(60)} / var_samp(case when lret is not null then mret end) {_W.format(60)} end as beta,
        min(day) over (partition by security_id) as first_day, min(day) over () as start from j window w as (partition by security_id order by day)),
f1 as (select f0.*, li.r.t as kind, si.sic, sn.snap, sh.shares from f0 left join li using (security_id) left join si using (security_id) left join sn using (security_id) asof left join sh on sh.security_id = f0.security_id and sh.filing_date <= f0.day),
f2 as (select *, case when shares is not null and (snap is null or pu is null or not (snap * coalesce(case when pu > 0 then pa / pu end, 1.0) > 0) or shares / (snap * coalesce(case when pu > 0 then pa / pu end, 1.0)) between 1.0 / 30 and 30) then shares * pu end as cap, case when date_diff('day', start, first_day) > 7 then date_diff('day', first_day, day) end as ipo from f1),
f3 as (select *, case when addv is not null then row_number() over (partition by day order by round(addv, 4) desc nulls last, security_id) end as addv_rank, count(addv) over (partition by day) as addv_m, case when rv is not null then row_number() over (partition by day order by round(rv, 9) desc nulls last, security_id) end as rv_rank, count(rv) over (partition by day) as rv_m, case when cap is not null then row_number() over (partition by day order by round(cap, 2) desc nulls last, security_id) end as cap_rank from f2),
cl as (select security_id, strftime(day, '%Y-%m-%d') as day, kind, {_sic_sql("sic", 2)} as sector, {_sic_sql("sic", 3)} as industry, sic, round(cap, 2) as market_cap, {_bucket_sql("cap", CAP)} as cap_bucket, cap_rank, round(addv, 4) as addv, {_bucket_sql("addv", LIQUIDITY)} as liquidity, addv_rank, round(100 * (addv_m - addv_rank) / addv_m, 6) as addv_pct, round(pa, 6) as prior_close, {_bucket_sql("pa", PRICE)} as price_bucket,
       round(rv, 6) as rv, {_bucket_sql("round(rv, 6)", VOLATILITY)} as volatility, round(100 * (rv_m - rv_rank) / rv_m, 6) as rv_pct, round(beta, 5) as beta, case when round(beta, 5) < 0.7 then 'defensive' when round(beta, 5) <= 1.3 then 'market' when beta is not null then 'aggressive' end as style, ipo, round(atr, 6) as atr from f3)
"""


def classification(spark: SparkSession, d: str) -> DataFrame:
    """One row per security and session: what was known of it before the day."""
    p = A.adjusted(spark, d)
    m = p.groupBy("day").agg(F.avg("lret").alias("mret"))
    p = p.join(m, "day")
    t, f = table(spark, d, "tickers"), table(spark, d, "financials").where(F.col("security_id").isNotNull())
    order = F.struct("as_of_date", F.coalesce("ticker_type", F.lit("")), F.coalesce("primary_exchange", F.lit("")))
    li = t.where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.max_by("ticker_type", order).alias("kind"))
    si = f.where(F.col("sic_from_filing").isNotNull()).groupBy("security_id").agg(F.max_by("sic_from_filing", F.struct("filing_date", "filing_id", "sic_from_filing")).alias("sic"))
    real = lambda c: (F.col(c) > 0) & ~F.isnan(c)
    sn = f.where(real("diluted_average_shares")).groupBy("security_id").agg(F.max_by("diluted_average_shares", F.struct("filing_date", "filing_id", "diluted_average_shares")).alias("snap"))
    w, life = H.by_security(), Window.partitionBy("security_id")
    start = F.broadcast(p.agg(F.min("day").alias("start")))  # one row
    ac = F.col("c") * F.col("factor")
    p = p.withColumns({"pu": F.lag("c").over(w), "pa": F.lag(ac).over(w), "addv": H.average("q", 20), "rv": H.realized_vol(21), "atr": H.atr(14), "beta": H.beta("mret", "lret", 60, 45), "first_day": F.min("day").over(life)})
    p = p.select("security_id", "day", "pu", "pa", "addv", "rv", "atr", "beta", "first_day").crossJoin(start)
    p = asof.asof_backward(p, f.where(real("basic_average_shares")), "security_id", "day", "filing_date", F.struct(F.col("basic_average_shares").alias("shares")), "s")
    p = p.join(li, "security_id", "left").join(si, "security_id", "left").join(sn, "security_id", "left")
    rebased = F.col("snap") * F.when(F.col("pu") > 0, F.col("pa") / F.col("pu")).otherwise(1.0)
    unknown = F.col("snap").isNull() | F.col("pu").isNull() | ~(rebased > 0)
    cap = F.when(unknown | (F.col("s.shares") / rebased).between(1 / 30, 30), F.col("s.shares") * F.col("pu"))
    p = p.withColumns({"cap": cap, "ipo": F.when(F.datediff("first_day", "start") > 7, F.datediff("day", "first_day").cast("bigint"))})
    p = p.withColumns({"_addv": F.round("addv", 4), "_rv": F.round("rv", 9), "_cap": F.round("cap", 2)})
    for c in ("addv", "rv", "cap"):
        p = R.rank_desc(p, ["day"], f"_{c}", ["security_id"], c)
    x, beta = sector_of(F.col("sic")), F.round("beta", 5)
    style = F.when(beta < 0.7, "defensive").when(beta <= 1.3, "market").when(beta.isNotNull(), "aggressive")
    return p.select(
        "security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", x["sector"].alias("sector"), x["industry"].alias("industry"), "sic", F.col("_cap").alias("market_cap"), bucket(F.col("cap"), CAP).alias("cap_bucket"), "cap_rank",
        F.col("_addv").alias("addv"), bucket(F.col("addv"), LIQUIDITY).alias("liquidity"), "addv_rank", F.round(100 * F.col("addv_pct"), 6).alias("addv_pct"), F.round("pa", 6).alias("prior_close"), bucket(F.col("pa"), PRICE).alias("price_bucket"),
        F.round("rv", 6).alias("rv"), bucket(F.round("rv", 6), VOLATILITY).alias("volatility"), F.round(100 * F.col("rv_pct"), 6).alias("rv_pct"), beta.alias("beta"), style.alias("style"), "ipo", F.round("atr", 6).alias("atr"),
    )


@query(_C + "select security_id, day, kind, sector, industry, market_cap, cap_bucket, cap_rank, addv, liquidity, addv_rank, prior_close, price_bucket, rv, volatility, rv_pct, beta, style, ipo as days_since_ipo from cl")
def security_classification(spark, d):
    """Market cap (filed shares as of the day times the unadjusted close before; none if they differ thirtyfold from the newest share count on the day's basis), buckets and ranks."""
    return classification(spark, d).select("security_id", "day", "kind", "sector", "industry", "market_cap", "cap_bucket", "cap_rank", "addv", "liquidity", "addv_rank", "prior_close", "price_bucket", "rv", "volatility", "rv_pct", "beta", "style", F.col("ipo").alias("days_since_ipo"))


_FUNDS = "kind in ('ETF', 'ETV', 'ETS', 'FUND')"
_FLAGS = {
    "is_common_stock": "kind = 'CS'", "is_etf": _FUNDS, "is_etn": "kind = 'ETN'", "is_adr": "kind like 'ADR%'", "is_warrant": "kind = 'WARRANT'", "is_preferred": "kind = 'PFD'", "is_unit": "kind = 'UNIT'",
    "is_leveraged_etf": f"coalesce({_FUNDS} and abs(beta) >= 1.8, false)", "is_inverse_etf": f"coalesce({_FUNDS} and beta <= -0.5, false)", "is_spac": "coalesce(trim(sic) = '6770', false)",
}
#: a missing input makes a tag false
_TAGS = {
    "is_mega_cap_tech": "cap_bucket = 'mega' and sector in ('Technology', 'Communication Services', 'Consumer Discretionary') and addv_rank <= 50 and beta > 0.9",
    "is_large_cap_tech": "cap_bucket in ('large', 'mega') and sector in ('Technology', 'Communication Services') and addv_rank <= 500",
    "is_semiconductor": "industry = 'Semiconductors'", "is_biotech": "industry in ('Biotechnology', 'Pharmaceuticals')", "is_regional_bank": "industry = 'Regional Banks'", "is_energy": "sector = 'Energy'",
    "is_china_adr": "kind like 'ADR%' and country in ('CN', 'HK')", "is_low_float_candidate": "addv_rank > 5000 and atr / prior_close > 0.05 and prior_close > 1", "is_meme_candidate": "rv_pct >= 95 and addv_rank <= 50", "is_recent_ipo": "ipo < 60",
}


@query(_C + ", co as (select cl.*, nullif(upper(t.locale), 'US') as country from cl left join (select security_id, max(locale) as locale from tickers where security_id is not null group by 1) t using (security_id)) select security_id, day, " + ", ".join(f"{e} as {n}" for n, e in _FLAGS.items()) + ", " + ", ".join(f"coalesce({e}, false) as {n}" for n, e in _TAGS.items()) + " from co")
def behavioral_tags(spark, d):
    """Structure flags (null without a listing type, where they come from it) and ten tags, each false if an input is missing."""
    country = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.max("locale").alias("locale"))
    c = classification(spark, d).join(country, "security_id", "left").withColumn("country", F.nullif(F.upper("locale"), F.lit("US")))
    return c.select("security_id", "day", *[F.expr(e).alias(n) for n, e in _FLAGS.items()], *[F.coalesce(F.expr(e), F.lit(False)).alias(n) for n, e in _TAGS.items()])


@query(_C + ", g as (select cl.*, lead(p.ret) over (partition by cl.security_id order by cl.day) as fwd from cl join p on p.security_id = cl.security_id and strftime(p.day, '%Y-%m-%d') = cl.day) select day, cap_bucket, liquidity, count(*) as names, round(avg(fwd), 6) as mean_fwd from g where kind = 'CS' and cap_bucket in ('mega', 'large', 'mid', 'small') and liquidity in ('highly_liquid', 'liquid', 'normal', 'thin') and not coalesce(trim(sic) = '6770', false) and not coalesce(ipo < 60, false) and fwd is not null and sector is not null group by day, cap_bucket, liquidity")
def cohort_cells(spark, d):
    """Next-session return by cell of the cohort: common stock, of some size and liquidity, not excluded by a flag (a missing flag excludes nothing), no cell with a null."""
    p = panel(spark, d).select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "ret")
    c = classification(spark, d).join(p, ["security_id", "day"]).withColumn("fwd", F.lead("ret").over(H.by_security()))
    no = lambda e: ~F.coalesce(F.expr(e), F.lit(False))
    c = c.where((F.col("kind") == "CS") & F.col("cap_bucket").isin("mega", "large", "mid", "small") & F.col("liquidity").isin("highly_liquid", "liquid", "normal", "thin") & no("trim(sic) = '6770'") & no("ipo < 60"))
    return c.dropna(subset=["fwd", "sector"]).groupBy("day", "cap_bucket", "liquidity").agg(F.count(F.lit(1)).alias("names"), F.round(F.avg("fwd"), 6).alias("mean_fwd"))


# sectors, the market's day, regimes ------------------------------------------------------------------

_SEC = f", si as (select security_id, arg_max(sic_from_filing, row(filing_date, filing_id, sic_from_filing)) as sic from financials where security_id is not null and sic_from_filing is not null group by 1), se as (select security_id, {_sic_sql('sic', 2)} as sector from si)"


def sectors(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull() & F.col("sic_from_filing").isNotNull())
    return f.groupBy("security_id").agg(F.max_by("sic_from_filing", F.struct("filing_date", "filing_id", "sic_from_filing")).alias("sic")).select("security_id", sector_of(F.col("sic"))["sector"].alias("sector"))


@query(_P + _SEC + ", x as (select day, coalesce(sector, 'Unknown') as sector, sector is null as nameless, ret, gap, case when o > 0 then c / o - 1 end as intraday, case when h > l then (c - l) / (h - l) end as place from p left join se using (security_id)), a as (select day, sector, any_value(nameless) as nameless, count(*) as n, avg(ret) as m, avg(gap) as g, avg(intraday) as i, avg(place) as pl, avg((ret > 0)::int) as up, avg((intraday > 0)::int) as green from x group by day, sector) select strftime(day, '%Y-%m-%d') as day, sector, n, round(m, 6) as mean_ret, round(g, 6) + 0.0 as mean_gap, round(i, 6) as mean_intraday, round(pl, 6) as mean_location, round(up, 9) as up_share, round(green, 9) as green_share, case when not nameless and i is not null then row_number() over (partition by day, nameless or i is null order by round(i, 9) desc, sector) end as sector_rank from a")
def sector_aggregate(spark, d):
    """Four equal-weight means and two shares per sector and day (nulls counted, not averaged), sectors ranked by the intraday mean, the unnamed one unranked."""
    x = panel(spark, d).join(sectors(spark, d), "security_id", "left")
    intraday, place = F.when(F.col("o") > 0, F.col("c") / F.col("o") - 1), F.when(F.col("h") > F.col("l"), (F.col("c") - F.col("l")) / (F.col("h") - F.col("l")))
    share = lambda c: F.avg((c > 0).cast("int"))
    a = x.groupBy("day", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.first(F.col("sector").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.avg("gap").alias("g"), F.avg(intraday).alias("i"), F.avg(place).alias("pl"), share(F.col("ret")).alias("up"), share(intraday).alias("green"))
    none = F.col("nameless") | F.col("i").isNull()
    rk = F.row_number().over(Window.partitionBy("day", none).orderBy(F.round("i", 9).desc(), "sector")).cast("bigint")
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return a.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "sector", "n", r6("m", "mean_ret"), (F.round("g", 6) + 0.0).alias("mean_gap"), r6("i", "mean_intraday"), r6("pl", "mean_location"), F.round("up", 9).alias("up_share"), F.round("green", 9).alias("green_share"), F.when(~none, rk).alias("sector_rank"))


@query(_P + _SEC + " select security_id, strftime(day, '%Y-%m-%d') as day, round(ret - avg(ret) over (partition by day, coalesce(sector, 'Unknown')), 6) + 0.0 as relative_strength from p left join se using (security_id)")
def relative_strength(spark, d):
    """Return less the mean of its sector on the day."""
    x = panel(spark, d).join(sectors(spark, d), "security_id", "left").withColumn("g", F.coalesce("sector", F.lit("Unknown")))
    return x.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), (F.round(F.col("ret") - F.avg("ret").over(Window.partitionBy("day", "g")), 6) + 0.0).alias("relative_strength"))


_MA = (20, 50, 200)


@query(_P + ", a as (select *, " + ", ".join(f"case when count(c) over (partition by security_id order by day rows between {n - 1} preceding and current row) = {n} then c > avg(c) over (partition by security_id order by day rows between {n - 1} preceding and current row) end as m{n}" for n in _MA) + f" from p) select security_id, strftime(day, '%Y-%m-%d') as day, " + ", ".join(f"lag(m{n}) over (partition by security_id order by day) as above_ma_{n}" for n in _MA) + ", round(c / max(c) over (partition by security_id order by day rows between unbounded preceding and current row) - 1, 6) as drawdown from a")
def moving_average_regime(spark, d):
    """Whether the close of the day before was above its mean of 20, 50 and 200 days, and the fall from the highest close so far."""
    w = H.by_security()
    p = panel(spark, d).withColumns({f"m{n}": F.when(F.count("c").over(w.rowsBetween(1 - n, 0)) == n, F.col("c") > F.avg("c").over(w.rowsBetween(1 - n, 0))) for n in _MA})
    return p.select("security_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.lag(f"m{n}").over(w).alias(f"above_ma_{n}") for n in _MA], F.round(F.col("c") / F.max("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1, 6).alias("drawdown"))


@query(_B + ", x as (select sym, day, sum(v) filter (mod < 600) as v30, sum(c * v) filter (mod < 600) as d30, arg_min(o, mod) as open, arg_max(c, mod) filter (mod < 600) / arg_min(o, mod) - 1 as r1000, arg_max(c, mod) filter (mod < 630) / arg_min(o, mod) - 1 as r1030, arg_max(c, mod) / arg_min(o, mod) - 1 as reod, sum(c * v) as dollars, max(h) - min(l) as rng from b where mod between 570 and 959 group by sym, day), pm as (select sym, day, sum(c * v) / sum(v) as vwap from b where mod between 240 and 569 group by sym, day), u as (select x.*, open * (1 + r1000) > pm.vwap as above from x left join pm using (sym, day)) select sym, day, v30 as volume_30m, round(d30, 4) as dollars_30m, round(d30 / v30, 6) as vwap_30m, round(r1000, 6) as ret_1000, round(r1030, 6) as ret_1030, round(reod, 6) as ret_eod, above as above_premarket_vwap from u")
def universe_snapshot(spark, d):
    """First half hour of each symbol and day, its returns to 10:00, 10:30 and the close, and whether 10:00 stood above the premarket's average price."""
    return _universe(spark, d).select("sym", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("v30").alias("volume_30m"), F.round("d30", 4).alias("dollars_30m"), F.round(F.col("d30") / F.col("v30"), 6).alias("vwap_30m"), *[F.round(c, 6).alias(n) for c, n in (("r1000", "ret_1000"), ("r1030", "ret_1030"), ("reod", "ret_eod"))], F.col("above").alias("above_premarket_vwap"))


def _universe(spark, d) -> DataFrame:
    m = F.col("mod")
    rth, half, pre = B.rth(), m.between(570, 599), m.between(240, 569)
    dollars = F.col("c") * F.col("v")
    s = lambda when, x: F.sum(F.when(when, x))
    g = bars(spark, d).groupBy("sym", "day").agg(
        s(half, F.col("v")).alias("v30"), s(half, dollars).alias("d30"), B.first_by("o", rth).alias("open"), B.last_by("c", half).alias("c1000"), B.last_by("c", m.between(570, 629)).alias("c1030"), B.last_by("c", rth).alias("ceod"),
        s(rth, dollars).alias("dollars"), (s(pre, dollars) / s(pre, F.col("v"))).alias("vwap"),
    ).where(F.col("open").isNotNull())
    ret = lambda c: F.col(c) / F.col("open") - 1
    return g.withColumns({"r1000": ret("c1000"), "r1030": ret("c1030"), "reod": ret("ceod")}).withColumn("above", F.col("open") * (1 + F.col("r1000")) > F.col("vwap"))


@query(_B + ", x as (select sym, day, arg_min(o, mod) as open, max(h) as h, min(l) as l, arg_max(c, mod) as c, sum(v) as v, arg_max(c, mod) filter (mod < 600) as c1000 from b where mod between 570 and 959 group by sym, day), n as (select sym, row_number() over (order by count(*) desc, sym) as j from x group by sym order by 2 limit 3) select day, " + ", ".join(f"max(case when n.j = {j} then x.sym end) as index_{j}, max(case when n.j = {j} then open end) as open_{j}, max(case when n.j = {j} then c end) as close_{j}, max(case when n.j = {j} then v end) as volume_{j}, round(max(case when n.j = {j} then c1000 / open - 1 end), 6) as ret_1000_{j}" for j in (1, 2, 3)) + " from x left join n on n.sym = x.sym group by day")
def index_day(spark, d):
    """The day of three index symbols (those with the most days) side by side; nulls on days without them."""
    rth = B.rth()
    x = bars(spark, d).where(rth).groupBy("sym", "day").agg(F.min_by("o", "minute").alias("open"), F.max_by("c", "minute").alias("close"), F.sum("v").alias("volume"), B.last_by("c", F.col("mod") < 600).alias("c1000"))
    names = x.groupBy("sym").count().orderBy(F.desc("count"), "sym").limit(3)
    names = F.broadcast(names.withColumn("j", F.row_number().over(Window.orderBy(F.desc("count"), "sym"))).select(F.col("sym").alias("_s"), "j"))  # three rows
    j = x.join(names, F.col("sym") == F.col("_s"), "left")
    of = lambda k, c: F.max(F.when(F.col("j") == k, c))
    cols = [c for k in (1, 2, 3) for c in (of(k, F.col("sym")).alias(f"index_{k}"), of(k, F.col("open")).alias(f"open_{k}"), of(k, F.col("close")).alias(f"close_{k}"), of(k, F.col("volume")).alias(f"volume_{k}"), F.round(of(k, F.col("c1000") / F.col("open") - 1), 6).alias(f"ret_1000_{k}"))]
    return j.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(*cols)


_ERA = "case " + " ".join(f"when day <= date '{z}' then '{n}'" for z, n in ERAS if z) + f" else '{ERAS[-1][1]}' end"
#: the exploration window that gives the bounds
_EXPLORE = ("2023-01-01", "2023-12-31")
_METRICS = {"dispersion": "stddev_pop(ret)", "breadth": "avg((ret > 0)::int)", "volatility": "sqrt(avg(lret * lret))", "liquidity": "quantile_cont(q, 0.5)"}


def _regimes_sql() -> str:
    parts = [f"select day, '{n}' as taxonomy, round({e}, 9) as x from p group by day having count(ret) >= 2" for n, e in _METRICS.items()]
    return _P + ", m as (" + " union all ".join(parts) + f"), b as (select taxonomy, case when count(x) >= 9 then quantile_cont(x, 1 / 3.0) end as lo, case when count(x) >= 9 then quantile_cont(x, 2 / 3.0) end as hi from m where day between date '{_EXPLORE[0]}' and date '{_EXPLORE[1]}' group by taxonomy)"


@query(_regimes_sql() + f" select strftime(m.day, '%Y-%m-%d') as day, taxonomy, case when x <= lo then 'low' when x <= hi then 'mid' else 'high' end as bucket from m join b using (taxonomy) where x is not null and lo is not null union all select strftime(day, '%Y-%m-%d'), 'era', {_ERA} from (select distinct day from p)")
def regime_tertiles_long(spark, d):
    """Five taxonomies in long form: tertiles of four metrics by the bounds of the exploration window alone, and the eras."""
    m, b = _metrics(spark, d)
    x = m.join(F.broadcast(b), "taxonomy").where(F.col("x").isNotNull() & F.col("q").isNotNull())  # four rows
    tertile = F.when(F.col("x") <= F.col("q")[0], "low").when(F.col("x") <= F.col("q")[1], "mid").otherwise("high")
    era = None
    for z, n in ERAS[:-1]:
        hit = F.col("day") <= F.lit(z).cast("date")
        era = F.when(hit, n) if era is None else era.when(hit, n)
    days = panel(spark, d).select("day").distinct().select("day", F.lit("era").alias("taxonomy"), era.otherwise(ERAS[-1][1]).alias("bucket"))
    return x.select("day", "taxonomy", tertile.alias("bucket")).unionByName(days).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _metrics(spark, d) -> tuple[DataFrame, DataFrame]:
    made = {"dispersion": F.stddev_pop("ret"), "breadth": F.avg((F.col("ret") > 0).cast("int")), "volatility": F.sqrt(F.avg(F.col("lret") * F.col("lret"))), "liquidity": F.percentile("q", F.lit(0.5))}
    g = panel(spark, d).groupBy("day").agg(F.count("ret").alias("n"), *[F.round(e, 9).alias(n) for n, e in made.items()]).where(F.col("n") >= 2)
    m = g.select("day", F.inline(F.array(*[F.struct(F.lit(n).alias("taxonomy"), F.col(n).alias("x")) for n in made])))
    inside = m.where(F.col("day").between(*[F.lit(x).cast("date") for x in _EXPLORE]))
    b = inside.groupBy("taxonomy").agg(F.percentile("x", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.count("x").alias("k"))
    return m, b.select("taxonomy", F.when(F.col("k") >= 9, F.col("q")).alias("q"))


@query(_regimes_sql() + " select taxonomy as key, case when lo is null then 'insufficient-data' else format('tertiles:{:.6f},{:.6f}', lo, hi) end as value from b")
def regime_stamps(spark, d):
    """The bounds in use as stamps beside the table."""
    _, b = _metrics(spark, d)
    return b.select(F.col("taxonomy").alias("key"), F.when(F.col("q").isNull(), "insufficient-data").otherwise(F.format_string("tertiles:%.6f,%.6f", F.col("q")[0], F.col("q")[1])).alias("value"))


@query("with f as (select security_id, cik, revenues, equity from financials where security_id is not null), c as (select security_id, cik, count(*) as n from f where cik is not null group by 1, 2), m as (select security_id, arg_max(cik, row(n, cik)) as cik from c group by 1), g as (select security_id, count(*) as filings, max(case when not isnan(revenues) then revenues end) as most_revenue, round(stddev_samp(case when not isnan(equity) and abs(equity) < 1e15 then equity / 1e6 end), 4) as equity_sd from f group by 1) select g.*, m.cik as usual_cik from g left join m using (security_id)")
def usual_identifier(spark, d):
    """The identifier most filings of a security bear (ties: the greater), their number, greatest revenue and deviation of equity in millions."""
    f = table(spark, d, "financials").where(F.col("security_id").isNotNull())
    m = f.where(F.col("cik").isNotNull()).groupBy("security_id", "cik").count().groupBy("security_id").agg(F.max_by("cik", F.struct("count", "cik")).alias("usual_cik"))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    g = f.groupBy("security_id").agg(F.count(F.lit(1)).alias("filings"), F.max(real("revenues")).alias("most_revenue"), F.round(F.stddev_samp(F.when(F.abs(real("equity")) < 1e15, F.col("equity") / 1e6)), 4).alias("equity_sd"))
    return g.join(m, "security_id", "left")


_NUM = ["revenues", "net_income_loss", "equity", "assets", "basic_earnings_per_share", "diluted_earnings_per_share", "fiscal_year"]


@query("with n as (" + " union all ".join(f"select '{c}' as feature, count(distinct case when not isnan(try_cast({c} as double)) then try_cast({c} as double) end) as n from financials" for c in _NUM) + " union all select 'constant', 1) select feature, n as distinct_values, n >= 2 as kept from n")
def degenerate_features(spark, d):
    """Features with at least two different values are kept; counted for all in one pass."""
    f = table(spark, d, "financials").withColumn("constant", F.lit(1.0))
    x = f.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias("v")) for c in [*_NUM, "constant"]])))
    g = x.groupBy("feature").agg(F.countDistinct("v").alias("distinct_values"))
    return g.select("feature", "distinct_values", (F.col("distinct_values") >= 2).alias("kept"))


@query(f"with ev as (select distinct security_id, {_SYMBOL.format('new_ticker')} as symbol, event_date as d0 from ticker_events where security_id is not null), w as (select security_id, symbol, d0 from ev union all select security_id, {_SYMBOL.format('max(display_symbol)')}, null from tickers where security_id is not null and security_id not in (select security_id from ev) group by security_id) select security_id, symbol, strftime(d0, '%Y-%m-%d') as valid_from, row_number() over (order by security_id, d0 nulls first, symbol) as place from w")
def deterministic_order(spark, d):
    """Validity windows numbered in one total order: by security, open begins first, then date and symbol."""
    e = table(spark, d, "ticker_events").where(F.col("security_id").isNotNull()).select("security_id", valid_symbol(F.col("new_ticker")).alias("symbol"), F.col("event_date").alias("d0")).distinct()
    t = table(spark, d, "tickers").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(valid_symbol(F.max("display_symbol")).alias("symbol"))
    w = e.unionByName(t.join(e.select("security_id").distinct(), "security_id", "left_anti").withColumn("d0", F.lit(None).cast("date")))
    # a running number over the whole order: counts per security first, their sums next, so no task sees more than its securities and one row each of the others
    per = w.groupBy("security_id").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("security_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("security_id").orderBy(F.col("d0").asc_nulls_first(), "symbol"))
    return w.withColumn("own", own).join(per.select("security_id", before.alias("before")), "security_id").select("security_id", "symbol", F.date_format("d0", "yyyy-MM-dd").alias("valid_from"), (F.col("before") + F.col("own")).cast("bigint").alias("place"))
