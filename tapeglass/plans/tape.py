"""Queries over minute bars: sessions, shapes, resampling, entries and what followed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.operators import bars as B
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


_B = """
with m as (select display_symbol as sym, epoch_us(t) // 60000000 as minute, arg_max(struct_pack(o := open, h := high, l := low, c := close, v := volume), row(t, volume, open, high, low, close)) as r
      from bars_1m_raw where volume > 0 and not isnan(volume) group by all),
b as (select sym, minute, cast(timezone('America/New_York', make_timestamptz(minute * 60000000)) as date) as d, strftime(timezone('America/New_York', make_timestamptz(minute * 60000000)), '%Y-%m-%d') as day,
        cast(hour(timezone('America/New_York', make_timestamptz(minute * 60000000))) * 60 + minute(timezone('America/New_York', make_timestamptz(minute * 60000000))) as integer) as mod,
        r.o as o, r.h as h, r.l as l, r.c as c, r.v as v from m)
"""


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.standing_bars(table(spark, d, "bars_1m_raw"))


def _day():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


@query(_B + "select sym, day, arg_min(o, minute) as o, max(h) as h, min(l) as l, arg_max(c, minute) as c, sum(v) as v, round(case when sum(v) > 0 then sum(c * v) / sum(v) end, 6) as vwap from b where mod between 570 and 959 group by sym, day")
def ohlcv_daily(spark, d):
    """Regular session of a day; none without a regular bar."""
    g = bars(spark, d).where(B.rth()).groupBy("sym", "day").agg(F.min_by("o", "minute").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "minute").alias("c"), F.sum("v").alias("v"), F.round(F.sum(F.col("c") * F.col("v")) / F.sum("v"), 6).alias("vwap"))
    return g.select("sym", _day(), "o", "h", "l", "c", "v", "vwap")


@query(_B + "select sym, day, cast((mod - 570) // 10 * 10 + 570 as bigint) as bucket, arg_min(o, minute) as o, max(h) as h, min(l) as l, arg_max(c, minute) as c, sum(v) as v from b where mod >= 570 group by 1, 2, 3")
def ohlcv_10m_resample(spark, d):
    return B.resample(bars(spark, d), 10).select("sym", _day(), "bucket", "o", "h", "l", "c", "v")


@query(_B + "select sym, day, count_if(mod between 570 and 629)::bigint as first_hour_bars, round(coalesce(sum(c) filter (mod between 570 and 629), 0), 4) as first_hour_closes, arg_max(c, minute) filter (mod between 570 and 629) as last_close from b group by sym, day")
def bars_nested_list(spark, d):
    """The first hour as a sorted list of bars per day (empty, not null, without bars), read back through array functions."""
    first = F.when(F.col("mod").between(570, 629), F.struct("minute", "o", "h", "l", "c", "v"))
    g = bars(spark, d).groupBy("sym", "day").agg(F.sort_array(F.collect_list(first)).alias("path"))  # at most 60 bars
    total = F.aggregate(F.transform("path", lambda x: x.c), F.lit(0.0), lambda a, x: a + x)
    return g.select("sym", _day(), F.size("path").cast("bigint").alias("first_hour_bars"), F.round(total, 4).alias("first_hour_closes"), F.when(F.size("path") > 0, F.element_at("path", -1).getField("c")).alias("last_close"))


@query(_B + "select sym, day, count_if(mod between 240 and 569)::bigint as premarket_bars, coalesce(sum(v) filter (mod between 240 and 569), 0) as premarket_volume, max(h) filter (mod between 240 and 569) as premarket_high, min(l) filter (mod between 240 and 569) as premarket_low, round(sum(c * v) filter (mod between 240 and 569) / sum(v) filter (mod between 240 and 569), 6) as premarket_vwap, count_if(mod between 570 and 959)::bigint as rth_bars from b group by sym, day")
def premarket_vs_rth(spark, d):
    pre = F.col("mod").between(240, 569)
    v = F.sum(F.when(pre, F.col("v")))
    return bars(spark, d).groupBy("sym", _day()).agg(F.count_if(pre).alias("premarket_bars"), F.coalesce(v, F.lit(0.0)).alias("premarket_volume"), F.max(F.when(pre, F.col("h"))).alias("premarket_high"), F.min(F.when(pre, F.col("l"))).alias("premarket_low"), F.round(F.sum(F.when(pre, F.col("c") * F.col("v"))) / v, 6).alias("premarket_vwap"), F.count_if(B.rth()).alias("rth_bars"))


@query(_B + "select sym, day, round(arg_max(c, minute) filter (mod between 930 and 959) / arg_min(o, minute) filter (mod between 930 and 959) - 1, 6) as last_30m_ret, round(coalesce(sum(v) filter (mod between 930 and 959), 0) / sum(v), 9) as last_30m_share from b where mod between 570 and 959 group by sym, day")
def last_30m_share(spark, d):
    late = F.col("mod").between(930, 959)
    g = bars(spark, d).where(B.rth()).groupBy("sym", "day").agg((B.last_by("c", late) / B.first_by("o", late) - 1).alias("r"), (F.coalesce(F.sum(F.when(late, F.col("v"))), F.lit(0.0)) / F.sum("v")).alias("s"))
    return g.select("sym", _day(), F.round("r", 6).alias("last_30m_ret"), F.round("s", 9).alias("last_30m_share"))


@query(_B + "select sym, day, " + ", ".join(f"round(arg_max(c, minute) filter (mod < {m}) / nullif(arg_min(o, minute), 0) - 1, 6) as ret_{m // 60:02d}{m % 60:02d}" for m in (580, 590, 600, 610, 630)) + " from b where mod between 570 and 959 group by sym, day")
def snapshot_returns(spark, d):
    """Last close strictly before each clock time over the session's open."""
    marks = (580, 590, 600, 610, 630)
    g = bars(spark, d).where(B.rth()).groupBy("sym", "day").agg(F.min_by("o", "minute").alias("open"), *[B.last_by("c", F.col("mod") < m).alias(f"m{m}") for m in marks])
    return g.select("sym", _day(), *[F.round(F.when(F.col("open") != 0, F.col(f"m{m}") / F.col("open")) - 1, 6).alias(f"ret_{m // 60:02d}{m % 60:02d}") for m in marks])


@query(_B + ", f as (select * from b where mod between 570 and 599), x as (select sym, day, max(h) as high, min(l) as low from f group by sym, day) select x.sym, x.day, high, (select min(mod) from f where f.sym = x.sym and f.day = x.day and f.h = x.high) as high_at, low, (select min(mod) from f where f.sym = x.sym and f.day = x.day and f.l = x.low) as low_at from x")
def window_extremes_first_time(spark, d):
    """First half hour's high and low, and the first minute each was reached."""
    g = bars(spark, d).where(F.col("mod").between(570, 599)).groupBy("sym", "day").agg(F.max(F.struct("h", (-F.col("mod")).alias("n"))).alias("hi"), F.min(F.struct("l", "mod")).alias("lo"))
    return g.select("sym", _day(), F.col("hi.h").alias("high"), (-F.col("hi.n")).alias("high_at"), F.col("lo.l").alias("low"), F.col("lo.mod").alias("low_at"))


@query(_B + "select sym, day, count(*) as rth_bars, count_if(mod < 600)::bigint as bars_30m, greatest(0, 30 - count_if(mod < 600))::bigint as missing_30m, greatest(0, 60 - count_if(mod < 630))::bigint as missing_hour, min(mod) - 570 as first_bar_after, bool_or(h < l or h < o or h < c or l > o or l > c or l <= 0) as bad_ohlc from b where mod between 570 and 959 group by sym, day")
def data_quality_counts(spark, d):
    bad = (F.col("h") < F.col("l")) | (F.col("h") < F.col("o")) | (F.col("h") < F.col("c")) | (F.col("l") > F.col("o")) | (F.col("l") > F.col("c")) | (F.col("l") <= 0)
    half, hour = F.count_if(F.col("mod") < 600), F.count_if(F.col("mod") < 630)
    g = bars(spark, d).where(B.rth()).groupBy("sym", "day").agg(F.count(F.lit(1)).alias("rth_bars"), half.alias("bars_30m"), F.greatest(F.lit(0), 30 - half).cast("bigint").alias("missing_30m"), F.greatest(F.lit(0), 60 - hour).cast("bigint").alias("missing_hour"), (F.min("mod") - 570).alias("first_bar_after"), F.bool_or(bad).alias("bad_ohlc"))
    return g.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(_B + ", g as (select sym, day, mod, mod - lag(mod) over (partition by sym, day order by mod) as g from b where mod between 570 and 959) select sym, day, max(g) as max_gap, max(mod) as last_minute, max(mod) < 840 as half_day from g group by sym, day")
def max_bar_gap(spark, d):
    """Longest pause between regular bars, and the last regular minute as the session's close."""
    b = bars(spark, d).where(B.rth()).withColumn("g", F.col("mod") - F.lag("mod").over(Window.partitionBy("sym", "day").orderBy("mod")))
    return b.groupBy("sym", _day()).agg(F.max("g").alias("max_gap"), F.max("mod").alias("last_minute"), (F.max("mod") < 840).alias("half_day"))
