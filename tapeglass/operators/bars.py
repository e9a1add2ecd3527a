"""Minute bars: standing bars, sessions, snapshots and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeglass.functions.timeline import MINUTE, floor_div, local_date, local_minute

#: minutes of the New York civil day
OPEN, CLOSE, PRE = 570, 960, 240


def standing_bars(bars: DataFrame) -> DataFrame:
    """sym, day, mod (minute of the New York day), o, h, l, c, v: one bar per symbol and minute with traded volume.

    Of several rows for a minute the one stamped last stands, ties to the greater row.
    """
    b = bars.where((F.col("volume") > 0) & ~F.isnan("volume") & F.col("display_symbol").isNotNull() & F.col("t").isNotNull())
    row = F.struct("t", "volume", "open", "high", "low", "close")
    g = b.groupBy(F.col("display_symbol").alias("sym"), floor_div(F.unix_micros("t"), MINUTE).alias("minute")).agg(F.max(row).alias("r"))
    at = F.timestamp_micros(F.col("minute") * MINUTE)
    return g.select("sym", "minute", local_date(at).alias("day"), local_minute(at).alias("mod"), F.col("r.open").alias("o"), F.col("r.high").alias("h"), F.col("r.low").alias("l"), F.col("r.close").alias("c"), F.col("r.volume").alias("v"))


def first_by(value: str, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.col("minute")))


def last_by(value: str, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("minute")))


def rth() -> Column:
    return F.col("mod").between(OPEN, CLOSE - 1)


def resample(bars: DataFrame, minutes: int, anchor: int = OPEN) -> DataFrame:
    """Bars of ``minutes`` anchored at a minute of the day; empty buckets have no row."""
    b = bars.where(F.col("mod") >= anchor).withColumn("bucket", floor_div((F.col("mod") - anchor).cast("bigint"), minutes) * minutes + anchor)
    return b.groupBy("sym", "day", "bucket").agg(F.min_by("o", "minute").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "minute").alias("c"), F.sum("v").alias("v"))
