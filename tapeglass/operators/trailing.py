"""Rolling totals over trailing calendar periods, days without activity included.

Each entity gets its calendar from its first to its last day.  A daily total reaches the calendar
days of the trailing period after it, so it is filed under the coarse date buckets of those days,
and the range join looks for candidates inside one bucket only.  Grouping follows the join's own
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeglass.functions.timeline import floor_div


def trailing_totals(daily: DataFrame, key: list[str], day: str, values: dict[str, Column], windows: list[int], width: int | None = None) -> DataFrame:
    """key, ``day``, and for each value and window ``<value>_<n>d_total``, ``_days`` (days with a value) and ``_mean`` (per calendar day).

    ``daily`` may have several rows for a key and day; they add up.  A window of n days ends with the
    calendar day itself.  ``width``: days to a bucket, by default the longest window.

    Defined cases: a null or NaN value, a day without a row and the time before the first day count as
    nothing (total 0, mean over n days all the same); rows with a null key or day are left out; an
    empty table gives no rows; further columns are ignored.
    """
    width = width or max(windows)
    most = max(windows)
    d = daily.select(*[F.col(c) for c in key], F.unix_date(day).alias("_d"), *[F.nanvl(v.cast("double"), F.lit(None)).alias(n) for n, v in values.items()]).where(F.col("_d").isNotNull())
    for c in key:
        d = d.where(F.col(c).isNotNull())
    d = d.groupBy(*key, "_d").agg(*[F.sum(n).alias(n) for n in values])
    span = d.groupBy(*key).agg(F.min("_d").alias("a"), F.max("_d").alias("z"))
    cal = span.withColumn("_b", F.explode(F.sequence(floor_div(F.col("a"), width), floor_div(F.col("z"), width))))
    cal = cal.select(*key, "_b", "a", "z").repartition(*key, "_b")
    dates = cal.withColumn("_day", F.explode(F.sequence(F.greatest(F.col("a").cast("bigint"), F.col("_b") * width), F.least(F.col("z").cast("bigint"), F.col("_b") * width + width - 1))))
    filed = d.withColumn("_b", F.explode(F.sequence(floor_div(F.col("_d"), width), floor_div(F.col("_d") + (most - 1), width))))
    left = dates.select(*key, "_b", "_day").alias("l")
    right = filed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_b").alias("_rb"), "_d", *values).alias("r")
    cond = (F.col("_b") == F.col("_rb")) & (F.col("_d") <= F.col("_day")) & (F.col("_d") > F.col("_day") - most)
    for i, c in enumerate(key):
        cond = (F.col(f"l.`{c}`") == F.col(f"_k{i}")) & cond
    joined = left.join(right, cond, "left")
    aggs = []
    for n in windows:
        inside = F.col("_d") > F.col("_day") - n
        for v in values:
            x = F.when(inside, F.col(f"r.`{v}`"))
            aggs += [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{v}_{n}d_total"), F.count(x).alias(f"{v}_{n}d_days")]
    out = joined.groupBy(*[F.col(f"l.`{c}`").alias(c) for c in key], "_b", "_day").agg(*aggs)
    for n in windows:
        for v in values:
            out = out.withColumn(f"{v}_{n}d_mean", F.col(f"{v}_{n}d_total") / n)
    return out.select(*key, F.date_from_unix_date(F.col("_day").cast("int")).alias(day), *[f"{v}_{n}d_{x}" for v in values for n in windows for x in ("total", "days", "mean")])
