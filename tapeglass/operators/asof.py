"""As-of joins and event windows without a range-join operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeglass.functions.timeline import DAY


def _block(t: Column, kind: T.DataType, width: int) -> Column:
    """Number of the stretch of time (``width`` days) that ``t`` lies in."""
    days = F.unix_date(t).cast("bigint") if isinstance(kind, T.DateType) else F.unix_micros(t) / DAY if isinstance(kind, T.TimestampType) else t.cast("bigint")
    return F.floor(days / width).cast("bigint")


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: Column, name: str, width: int = 256) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before ``left_at``: a union and a window, no range join.

    ``value`` is a struct whose order breaks ties; rows of ``left`` come out once each.  A key is cut into
    stretches of ``width`` days (or units of a number) that are looked through apart from each other,
    with the last value before the stretch brought in, so a hot key is spread over its stretches.
    Rows of ``left`` with a null key or time find nothing.
    """
    kept, pad = left.columns, F.lit(None)
    blk = _block(F.col("_t"), left.schema[left_at].dataType, width)
    a = left.select(F.col(key).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row")).withColumn("_b", blk)
    b = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), value.alias("_v")).where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    b = b.groupBy("_k", "_t").agg(F.max("_v").alias("_v")).withColumns({"_side": F.lit(0), "_row": pad.cast(a.schema["_row"].dataType), "_b": _block(F.col("_t"), right.schema[right_at].dataType, width)})
    # a row per key and stretch: the last value in it, and from that the last one before it
    told = b.groupBy("_k", "_b").agg(F.max_by("_v", "_t").alias("_v")).unionByName(a.select("_k", "_b").distinct().withColumn("_v", pad.cast(b.schema["_v"].dataType)))
    told = told.groupBy("_k", "_b").agg(F.max("_v").alias("_v"))
    before = F.last("_v", True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = told.select("_k", "_b", before.alias("_v")).where(F.col("_v").isNotNull())
    carried = carried.withColumns({"_t": pad.cast(a.schema["_t"].dataType), "_side": F.lit(-1), "_row": pad.cast(a.schema["_row"].dataType)})
    u = a.withColumn("_v", pad.cast(b.schema["_v"].dataType)).unionByName(b).unionByName(carried)
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn(name, F.last("_v", True).over(w)).where(F.col("_side") == 1)
    return u.select("_row.*", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.col(name)).alias(name))


def asof_forward(left: DataFrame, calendar: DataFrame, key: str, at: str, day: str, name: str, strict: bool = False, width: int = 256) -> DataFrame:
    """``left`` with the first ``day`` of ``calendar`` (per key) at or after ``at``, or after it if ``strict``; stretches as in ``asof_backward``."""
    kept, pad = left.columns, F.lit(None)
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*kept).alias("_row")).withColumn("_b", _block(F.col("_t"), left.schema[at].dataType, width))
    row = a.schema["_row"].dataType
    b = calendar.select(F.col(key).alias("_k"), F.col(day).alias("_t")).where(F.col("_k").isNotNull() & F.col("_t").isNotNull()).distinct()
    b = b.withColumns({"_side": F.lit(0 if strict else 1), "_row": pad.cast(row), "_b": _block(F.col("_t"), calendar.schema[day].dataType, width), "_c": F.col("_t")})
    kind = calendar.schema[day].dataType
    told = b.groupBy("_k", "_b").agg(F.min("_t").alias("_c")).unionByName(a.select("_k", "_b").distinct().withColumn("_c", pad.cast(kind))).groupBy("_k", "_b").agg(F.min("_c").alias("_c"))
    after = F.first("_c", True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(1, Window.unboundedFollowing))
    carried = told.select("_k", "_b", after.alias("_c")).where(F.col("_c").isNotNull()).withColumns({"_t": F.col("_c").cast(a.schema["_t"].dataType), "_side": F.lit(2), "_row": pad.cast(row)})
    u = a.withColumn("_c", pad.cast(kind)).unionByName(b).unionByName(carried)
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    u = u.withColumn(name, F.first("_c", True).over(w)).where(F.col("_row").isNotNull())
    return u.select("_row.*", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.col(name)).alias(name))


def latest_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, most_days: int, order: list[str]) -> DataFrame:
    """Each row of ``left`` with the newest row of ``right`` at most ``most_days`` before it: an equi join on key and coarse date bucket.

    Repeated rows of ``left`` come out once; rows without a match don't come out.
    """
    width = most_days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    a = left.withColumn("_b", bucket(F.col(left_at)))
    b = right.withColumn("_b2", F.explode(F.array(bucket(F.col(right_at)), bucket(F.col(right_at)) + 1))).withColumnRenamed(key, "_k2")
    j = a.join(b, (F.col(key) == F.col("_k2")) & (F.col("_b") == F.col("_b2")) & F.datediff(left_at, right_at).between(0, most_days))
    w = Window.partitionBy(*left.columns).orderBy(F.col(right_at).desc(), *order)
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_b", "_b2", "_k2")
