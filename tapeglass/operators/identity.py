"""Symbols, stable ids and corporate actions as validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity_windows(events: DataFrame, listings: DataFrame) -> DataFrame:
    """security_id, symbol, valid_from, valid_to (exclusive): each rename holds until the next.

    ``events``: security_id, symbol, day.  ``listings``: security_id, symbol; a security without
    events gets one open window.
    """
    w = Window.partitionBy("security_id").orderBy("day", "symbol")
    e = events.distinct()
    chain = e.select("security_id", "symbol", F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_to"))
    none = F.lit(None).cast("date")
    rest = listings.join(e.select("security_id").distinct(), "security_id", "left_anti").select("security_id", "symbol", none.alias("valid_from"), none.alias("valid_to"))
    return chain.unionByName(rest)


def resolve(rows: DataFrame, windows: DataFrame, symbol: str, day: str, name: str = "resolved_id") -> DataFrame:
    """``rows`` with the one security whose window covers (symbol, day); none if two different ones claim it.

    Open ends are nulls.  The windows are joined on the symbol, then filtered, and a row's claims are
    counted per distinct (symbol, day), so rows are never multiplied.
    """
    ask = rows.select(F.col(symbol).alias("_sym"), F.col(day).alias("_day")).where(F.col("_sym").isNotNull()).distinct()
    covers = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_day"))) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    hit = ask.join(windows, (F.col("_sym") == F.col("symbol")) & covers).groupBy("_sym", "_day").agg(F.min("security_id").alias("_a"), F.max("security_id").alias("_z"))
    return rows.join(hit, (F.col(symbol) == F.col("_sym")) & F.col(day).eqNullSafe(F.col("_day")), "left").withColumn(name, F.when(F.col("_a") == F.col("_z"), F.col("_a"))).drop("_sym", "_day", "_a", "_z")


def step_factors(splits: DataFrame, pin: str) -> DataFrame:
    """key, from_day, until_day, factor: the product of split_from / split_to over splits after a day, as a step function.

    Splits after the ``pin`` date and those into nothing don't count.
    """
    s = splits.where((F.col("execution_date") <= F.lit(pin).cast("date")) & (F.col("split_to") != 0)).groupBy("key", "execution_date").agg(F.product(F.col("split_from") / F.col("split_to")).alias("ratio"))
    after = Window.partitionBy("key").orderBy("execution_date").rowsBetween(0, Window.unboundedFollowing)
    before = F.lag("execution_date").over(Window.partitionBy("key").orderBy("execution_date"))
    return s.select("key", before.alias("from_day"), F.col("execution_date").alias("until_day"), F.product("ratio").over(after).alias("factor"))


def collisions(rows: DataFrame) -> DataFrame:
    """security_id, day, symbols: ids seen under more than one symbol on a day."""
    return rows.where(F.col("security_id").isNotNull()).groupBy("security_id", "day").agg(F.countDistinct("symbol").alias("symbols")).where(F.col("symbols") > 1)
