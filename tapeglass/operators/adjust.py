"""Corporate actions: split factors, cash, and what a day is worth on another day's basis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.operators.identity import step_factors


def split_factor(rows: DataFrame, splits: DataFrame, pin: str, key: str, symbol: str, day: str, name: str = "factor") -> DataFrame:
    """``rows`` with the product of split_from / split_to over the splits after ``day`` and up to ``pin``.

    ``splits``: security_id, symbol, execution_date, split_from, split_to.  The splits under a row's
    ``key`` count; only if there are none at all under it, those under its ``symbol``.  Splits into
    nothing and after the pin don't count.  Rows come out once each; without splits the factor is 1.
    """
    known = splits.where((F.col("execution_date") <= F.lit(pin).cast("date")) & (F.col("split_to") != 0))
    sides = {}
    for side, c, own in (("id", "security_id", key), ("sym", "symbol", symbol)):
        steps = step_factors(known.where(F.col(c).isNotNull()).withColumn("key", F.col(c)), pin)
        sides[side] = steps.select(F.col("key").alias(f"_k_{side}"), F.col("from_day").alias(f"_f_{side}"), F.col("until_day").alias(f"_u_{side}"), F.col("factor").alias(f"_x_{side}")), own
    out = rows
    for side, (steps, own) in sides.items():
        covers = (F.col(own) == F.col(f"_k_{side}")) & (F.col(f"_f_{side}").isNull() | (F.col(day) >= F.col(f"_f_{side}"))) & (F.col(day) < F.col(f"_u_{side}"))
        out = out.join(steps, covers, "left")
    has = known.where(F.col("security_id").isNotNull()).select(F.col("security_id").alias("_has")).distinct()
    out = out.join(has, F.col(key) == F.col("_has"), "left")
    factor = F.when(F.col("_has").isNotNull(), F.coalesce("_x_id", F.lit(1.0))).otherwise(F.coalesce("_x_sym", F.lit(1.0)))
    return out.withColumn(name, factor).select(*[c for c in rows.columns if c != name], name)


def cash_so_far(rows: DataFrame, cash: DataFrame, key: str, day: str, name: str = "cash") -> DataFrame:
    """``rows`` with all cash of their key that went ex up to and on ``day``; differences of it are the cash of a period.

    ``cash``: key, ex_date, amount.  The running sums are a step function per key.
    """
    w = Window.partitionBy("_k").orderBy("_from")
    s = cash.where(F.col("amount").isNotNull() & F.col("ex_date").isNotNull()).groupBy(F.col(key).alias("_k"), F.col("ex_date").alias("_from")).agg(F.sum("amount").alias("_a"))
    s = s.select("_k", "_from", F.lead("_from").over(w).alias("_until"), F.sum("_a").over(w).alias("_sum"))
    on = (F.col(key) == F.col("_k")) & (F.col(day) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(day) < F.col("_until")))
    return rows.join(s, on, "left").withColumn(name, F.coalesce("_sum", F.lit(0.0))).drop("_k", "_from", "_until", "_sum")


def days_ahead(starts: DataFrame, daily: DataFrame, key: str, index: str, most: int) -> DataFrame:
    """Each row of ``starts`` (key, index) with the ``most`` rows of ``daily`` after it, as ``ahead`` (1, 2, ...) and daily's other columns.

    Index counts a key's own rows.  Daily rows are filed under the blocks from which they are within
    reach, so a key with a long history is spread over its blocks.  Left: a start without later rows comes once, with nulls.
    """
    block = lambda c: F.floor(c / most).cast("bigint")
    rest = [c for c in daily.columns if c not in (key, index)]
    filed = daily.select(F.col(key).alias("_k"), F.col(index).alias("_i"), *rest).withColumn("_b", F.explode(F.array_distinct(F.array(block(F.col("_i") - 1), block(F.col("_i") - most)))))
    on = (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b")) & (F.col("_i") > F.col(index)) & (F.col("_i") <= F.col(index) + most)
    return starts.withColumn("_at", block(F.col(index))).join(filed, on, "left").withColumn("ahead", F.col("_i") - F.col(index)).drop("_k", "_i", "_at", "_b")
