"""Ranks and quantile cuts inside a group, always by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.session import cut


def finite(value: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def rank_desc(df: DataFrame, group: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """``<name>_rank`` 1..m by falling value among the group's finite values, and ``<name>_pct`` = (m - rank) / m; null stays null.

    Ties keep the order of the columns ``order``.
    """
    v = finite(F.col(value))
    w = Window.partitionBy(*group).orderBy(v.desc_nulls_last(), *order)
    m = F.count(v).over(Window.partitionBy(*group))
    df = df.withColumns({f"{name}_rank": F.when(v.isNotNull(), F.row_number().over(w).cast("bigint")), "_m": m})
    return df.withColumn(f"{name}_pct", (F.col("_m") - F.col(f"{name}_rank")) / F.col("_m")).drop("_m")


def rank_average(group: list[str], value: str) -> Column:
    """Mean rank of ties over the number of values."""
    w = Window.partitionBy(*group).orderBy(value)
    peers, n = F.count(value).over(Window.partitionBy(*group, value)), F.count(value).over(Window.partitionBy(*group))
    return F.when(F.col(value).isNotNull(), (F.rank().over(w) - F.count(F.when(F.col(value).isNull(), 1)).over(Window.partitionBy(*group)) + (peers - 1) / 2) / n)


def rank_ordinal(group: list[str], value: str, order: list[str]) -> Column:
    w = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last(), *order)
    return F.when(F.col(value).isNotNull(), F.row_number().over(w) / F.count(value).over(Window.partitionBy(*group)))


def quantile_bucket(df: DataFrame, group: list[str], value: str, n: int, name: str) -> DataFrame:
    """Bucket 1..n between linear quantiles of a group, closed below; the last one closed above as well.  Over all rows see ``global_ntile``."""
    if not group:
        raise ValueError("quantiles of all rows in one task: use global_ntile or multiselect")
    j = df.join(df.groupBy(*group).agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_q")), group)
    return j.withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("_q", lambda q: F.col(value) >= q)) + 1).cast("bigint")).drop("_q")


def top_share(df: DataFrame, group: list[str], value: str, share: float, order: list[str]) -> DataFrame:
    """Of each group the max(1, round(n * share)) rows with the greatest values."""
    g = Window.partitionBy(*group)
    w = g.orderBy(F.col(value).desc_nulls_last(), *order)
    return df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(g)}).where(F.col("_r") <= F.greatest(F.lit(1), F.round(F.col("_n") * share))).drop("_r", "_n")


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its rank 1..n over all rows by the total order ``order``, without one task for all rows.

    Rows are parted by ranges of the order, numbered inside their range, and moved up by the number of
    rows in the ranges before: a number per range is all that comes together.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumns({f"_o{j}": c for j, c in enumerate(cols)})
    keys = [f"_o{j}" for j in range(len(cols))]
    parted = cut(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    per = parted.groupBy("_part").count()
    before = per.select(F.col("_part").alias("_q"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parted.join(F.broadcast(before), F.col("_part") == F.col("_q")).withColumn(name, (F.col("_before") + own).cast("bigint")).drop(*keys, "_part", "_q", "_before")


def global_ntile(df: DataFrame, order: list, n: int, name: str) -> DataFrame:
    """``df`` with its bucket 1..n over all rows by the total order, the first buckets one larger where the rows don't divide."""
    r = global_rank(df, order, "_rank")
    m = F.broadcast(r.agg(F.count(F.lit(1)).alias("_m")))  # one row
    size, rest = F.floor(F.col("_m") / n), F.col("_m") % n
    edge = rest * (size + 1)
    bucket = F.when(F.col("_rank") <= edge, F.ceil(F.col("_rank") / (size + 1))).otherwise(rest + F.ceil((F.col("_rank") - edge) / F.greatest(size, F.lit(1))))
    return r.crossJoin(m).withColumn(name, bucket.cast("bigint")).drop("_rank", "_m")
