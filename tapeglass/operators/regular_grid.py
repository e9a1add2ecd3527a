"""Irregular readings onto a regular grid, per source.

Readings are aggregated by bucket, each source gets its whole sequence of buckets from its first to
its last reading, the readings are left joined, the last one is carried forward over at most
``max_gap`` buckets, and what is still without one is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import floor_div


def regular_grid(readings: DataFrame, source: list[str], bucket: Column, values: dict[str, Column], carry: list[str], max_gap: int, block: int = 1024, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per source and bucket: source, bucket, state, since, previous, values.

    ``bucket``: bigint bucket number of a reading.  ``values``: aggregates of a bucket's readings;
    those in ``carry`` are carried forward.  ``state`` is ``read``, ``carried`` or ``missing``;
    ``since``: buckets since the last reading (0 if read); ``previous``: the bucket of the reading
    before this bucket, null for the first.  A source's sequence is cut into blocks of ``block``
    buckets that are filled apart from each other, with the last reading before the block brought in.
    ``bounds``: first and last bucket of a source's grid as functions of its columns; buckets before the
    first reading are ``missing``, readings outside the bounds are left out.  Without them a grid goes from
    a source's first to its last reading.

    Defined cases: readings with a null in the source or no bucket are left out; a null aggregate is
    carried as null; repeated readings count as ``values`` says; empty input gives an empty grid.
    """
    r = readings.withColumn("_bucket", bucket.cast("bigint")).where(F.col("_bucket").isNotNull())
    for c in source:
        r = r.where(F.col(c).isNotNull())
    b = r.groupBy(*source, "_bucket").agg(*[v.alias(n) for n, v in values.items()]) if values else r.select(*source, "_bucket").distinct()
    if bounds:
        b = b.where(F.col("_bucket").between(*bounds))
    # both sides of the join below come from this one shuffle
    b = b.withColumn("_blk", floor_div(F.col("_bucket"), block)).where(F.col("_blk").isNotNull())
    last = F.struct("_bucket", *carry)
    s = b.groupBy(*source, "_blk").agg(F.min("_bucket").alias("first"), F.max_by(last, "_bucket").alias("last"))
    w = Window.partitionBy(*source).orderBy("_blk")
    s = s.withColumns({"before": F.lag("last").over(w), "next": F.lead("_blk").over(w)})
    low, high = bounds or (F.col("first"), F.col("last._bucket"))
    start = F.when(F.col("before").isNull(), floor_div(low.cast("bigint"), block)).otherwise(F.col("_blk"))
    stop = F.when(F.col("next").isNull(), floor_div(high.cast("bigint"), block)).otherwise(F.col("next") - 1)
    s = s.withColumn("_g", F.explode(F.sequence(start, stop)))
    a = F.when(F.col("before").isNull(), F.greatest(low.cast("bigint"), F.col("_g") * block)).otherwise(F.col("_g") * block)
    z = F.when(F.col("next").isNull(), F.least(high.cast("bigint"), (F.col("_g") + 1) * block - 1)).otherwise((F.col("_g") + 1) * block - 1)
    into = F.when(F.col("_g") > F.col("_blk"), F.col("last")).otherwise(F.col("before"))
    grid = s.select(*source, F.col("_g").alias("_blk"), into.alias("_in"), F.explode(F.sequence(a, z)).alias("_bucket"))
    full = grid.join(b.withColumn("_own", last), [*source, "_blk", "_bucket"], "left")
    up_to = Window.partitionBy(*source, "_blk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*source, "_blk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({"_last": F.coalesce(F.last("_own", True).over(up_to), "_in"), "_prev": F.coalesce(F.last("_own", True).over(earlier), "_in")})
    since = F.col("_bucket") - F.col("_last._bucket")
    state = F.when(F.col("_own").isNotNull(), "read").when(F.coalesce(since <= max_gap, F.lit(False)), "carried").otherwise("missing")
    return full.select(
        *source, F.col("_bucket").alias("bucket"), state.alias("state"), since.alias("since"), F.col("_prev._bucket").alias("previous"),
        *[(F.when(since <= max_gap, F.col(f"_last.`{n}`")) if n in carry else F.col(n)).alias(n) for n in values],
    )


def gaps(grid: DataFrame, source: list[str], least: int) -> DataFrame:
    """Consecutive readings ``least`` or more buckets apart: source, gap_from, gap_to."""
    return grid.where((F.col("state") == "read") & (F.col("bucket") - F.col("previous") >= least)).select(*source, F.col("previous").alias("gap_from"), F.col("bucket").alias("gap_to"))
