"""Trailing analytics over a daily panel: every frame ends at the day before.

The panel has security_id, day, o, h, l, c, v (volume), q (dollars), one row per security and traded
day.  Each function adds columns over one window specification, so Spark sorts once per security.
A figure over n days is null until the days it needs are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_security() -> WindowSpec:
    return Window.partitionBy("security_id").orderBy("day")


def prior(n: int) -> WindowSpec:
    """The n traded days before the row's own."""
    return by_security().rowsBetween(-n, -1)


def full(value: Column, agg: Column, n: int, frame: WindowSpec | None = None) -> Column:
    """``agg`` over the n days before, null unless all n have ``value``."""
    w = frame or prior(n)
    return F.when(F.count(value).over(w) == n, agg.over(w))


def with_returns(panel: DataFrame) -> DataFrame:
    """idx (traded days before), pc (close before), ret, log return, true range, overnight gap, and the parts of the Yang-Zhang estimate."""
    w = by_security()
    p = panel.withColumns({"idx": (F.row_number().over(w) - 1).cast("bigint"), "pc": F.lag("c").over(w)})
    good = (F.col("o") > 0) & (F.col("h") > 0) & (F.col("l") > 0) & (F.col("c") > 0)
    ratio = lambda a, b: F.when(b > 0, a / b)
    return p.withColumns({
        "ret": ratio(F.col("c"), F.col("pc")) - 1,
        "lret": F.when((F.col("pc") > 0) & (F.col("c") > 0), F.ln(F.col("c") / F.col("pc"))),
        "tr": F.when(F.col("pc").isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("pc")), F.abs(F.col("l") - F.col("pc")))),
        "gap": ratio(F.col("o"), F.col("pc")) - 1,
        "on": F.when(good & (F.col("pc") > 0), F.ln(F.col("o") / F.col("pc"))),
        "oc": F.when(good, F.ln(F.col("c") / F.col("o"))),
        "rs": F.when(good, F.ln(F.col("h") / F.col("c")) * F.ln(F.col("h") / F.col("o")) + F.ln(F.col("l") / F.col("c")) * F.ln(F.col("l") / F.col("o"))),
    })


def atr(n: int) -> Column:
    return full(F.col("tr"), F.avg("tr"), n)


def realized_vol(n: int) -> Column:
    return full(F.col("lret"), F.stddev_samp("lret"), n) * F.sqrt(F.lit(252.0))


def average(value: str, n: int) -> Column:
    return full(F.col(value), F.avg(value), n)


def yang_zhang(n: int) -> Column:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    w = prior(n)
    var = F.var_samp("on").over(w) + k * F.var_samp("oc").over(w) + (1 - k) * F.avg("rs").over(w)
    there = (F.count("on").over(w) == n) & (F.count("oc").over(w) == n) & (F.count("rs").over(w) == n)
    return F.when(there & (var >= 0), F.sqrt(var * 252))


def days_since_move(x: float) -> Column:
    """Traded days since the last move of at least x, counted to the row's own day."""
    moved = F.last(F.when(F.abs(F.col("ret")) >= x, F.col("idx")), True).over(by_security().rowsBetween(Window.unboundedPreceding, -1))
    return F.col("idx") - moved


def up_streak() -> Column:
    """Days in a row with a positive return, up to the day before; null on the first day."""
    w = by_security().rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(~F.coalesce(F.col("ret") > 0, F.lit(False)), F.col("idx")), True).over(w)
    return F.col("idx") - 1 - stop


def first_in(fired: Column, n: int) -> Column:
    """Fired today but in none of the n days before: false if not today, null if unknown or too short a history."""
    w = prior(n)
    known = F.when(F.count(F.lit(1)).over(w) == n, F.max(F.coalesce(fired, F.lit(False))).over(w))
    return F.when(~fired, False).when(fired, ~known)


def median_of_prior(value: str, n: int) -> Column:
    return full(F.col(value), F.percentile(F.col(value), F.lit(0.5)), n)


def beta(x: str, y: str, n: int, least: int) -> Column:
    """Slope of y on x over the n days before, of at least ``least`` days that have both."""
    w = prior(n)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fx, fy = F.when(both, F.col(x)), F.when(both, F.col(y))
    v = F.var_samp(fx).over(w)
    return F.when((F.count(fx).over(w) >= least) & (v > 0), F.covar_samp(fx, fy).over(w) / v)


def ewma(panel: DataFrame, value: str, halflife: float) -> DataFrame:
    """security_id, day, ewma: one recursion v = decay * v + (1 - decay) * value over a security's whole series, a row per day.

    Days without a value are left out; the first value starts the recursion.  A series is cut into
    blocks of a year: each is folded to its length and weighted sum, a running pass over a security's
    blocks gives the state at each one's start, and from that the days follow (decay ** -366 must be finite).
    """
    decay = 0.5 ** (1 / halflife)
    p = panel.where(F.col(value).isNotNull()).groupBy("security_id", F.year("day").alias("_year")).agg(F.sort_array(F.collect_list(F.struct("day", F.col(value).cast("double").alias("x")))).alias("_s"))  # some 250 days
    p = p.withColumn("_fold", F.struct(F.size("_s").alias("n"), F.aggregate("_s", F.lit(0.0), lambda a, r: a * decay + r.x * (1 - decay)).alias("sum")))
    w = Window.partitionBy("security_id").orderBy("_year")
    p = p.withColumns({"_first": F.first(F.col("_s")[0]["x"]).over(w), "_folds": F.collect_list("_fold").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    p = p.withColumn("_state", F.aggregate("_folds", F.col("_first"), lambda a, b: a * F.pow(F.lit(decay), b.n) + b.sum))
    d = p.select("security_id", "_year", "_state", F.posexplode("_s").alias("_i", "_r"))
    k = F.pow(F.lit(decay), F.col("_i") + 1)
    inside = F.sum(F.col("_r.x") * (1 - decay) / k).over(Window.partitionBy("security_id", "_year").orderBy("_i"))
    return d.select("security_id", F.col("_r.day").alias("day"), (k * (F.col("_state") + inside)).alias("ewma"))
