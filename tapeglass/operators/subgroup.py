"""Bump hunting: peel a box of features down to where the target's mean is highest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.session import cut


def binned(df: DataFrame, features: list[str], bins: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """``df`` with ``<feature>_bin`` and the bins' upper edges: values of the data, at about equal counts.

    With at most ``bins`` different values of a feature each has a bin of its own.
    """
    from pyspark.ml.feature import Bucketizer

    edges = {}
    for f in features:
        few = [r[0] for r in df.select(f).distinct().limit(bins + 1).collect()]
        edges[f] = sorted(few) if len(few) <= bins else sorted(set(df.stat.approxQuantile(f, [k / bins for k in range(1, bins + 1)], 0.25 / bins)))
    # a bin is open below and closed above, so the splits lie just above its edges
    splits = {f: [-float("inf"), *[float(np.nextafter(x, np.inf)) for x in edges[f][:-1]], float("inf")] for f in features}
    out = df
    for f in features:
        if len(splits[f]) > 2:
            out = Bucketizer(splits=splits[f], inputCol=f, outputCol=f"{f}_bin", handleInvalid="error").transform(out)
        else:
            out = out.withColumn(f"{f}_bin", F.lit(0.0))
    return out.withColumns({f"{f}_bin": F.col(f"{f}_bin").cast("int") for f in features}), edges


def peel(df: DataFrame, features: list[str], target: str, alpha: float = 0.05, least: float = 0.1, every: int = 10, bins: int = 4096) -> list[dict]:
    """The trajectory of boxes: step, feature, side, bound, n, mean.

    Each step drops the ``alpha`` tail of one feature, on the side that leaves the highest mean, until
    no tail can be dropped that leaves ``least`` of the rows.  A step drops a bin at least, so it ends.
    Bounds lie on the edges of ``bins`` bins per feature, so a step is one grouped pass that gives counts
    and sums per bin, at most that many rows per feature to the driver; no quantile is worked out in one
    task.  The box is materialised ``every`` so many steps.  Rows with a null or NaN feature or a null target are left out.
    """
    base = df.where(F.col(target).isNotNull())
    for f in features:
        base = base.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    whole = base.count()
    if not whole:
        return []
    base, edges = binned(base.withColumns({f: F.col(f).cast("double") for f in features}), features, bins)
    base = cut(base.select(*[f"{f}_bin" for f in features], F.col(target).cast("double").alias("_y")))
    box, out = base, []
    while True:
        long = box.select("_y", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"{f}_bin").alias("bin")) for j, f in enumerate(features)])))
        rows = long.groupBy("j", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")).collect()  # at most ``bins`` a feature
        best = None
        for j, f in enumerate(features):
            mine = sorted((r.bin, r.n, r.s) for r in rows if r.j == j)
            b, n, s = (np.array(x) for x in zip(*mine, strict=True))
            total, mean = n.sum(), s.sum()
            low, high = n.cumsum(), n[::-1].cumsum()[::-1]
            # the tail holds the bins up to the one in which the share alpha is reached
            k = int(np.searchsorted(low, alpha * total, "left"))
            q = len(b) - 1 - int(np.searchsorted(high[::-1], alpha * total, "left"))
            for side, drop, at in (("low", slice(0, k + 1), b[k]), ("high", slice(q, None), b[q])):
                left = int(total - n[drop].sum())
                if left and left >= least * whole:
                    m = float((mean - s[drop].sum()) / left)
                    bound = edges[f][at] if side == "low" else edges[f][at - 1] if at else edges[f][0]
                    if best is None or m > best[0]:
                        best = (m, f, side, int(at), float(bound), left)
        if best is None:
            return out
        m, f, side, at, bound, left = best
        box = box.where(F.col(f"{f}_bin") > at if side == "low" else F.col(f"{f}_bin") < at)
        out.append({"step": len(out), "feature": f, "side": side, "bound": bound, "n": left, "mean": m})
        if len(out) % every == 0:
            box = cut(box)
