"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a random order that depends on their ids alone and cut into blocks
of equal tokens.  Slot i of the mixture takes the point frac((i + 1/2) * golden ratio), which falls into
one source's stretch of the cumulative weights, so every stretch of the schedule has the target shares.
The n-th slot of a source takes its n-th block, from the start again once all are used, at most
``max_repeats`` times.  Running sums and ranks are made in two steps, within chunks and over the chunks'
totals, so that no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.session import cut

_PHI = 0.6180339887498949
_CHUNKS = 4096
_SLOTS = 65_536
_CELLS = 4096


def blocks(sizes: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """source, doc_id, n_tokens with ``block`` and ``place``: the shuffled order cut into equal-token blocks."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    s = sizes.withColumn("_h", h).withColumn("_c", F.shiftrightunsigned("_h", 52))
    per = s.groupBy("source", "_c").agg(F.sum("n_tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("source").alias("_s"), F.col("_c").alias("_pc"), before.alias("_before"))  # at most 4,096 rows a source
    w = Window.partitionBy("source", "_c").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(per, (F.col("source") == F.col("_s")) & (F.col("_c") == F.col("_pc")))
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    return s.withColumn("place", start.cast("bigint")).select("source", "doc_id", "n_tokens", F.floor(F.col("place") / block_tokens).cast("bigint").alias("block"), "place")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[list[dict], float]:
    """Per source: share, tokens there are, repeats; and the size of the mixture."""
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    have = sizes.groupBy(F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = [r.asDict() for r in t.join(have, F.col("source") == F.col("_s"), "left").drop("_s").orderBy("source").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 sources have a target")
    for r in rows:
        r["tokens"], r["docs"], r["repeats"] = r["tokens"] or 0, r["docs"] or 0, max(0, r["repeats"] or 0)
    live = [r for r in rows if r["tokens"] * r["repeats"] > 0]
    whole = sum(r["share"] for r in live)
    for r in rows:
        r["weight"] = r["share"] / whole if r in live else 0.0
    feasible = min((r["tokens"] * r["repeats"] / r["weight"] for r in live), default=0.0)
    return rows, float(total_tokens or feasible)


def mixture(sizes: DataFrame, targets: DataFrame, block_tokens: int = 1024, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """slot, source, repeat_no, doc_id, n_tokens: the mixture in order of its slots.

    ``sizes``: source, doc_id, n_tokens.  ``targets``: source, target_share, max_repeats.  Without
    ``total_tokens`` the mixture is the largest in which every source that has documents reaches its
    share within its repeats; with it, a source that runs out is short of its share (see ``shares``).

    Defined cases: documents without a source, of a source without a target, or without tokens take no
    part; a target without documents (or with no repeats) gets nothing and the other shares grow in
    proportion; a repeated document row is a document of its own; no documents or no targets give no
    rows; further columns are ignored.
    """
    spark = sizes.sparkSession
    s = cut(sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("source", "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")))
    rows, total = plan(s, targets, total_tokens)
    live = [r for r in rows if r["weight"] > 0]
    empty = f"slot bigint, source string, repeat_no int, doc_id {sizes.schema['doc_id'].dataType.simpleString()}, n_tokens bigint"
    if not live:
        return spark.createDataFrame([], empty)
    # each source's stretch of the unit interval, filed under the cells it touches: a lookup by cell, whatever the number of sources
    stretches, upto = [], 0.0
    for k, r in enumerate(live):
        low, upto = upto, upto + r["weight"] if k + 1 < len(live) else 2.0
        for c in range(int(low * _CELLS), min(int(upto * _CELLS), _CELLS - 1) + 1):
            stretches.append((c, low, upto, r["source"], -(-r["tokens"] // block_tokens), r["repeats"]))
    lookup = F.broadcast(spark.createDataFrame(stretches, "_cell int, _low double, _high double, source string, _n bigint, _most int"))  # a row per cell and source at most, 10,000 sources
    b = blocks(s.join(F.broadcast(spark.createDataFrame([(r["source"],) for r in live], "source string")), "source", "left_semi"), block_tokens, seed)
    u = (F.col("id") + F.lit(0.5)) * F.lit(_PHI)
    slots = spark.range(0, max(1, round(total / block_tokens))).withColumn("u", u - F.floor(u)).withColumn("_at", F.floor(F.col("u") * _CELLS).cast("int"))
    slots = slots.join(lookup, (F.col("_at") == F.col("_cell")) & (F.col("u") >= F.col("_low")) & (F.col("u") < F.col("_high")))
    slots = slots.select("id", "source", "_n", "_most", F.floor(F.col("id") / _SLOTS).alias("_c"))
    per = slots.groupBy("source", "_c").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("source").alias("_s"), F.col("_c").alias("_pc"), before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source", "_c").orderBy("id")) - 1
    slots = slots.join(per, (F.col("source") == F.col("_s")) & (F.col("_c") == F.col("_pc"))).withColumn("_r", F.col("_before") + rank)
    slots = slots.withColumns({"block": F.pmod("_r", "_n"), "repeat_no": F.floor(F.col("_r") / F.col("_n")).cast("int")})
    slots = slots.where(F.col("repeat_no") < F.col("_most")).select(F.col("id").alias("slot"), F.col("source").alias("_slot_source"), F.col("block").alias("_slot_block"), "repeat_no")
    return slots.join(b, (F.col("_slot_source") == F.col("source")) & (F.col("_slot_block") == F.col("block"))).select("slot", "source", "repeat_no", "doc_id", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_uses, tokens_there, tokens_unused of every source with a target.

    ``tokens_there``: of the source's documents in ``sizes``; ``tokens_unused``: of those that are not in the mixture at all.
    """
    once = mixed.groupBy("source", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("uses"), F.max("repeat_no").alias("last"))
    used = once.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.sum("n_tokens").alias("apart"), F.count(F.lit(1)).alias("documents"), (F.max("last") + 1).alias("most_uses"))
    there = sizes.where(F.col("n_tokens") > 0).groupBy(F.col("source").alias("_h")).agg(F.sum("n_tokens").cast("bigint").alias("there"))
    t = targets.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("_t")).agg(F.max("target_share").alias("target_share"))
    j = t.join(used, F.col("_t") == F.col("source"), "left").join(there, F.col("_t") == F.col("_h"), "left")
    whole = F.sum("tokens").over(Window.partitionBy())  # over the few sources
    none = F.lit(0).cast("bigint")
    return j.select(
        F.col("_t").alias("source"), "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, none).alias(c) for c in ("tokens", "documents", "most_uses")],
        F.coalesce("there", none).alias("tokens_there"), (F.coalesce("there", none) - F.coalesce("apart", none)).alias("tokens_unused"),
    )
