"""Attributes as known at event time.

Facts become disjoint rectangles of valid and recorded time (the bitemporal ledger), in each of which
one fact is the current one.  The rectangles are indexed by a grid of equal cells, and each event, a
point (time it speaks about, time at which it may know), is looked up in its own cell only, so a hot
key is spread over its cells and no event meets a fact that became known later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.functions.timeline import DAY, EVER, FOREVER, floor_div
from tapeglass.operators.bitemporal import bitemporal_ledger


def locate(events: DataFrame, facts: DataFrame, key: list[str], event_time: str, value: str, valid_from: str, recorded_at: str, known_time: str | None = None, rank: str | None = None, extra: list[str] | None = None, cell: int = 16 * DAY) -> DataFrame:
    """Each event with the fact current at (``event_time``, ``known_time``): event columns, extra, value.

    Inner: an event of which nothing was known has no row.  ``known_time`` is ``event_time`` unless
    given.  ``extra``: further key columns of ``facts`` alone (say the kind of fact); an event gets one
    row for each.  Times are timestamps; a fact known exactly at the event's time counts.

    Defined cases: events and facts with a null in the key, and events without a time, match nothing;
    of facts that begin and became known at once the higher ``rank`` wins, then the greater value;
    repeated events with the same columns come out once; further columns of ``facts`` are ignored;
    columns of ``events`` named like ``extra`` or ``value`` give way to the result's; an empty table on either side gives no rows.  ``value`` comes out as text.
    """
    extra = extra or []
    ledger = bitemporal_ledger(facts, [*key, *extra], value, valid_from, recorded_at, rank)
    t, known = F.unix_micros(event_time), F.unix_micros(known_time or event_time)
    columns = [c for c in events.columns if c not in (*extra, value)]
    ev = events.select(*columns).where(F.col(event_time).isNotNull() & (F.col(known_time).isNotNull() if known_time else F.lit(True)))
    for c in key:
        ev = ev.where(F.col(c).isNotNull())
    ev = ev.withColumns({"_t": t, "_known": known})
    # the part of the grid that events can touch: one row of four numbers, worked out beside the rectangles
    cv, cr = floor_div(F.col("_t"), cell), floor_div(F.col("_known"), cell)
    span = F.broadcast(ev.agg(F.min(cv).alias("_low"), F.max(cv).alias("_high"), F.min(cr - cv).alias("_least"), F.max(cr - cv).alias("_most")))
    ev = ev.withColumns({"_cv": cv, "_cr": cr}).repartition(*key, "_cv", "_cr").dropDuplicates([*columns, "_cv", "_cr"])
    edge = lambda c, end: F.coalesce(F.unix_micros(c), F.lit(end))
    rect = ledger.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *extra, F.col(value).alias("_value"),
        edge("valid_from", EVER).alias("_vf"), edge("valid_to", FOREVER).alias("_vt"), edge("recorded_from", EVER).alias("_rf"), edge("recorded_to", FOREVER).alias("_rt"),
    )
    # cells the rectangle covers, clipped to those that can hold an event; without events the bounds are null and none is left
    rect = rect.crossJoin(span).where(F.col("_low").isNotNull())
    v0 = F.greatest(floor_div(F.col("_vf"), cell), floor_div(F.col("_rf"), cell) - F.col("_most"), F.col("_low"))
    v1 = F.least(floor_div(F.col("_vt") - 1, cell), floor_div(F.col("_rt") - 1, cell) - F.col("_least"), F.col("_high"))
    rect = rect.withColumns({"_v0": v0, "_v1": v1}).where(F.col("_v0") <= F.col("_v1"))
    rect = rect.withColumn("_cv", F.explode(F.sequence("_v0", "_v1")))
    r0 = F.greatest(floor_div(F.col("_rf"), cell), F.col("_cv") + F.col("_least"))
    r1 = F.least(floor_div(F.col("_rt") - 1, cell), F.col("_cv") + F.col("_most"))
    rect = rect.withColumns({"_r0": r0, "_r1": r1}).where(F.col("_r0") <= F.col("_r1")).withColumn("_cr", F.explode(F.sequence("_r0", "_r1")))
    on = [ev["_cv"] == rect["_cv"], ev["_cr"] == rect["_cr"], *[ev[c] == rect[f"_k{i}"] for i, c in enumerate(key)]]
    inside = (ev["_t"] >= rect["_vf"]) & (ev["_t"] < rect["_vt"]) & (ev["_known"] >= rect["_rf"]) & (ev["_known"] < rect["_rt"])
    cond = inside
    for c in reversed(on):
        cond = c & cond
    return ev.join(rect, cond).select(*[ev[c] for c in columns], *[rect[c] for c in extra], rect["_value"].alias(value))
