"""Bitemporal ledger: the history of a changing attribute, with valid and recorded time.

A statement says "from ``valid_from`` on the attribute is ``value``" and became known at
``recorded_at``.  At a recorded time T the statements known by then lie on the valid-time axis, and
each holds until the next one.  Maximal runs of equal values are the versions.  The ledger has one
row per version and period of recorded time over which it read the same, so a late statement closes
the row it splits (``recorded_to``) and adds its parts; nothing is overwritten.

How it is made: points on the valid axis are swept from late to early while an ordered list keeps, for
each stretch of recorded time, the version that is open at the sweep line.  A statement closes the
version it cuts off, or extends it to the left if it says the same; the stretches it meets are found by
bisection.  The sweep runs twice: inside blocks of (key, stretch of valid time), so a hot key is spread
over its blocks, and then over what the blocks hand to each other, the first and the last version of
each.  Statements that can never begin a version are dropped in the blocks before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeglass.functions.timeline import DAY, EVER, FOREVER, floor_div


def _axis(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    return col.cast("bigint")


def _back(col: Column, kind: T.DataType) -> Column:
    """The axis value as its own type; the ends of time become null."""
    inside = F.when((col != F.lit(FOREVER)) & (col != F.lit(EVER)), col)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(inside.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(inside)
    return inside


def points(statements: DataFrame, key: list[str], value: str, valid_from: str, recorded_at: str, rank: str | None, block: int) -> DataFrame:
    """Statements that stand for some time at their own place on the valid axis: k, blk, v, x, ra, rb.

    Of several at one place the higher rank stands, then the later recorded, then the greater value.
    Statements that never begin a version are left out.
    """
    kinds = {f.name: f.dataType for f in statements.schema.fields}
    s = statements.select(
        F.struct(*[F.col(c).alias(c) for c in key]).alias("k"),
        _axis(F.col(valid_from), kinds[valid_from]).alias("v"),
        F.coalesce(_axis(F.col(recorded_at), kinds[recorded_at]), F.lit(EVER)).alias("ra"),
        F.col(value).cast("string").alias("x"),
        (F.col(rank) if rank else F.lit(0)).alias("rank"),
    ).where(F.col("v").isNotNull() & ~F.greatest(*[F.col(f"k.`{c}`").isNull() for c in key], F.lit(False)))
    s = s.withColumn("blk", floor_div(F.col("v"), block)).repartition("k", "blk")
    here = Window.partitionBy("k", "blk", "v").orderBy("ra", "rank", "x")
    own = F.struct("rank", "ra", "x")
    s = s.withColumn("best", F.max(own).over(here.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("best") == own)
    n = F.row_number().over(here)
    s = s.withColumn("n", n).withColumn("px", F.lag("x").over(here)).where((F.col("n") == 1) | ~F.col("px").eqNullSafe(F.col("x")))
    s = s.withColumn("rb", F.lead("ra", 1, FOREVER).over(here)).where(F.col("ra") < F.col("rb"))
    before = Window.partitionBy("k", "blk").orderBy("v", "ra")
    same = F.lag(F.struct("v", "x", "ra", "rb")).over(before)
    s = s.withColumn("q", same)
    idle = F.col("q.v").isNotNull() & (F.col("q.v") < F.col("v")) & F.col("q.x").eqNullSafe(F.col("x")) & (F.col("q.ra") <= F.col("ra")) & (F.col("q.rb") >= F.col("rb"))
    return s.where(~idle).select("k", "blk", "v", "x", "ra", "rb")


class Axis:
    """A map from recorded time to what holds over a stretch of it: stretches in order, each until the next begins."""

    def __init__(self) -> None:
        self.at: list[int] = [EVER]
        self.what: list[tuple | None] = [None]

    def change(self, ra: int, rb: int, new: Callable[[tuple | None, int, int], tuple]) -> None:
        """Replace what holds over ra..rb by ``new(what, from, to)``; the stretches it meets are found by bisection, the others aren't touched."""
        at, what = self.at, self.what
        i, j = bisect_right(at, ra) - 1, bisect_left(at, rb)
        t: list[int] = []
        w: list[tuple | None] = []
        if at[i] < ra:
            t.append(at[i])
            w.append(what[i])
        elif i and what[i - 1] is not None:
            i -= 1
            t.append(at[i])
            w.append(what[i])
        for k in range(bisect_right(at, ra) - 1, j):
            a, b = max(at[k], ra), min(at[k + 1] if k + 1 < len(at) else FOREVER, rb)
            n = new(what[k], a, b)
            if not w or w[-1] != n:
                t.append(a)
                w.append(n)
        end = at[j] if j < len(at) else FOREVER
        if rb < end:
            if w[-1] != what[j - 1]:
                t.append(rb)
                w.append(what[j - 1])
        elif j < len(at) and what[j] == w[-1]:
            j += 1
        at[i:j], what[i:j] = t, w

    def stretches(self) -> Iterator[tuple[int, int, tuple]]:
        for k, (a, w) in enumerate(zip(self.at, self.what, strict=True)):
            if w is not None:
                yield a, self.at[k + 1] if k + 1 < len(self.at) else FOREVER, w


def sweep_block(rows: Iterable[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Sweep one block's (v, x, ra, rb) by falling v: the versions that begin and end inside it, and what its neighbours need.

    Versions: (x, valid_from, valid_to, recorded_from, recorded_to).  For the neighbours, per stretch of
    recorded time: the first version's begin and value, a mark where it ends (its end is known, and what
    lies behind the mark is told already), and the last version's begin and value, as (v, x, marked, ra, rb).
    """
    # over a stretch: begin and value of the first version, its end if another follows, begin and value of the last one
    axis, inner = Axis(), []
    for v, x, ra, rb in rows:

        def new(was, a, b, v=v, x=x):
            if was is None:
                return v, x, None, None, None
            first, value, end, last, ending = was
            if value == x:
                return v, x, end, last, ending
            if end is None:
                return v, x, first, first, value
            inner.append((value, first, end, a, b))
            return v, x, first, last, ending

        axis.change(ra, rb, new)
    edges: list[tuple] = []
    open_: dict[int, list] = {}

    def tell(kind: int, a: int, b: int, fact: tuple | None) -> None:
        was = open_.get(kind)
        if was and was[2] == fact and was[1] == a:
            was[1] = b
            return
        if was and was[2] is not None:
            edges.append((*was[2], was[0], was[1]))
        open_[kind] = [a, b, fact]

    for a, b, (first, value, end, last, ending) in axis.stretches():
        tell(0, a, b, (first, value, False))
        tell(1, a, b, (end, None, True) if end is not None and end != last else None)
        tell(2, a, b, (last, ending, False) if end is not None else None)
    edges += [(*fact, a, b) for a, b, fact in open_.values() if fact is not None]
    return inner, edges


def sweep(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Sweep (key, v, x, marked, ra, rb), sorted by key and falling v; yields (key, x, valid_from, valid_to, recorded_from, recorded_to).

    Over a stretch of recorded time (begin, value, marked, end) is the version open at the sweep line; a
    marked one only ends the one before it.
    """
    for key, own in groupby(rows, lambda r: r[0]):
        axis, out = Axis(), []
        for _, v, x, marked, ra, rb in own:

            def new(was, a, b, v=v, x=x, marked=marked):
                if was is None:
                    return v, x, marked, FOREVER
                begin, value, mark, end = was
                if value == x and mark == marked:
                    return v, x, marked, end
                if not mark:
                    out.append((key, value, begin, end, a, b))
                return v, x, marked, begin

            axis.change(ra, rb, new)
            if len(out) >= 20_000:
                yield from out
                out.clear()
        yield from out
        yield from ((key, value, begin, end, a, b) for a, b, (begin, value, mark, end) in axis.stretches() if not mark)


def _batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for first in (rows := iter(rows)):
        cols = zip(*[first, *islice(rows, 20_000)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def bitemporal_ledger(statements: DataFrame, key: list[str], value: str, valid_from: str, recorded_at: str, rank: str | None = None, block: int | None = None) -> DataFrame:
    """The full ledger: key columns, value, valid_from, valid_to, recorded_from, recorded_to.

    ``valid_from`` and ``recorded_at`` are dates, timestamps or bigints.  ``valid_to`` null: until
    further notice; ``recorded_to`` null: the row stands today.  ``rank``: of statements at one place
    the higher outranks, whenever recorded.  ``block``: stretch of the valid axis (days or
    microseconds) that spreads a key, by default 128 days.

    Defined cases: rows with a null key or valid_from say nothing and are left out; a null value is a
    value ("none from here on"), so a bounded period is a value and a null; a null ``recorded_at``
    means known for ever; repeated rows change nothing; ties go to the greater value; further columns
    are ignored; an empty table gives an empty ledger.
    """
    kinds = {f.name: f.dataType for f in statements.schema.fields}
    if block is None:
        block = 128 * DAY if isinstance(kinds[valid_from], T.TimestampType) else 128
    p = points(statements, key, value, valid_from, recorded_at, rank, block)
    # the key travels as one JSON text: the sweeps only compare it
    p = p.select(F.to_json("k").alias("kj"), "blk", "v", "x", "ra", "rb").sortWithinPartitions("kj", "blk", F.desc("v"), "ra")
    flat = [("kj", pa.string()), ("part", pa.int64()), ("x", pa.string()), ("v", pa.int64()), ("vt", pa.int64()), ("marked", pa.bool_()), ("ra", pa.int64()), ("rb", pa.int64())]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
            for (kj, blk), own in groupby(rows, lambda r: r[:2]):
                inner, edges = sweep_block(r[2:] for r in own)
                for x, vf, vt, a, b in inner:
                    yield kj, 1 + blk % 1024, x, vf, vt, False, a, b
                for v, x, marked, a, b in edges:
                    yield kj, 0, x, v, None, marked, a, b

        yield from _batches(told(), [n for n, _ in flat], [t for _, t in flat])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
            for through, own in groupby(rows, lambda r: r[1] > 0):
                if through:
                    yield from ((kj, x, v, vt, ra, rb) for kj, _, x, v, vt, _, ra, rb in own)
                else:
                    yield from sweep((kj, v, x, marked, ra, rb) for kj, _, x, v, _, marked, ra, rb in own)

        yield from _batches(every(), ["kj", "x", "vf", "vt", "rf", "rt"], [pa.string(), pa.string(), *[pa.int64()] * 4])

    # versions that lie inside a block are told and only pass through, spread by their block; the rest of a key meets in one place
    told = p.mapInArrow(inside, "kj string, part bigint, x string, v bigint, vt bigint, marked boolean, ra bigint, rb bigint")
    told = told.repartition("kj", "part").sortWithinPartitions("kj", "part", F.desc("v"), "ra")
    swept = told.mapInArrow(across, "kj string, x string, vf bigint, vt bigint, rf bigint, rt bigint")
    # a version that a later cut left unchanged comes in several stretches of recorded time
    w = Window.partitionBy("kj", "x", "vf", "vt").orderBy("rf")
    swept = swept.withColumn("new", F.when(F.lag("rt").over(w) == F.col("rf"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    merged = swept.groupBy("kj", "x", "vf", "vt", "run").agg(F.min("rf").alias("rf"), F.max("rt").alias("rt"))
    schema = T.StructType([T.StructField(c, kinds[c]) for c in key])
    k = F.from_json("kj", schema)
    return merged.withColumn("k", k).select(
        *[F.col(f"k.`{c}`").alias(c) for c in key],
        F.col("x").alias(value),
        _back(F.col("vf"), kinds[valid_from]).alias("valid_from"),
        _back(F.col("vt"), kinds[valid_from]).alias("valid_to"),
        _back(F.col("rf"), kinds[recorded_at]).alias("recorded_from"),
        _back(F.col("rt"), kinds[recorded_at]).alias("recorded_to"),
    )


def standing(ledger: DataFrame) -> DataFrame:
    """The versions as known today."""
    return ledger.where(F.col("recorded_to").isNull())


def as_known(ledger: DataFrame, at: Column) -> DataFrame:
    """The versions as they read at the recorded time ``at``."""
    return ledger.where((F.col("recorded_from").isNull() | (F.col("recorded_from") <= at)) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > at)))


def changes(ledger: DataFrame, key: list[str]) -> DataFrame:
    """Number of ledger rows per key, standing and superseded."""
    return ledger.groupBy(*key).agg(F.count_if(F.col("recorded_to").isNull()).alias("standing"), F.count_if(F.col("recorded_to").isNotNull()).alias("superseded"))
