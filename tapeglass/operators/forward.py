"""What followed an entry: tapes of minute bars from each fill to the close five trading days later.

Bars go to tasks once, by symbol and block of trading days; the first days of a block go to the block
before as well, so every entry day finds the days after it in its own task.  There each entry day gets
its tape in order, each entry minute its fill, and everything asked of the path is a running window or a
conditional aggregate on that partitioning.  A symbol with very many days is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions.timeline import MINUTE, floor_div, local_micros

# fixed values: the grids of entries, horizons, thresholds, label pairs and checkpoints
OFFSETS = "0935 0940 0945 0950 0955 1000 1005 1010 1015 1020 1030 1045 1100 1130 1200 1300 1530".split()
MINUTES = {"10min": 10, "30min": 30, "60min": 60}
DAYS = {"1d": 1, "2d": 2, "3d": 3, "5d": 5}
HORIZONS = [*MINUTES, "EOD", *DAYS]
PCT = "0.5 1 2 3 5 10 20".split()
ATR = "0.25 0.5 1 1.5 2 3".split()
#: target and stop, per cent or multiples of the average true range, and the horizon
PAIRS = [("pct", 0.005, 0.005, "30min"), ("pct", 0.01, 0.01, "EOD"), ("pct", 0.02, 0.01, "EOD"), ("pct", 0.03, 0.015, "EOD"), ("pct", 0.02, 0.02, "1d"), ("pct", 0.03, 0.03, "5d"), ("atr", 1.0, 0.5, "EOD"), ("atr", 2.0, 1.0, "5d")]
CHECKPOINTS = "1m 2m 3m 5m 10m 15m 20m 30m 45m 60m 90m 120m 180m EOD 1d_open 1d_30m 1d_close 2d_open 2d_close 3d_open 3d_close 5d_open 5d_close".split()
OPEN, CLOSE, PRE, REACH, BLOCK = 570, 960, 240, 5, 64


def minute_of(label: str) -> int:
    return int(label[:2]) * 60 + int(label[2:])


def spread(bars: DataFrame, context: DataFrame | None, calendar: DataFrame) -> DataFrame:
    """The bars of each entry day and the days after it, by (sym, blk): sym, blk, D, day, k, mod, ctx, o, h, l, c, v; see ``day_tape``.

    A row of ``context`` stands before its day's bars with a mod of -1.
    """
    cal = F.broadcast(calendar.select(F.col("day").alias("_d"), F.col("day_idx").alias("i")))  # a row per trading day
    b = bars.where((F.col("volume") > 0) & ~F.isnan("volume") & F.col("display_symbol").isNotNull() & F.col("t").isNotNull())
    # the clock of New York is read once a row: no filter moves below a column that is held to be indeterminate
    clock = F.when(F.monotonically_increasing_id() >= 0, floor_div(local_micros(F.col("t")), MINUTE))
    b = b.select(F.col("display_symbol").alias("sym"), clock.alias("_m"), F.struct("t", "volume", "open", "high", "low", "close").alias("r"))
    b = b.withColumn("mod", F.pmod("_m", F.lit(1440)).cast("int")).where(F.col("mod").between(PRE, CLOSE - 1))
    b = b.select("sym", F.date_from_unix_date(floor_div(F.col("_m"), 1440).cast("int")).alias("day"), "mod", "r")
    none = F.lit(None)
    facts = []
    if context is not None:
        known = context.select("sym", "day", F.lit(-1).alias("mod"), none.cast(b.schema["r"].dataType).alias("r"), F.struct(*[c for c in context.columns if c not in ("sym", "day")]).alias("ctx"))
        b = b.withColumn("ctx", none.cast(known.schema["ctx"].dataType)).unionByName(known)
        facts = ["ctx"]
    both = b.join(cal, F.col("day") == F.col("_d")).drop("_d")
    block = lambda i: F.floor(i / BLOCK)
    own = F.array(block(F.col("i")))
    blocks = F.when(F.col("mod") >= OPEN, F.array_distinct(F.array(block(F.col("i")), block(F.col("i") - REACH)))).otherwise(own)
    # a small input is much work all the same: the number is given, so that tasks aren't put together by size
    spark = bars.sparkSession
    both = both.withColumn("blk", F.explode(blocks)).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "sym", "blk")
    one = both.groupBy("sym", "blk", "i", "day", "mod").agg(F.max("r").alias("r"), *[F.max(c).alias(c) for c in facts])
    regular = F.col("mod") >= OPEN
    # days of the block on which the symbol has a regular bar: only they are entry days (69 at most)
    here = F.collect_set(F.when(regular, F.col("i"))).over(Window.partitionBy("sym", "blk"))
    reach = F.when(regular, F.sequence(F.lit(0), F.lit(REACH))).otherwise(F.array(F.lit(0)))
    inside = lambda k: (F.floor((F.col("i") - k) / BLOCK) == F.col("blk")) & F.array_contains("here", F.col("i") - k)
    t = one.withColumn("here", here).withColumn("k", F.explode(F.filter(reach, inside))).withColumn("D", F.col("i") - F.col("k"))
    t = t.select("sym", "blk", "D", "day", "k", "mod", *facts, *[F.col(f"r.{n}").alias(a) for n, a in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))])
    return t


def day_tape(bars: DataFrame, context: DataFrame | None, calendar: DataFrame, offsets: list[str]) -> DataFrame:
    """The bars of each entry day and the ``REACH`` trading days after it, in order.

    ``bars``: display_symbol, t, open, high, low, close, volume, raw.  ``context``: sym, day and figures
    known before the day, one row each, or None (then there is no ctx).  ``calendar``: day, day_idx.  Columns: sym, blk, D, day, ctx, k
    (trading days after the entry day), mod (minute of day; below 570 of the entry day only), pos, o, h,
    l, c, v, before (close of the bar before), gap (minutes since the bar before on the same day), ends
    (whether the day ends), next_mod, opens (first minute of the day), fills (entry and f for each offset
    that has one: the first regular bar at or after it).  Of several rows for a minute the one stamped last
    stands.  Rows without traded volume, symbol or time are left out.
    """
    t = spread(bars, context, calendar)
    facts = [c for c in t.columns if c == "ctx"]
    regular = F.col("mod") >= OPEN
    w = Window.partitionBy("sym", "blk", "D")
    order = w.orderBy("k", "mod")
    earlier = F.lag(F.when(regular, F.col("mod"))).over(order)
    same = F.lag("k").over(order) == F.col("k")
    following = F.lead("k").over(order)
    t = t.withColumns({
        "pos": F.row_number().over(order).cast("bigint"), **{c: F.max(c).over(w) for c in facts}, "day": F.max(F.when(F.col("k") == 0, F.col("day"))).over(w),
        "before": F.when(regular, F.lag("c").over(order)), "gap": F.when(same & regular, F.col("mod") - earlier),
        "ends": following.isNull() | (following > F.col("k")), "next_mod": F.lead("mod").over(order), "_earlier": F.when(same, earlier),
    })
    # a bar fills the minutes after the bar before it, up to its own
    minutes = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(minute_of(e)).alias("m")) for e in offsets])
    mine = F.filter(minutes, lambda e: (e.m <= F.col("mod")) & (F.col("_earlier").isNull() | (e.m > F.col("_earlier"))))
    bar = F.struct("pos", "mod", "o", "h", "l", "c", "v")
    entry_bar = regular & (F.col("k") == 0) & F.col("c").isNotNull()
    t = t.withColumn("_fills", F.when(entry_bar & (F.size(mine) > 0), F.transform(mine, lambda e: F.struct(e.entry.alias("entry"), bar.alias("f")))))
    first = Window.partitionBy("sym", "blk", "D", "k")
    t = t.withColumns({"fills": F.flatten(F.collect_list("_fills").over(w)), "opens": F.min(F.when(regular, F.col("mod"))).over(first)})  # an entry each
    t = t.drop("_fills", "_earlier")
    return t.where(F.col("c").isNotNull() & F.col("day").isNotNull())


def entries(tape: DataFrame) -> DataFrame:
    """``day_tape`` once per entry with a fill: entry, f (the fill's bar), price, atr, idx (bars since the fill, below 0 before it)."""
    x = tape.withColumn("_e", F.explode(F.filter("fills", lambda e: e.f.o > 0))).withColumns({"entry": F.col("_e.entry"), "f": F.col("_e.f")}).drop("fills", "_e")
    return x.withColumns({"price": F.col("f.o"), "idx": F.col("pos") - F.col("f.pos")})


def follow(tape: DataFrame) -> DataFrame:
    """The bars from each fill on: idx counts from 0."""
    return entries(tape).where(F.col("idx") >= 0)


KEY = ["sym", "blk", "D", "day", "entry"]


_STATE = [
    ("idx", "bigint"), ("price", "double"), ("atr", "double"), ("c", "double"), ("hi", "double"), ("hi_at", "bigint"), ("lo", "double"), ("lo_at", "bigint"), ("cmax", "double"), ("cmax_at", "bigint"), ("cmin", "double"), ("cmin_at", "bigint"),
    ("volume", "double"), ("dollars", "double"), ("n_over", "bigint"), ("n_under", "bigint"), ("sr", "double"), ("sr2", "double"), ("pause", "bigint"), ("longest_over", "bigint"), ("longest_under", "bigint"), ("recovery", "bigint"),
]
_PA = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "date": pa.date32(), "int": pa.int32()}


class Path:
    """The regular bars of one symbol's entry day and the days after it, in order."""

    def __init__(self, sym: str, blk: int, D: int, cols: dict[str, np.ndarray]):
        self.sym, self.blk, self.D = sym, blk, D
        facts = cols["mod"] < 0
        self.atr = float(cols["atr"][facts][0]) if facts.any() else float("nan")
        keep = cols["mod"] >= OPEN
        self.k, self.mod, self.o, self.h, self.l, self.c, self.v = (cols[n][keep] for n in ("k", "mod", "o", "h", "l", "c", "v"))
        self.n0 = int(np.searchsorted(self.k, 0, "right"))
        self.day = cols["day"][keep][0] if self.n0 else None
        self.first, self.last = np.searchsorted(self.k, np.arange(REACH + 1), "left"), np.searchsorted(self.k, np.arange(REACH + 1), "right") - 1

    def fills(self) -> Iterator[tuple[str, int]]:
        """Each entry that has a bar to fill it, at a price above zero, and that bar's place."""
        for e in OFFSETS:
            p = int(np.searchsorted(self.mod[: self.n0], minute_of(e)))
            if p < self.n0 and self.o[p] > 0:
                yield e, p

    def end(self, name: str, p: int) -> int:
        """Place of the bar a horizon or checkpoint ends with for a fill at ``p``; -1 if it has none."""
        if name == "EOD":
            return self.n0 - 1
        if name in MINUTES or name[-1] == "m" and name[:-1].isdigit():
            n = MINUTES[name] if name in MINUTES else int(name[:-1])
            return int(np.searchsorted(self.mod[: self.n0], self.mod[p] + n, "right")) - 1
        k = int(name[0])
        a, z = int(self.first[k]), int(self.last[k])
        if z < a:
            return -1
        if name.endswith("_open"):
            return a
        if name.endswith("_30m"):
            return a + int(np.searchsorted(self.mod[a : z + 1], self.mod[a] + 30, "right")) - 1
        return z


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[Path]:
    """Rows sorted by sym, D, k and mod, put together by sym and D."""
    kept: list[pa.RecordBatch] = []

    def made(rows: list[pa.RecordBatch]) -> Path:
        t = pa.Table.from_batches(rows).combine_chunks()
        cols = {n: t.column(n).to_numpy() for n in ("k", "mod", "o", "h", "l", "c", "v", "atr")}
        cols["day"] = t.column("day").cast(pa.int32()).to_numpy()
        return Path(t.column("sym")[0].as_py(), t.column("blk")[0].as_py(), t.column("D")[0].as_py(), cols)

    key = None
    for b in batches:
        if not b.num_rows:
            continue
        sym, D = b.column(0).dictionary_encode(), b.column(2).to_numpy()
        code = sym.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (D[1:] != D[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            mine = (sym.dictionary[int(code[a])].as_py(), int(D[a]))
            if kept and mine != key:
                yield made(kept)
                kept = []
            key = mine
            kept.append(b.slice(a, z - a))
    if kept:
        yield made(kept)


def _sorted(bars: DataFrame, context: DataFrame | None, calendar: DataFrame) -> DataFrame:
    t = spread(bars, context, calendar).where((F.col("mod") >= OPEN) | (F.col("mod") < 0))
    atr = F.col("ctx.atr") if context is not None else F.lit(None).cast("double")
    t = t.select("sym", F.col("blk").cast("bigint").alias("blk"), F.col("D").cast("bigint").alias("D"), "day", F.col("k").cast("int").alias("k"), "mod", atr.alias("atr"), "o", "h", "l", "c", "v")
    return t.sortWithinPartitions("sym", "blk", "D", "k", "mod")


_KEYS = [("sym", "string"), ("day", "date"), ("entry", "string")]


def path_states(bars: DataFrame, context: DataFrame | None, calendar: DataFrame, names: list[str]) -> DataFrame:
    """The state of every entry's path at each of ``names`` (horizons or checkpoints): sym, day, entry, name, no and the state; nulls where a name has no bar.

    idx: bars since the fill; hi, lo, cmax and cmin: extremes of highs, lows and closes, ``_at`` the first
    bar that reached them; n_over and n_under: closes above and below the entry; sr and sr2: sums of the
    bars' returns and their squares; pause: minutes of the longest pause within a day; recovery: bars
    from the first close below to the first one not below.  All entries of a day read the same bars, so
    the sums and extremes are worked out in Arrow batches, an array operation each, where a window over
    every entry's copy of them would take more than twice as long.
    """
    fields = [*_KEYS, ("name", "string"), ("no", "int"), *_STATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in fields]
        for t in _paths(batches):
            step = np.r_[0, np.where(t.k[1:] == t.k[:-1], t.mod[1:] - t.mod[:-1], 0)] if len(t.k) else t.k
            ret = np.r_[0.0, t.c[1:] / t.c[:-1] - 1] if len(t.c) else t.c
            for e, p in t.fills():
                price = float(t.o[p])
                ends = np.array([t.end(n, p) for n in names])
                at = np.maximum(ends - p, 0)
                c, idx = t.c[p:], np.arange(len(t.c) - p)
                ch, cl, cm, cn = np.maximum.accumulate(t.h[p:]), np.minimum.accumulate(t.l[p:]), np.maximum.accumulate(c), np.minimum.accumulate(c)
                over, under = c > price, c < price
                r = ret[p:].copy()
                r[0] = 0.0
                pause = step[p:].copy()
                pause[0] = 0
                longest = [np.maximum.accumulate(np.where(x, idx - np.maximum.accumulate(np.where(x, -1, idx)), 0)) for x in (over, under)]
                fu = int(np.argmax(under)) if under.any() else len(c)
                back = ~under[fu:]
                rec = fu + int(np.argmax(back)) if back.any() else len(c)
                state = [
                    at, np.full(len(at), price), np.full(len(at), t.atr), c[at], ch[at], np.searchsorted(ch, ch[at], "left"), cl[at], np.searchsorted(-cl, -cl[at], "left"), cm[at], np.searchsorted(cm, cm[at], "left"), cn[at], np.searchsorted(-cn, -cn[at], "left"),
                    np.cumsum(t.v[p:])[at], np.cumsum(c * t.v[p:])[at], np.cumsum(over)[at], np.cumsum(under)[at], np.cumsum(r)[at], np.cumsum(r * r)[at], np.maximum.accumulate(pause)[at], longest[0][at], longest[1][at], np.where(at >= rec, rec - fu, 0),
                ]
                none = ends < 0
                for col, x in zip(out, [[t.sym] * len(names), [t.day] * len(names), [e] * len(names), names, range(len(names))], strict=False):
                    col.extend(x)
                for col, x in zip(out[5:], state, strict=True):
                    col.append(np.ma.masked_array(x, none))
            if len(out[0]) > 50_000:
                yield _packed(out, fields)
                out = [[] for _ in fields]
        if out[0]:
            yield _packed(out, fields)

    return _sorted(bars, context, calendar).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def _packed(out: list[list], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    arrays = []
    for col, (n, k) in zip(out, fields, strict=True):
        if col and isinstance(col[0], np.ma.MaskedArray):
            x = np.ma.concatenate(col)
            gone = np.ma.getmaskarray(x) | (np.isnan(x.data) if n == "atr" else False)
            arrays.append(pa.array(x.data.astype(np.int64 if k == "bigint" else np.float64), _PA[k], mask=gone))
        else:
            arrays.append(pa.array(np.array(col, dtype=np.int32), pa.int32()).cast(pa.date32()) if k == "date" else pa.array(col, _PA[k]))
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def path_lines(bars: DataFrame, context: DataFrame, calendar: DataFrame) -> DataFrame:
    """First touches on every entry's path: sym, day, entry, atr, ends, lines, targets, stops.

    ``ends``: the bar each horizon ends with.  ``lines``: first bar to touch each percentage and multiple
    of the true range, up by highs and down by lows in turn.  ``targets`` and ``stops``: the same for the
    pairs.  Bars count from 0, null: none.  A running extreme is sorted, so a touch is a search in it.
    """
    fields = [*_KEYS, ("atr", "double"), *[(n, "array<bigint>") for n in ("ends", "lines", "targets", "stops")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        pct, mult = np.array([float(x) / 100 for x in PCT]), np.array([float(x) for x in ATR])
        for t in _paths(batches):
            known = t.atr > 0
            for e, p in t.fills():
                price, n = float(t.o[p]), len(t.h) - p
                up, down = np.maximum.accumulate(t.h[p:]), -np.minimum.accumulate(t.l[p:])
                some = lambda x: [int(i) if i < n else None for i in x]
                first = [np.searchsorted(up / price - 1, pct), np.searchsorted(-(-down / price - 1), pct)]
                far = [np.searchsorted(up, price + mult * t.atr), np.searchsorted(down, -(price - mult * t.atr))] if known else [np.full(len(mult), n)] * 2
                lines = [x for pair in (first, far) for both in zip(*pair, strict=True) for x in both]
                hit, lost = [], []
                for kind, a, b, _ in PAIRS:
                    high, low = (price * (1 + a), price * (1 - b)) if kind == "pct" else (price + a * t.atr, price - b * t.atr)
                    fine = kind == "pct" or known
                    hit.append(np.searchsorted(up, high) if fine else n)
                    lost.append(np.searchsorted(down, -low) if fine else n)
                ends = [t.end(h, p) for h in HORIZONS]
                rows.append((t.sym, t.day, e, t.atr if t.atr == t.atr else None, [z - p if z >= 0 else None for z in ends], some(lines), some(hit), some(lost)))
            if len(rows) > 5000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), *[pa.list_(pa.int64())] * 4]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        arrays[1] = pa.array(np.array([r[1] for r in rows], dtype=np.int32)).cast(pa.date32())
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    return _sorted(bars, context, calendar).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))
