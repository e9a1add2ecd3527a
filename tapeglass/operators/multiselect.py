"""Exact percentiles per group of very large columns, by distributed multi-select.

``sorted_runs`` sorts each partition's values of each group once, where they lie.  Runs of other
partitions or days can be added with a union at any time; they are the combinable form of the result.

``percentiles`` then looks for all wanted ranks of all groups at once.  In each round the runs propose
the medians of what is still possible, the weighted median of the proposals becomes the pivot, the
values are counted below, at and above it, and the range that is ruled out is discarded.  At least a
quarter of the possible values goes with each round, about half as a rule.

Runs of one group that fit together into ``run_rows`` values are put together, so what a small group
has lies in a single run.  The rounds are the same for every group; where all that is still possible
lies in one run, its proposal is the weighted median and its counts are the totals, so its rounds need
no exchange and go on in the task, for all such groups at a time.  Between the runs of larger groups
only a few numbers per run and rank move in a round.  No group is ever collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.session import cut

GROUP = ["grouping", "grp", "measure"]
#: states of this many rows (some 100 bytes each) may be broadcast
BROADCAST_ROWS = 200_000


def sorted_runs(df: DataFrame, groupings: dict[str, Column], measures: dict[str, Column], run_rows: int = 500_000) -> DataFrame:
    """grouping, grp, measure, run (sorted values): one row per group and up to ``run_rows`` rows of a partition.

    Null and NaN are no values; infinities are.  Rows with a null in a grouping belong to none of its
    groups.  Repeated rows count as often as they come.
    """
    names, nums = list(groupings), list(measures)
    flat = df.select(*[g.cast("string").alias(f"g{i}") for i, g in enumerate(groupings.values())], *[m.cast("double").alias(f"m{i}") for i, m in enumerate(measures.values())])

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for gi, grouping in enumerate(names):
            coded = table.column(f"g{gi}").combine_chunks().dictionary_encode()
            words = coded.dictionary
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for mi, measure in enumerate(nums):
                x = table.column(f"m{mi}").to_numpy()
                ok = (code >= 0) & ~np.isnan(x)
                c, v = code[ok], x[ok] + 0.0  # one zero
                order = np.lexsort((v, c))
                c, v = c[order], v[order]
                at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.array([], dtype=int)
                runs = pa.ListArray.from_arrays(pa.array(np.r_[at, len(c)], pa.int32()), pa.array(v))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([grouping] * n, pa.string()), words.take(pa.array(c[at], pa.int32())).cast(pa.string()), pa.array([measure] * n, pa.string()), runs], names=[*GROUP, "run"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= run_rows:
                yield from one(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from one(pa.Table.from_batches(held))

    return flat.mapInArrow(build, "grouping string, grp string, measure string, run array<double>")


def store_runs(runs: DataFrame, path: str) -> None:
    """Keep the runs of a day or another part as a table; ``percentiles`` takes any union of such tables."""
    runs.write.mode("overwrite").parquet(path)


def stored_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def rank_of(n: int, p: float) -> int:
    """0-based place of the discrete percentile: the smallest value with a share of at least p up to it."""
    return max(1, n - math.floor(n - p * n)) - 1


def select_sorted(flat: np.ndarray, begins: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-th of ``flat[x:y]`` and the rounds it took, for many targets at a time.

    ``flat`` is sorted from each of ``begins`` on; a target lies between two of them and never cuts
    through equal values.  Each round: the median as pivot, three-way count, the side that holds the
    rank stays.
    """
    new = np.zeros(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begins[begins < len(flat)]] = True
    edges = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    ends = np.r_[edges[1:], len(flat)]
    x, y, k = x.copy(), y.copy(), k.copy()
    value, rounds, live = np.full(len(x), np.nan), np.zeros(len(x), dtype=np.int32), np.arange(len(x))
    while len(live):
        m = (x[live] + y[live] - 1) // 2
        below, upto = edges[which[m]] - x[live], ends[which[m]] - x[live]
        rounds[live] += 1
        left, right = k[live] < below, k[live] >= upto
        found = ~left & ~right
        value[live[found]] = flat[m[found]]
        y[live[left]] = x[live[left]] + below[left]
        k[live[right]] -= upto[right]
        x[live[right]] += upto[right]
        live = live[~found]
    return value, rounds


_TARGET = "struct<j: int, k: bigint, lo: double, hi: double, pivot: double, value: double, rounds: int, cnt: bigint>"
_TOLD = "struct<j: int, lt: bigint, eq: bigint, gt: bigint, med_lt: double, med_gt: double>"
_told = pa.list_(pa.struct([("j", pa.int32()), *[(c, pa.int64()) for c in ("lt", "eq", "gt")], *[(c, pa.float64()) for c in ("med_lt", "med_gt")]]))
_target = pa.list_(pa.struct([("j", pa.int32()), ("k", pa.int64()), *[(c, pa.float64()) for c in ("lo", "hi", "pivot", "value")], ("rounds", pa.int32()), ("cnt", pa.int64())]))
_id = [(c, pa.string()) for c in GROUP]


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows sorted by group and slot, in portions of some ``most`` values: first row of each group and slot, their values sorted, begins and end."""
    keys: list[tuple] = []
    runs: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def portion():
        seg = np.repeat(np.array(owner), [len(r) for r in runs])
        flat = np.concatenate(runs)
        order = np.lexsort((flat, seg))
        return keys, flat[order], np.r_[0, np.cumsum(np.bincount(seg, minlength=len(keys)))]

    for b in batches:
        off, flat = b.column(b.schema.get_field_index("run")).offsets.to_numpy(), b.column(b.schema.get_field_index("run")).values.to_numpy(zero_copy_only=False)
        rest = [b.column(i).to_pylist() for i in range(b.num_columns) if b.schema.names[i] != "run"]
        for i, row in enumerate(zip(*rest, strict=True)):
            if not keys or keys[-1][:4] != row[:4]:
                if size >= most:
                    yield portion()
                    keys, runs, owner, size = [], [], [], 0
                keys.append(row)
            runs.append(flat[off[i] : off[i + 1]])
            owner.append(len(keys) - 1)
            size += len(runs[-1])
    if keys:
        yield portion()


def _meet(probs: list[float], most: int):
    """Runs of a group and slot put together: the group's values if it has one slot, else the run and its first proposal."""
    kinds = [*_id, ("n", pa.int64()), ("rounds", pa.int32()), ("values", pa.list_(pa.float64())), ("run", pa.list_(pa.float64())), ("told", _told)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, flat, at in _segments(batches, most):
            whole = [i for i, r in enumerate(keys) if r[4] is None]
            x = np.repeat(at[whole], len(probs)) if whole else np.zeros(0, dtype=np.int64)
            y = np.repeat(at[[i + 1 for i in whole]], len(probs)) if whole else x
            k = np.array([rank_of(int(at[i + 1] - at[i]), p) for i in whole for p in probs], dtype=np.int64)
            value, rounds = select_sorted(flat, at[:-1], x, y, k)
            got = dict(zip(whole, zip(value.reshape(-1, len(probs)), rounds.reshape(-1, len(probs)), strict=True), strict=True)) if whole else {}
            rows = []
            for i, r in enumerate(keys):
                if i in got:
                    rows.append((*r[:3], int(at[i + 1] - at[i]), int(got[i][1].max()), got[i][0], None, None))
                else:
                    own = flat[at[i] : at[i + 1]]
                    first = {"lt": len(own), "eq": 0, "gt": 0, "med_lt": float(own[(len(own) - 1) // 2]), "med_gt": None}
                    rows.append((*r[:3], r[4], 0, None, own, [{"j": j, **first} for j in range(len(probs))]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def _finish(most: int):
    """The groups whose possible values have come together: the rest of their rounds."""
    kinds = [*_id, ("targets", _target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, flat, at in _segments(batches, most):
            todo = [(i, t) for i, r in enumerate(keys) for t in r[4]]
            x = np.array([at[i] if t["lo"] is None else at[i] + np.searchsorted(flat[at[i] : at[i + 1]], t["lo"], "right") for i, t in todo], dtype=np.int64)
            y = np.array([at[i + 1] if t["hi"] is None else at[i] + np.searchsorted(flat[at[i] : at[i + 1]], t["hi"], "left") for i, t in todo], dtype=np.int64)
            value, rounds = select_sorted(flat, at[:-1], x, y, np.array([t["k"] for _, t in todo], dtype=np.int64))
            out: list[list] = [[] for _ in keys]
            for (i, t), v, n in zip(todo, value.tolist(), rounds.tolist(), strict=True):
                out[i].append({**t, "value": v, "rounds": t["rounds"] + n})
            cols = [*zip(*[r[:3] for r in keys], strict=True), out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and proposals of each run for the ranks still open, and what is left of the run."""
    for b in batches:
        off, flat = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy(zero_copy_only=False)
        kept, told = [], []
        for i, targets in enumerate(b.column(4).to_pylist()):
            a, mine = flat[off[i] : off[i + 1]], []
            keep = np.zeros(len(a) + 1, dtype=np.int32)
            for t in targets:
                x = 0 if t["lo"] is None else int(np.searchsorted(a, t["lo"], "right"))
                y = len(a) if t["hi"] is None else int(np.searchsorted(a, t["hi"], "left"))
                if x >= y:
                    continue
                keep[x] += 1
                keep[y] -= 1
                s = a[x:y]
                lt, le = int(np.searchsorted(s, t["pivot"], "left")), int(np.searchsorted(s, t["pivot"], "right"))
                gt = len(s) - le
                mine.append({"j": t["j"], "lt": lt, "eq": le - lt, "gt": gt, "med_lt": float(s[(lt - 1) // 2]) if lt else None, "med_gt": float(s[le + (gt - 1) // 2]) if gt else None})
            kept.append(a[np.cumsum(keep[:-1]) > 0])
            told.append(mine)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kept, pa.list_(pa.float64())), pa.array(told, _told)], names=[*GROUP, "run", "told"])


def decide(targets: list[dict], told: list[dict]) -> list[dict]:
    """The targets of a group after a round: the side that holds the rank, and its weighted median as the next pivot."""
    by: dict[int, list[dict]] = {}
    for t in told:
        by.setdefault(t["j"], []).append(t)
    out = []
    for t in targets:
        mine = by.get(t["j"], [])
        if t["value"] is not None or not mine:
            out.append(t)
            continue
        lt, eq, gt = (sum(m[c] for m in mine) for c in ("lt", "eq", "gt"))
        t = {**t, "rounds": t["rounds"] + 1}
        if t["pivot"] is not None and lt <= t["k"] < lt + eq:
            out.append({**t, "value": t["pivot"], "cnt": 0})
            continue
        side = "lt" if t["k"] < lt else "gt"
        if t["pivot"] is not None:
            t |= {"hi": t["pivot"]} if side == "lt" else {"lo": t["pivot"], "k": t["k"] - lt - eq}
        offers = sorted((m[f"med_{side}"], m[side]) for m in mine if m[side])
        half, seen = sum(w for _, w in offers) / 2, 0
        for med, w in offers:
            seen += w
            if seen >= half:
                break
        out.append({**t, "pivot": med, "cnt": sum(w for _, w in offers)})
    return out


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [decide(t, [x for run in told for x in run]) for t, told in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, _target)], names=[*GROUP, "targets"])


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, once its rows are counted and few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def percentiles(runs: DataFrame, probs: list[float], run_rows: int = 1_000_000, most_rounds: int = 200) -> DataFrame:
    """grouping, grp, measure, n, values (one per probability, exact), rounds (the most a rank of the group took).

    The value of probability p is the smallest with a share of at least p up to it.  ``run_rows``: so
    many values of a group may lie in one run, and in one task.  Defined cases: groups without values
    have no row; ties and repeated values count each; no runs give no rows.
    """
    names = ", ".join(f"{c} string" for c in GROUP)
    runs = cut(runs.select(*GROUP, "run").withColumn("_at", F.monotonically_increasing_id()))
    large = cut(runs.groupBy(*GROUP).agg(F.sum(F.size("run")).cast("bigint").alias("n")).where(F.col("n") > run_rows))
    several = large.count()
    placed = runs.join(F.broadcast(large) if several <= BROADCAST_ROWS else large, GROUP, "left")
    slot = F.coalesce(F.pmod(F.xxhash64("_at"), F.ceil(F.col("n") / run_rows).cast("bigint")), F.lit(0).cast("bigint"))
    placed = placed.select(*GROUP, slot.alias("slot"), "n", "run").repartition(*GROUP, "slot").sortWithinPartitions(*GROUP, "slot")
    met = placed.mapInArrow(_meet(probs, run_rows), f"{names}, n bigint, rounds int, values array<double>, run array<double>, told array<{_TOLD}>")
    if not several:
        return met.select(*GROUP, "n", "values", "rounds")
    met = cut(met)
    left, told = met.where(F.col("run").isNotNull()).select(*GROUP, "run"), met.where(F.col("run").isNotNull()).select(*GROUP, "told")
    none = F.lit(None).cast("double")
    n = F.col("n")
    k = [F.greatest(F.lit(1), n - F.floor(n - F.lit(p) * n)).cast("bigint") - 1 for p in probs]
    targets = F.array(*[F.struct(F.lit(j).alias("j"), x.alias("k"), none.alias("lo"), none.alias("hi"), none.alias("pivot"), none.alias("value"), F.lit(0).alias("rounds"), n.alias("cnt")) for j, x in enumerate(k)])
    state, found = large.select(*GROUP, targets.alias("targets")), []
    still = lambda: F.filter("targets", lambda t: t.value.isNull())
    for _ in range(most_rounds):
        heard = told.groupBy(*GROUP).agg(F.collect_list("told").alias("told"))  # a few numbers per run of a group
        state = cut(state.join(heard, GROUP).select(*GROUP, "targets", "told").mapInArrow(_decide, f"{names}, targets array<{_TARGET}>"))
        held = F.aggregate(still(), F.lit(0).cast("bigint"), lambda a, t: a + t.cnt)
        step = F.when(F.size(still()) == 0, "found").when(held <= run_rows, "near").otherwise("open")
        state = state.withColumn("step", step)
        counts = {r["step"]: r["count"] for r in state.groupBy("step").count().collect()}  # three rows at most
        of = lambda what: state.where(F.col("step") == what)
        if counts.get("found"):
            found.append(of("found").select(*GROUP, "targets"))
        if counts.get("near"):
            few = of("near").select(*GROUP, still().alias("t"), F.filter("targets", lambda t: t.value.isNotNull()).alias("known"))
            inside = F.filter("run", lambda v: F.exists("t", lambda t: (t.lo.isNull() | (v > t.lo)) & (t.hi.isNull() | (v < t.hi))))
            near = left.join(_small(few.select(*GROUP, "t")), GROUP).select(*GROUP, F.lit(0).alias("slot"), "t", inside.alias("run"))
            near = near.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_finish(run_rows), f"{names}, targets array<{_TARGET}>")
            found.append(near.join(few.select(*GROUP, "known"), GROUP).select(*GROUP, F.concat("targets", "known").alias("targets")))
        if not counts.get("open"):
            break
        state = of("open").select(*GROUP, "targets")
        ask = _small(state.select(*GROUP, still().alias("t")))
        out = cut(left.join(ask, GROUP).select(*GROUP, "run", "t").mapInArrow(_count, f"{names}, run array<double>, told array<{_TOLD}>"))
        left, told = out.where(F.size("run") > 0).select(*GROUP, "run"), out.where(F.size("told") > 0).select(*GROUP, "told")
    else:
        raise RuntimeError("multi-select didn't end")
    every = reduce(DataFrame.unionByName, found)
    values = F.transform(F.array_sort(F.transform("targets", lambda t: F.struct(t.j, t.value))), lambda t: t.value)
    wide = every.select(*GROUP, values.alias("values"), F.array_max(F.transform("targets", lambda t: t.rounds)).alias("rounds"))
    return met.where(F.col("run").isNull()).select(*GROUP, "n", "values", "rounds").unionByName(large.join(wide, GROUP).select(*GROUP, "n", "values", "rounds"))
