import random
import time

from pyspark.sql import functions as F

from tapeglass.operators.bitemporal import as_known, bitemporal_ledger, standing
from tapeglass.operators.known_at import locate

SCHEMA = "k string, x string, vf bigint, r bigint, rank int"


def versions_at(statements, key, at):
    """Brute force: the coalesced versions of a key as known at ``at``."""
    best = {}
    for k, x, v, r, rank in statements:
        if k == key and v is not None and (r is None or r <= at):
            mine = (rank, -(2**63) if r is None else r, (x is not None, x or ""))
            if v not in best or mine > best[v][0]:
                best[v] = (mine, x)
    out = []
    for v in sorted(best):
        if not out or out[-1][1] != best[v][1]:
            out.append((v, best[v][1]))
    return [(v, out[i + 1][0] if i + 1 < len(out) else None, x) for i, (v, x) in enumerate(out)]


def ledger(spark, rows, block=7):
    return bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), ["k"], "x", "vf", "r", "rank", block)


def test_every_reading_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.choice(["X", "Y", None]), rnd.randrange(40), rnd.choice([None, *range(12)]), rnd.randrange(2)) for _ in range(300)]
    rows += rows[:40]
    got = [r.asDict() for r in ledger(spark, rows).collect()]
    for at in range(-1, 13):
        for k in "abc":
            seen = sorted((r["valid_from"], r["valid_to"], r["x"]) for r in got if r["k"] == k and (r["recorded_from"] is None or r["recorded_from"] <= at) and (r["recorded_to"] is None or r["recorded_to"] > at))
            assert seen == sorted(versions_at(rows, k, at)), (k, at)


def test_late_statement_closes_and_splits(spark):
    rows = [("a", "X", 1, 1, 0), ("a", "X", 9, 2, 0), ("a", "Y", 5, 7, 0)]
    l = ledger(spark, rows, block=100)
    assert {(r.x, r.valid_from, r.valid_to, r.recorded_from, r.recorded_to) for r in l.collect()} == {("X", 1, None, 1, 7), ("X", 1, 5, 7, None), ("Y", 5, 9, 7, None), ("X", 9, None, 7, None)}
    assert {(r.x, r.valid_from) for r in standing(l).collect()} == {("X", 1), ("Y", 5), ("X", 9)}
    assert as_known(l, F.lit(3)).count() == 1


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(None, "X", 1, 1, 0), ("a", "X", None, 1, 0), ("a", None, 2, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("valid_from", F.lit("other")).withColumn("blk", F.lit(1))
    out = bitemporal_ledger(df, ["k"], "x", "vf", "r", "rank").collect()
    assert [(r.k, r.x, r.valid_from, r.valid_to) for r in out] == [("a", None, 2, None)]
    assert ledger(spark, []).count() == 0


def test_locate_equals_brute_force(spark):
    rnd = random.Random(3)
    t0 = 1_700_000_000
    facts = [(rnd.choice("ab"), rnd.choice("fs"), str(i), t0 + rnd.randrange(0, 4_000_000), t0 + rnd.randrange(0, 4_000_000), rnd.randrange(3)) for i in range(120)]
    events = [(i, rnd.choice(["a", "b", "c", None]), t0 + rnd.randrange(-10, 4_100_000), t0 + rnd.randrange(-10, 4_100_000)) for i in range(200)] + [(999, "a", None, None)]
    f = spark.createDataFrame(facts, "k string, kind string, x string, v bigint, r bigint, rank int").withColumns({"v": F.timestamp_seconds("v"), "r": F.timestamp_seconds("r")})
    e = spark.createDataFrame(events + events[:5], "id int, k string, t bigint, known bigint").withColumns({"t": F.timestamp_seconds("t"), "known": F.timestamp_seconds("known")})
    e = e.withColumns({"x": F.lit("clash"), "kind": F.lit("clash")})
    f = f.withColumn("t", F.lit("clash"))
    for known in (None, "known"):
        got = {(r.id, r.kind, r.x) for r in locate(e, f, ["k"], "t", "x", "v", "r", known, "rank", ["kind"]).collect()}
        want = set()
        for i, k, t, kn in events:
            at = t if known is None else kn
            for kind in "fs":
                c = [(v, rank, r, x) for fk, fkind, x, v, r, rank in facts if fk == k and fkind == kind and t is not None and v <= t and r <= at]
                if c:
                    want.add((i, kind, max(c)[3]))
        assert got == want
    assert locate(e.limit(0), f, ["k"], "t", "x", "v", "r", rank="rank", extra=["kind"]).count() == 0
    assert locate(e, f.limit(0), ["k"], "t", "x", "v", "r", rank="rank", extra=["kind"]).count() == 0


def test_backfill_recorded_from_new_to_old_stays_linear():
    from tapeglass.operators.bitemporal import FOREVER, sweep, sweep_block

    n = 8000
    rows = [(n - i, f"x{i}", i, FOREVER) for i in range(n)]
    began = time.perf_counter()
    out = list(sweep(("k", v, x, False, ra, rb) for v, x, ra, rb in rows))
    inner, edges = sweep_block(rows)
    assert time.perf_counter() - began < 1.5
    assert len(out) == 2 * n - 1 and len({(r[1], r[2]) for r in out}) == n
    assert len(inner) == n - 2 and len(edges) > n


def test_a_key_is_split_into_blocks(spark):
    """One key's statements in many blocks give the ledger that one block gives."""
    rnd = random.Random(8)
    rows = [("a", rnd.choice("XYZ"), rnd.randrange(400), rnd.randrange(60), 0) for _ in range(900)]
    one, many = ({tuple(r) for r in ledger(spark, rows, block).collect()} for block in (1000, 9))
    assert one == many and len(one) > 500
