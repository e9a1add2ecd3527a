from tapeglass.operators.work_ledger import LOG, WorkLedger, fold, output_path


def states(spark, rows, now=None):
    df = spark.createDataFrame(rows, LOG)
    return {r.item: (r.state, r.version) for r in fold(df, ["item"], now).collect()}


def ev(item, kind, version=None, token=None, until=None, worker=None):
    return (item, kind, version, token, until, worker, 0)


def test_fold_states(spark):
    rows = [
        ev("new", "offer", "v1", 1),
        ev("done", "offer", "v1", 1), ev("done", "done", "v1", 1), ev("done", "done", "v1", 1),
        ev("changed", "offer", "v1", 1), ev("changed", "done", "v1", 1), ev("changed", "offer", "v2", 2),
        ev("nullver", "offer", None, 3), ev("nullver", "done", "x", 3),
        ev("nulldone", "offer", None, 3), ev("nulldone", "done", None, 3),
        ev("held", "offer", "v", 1), ev("held", "lease", "v", 5, 100, "w"),
        ev("stale", "offer", "v", 1), ev("stale", "lease", "v", 5, 10, "w"), ev("stale", "lease", "v", 6, 20, "u"), ev("stale", "done", "v", 5),
        ev("gone", "offer", "v", 1), ev("gone", "withdraw", None, 2),
        ev(None, "offer", "v", 1), ev("notoken", "offer", "v", None),
    ]
    assert states(spark, rows, now=50) == {
        "new": ("pending", "v1"), "done": ("done", "v1"), "changed": ("pending", "v2"), "nullver": ("pending", None), "nulldone": ("done", None),
        "held": ("leased", "v"), "stale": ("pending", "v"), "gone": ("withdrawn", "v"),
    }
    assert states(spark, rows, now=200)["held"] == ("pending", "v")
    assert states(spark, []) == {}


def test_log_survives_failures(spark, tmp_path):
    led = WorkLedger(spark, str(tmp_path / "log"))
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1")], "item string, version string")
    led.offer(items, 0)
    led.offer(items, 1)
    first = led.lease("w1", 2, now=10, seconds=5)
    assert sorted(r.item for r in first.collect()) == ["a", "b"] and led.lease("w2", 2, now=11, seconds=5).count() == 0
    old = [(r.item, r.version, r.token) for r in first.collect()]
    second = led.lease("w2", 2, now=20, seconds=5)  # the first worker's lease ran out
    assert second.count() == 2
    led.done(spark.createDataFrame(old, "item string, version string, token bigint"), "w1", 21)
    assert {r.state for r in led.state(21).collect()} == {"leased"}
    led.done(second, "w2", 22)
    assert {r.state for r in led.state(22).collect()} == {"done"}
    led.offer(spark.createDataFrame([("a", "2")], "item string, version string"), 23)
    assert {r.item: r.state for r in led.state(23).collect()} == {"a": "pending", "b": "done"}
    assert output_path("r", "a", "1") == output_path("r", "a", "1") != output_path("r", "a", "2") and output_path("r", "a", None) != output_path("r", "a", "")


def test_planners_cannot_take_the_same_number(spark, tmp_path):
    items = spark.createDataFrame([(x, "1") for x in "abc"], "item string, version string")
    one, two = (WorkLedger(spark, str(tmp_path / "log")) for _ in range(2))
    one.offer(items, 0)
    plain, met = two.position, []

    def late():
        """The second planner looks, and before it claims the number the first one takes everything."""
        at = plain()
        if not met:
            met.append(at)
            one.lease("w1", 2, now=0, seconds=100)
        return at

    two.position = late
    got = two.lease("w2", 3, now=0, seconds=100)
    assert [r.item for r in got.collect()] == ["c"] and met
    two.position = plain
    assert {r.item: r.worker for r in two.state(1).collect()} == {"a": "w1", "b": "w1", "c": "w2"}


def test_snapshots_and_what_dies_before_its_commit(spark, tmp_path):
    root = str(tmp_path / "log")
    led = WorkLedger(spark, root)
    assert led.state(0).count() == 0 and led.compact() == 0
    led.offer(spark.createDataFrame([("a", "1"), ("b", None)], "item string, version string"), 0)
    mine = led.lease("w", 9, now=0, seconds=10)
    before = sorted(map(tuple, led.state(5).collect()))
    assert led.compact() == 2 == led.compact()
    assert sorted(map(tuple, led.state(5).collect())) == before
    led._write(spark.createDataFrame([("x", "offer", "1", 9, None, None, 0)], LOG))  # written, never claimed
    assert sorted(map(tuple, led.state(5).collect())) == before
    later = led.lease("v", 9, now=50, seconds=10)
    assert sorted(r.item for r in led.stale(mine).collect()) == ["a", "b"] and led.stale(later).count() == 0
    led.done(mine, "w", 51)
    led.done(later.where("item = 'a'"), "v", 52)
    assert {r.item: r.state for r in led.state(99).collect()} == {"a": "done", "b": "pending"}
    led.compact()
    assert {r.item: r.state for r in led.state(99).collect()} == {"a": "done", "b": "pending"}
