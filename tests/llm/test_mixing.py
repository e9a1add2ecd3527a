import random

import pytest

from tapeglass.llm.mixing import mixture, shares


def data(spark):
    rnd = random.Random(6)
    docs = [(s, i, rnd.randrange(1, 200)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 400 + ["small"] * 40 + ["untargeted"] * 50)]
    docs += [(None, 9001, 5), ("big", 9002, 0), ("big", 9003, None)]
    t = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("absent", 0.1, 2), ("zero", 0.0, 1), (None, 0.1, 1)]
    return docs, spark.createDataFrame(docs, "source string, doc_id bigint, n_tokens int").selectExpr("*", "1 as block", "2 as slot"), spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def test_shares_follow_targets_and_repeats_are_capped(spark):
    docs, d, t = data(spark)
    m = mixture(d, t, block_tokens=256).cache()
    rows = m.collect()
    uses = {}
    for r in rows:
        uses.setdefault(r.doc_id, []).append(r.repeat_no)
    cap = {"big": 1, "mid": 2, "small": 4}
    source = {i: s for s, i, _ in docs}
    for i, u in uses.items():
        assert len(u) == len(set(u)) <= cap[source[i]]
    s = {r.source: r for r in shares(m, t, d).collect()}
    for name, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(s[name].actual_share - share) < 0.02
    assert s["absent"].actual_share == 0 and s["small"].most_uses == 4
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture(d.repartition(5), t, block_tokens=256).collect()))


def test_budget_reports_what_ran_out(spark):
    docs, d, t = data(spark)
    m = mixture(d, t, block_tokens=256, total_tokens=200_000)
    s = {r.source: r for r in shares(m, t, d).collect()}
    small = sum(n for x, _, n in docs if x == "small")
    assert s["small"].tokens == 4 * small
    assert s["small"].actual_share < 0.11
    assert s["small"].tokens_unused == 0 and s["small"].tokens_there == small and s["absent"].tokens_there == 0
    seen = {r.doc_id for r in m.collect()}
    assert s["big"].tokens_unused == sum(n for x, i, n in docs if x == "big" and n and i not in seen)


def test_ten_thousand_sources(spark):
    n = 10_000
    d = spark.range(n * 2).selectExpr("concat('s', id % 10000) as source", "id as doc_id", "cast(60 as bigint) as n_tokens")
    t = spark.range(n).selectExpr("concat('s', id) as source", "1 / 10000D as target_share", "3 as max_repeats")
    m = mixture(d, t, block_tokens=64)
    per = m.groupBy("source").agg({"slot": "count"}).collect()
    assert len(per) == n
    with pytest.raises(ValueError):
        mixture(d, t.union(spark.createDataFrame([("one more", 0.1, 1)], t.schema)))


def test_empty(spark):
    _, d, t = data(spark)
    assert mixture(d.limit(0), t).count() == 0 and mixture(d, t.limit(0)).count() == 0
