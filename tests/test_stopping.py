import random

from tapeglass.plans.research import stopping


def test_policy_is_learned_on_one_fold_and_valued_on_the_other(spark):
    rnd, rows = random.Random(6), []
    for _ in range(1500):
        path = [rnd.gauss(0, 0.008)]
        for _ in range(3):
            path.append(path[-1] + rnd.gauss(0, 0.006) - 0.4 * (max(0, *path) - path[-1]))
        rows.append((rnd.randrange(2), *path))
    rows.append((0, 0.5, -0.5, -0.5, 0.1))  # a state the other fold never has
    got = stopping(spark.createDataFrame(rows, "fold int, r0 double, r1 double, r2 double, v double"), (1, 5, 10))
    want = {}
    for f in (0, 1):
        value = [r[4] for r in rows]
        for k in (2, 1, 0):
            cells = {}
            for i, r in enumerate(rows):
                state, fall = int(min(max(r[1 + k] // 0.005, -4), 4)), int(min((max(0.0, *r[1 : 2 + k]) - r[1 + k]) // 0.005, 2))
                cells.setdefault((state, fall), ([], []))[r[0] == f].append(i)
            mean = lambda x: sum(x) / len(x) if x else None
            for (state, fall), (learn, held) in cells.items():
                stay, leave = mean([value[i] for i in learn]), mean([rows[i][1 + k] for i in learn])
                go = bool(learn) and leave >= stay
                for i in learn + held:
                    value[i] = rows[i][1 + k] if go else value[i]
                want[f, (1, 5, 10)[k], state, fall] = (len(learn), stay, leave, go, len(held), mean([value[i] for i in held]))
    assert {r[:4] for r in got} == set(want) and len(got) == len(want) and {r[3] for r in got} == {0, 1, 2}
    for r in got:
        for a, b in zip(r[4:], want[r[:4]]):
            assert a == b or abs(a - b) < 1e-12
