import random
import time

import numpy as np
from tapeglass.llm.tiling import leaks, rolling, tile
from tapeglass.llm.words import hashed, words


def numbers(text):
    ids, _ = hashed([text])
    return ids[:-1]


def runs(doc, item, least):
    """Brute force: the longest common run of words."""
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def test_words_ignore_markup_and_encoding():
    assert words("<p>The <b>lend</b>ing&nbsp;A&#103;ent&amp;co<br/>ＦＵＬＬ­width re​state</p>") == b"the lending agent co fullwidth restate".split()
    assert words("a<!-- x <b> -->b x_y 5 < 6") == b"a b x y 5 6".split()
    assert words("成交量，流动性。ÄÖ") == [w.encode() for w in ("成交量", "流动性", "äö")]
    assert words(None) == words("") == words(" -\n") == []


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=30))) for i in range(12)] + [(50, None), (51, ""), (52, "w1 w2")]
    docs = []
    for i in range(60):
        t = rnd.choices(vocabulary + ["x"], k=rnd.randrange(0, 60))
        if rnd.random() < 0.6:
            src = rnd.choice(items[:12])[1].split()
            a = rnd.randrange(0, 20)
            t[5:5] = src[a : a + rnd.randrange(3, 10)]
        docs.append((i, "  ".join(t).title()))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, items[0][1] * 1)]
    d = spark.createDataFrame(docs + [docs[3]], "doc_id bigint, text string").selectExpr("*", "'clash' as item_id", "1 as tiles")
    e = spark.createDataFrame(items + [items[0]], "item_id bigint, text string")
    for most, few in ((1 << 28, 10**6), (1 << 15, 0)):  # items broadcast, and windows joined by a shuffle
        got = {(r.doc_id, r.item_id): r.longest for r in leaks(d, e, least=5, most_bits=most, broadcast_rows=few).collect()}
        want = {}
        for di, t in docs:
            for ii, x in items:
                n = runs(words(t), words(x), 5)
                if n:
                    want[di, ii] = n
        assert got == want
    assert leaks(d.limit(0), e).count() == 0 and leaks(d, e.limit(0)).count() == 0


def greedy(doc, item, least):
    """Brute force: mark the longest match of unmarked words, first place first, until none is left."""
    du, iu, out = set(), set(), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in du and i + n not in iu:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return out
        d, i, n = best
        out.append(best)
        du |= set(range(d, d + n))
        iu |= set(range(i, i + n))


def test_tiles_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(120):
        doc, item = (np.array(rnd.choices(range(1, rnd.choice([2, 3, 6, 20])), k=rnd.randrange(0, 40)), dtype=np.uint64) for _ in range(2))
        want = greedy(doc.tolist(), item.tolist(), 3)
        got = tile(doc, item, 3)
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
        for d, i, n in got:
            assert (doc[d : d + n] == item[i : i + n]).all()


def test_repeated_words_stay_cheap():
    began = time.perf_counter()
    assert tile(np.full(3000, 7, dtype=np.uint64), np.full(800, 7, dtype=np.uint64), 13) == [(0, 0, 800)]
    log, item = (np.array([1, 2] * n, dtype=np.uint64) for n in (20_000, 1_000))
    assert sum(n for _, _, n in tile(log, item, 13)) == 2000
    assert time.perf_counter() - began < 1


def test_rolling_hashes_depend_on_the_words_alone():
    ids = np.random.default_rng(1).integers(1, 2**63, 200).astype(np.uint64)
    for least in (5, 40):
        again = np.concatenate([ids[50:], ids])
        assert len(set(rolling(ids, least).tolist())) == 200 - least + 1
        assert (rolling(again, least)[150:] == rolling(ids, least)).all()
    assert hashed([]) [1] == [] and [len(x) for x in hashed([None, "", "a b"])] == [5, 3]
    assert (numbers("a bc abc") == hashed(["zz", "x a bc abc"])[0][3:6]).all() and len(set(numbers("a b ab ba aa").tolist())) == 5


def test_reordered_passages_add_up():
    item = [f"a{i}" for i in range(30)]
    doc = item[20:30] + ["z"] + item[10:20] + ["z"] + item[0:10] + item[0:10]
    tiles = tile(numbers(" ".join(doc)), numbers(" ".join(item)), 8)
    assert sorted(n for _, _, n in tiles) == [10, 10, 10]
    used = [p for d, _, n in tiles for p in range(d, d + n)]
    assert len(used) == len(set(used))


def test_recall_of_reordered_items(spark, folder):
    """Every item, its words in passages of 8 to 20 in another order, a third of them dropped, put into another text."""
    rnd = random.Random(12)
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    planted = []
    for k, (item, w) in enumerate(items):
        cuts, at = [], 0
        while at < len(w):
            n = rnd.randrange(8, 21)
            cuts.append(w[at : at + n])
            at += n
        kept = [c for c in cuts if len(c) >= 8]
        rnd.shuffle(kept)
        kept = kept[: max(1, round(len(kept) * 2 / 3))]
        if sum(map(len, kept)) < 0.5 * len(w):
            continue
        text = " ".join(f"filler{rnd.randrange(9)} " + b" ".join(c).decode() for c in kept)
        planted.append((k, item, f"Some {text} more"))
    d = spark.createDataFrame(planted, "doc_id bigint, want bigint, text string")
    hit = leaks(d, spark.read.parquet(f"{folder}/eval_items.parquet"), least=8).where("coverage >= 0.5").join(d.select("doc_id", "want"), "doc_id").where("item_id = want").select("doc_id").distinct().count()
    assert len(planted) > 100 and hit / len(planted) >= 0.9


def test_planted_items_are_found(spark, folder):
    from tapeglass.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{folder}/eval_items.parquet").toPandas()
    grams = {}
    for i, t in zip(items.item_id, items.text, strict=True):
        w = words(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = set()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = words(t)
        want |= {(i, x) for k in range(len(w) - 12) for x in grams.get(tuple(w[k : k + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in QUERIES["p8_found"](spark, folder).collect()} == want and want
