"""Evaluation texts leaking into training text, by greedy string tiling.

Items and documents become words, and windows of ``least`` words get a rolling (Karp-Rabin) hash.  A
bitmap of fixed size tells which windows an item may have; what it lets through of the documents is
little, and only that is kept.  Windows of documents and items are joined on their hash; a document and
an item that share one are tiled: the longest passage both have is looked for by Karp-Rabin at falling
lengths, marked, and looked for again among the words not yet marked, none shorter than ``least``.  The
tiles tell how long the longest shared passage is and how much of the item the document holds, in
whatever order.

The documents are read once and never shuffled, only their suspicious passages are.  Neither the items
nor any fingerprints of documents come to the driver; of the items it holds the bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.words import hashed, mix
from tapeglass.session import cut

_BASE = 0x9E3779B97F4A7C15
_WRAP = 1 << 64
#: item windows up to this many rows (some 50 bytes each) and items up to this many characters may be broadcast
BROADCAST_ROWS = 1_000_000
BROADCAST_CHARS = 20_000_000
#: copies of the item windows when they are not broadcast, so that a window a great many documents have meets several tasks
SALT = 16
#: a window's bits in the bitmap come from its hash shifted by these
_SHIFTS = (0, 12, 24, 36)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base, modulo 2**64."""
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(ids: np.ndarray, least: int) -> np.ndarray:
    """Hash of each window of ``least`` numbers, modulo 2**64; the cost doesn't depend on ``least``."""
    n = len(ids) - least + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = ids.astype(np.uint64)
    if least <= 32:
        h = np.zeros(n, dtype=np.uint64)
        for k in range(least):
            h *= np.uint64(_BASE)
            h += x[k : k + n]
        return h
    # sums of x[i] * base**-i, brought to one power again
    w = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * _inverse_powers(len(x)))])
    return (w[least:] - w[:-least]) * powers(len(x))[least - 1 :]


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, pow(_BASE, -1, _WRAP), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _whole(used: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of ``length`` has no word that is used."""
    c = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(used)])
    return c[length:] == c[:-length]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length), longest first, then by place.

    The greatest length at which the unmarked words share a window is found by halving, all windows of
    that length are marked in order of their places as far as they are still free, and so on down to
    ``least``.  A length costs a few passes over the words, however often a word repeats.  A zero stands
    for no word.
    """
    d_used, i_used, tiles = doc == 0, item == 0, []
    hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shared(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document's free windows of length n that the item has free as well, and of the item's free windows."""
        if n not in hashes:
            hashes[n] = rolling(doc, n), rolling(item, n)
        hd, hi = hashes[n]
        d, i = np.flatnonzero(_whole(d_used, n)), np.flatnonzero(_whole(i_used, n))
        if not len(i):
            return d[:0], i
        known = np.sort(hi[i])
        at = np.searchsorted(known, hd[d])
        at[at == len(known)] = 0
        return d[known[at] == hd[d]], i

    most = min(len(doc), len(item))
    while most >= least and len(shared(least)[0]):
        low, high = least, most
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(shared(n)[0]) else (low, n - 1)
        n = low
        d_at, i_at = shared(n)
        hd, hi = hashes[n]
        places: dict[int, list[int]] = {}
        for i in i_at[::-1].tolist():
            places.setdefault(int(hi[i]), []).append(i)
        free_from = 0
        for d in d_at.tolist():
            if d < free_from:
                continue
            mine = places[int(hd[d])]
            while mine and i_used[mine[-1] : mine[-1] + n].any():
                mine.pop()
            # the hash only proposes; the words decide
            if mine and np.array_equal(doc[d : d + n], item[mine[-1] : mine[-1] + n]):
                i = mine.pop()
                tiles.append((d, i, n))
                d_used[d : d + n] = True
                i_used[i : i + n] = True
                free_from = d + n
        hashes.clear()
        most = n - 1
    return tiles


def windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(item, ids): the item's words as numbers, and its different windows."""
    for b in batches:
        ids, at = hashed(b.column(1).to_pylist())
        own = [ids[x : y - 1] for x, y in zip(at, [*at[1:], len(ids)], strict=True)]
        hashes = [np.unique(mix(rolling(x, least))).view(np.int64) for x in own]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], names=["_item", "_words", "_windows"])


def bitmap(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of the hashes in column ``h``, four each and 64 or more for each as far as ``most_bits`` allow: 32,768 bits a row come to the driver."""
    n = hashes.count()
    bits = 1 << 15
    while bits < min(64 * n, most_bits):
        bits *= 2
    at = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("h", s), F.lit(bits)) + 1 for s in _SHIFTS]))  # bitmap positions count from 1
    places = hashes.select(at.alias("at"))
    rows = places.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def suspicious(ids: np.ndarray, at: list[int], bits: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, words of its suspicious passages with zeros between, their different windows) of each text that has some."""
    h = mix(rolling(ids, least))
    hits = np.arange(len(h))
    for s in _SHIFTS:
        slot = (h[hits] >> np.uint64(s)) & np.uint64(len(bits) * 8 - 1)
        hits = hits[(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    if not len(hits):
        return
    # a window may not reach over the end of a text
    hits = hits[_whole(ids == 0, least)[hits]]
    if not len(hits):
        return
    text = np.searchsorted(np.array(at), hits, "right") - 1
    for t in np.unique(text):
        mine = hits[text == t]
        apart = np.flatnonzero(np.diff(mine) > least)
        parts = []
        for a, z in zip(mine[np.r_[0, apart + 1]], mine[np.r_[apart, len(mine) - 1]], strict=True):
            parts += [ids[a : z + least], np.zeros(1, dtype=ids.dtype)]
        yield int(t), np.concatenate(parts), np.unique(h[mine])


def portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in a row of some 150,000 characters together, with the number of the first: their arrays stay in the processor's cache."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > 150_000:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 13, most_bits: int = 1 << 28, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every document and item that share ``least`` or more words in a row: doc_id, item_id, tiles, longest, covered, item_words, coverage.

    ``longest``: words of the longest passage; ``covered``: words of the item under tiles, in any
    order; ``coverage``: their share of the item.  ``most_bits``: size of the bitmap; more windows than
    it can hold well let more of the documents through, and the join still decides.  Words are compared
    by 64 bits.

    Defined cases: null and empty texts share nothing; items shorter than ``least`` words can't leak;
    repeated documents have a row each, rows with one doc_id count together, repeated rows of one item
    count once (two texts under one id: the longer passage); further columns are ignored; empty tables
    give no rows.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[doc_id].dataType, items.schema[item_id].dataType
    named = items.select(F.col(item_id).cast("string").alias("_item"), F.col(item_text).alias("_text")).where(F.col("_item").isNotNull() & F.col("_text").isNotNull()).distinct()
    told = cut(named.mapInArrow(lambda batches: windows(batches, least), "_item string, _words array<bigint>, _windows array<bigint>").where(F.size("_windows") > 0).withColumn("_no", F.monotonically_increasing_id()))
    asked = told.select(F.explode("_windows").alias("h"), "_no")
    held = spark.sparkContext.broadcast(bitmap(asked.select("h").distinct(), most_bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            names, rows = b.column(0), []
            for first, texts in portions(b.column(1).to_pylist()):
                rows += [(first + t, *found) for t, *found in suspicious(*hashed(texts), bits, least)]
            if rows:
                t, passages, h = zip(*rows, strict=True)
                as_list = lambda xs: pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(t)), as_list(passages), as_list(h)], names=["_row", "_passages", "_windows"])

    docs = documents.select(F.col(doc_id).cast("string").alias("_row"), F.col(text).alias("_text")).where(F.col("_text").isNotNull() & F.col("_row").isNotNull())
    found = cut(docs.mapInArrow(scan, "_row string, _passages array<bigint>, _windows array<bigint>").withColumn("_doc", F.monotonically_increasing_id()))
    few = asked.count() <= broadcast_rows
    seen = found.select("_doc", F.explode("_windows").alias("h"))
    if few:
        pairs = seen.join(F.broadcast(asked), "h")  # counted above
    else:
        salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        pairs = seen.withColumn("_salt", F.pmod("_doc", F.lit(SALT)).cast("int")).join(salted, ["h", "_salt"])
    pairs = pairs.select("_doc", "_no").distinct()
    words = told.select("_no", "_item", "_words")
    if few and (told.agg(F.sum(F.size("_words"))).first()[0] or 0) <= BROADCAST_CHARS // 8:
        words = F.broadcast(words)
    both = found.select("_doc", "_row", "_passages").join(pairs, "_doc").join(words, "_no").select("_row", "_item", "_passages", "_words")
    # few bytes and much work: kept apart, so that tasks aren't put together by size
    both = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "_row", "_item")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (b.column(2), b.column(3))]
            for k in range(b.num_rows):
                doc, item = (flat[off[k] : off[k + 1]].view(np.uint64) for off, flat in lists)
                lengths = [n for _, _, n in tile(doc, item, least)]
                out.append((len(lengths), max(lengths, default=0), sum(lengths), len(item)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int32()) for c in (zip(*out, strict=True) if out else [[]] * 4)]], names=["_row", "_item", "tiles", "longest", "covered", "item_words"])

    tiled = both.mapInArrow(lay, "_row string, _item string, tiles int, longest int, covered int, item_words int").where(F.col("longest") >= least)
    best = tiled.groupBy("_row", "_item").agg(F.max(F.struct("longest", "covered", "tiles", "item_words")).alias("r"))
    return best.select(F.col("_row").cast(kind).alias(doc_id), F.col("_item").cast(item_kind).alias("item_id"), "r.tiles", "r.longest", "r.covered", "r.item_words", (F.col("r.covered") / F.col("r.item_words")).alias("coverage"))
