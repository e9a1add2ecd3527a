"""Processing only new or changed records: a ledger of work items.

The ledger is a log of what happened to each item.  Folding the log gives the state of every item:
``pending``, ``leased`` or ``done``.

- ``offer``: the item exists in this version (a content tag) as of its fencing token;
- ``lease``: a worker took it until ``until``, with a higher token than any before;
- ``done``: a worker finished the version of its token;
- ``withdraw``: there is nothing to do for the item now.

A lease that ran out counts for nothing, so the item is pending again.  A ``done`` counts only if it
carries the token of the offer or lease in force, so a writer that lost its lease can't finish the
item behind a later one's back.  Where an item's output is written depends on item and version alone,
so that a retry overwrites its own first attempt and nothing else.

On storage the ledger is a row of numbered commits.  The events of a commit are written first; then its
number is claimed by creating one file that must not exist yet, and readers read claimed commits only.
So a writer that dies leaves no part of its events behind, and of two planners that chose the same
items one fails to claim the number and has to choose again.  ``compact`` folds all commits up to one
into a snapshot of a row per item and version; from then on a reader reads the snapshot and the commits
after it, so a run costs what is new and not the whole history.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "item string, kind string, version string, token bigint, until bigint, worker string, at bigint"
#: what a snapshot keeps of each item and version
SNAPSHOT = "item string, _v struct<given: boolean, tag: string>, offered bigint, lease struct<token: bigint, until: bigint, worker: string>, done bigint, withdrawn bigint"


def partial(log: DataFrame, item: list[str]) -> DataFrame:
    """The log's events as a row per item and version: item, _v, and the greatest offer, lease, done and withdraw."""
    e = log.where(F.col("token").isNotNull())
    for c in item:
        e = e.where(F.col(c).isNotNull())
    # null as a version of its own: a struct that is never null
    v = F.struct(F.col("version").isNotNull().alias("given"), F.coalesce("version", F.lit("")).alias("tag"))
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    lease = F.struct("token", F.coalesce("until", F.lit(0).cast("bigint")).alias("until"), "worker")
    return e.withColumn("_v", v).groupBy(*item, "_v").agg(of("offer", F.col("token")).alias("offered"), of("lease", lease).alias("lease"), of("done", F.col("token")).alias("done"), of("withdraw", F.col("token")).alias("withdrawn"))


def merged(parts: DataFrame, item: list[str]) -> DataFrame:
    """Rows of several ``partial`` results put together."""
    return parts.groupBy(*item, "_v").agg(*[F.max(c).alias(c) for c in ("offered", "lease", "done", "withdrawn")])


def states(per: DataFrame, item: list[str], now: int | None = None) -> DataFrame:
    """The state of each item from its rows per version; see ``fold``."""
    top = per.groupBy(*item).agg(F.max(F.when(F.col("offered").isNotNull(), F.struct("offered", "_v", "lease", "done"))).alias("o"), F.max("withdrawn").alias("withdrawn"))
    live = F.lit(False) if now is None else F.coalesce(F.col("o.lease.until") > F.lit(now), F.lit(False))
    need = F.coalesce(F.col("o.lease.token"), F.lit(-(2**62)))
    state = (
        F.when(F.col("o").isNull() | (F.col("withdrawn") > F.col("o.offered")), "withdrawn")
        .when(F.coalesce(F.col("o.done") >= need, F.lit(False)), "done")
        .when(live, "leased")
        .otherwise("pending")
    )
    return top.select(*item, state.alias("state"), F.when(F.col("o._v.given"), F.col("o._v.tag")).alias("version"), F.greatest("o.offered", "o.lease.token").alias("token"), F.when(live, F.col("o.lease.worker")).alias("worker"), F.when(live, F.col("o.lease.until")).alias("until"))


def fold(log: DataFrame, item: list[str], now: int | None = None) -> DataFrame:
    """State of each item: item, state, version, token, worker, until.

    ``log`` has the item's columns and kind, version, token, until, worker.  The offer with the highest
    token gives the version (with equal tokens the greater); a later ``withdraw`` takes the item out
    (state ``withdrawn``).  The item is ``done`` if a ``done`` of the offered version has a token not
    below that of the latest lease of this version; ``leased`` if that lease runs beyond ``now``; else
    ``pending``.  A null version is a version of its own.

    Everything is a grouped maximum, combined before the shuffle, so an item with a great many events
    costs a row per task.  Defined cases: events with a null in the item or no token are left out;
    repeated events change nothing; an empty log gives no items.
    """
    return states(partial(log, item), item, now)


def output_path(root: str, item: str, version: str | None) -> str:
    """Where the output of an item's version belongs: the same for every attempt."""
    name = hashlib.sha256(f"{item}\0{'' if version is None else '=' + version}".encode()).hexdigest()[:32]
    return f"{root}/{name[:2]}/{name}"


class Conflict(Exception):
    """Another writer claimed the number first."""


class _Store:
    """The few file operations the ledger needs, on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        """File names of a folder; none if it isn't there.  Any other fault is raised."""
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def claim(self, name: str, text: str) -> None:
        """Create the file ``name`` with ``text``, or raise ``Conflict`` if it is there."""
        p = self.path(name)
        self.fs.mkdirs(p.getParent())
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then; the kernel does both at once
            at = self.path(name).toUri().getPath()
            whole = f"{at}.{uuid.uuid4().hex}"
            with open(whole, "x") as f:
                f.write(text)
            try:
                os.link(whole, at)
            except FileExistsError:
                raise Conflict(name) from None
            finally:
                os.unlink(whole)
            return
        try:
            out = self.fs.create(p, False)
        except Exception as e:
            if self.fs.exists(p):
                raise Conflict(name) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        f = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class WorkLedger:
    """A ledger in a folder that all executors share.  Any number of planners and workers may use it at once."""

    def __init__(self, spark: SparkSession, folder: str, attempts: int = 20):
        self.spark, self.folder, self.attempts = spark, folder, attempts
        self.store = _Store(spark, folder)

    def _numbers(self, kind: str) -> list[int]:
        return [int(n) for n in self.store.names(f"{self.folder}/{kind}") if n.isdigit()]

    def position(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max(self._numbers("commits"), default=0)

    def _per(self, upto: int) -> DataFrame:
        """Rows per item and version as of commit ``upto``: the newest snapshot before it and the commits since."""
        snap = max((n for n in self._numbers("snapshots") if n <= upto), default=0)
        at = lambda kind, n: f"{self.folder}/data/{self.store.read(f'{self.folder}/{kind}/{n:020d}')}"
        tail = [n for n in self._numbers("commits") if snap < n <= upto]
        parts = [self.spark.read.schema(SNAPSHOT).parquet(at("snapshots", snap))] if snap else []
        if tail:
            parts.append(partial(self.spark.read.schema(LOG).parquet(*[at("commits", n) for n in tail]), ["item"]))
        if not parts:
            return self.spark.createDataFrame([], SNAPSHOT)
        return merged(reduce(DataFrame.unionByName, parts), ["item"]) if len(parts) > 1 else parts[0]

    def state(self, now: int, upto: int | None = None) -> DataFrame:
        return states(self._per(self.position() if upto is None else upto), ["item"], now)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def _commit(self, number: int, events: DataFrame) -> None:
        columns = [c.split()[0] for c in LOG.split(", ")]
        name = self._write(events.select(*columns))
        try:
            self.store.claim(f"{self.folder}/commits/{number:020d}", name)
        except Conflict:
            self.store.remove(f"{self.folder}/data/{name}")
            raise

    def _decide(self, events) -> int:
        """Commit ``events(number, position)``; after a conflict they are worked out anew from what is there then."""
        for _ in range(self.attempts):
            last = self.position()
            try:
                self._commit(last + 1, events(last + 1, last))
                return last + 1
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: no number could be claimed in {self.attempts} attempts")

    def offer(self, items: DataFrame, at: int) -> None:
        """Offer item, version; those already offered in this version stay as they are."""
        none = F.lit(None)

        def events(number: int, last: int) -> DataFrame:
            known = self.state(at, last).select("item", F.col("version").alias("_have"), F.lit(True).alias("_known"))
            new = items.select("item", "version").distinct().join(known, "item", "left").where(F.col("_known").isNull() | ~F.col("_have").eqNullSafe(F.col("version")))
            return new.select("item", F.lit("offer").alias("kind"), "version", F.lit(number).cast("bigint").alias("token"), none.cast("bigint").alias("until"), none.cast("string").alias("worker"), F.lit(at).cast("bigint").alias("at"))

        self._decide(events)

    def lease(self, worker: str, most: int, now: int, seconds: int) -> DataFrame:
        """Lease up to ``most`` pending items to ``worker``; returns item, version, token.  No item is ever leased twice under one token."""

        def events(number: int, last: int) -> DataFrame:
            chosen = self.state(now, last).where(F.col("state") == "pending").orderBy("item").limit(most)
            return chosen.select("item", F.lit("lease").alias("kind"), "version", F.lit(number).cast("bigint").alias("token"), F.lit(now + seconds).cast("bigint").alias("until"), F.lit(worker).alias("worker"), F.lit(now).cast("bigint").alias("at"))

        number = self._decide(events)
        name = self.store.read(f"{self.folder}/commits/{number:020d}")
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/data/{name}").select("item", "version", "token")

    def done(self, leased: DataFrame, worker: str, at: int) -> None:
        """Finish items under the tokens they were leased with; a stale token changes nothing."""
        none = F.lit(None).cast("bigint")
        self._decide(lambda number, last: leased.select("item", F.lit("done").alias("kind"), "version", F.col("token").cast("bigint").alias("token"), none.alias("until"), F.lit(worker).alias("worker"), F.lit(at).cast("bigint").alias("at")))

    def stale(self, leased: DataFrame) -> DataFrame:
        """Those of ``leased`` (item, version, token) that are no longer in force: a worker asks before it publishes."""
        now = self.state(0).select("item", F.col("token").alias("_t"), F.col("version").alias("_v"))
        return leased.join(now, "item", "left").where(~F.col("_t").eqNullSafe(F.col("token")) | ~F.col("_v").eqNullSafe(F.col("version"))).select(*leased.columns)

    def compact(self) -> int:
        """Fold everything so far into a snapshot; returns its number.  Doing it twice changes nothing."""
        last = self.position()
        if last and last not in self._numbers("snapshots"):
            name = self._write(self._per(last))
            try:
                self.store.claim(f"{self.folder}/snapshots/{last:020d}", name)
            except Conflict:
                self.store.remove(f"{self.folder}/data/{name}")
        return last
