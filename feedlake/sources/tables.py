"""Tables in plain Parquet whose versions become visible by one file that is created if absent."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedlake.operators.dedup import keep_latest
from feedlake.operators.incremental import LEDGER, pending_partitions
from feedlake.sources.sinks import DENSE

#: So many keys at most are sent to every executor.
FEW = 500_000
#: An update of fewer than one in so many rows of its buckets is laid over them instead of rewriting them, so many times at most.
THIN, LAYERS = 16, 4


class CommitLog:
    """Numbered JSON entries below a folder; an entry's number is taken by whoever creates its file first."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 60.0):
        self.path, self.stale, self._make = path, stale, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self) -> list[int]:
        where = self._make(self.path)
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._make(f"{self.path}/{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, number: int, entry: dict) -> bool:
        """Write entry ``number`` whole and then give it its name; False if another writer has the number.

        A number is claimed by creating a file that must be absent, so that one
        writer gets it and no reader sees half an entry. A claim whose writer died is
        given up after ``stale`` seconds. The file system must create and rename files atomically.
        """
        draft, gone = self._make(f"{self.path}/.{uuid.uuid4().hex}"), self._make(f"{self.path}/.{uuid.uuid4().hex}")
        final, claim = self._make(f"{self.path}/{number:010d}.json"), self._make(f"{self.path}/.claim-{number:010d}")
        try:
            self.fs.create(claim, False).close()
        except Exception as error:  # noqa: BLE001 - the Java error comes wrapped
            if not self.fs.exists(claim):
                raise error
            age = time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000
            if not self.fs.exists(final) and age > self.stale and self.fs.rename(claim, gone):
                self.fs.delete(gone, False)
            return False
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return bool(self.fs.rename(draft, final))


class BucketTable:
    """OP-55: a keyed table in buckets of the key's hash; an upsert rewrites the buckets it touches and no others.

    Updates of few of their buckets' rows are laid over these as layers, which readers resolve by key; a bucket with
    ``LAYERS`` of them is rewritten. A version is a manifest: for each bucket the version that wrote it last, or the
    list of its layers, the last one on top.
    Readers take the newest manifest, so they see a version whole or not at
    all, and a writer that fails before its manifest is there has changed nothing. Buckets should be as many as keep one
    in a task; their number is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("_id",), buckets: int = 64):
        self.spark, self.path, self.keys, self.log = spark, path, list(keys), CommitLog(spark, f"{path}/manifests")
        versions = self.log.numbers()
        self.buckets = self.log.read(versions[-1])["buckets"] if versions else buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _manifest(self, version: int | None = None) -> tuple[int, dict[str, list[str]], str | None]:
        versions = self.log.numbers()
        if not versions:
            return 0, {}, None
        number = versions[-1] if version is None else version
        entry = self.log.read(number)
        return number, {b: v if isinstance(v, list) else [v] for b, v in entry["written"].items()}, entry["schema"]

    def _read(self, written: dict[str, list[str]], schema: str | None) -> DataFrame | None:
        if not written:
            return None

        def rows(layers: dict[str, list[str]]) -> DataFrame:
            paths = [f"{self.path}/data/version={v}/bucket={b}" for b, vs in layers.items() for v in vs]
            return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)

        # Rows of a layer stay if no higher one has their key; rows without a key stay.
        out = rows({b: vs[:1] for b, vs in written.items()})
        for k in range(1, max(map(len, written.values()))):
            layer = rows({b: vs[k : k + 1] for b, vs in written.items() if len(vs) > k})
            out = self._kept(out, layer.select(*self.keys).distinct()).unionByName(layer)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or ``version``; None if there is none."""
        return self._read(*self._manifest(version)[1:])

    def _kept(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of ``old`` with none of ``keys``; whichever is few, the keys or those that stay, decides without a shuffle of rows."""
        if keys.count() <= FEW:
            return old.join(F.broadcast(keys), self.keys, "left_anti")
        stay = old.select(*self.keys).join(keys, self.keys, "left_anti").distinct()
        if stay.count() > FEW:
            return old.join(keys, self.keys, "left_anti")
        named = stay.toDF(*(f"__{k}" for k in self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]  # rows without a key stay as well
        return old.join(F.broadcast(named), reduce(lambda x, y: x & y, same), "left_semi")

    def upsert(
        self, updates: DataFrame, time_col: str | None = "ingest_time", before_commit: Callable[[], None] = lambda: None,
        attach: Callable[[DataFrame], DataFrame] | None = None, deal: bool = True,
    ) -> list[int]:
        """Replace or add the rows of ``updates``' keys, the latest of each; the numbers of the buckets written.

        Updates have the table's columns; columns that the table lacks are added, null in rows written before.
        Another writer that commits in between makes this one start over. ``attach`` joins wide columns to the
        latest updates and must give a row for each; ``deal=False`` writes from the tasks in which the rows are, so that
        no text is shuffled, but a bucket has up to a file for each task.
        """
        while True:
            number, written, schema = self._manifest()
            latest = keep_latest(updates, self.keys, time_col) if time_col else updates.dropDuplicates(self.keys)
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            latest.write.options(**DENSE).parquet(staged)
            latest = self.spark.read.parquet(staged)
            fresh = attach(latest) if attach else latest
            touched = sorted(r["bucket"] for r in latest.select(self._bucket()).distinct().collect())  # at most ``buckets`` numbers
            old = self._read({b: v for b, v in written.items() if int(b) in set(touched)}, schema)
            deep = max((len(written.get(str(b), [])) for b in touched), default=0)
            thin = old is not None and deep <= LAYERS and latest.count() * THIN < old.count()
            if thin:  # a column that either side lacks is null
                merged = old.limit(0).unionByName(fresh, allowMissingColumns=True)
            else:
                merged = fresh if old is None else self._kept(old, latest.select(*self.keys)).unionByName(fresh, allowMissingColumns=True)
            version = f"{number + 1}-{uuid.uuid4().hex[:8]}"
            placed = merged.withColumn("bucket", self._bucket())
            (placed.repartition("bucket") if deal else placed).write.options(**DENSE).partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
            before_commit()
            entry = {"buckets": self.buckets, "written": written | {str(b): (written.get(str(b), []) if thin else []) + [version] for b in touched}, "schema": merged.schema.json()}
            if self.log.create(number + 1, entry):
                return touched
            time.sleep(0.1)

    def vacuum(self) -> int:
        """Delete what only earlier versions have, which can't be read any more; how many bucket folders went. Writers at work lose nothing, as what is not committed stays."""
        named = [{(v, b) for b, vs in self._manifest(n)[1].items() for v in vs} for n in self.log.numbers()]
        gone = set().union(*named[:-1]) - named[-1] if named else set()
        return sum(bool(self.log.fs.delete(self.log._make(f"{self.path}/data/version={v}/bucket={b}"), True)) for v, b in gone)


class Ledger:
    """OP-43, OP-44: which (source, date) pairs are done. Entries are Parquet; a commit names one and takes the next free number.

    ``ALL`` is a source of its own, for runs over the whole lake. Pairs without
    a date are neither recorded nor skipped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, f"{path}/commits")

    def read(self, numbered: bool = False) -> DataFrame:
        """The latest entry of each pair; ``numbered`` adds ``commit``."""
        names = {self.log.read(n)["entry"]: n for n in self.log.numbers()}
        paths = [f"{self.path}/entries/entry={name}" for name in names]
        if not paths:
            rows = self.spark.createDataFrame([], f"{LEDGER}, entry string")
        else:
            rows = self.spark.read.schema(f"{LEDGER}, entry string").option("basePath", f"{self.path}/entries").parquet(*paths)
        latest = keep_latest(rows, ["source", "date"], "processed_at")
        if numbered:
            commits = self.spark.createDataFrame(list(names.items()), "entry string, commit long")
            latest = latest.join(commits, "entry")
        return latest.drop("entry")

    def pending(self, candidates: DataFrame) -> DataFrame:
        return pending_partitions(candidates, self.read())

    def mark(self, done: DataFrame) -> int | None:
        """Record pairs that aren't there yet, stamped now; the commit's number, None if there was nothing to record."""
        fresh = self.pending(done.select("source", "date")).filter(F.col("date").isNotNull()).distinct()
        name = uuid.uuid4().hex
        fresh.withColumn("processed_at", F.current_timestamp()).write.parquet(f"{self.path}/entries/entry={name}")
        if self.spark.read.schema(LEDGER).parquet(f"{self.path}/entries/entry={name}").isEmpty():
            return None
        while True:  # another writer's commit doesn't touch this entry: only the number is tried again
            number = (self.log.numbers() or [0])[-1] + 1
            if self.log.create(number, {"entry": name}):
                return number
            time.sleep(0.1)
