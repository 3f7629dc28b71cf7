"""Large keyed state: RocksDB, running top lists with timers, and tables of what the state holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from feedlake.operators.aggregates import top_hashtags

# The provider that keeps state on local disk, and uploads changes alone at each batch; all stores of an executor share one bound of memory.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """OP-48, OP-50, OP-51 for state beyond the heap: streams started inside keep it in RocksDB; a checkpoint keeps the provider it began with."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """What a stream's first stateful operator holds after its last batch: (key, value, partition_id).

    Members of an aggregate's value are named alike; each gets its place in the value as a suffix.
    """
    reader = spark.read.format("statestore").option("path", checkpoint)
    held = (reader.option("stateVarName", variable) if variable else reader).load()
    if "value" not in held.columns or len(set(held.schema["value"].dataType.names)) == len(held.schema["value"].dataType.names):
        return held
    told = StructType([StructField(f"{f.name}_{k}", f.dataType) for k, f in enumerate(held.schema["value"].dataType)])
    return held.withColumn("value", F.col("value").cast(told))


class TopTags(StatefulProcessor):
    """Counts of one window's hashtags; gives the most used ones after each batch, and for good when the window closes."""

    def __init__(self, top: int, duration_ms: int):
        self.top, self.duration_ms = top, duration_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "hashtag string", "n long")

    def _best(self, key, closed: bool) -> Iterator[Row]:
        found = sorted(((-n[0], tag[0]) for tag, n in self.counts.iterator()))[: self.top]
        for n, tag in found:
            yield Row(time_start=key[0], part=key[1], hashtag=tag, count=-n, closed=closed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        end = int(key[0].timestamp() * 1000) + self.duration_ms
        if not any(t == end for t in self.handle.listTimers()):
            self.handle.registerTimer(end)
        for hashtag, n in Counter(row.hashtag for row in rows).items():  # the state is asked once a hashtag, not once a row
            before = self.counts.getValue((hashtag,))[0] if self.counts.containsKey((hashtag,)) else 0
            self.counts.updateValue((hashtag,), (before + n,))
        yield from self._best(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._best(key, True)
        self.counts.clear()

    def close(self) -> None:
        pass


def running_top(df: DataFrame, path: str, checkpoint: str, duration: timedelta = timedelta(hours=1), top: int = 10, parts: int = 8) -> StreamingQuery:
    """OP-38 on a stream with a watermark, also while windows are open.

    A window's hashtags are dealt to ``parts`` keys, so that no key holds all of
    a window's; each gives its ``top``, among which the window's top are. After
    each batch ``path/open`` has the lists that changed (see :func:`open_top`);
    ``path/closed`` gets the ranked list of each window once, when the watermark passes its
    end, and the window's state goes. Rows behind the watermark are dropped.
    """
    seconds = int(duration.total_seconds())
    tags = df.select("event_time", F.explode("hashtags").alias("hashtag")).filter(F.col("hashtag").isNotNull())
    keyed = tags.select(
        "event_time", F.window("event_time", f"{seconds} seconds")["start"].alias("time_start"),
        F.pmod(F.xxhash64("hashtag"), F.lit(parts)).cast("int").alias("part"), "hashtag",
    )
    made = keyed.groupBy("time_start", "part").transformWithState(
        TopTags(top, seconds * 1000), "time_start timestamp, part int, hashtag string, count long, closed boolean", "Append", "EventTime"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter(~F.col("closed")).drop("closed").write.mode("overwrite").parquet(f"{path}/open/batch_id={number}")
        ended = batch.filter("closed").withColumn("time_end", F.col("time_start") + F.expr(f"INTERVAL {seconds} SECONDS"))
        top_hashtags(ended.select("time_start", "time_end", "hashtag", "count"), top).write.mode("overwrite").parquet(f"{path}/closed/batch_id={number}")
        batch.unpersist()

    with rocksdb_state(df.sparkSession):
        return made.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_top(spark: SparkSession, path: str, top: int = 10) -> DataFrame:
    """The newest lists of windows of a :func:`running_top`, ranked; closed windows keep their last one."""
    lists = spark.read.parquet(f"{path}/open")
    newest = lists.withColumn("last", F.max("batch_id").over(Window.partitionBy("time_start", "part"))).filter("batch_id = last")
    return top_hashtags(newest.select("time_start", "hashtag", "count"), top)
