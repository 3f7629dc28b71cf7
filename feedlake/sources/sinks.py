"""Batch and stream sinks, and the projections they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.functions.exprs import json_text
from feedlake.operators.dedup import keep_latest
from feedlake.sources.schemas import COMMENTS, SERVED

CLEAN_PARTITIONS = ("source", "event_year", "event_month", "event_date")
RAW_PARTITIONS = ("source", "year", "month", "day", "hour")
#: Texts take two thirds of what Spark's default codec makes of them.
DENSE = {"compression": "zstd"}
#: Tasks move their own files to the table, not the driver one after the other; what a failed job has moved stays.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

#: For many small files on a local disk: no checksum file beside each, and one external call for permissions a file instead of several. Other file systems ignore it.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def serving_view(df: DataFrame) -> DataFrame:
    """OP-12: the served columns that exist, with ``_id``, parsed comments and the clean text as content."""
    out = df.select(*[c for c in SERVED if c in df.columns])
    if "content_clean" in out.columns:
        out = out.withColumnRenamed("content_clean", "content")
    if "comments_list" in out.columns and out.schema["comments_list"].dataType.simpleString() == "string":
        out = out.withColumn("comments_list", F.from_json("comments_list", COMMENTS))
    return out.withColumn("_id", F.col("post_id"))


def wire_view(df: DataFrame) -> DataFrame:
    """OP-13: (key, value): the post's id and the row as JSON, with every ``extra`` as JSON text."""
    if "extra" in df.columns:
        df = df.withColumn("extra", json_text(F.col("extra"), df.schema["extra"].dataType.simpleString(), empty=None))
    return df.select(F.col("post_id").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


#: Columns of nearly the same text.
TEXTS = ("content", "content_clean")


def packed(df: DataFrame) -> DataFrame:
    """``content`` and ``content_clean`` as one list ``texts``: what nearly repeats lies side by side in a file, where the second takes next to no room."""
    return df.withColumn("texts", F.array(*TEXTS)).drop(*TEXTS)


def unpacked(df: DataFrame) -> DataFrame:
    """The columns of :func:`packed` rows."""
    return df.withColumns({c: F.get("texts", F.lit(k)) for k, c in enumerate(TEXTS)}).drop("texts") if "texts" in df.columns else df


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The table of :func:`write_clean` with all its columns, packed or not."""
    return unpacked(spark.read.parquet(path))


def write_clean(df: DataFrame, path: str, mode: str = "overwrite", deal: bool = True, pack: bool = False) -> None:
    """OP-54: clean posts by source, year, month and date.

    ``overwrite`` replaces only the partitions written, so that a re-run gives
    the same table; ``append`` adds. ``deal=False`` writes from the tasks in which the rows
    are: no text is shuffled, but a partition has up to a file for each task. ``pack`` writes :func:`packed` texts, for :func:`read_clean`.
    """
    df = packed(df) if pack else df
    options = DENSE | ({"partitionOverwriteMode": "dynamic"} if mode == "overwrite" else {})
    dealt = df.hint("rebalance", *CLEAN_PARTITIONS) if deal else df
    dealt.write.mode(mode).options(**options).partitionBy(*CLEAN_PARTITIONS).parquet(path)


def upsert(target: DataFrame | None, updates: DataFrame, keys: Sequence[str] = ("_id",), time_col: str | None = "ingest_time") -> DataFrame:
    """OP-55: the target with each key's rows replaced by its latest update; applying it twice changes nothing."""
    fresh = keep_latest(updates, keys, time_col) if time_col else updates.dropDuplicates(list(keys))
    return fresh if target is None else target.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def hour_columns(df: DataFrame) -> DataFrame:
    """Partition columns of the raw lake, in UTC; posts without event time go."""
    t = F.col("event_time")
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)}
    return df.filter(t.isNotNull()).withColumns(parts)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def land_raw(
    df: DataFrame, path: str, checkpoint: str | None = None, interval: str | None = "60 seconds", rows: int = 5000, attach: Callable[[DataFrame], DataFrame] | None = None, order: Sequence = (),
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery | None:
    """OP-52: flat posts to Parquet by source and UTC hour, in files of at most ``rows`` rows. A stream without ``interval`` runs once over what is there.

    A stream's batch has folders of its own (``batch``) within its hours, which a retry replaces; the source's limit for each
    trigger bounds what an hour can have in one.

    ``attach`` (batch) joins wide columns to rows that lie in their hours' tasks already, by a hash join that keeps their order, so that no
    text is shuffled or sorted again; ``order`` lays rows of a file side by side. ``deal`` deals rows to tasks
    otherwise than by their hours, as for an ``attach`` that is not a broadcast; an hour has up to a file for each task then.
    """
    landed = hour_columns(df)
    if not df.isStreaming:
        if attach:
            dealt = deal(landed) if deal else landed.repartition(tasks(df.sparkSession), *RAW_PARTITIONS)
            # A sort below a join goes as useless unless something depends on the order; without it, the writer sorts rows with their texts.
            placed = dealt.sortWithinPartitions(*RAW_PARTITIONS, *order).withColumn("__place", F.monotonically_increasing_id())
            dealt = attach(placed.filter("__place >= 0").drop("__place"))
        else:
            dealt = landed.hint("rebalance", *RAW_PARTITIONS)
        dealt.write.mode("append").options(maxRecordsPerFile=rows, **DENSE, **(MOVED_BY_TASKS if deal else {})).partitionBy(*RAW_PARTITIONS).parquet(path)
        return None
    options = DENSE | {"maxRecordsPerFile": rows, "partitionOverwriteMode": "dynamic"}

    def write(batch: DataFrame, number: int) -> None:
        parts = (*RAW_PARTITIONS, "batch")
        dealt = batch.repartition(tasks(batch.sparkSession), *RAW_PARTITIONS)  # by number: many small files take long in one task
        dealt.withColumn("batch", F.lit(number)).write.mode("overwrite").options(**options).partitionBy(*parts).parquet(path)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def compact_hours(spark: SparkSession, path: str, rows: int = 5000, where: str = "true") -> DataFrame:
    """OP-52: hours of a landed stream that have more files than their rows need, written anew; the hours (with files and rows before).

    An hour's rows go to ``batch=-1``. All such hours are written in one job to
    a folder aside; then each hour's folder is replaced by two renames. Compact
    hours that get no more rows, while nothing reads them: between the renames an hour
    is absent, and what a crash leaves below ``_compacted`` and ``_replaced`` can be moved back by hand.
    """
    keys = list(RAW_PARTITIONS)
    lake = spark.read.parquet(path).filter(where)
    files = lake.groupBy(*keys, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    hours = files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("n").alias("rows"))
    many = hours.filter(F.col("files") > F.ceil(F.col("rows") / rows))
    aside = f"{path}/_compacted"
    sliced = many.select(*keys, F.ceil(F.col("rows") / rows).alias("__slices"))
    chosen = lake.join(sliced, keys).withColumn("batch", F.lit(-1))
    part = F.pmod(F.xxhash64(*[c for c in lake.columns if c not in keys]), F.col("__slices"))  # an hour of many files is many tasks' work
    chosen.repartition(tasks(spark), *keys, part).drop("__slices").write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*keys, "batch").parquet(aside)
    made = spark._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(made("/".join([aside, *(f"{k}=*" for k in keys)])))
    for status in found or []:
        name = "/".join(str(status.getPath()).rsplit("/", len(keys))[1:])
        fs.mkdirs(made(f"{path}/_replaced/{name}").getParent())
        if not (fs.rename(made(f"{path}/{name}"), made(f"{path}/_replaced/{name}")) and fs.rename(status.getPath(), made(f"{path}/{name}"))):
            raise RuntimeError(f"{name} could not be replaced")
    for name in ("_replaced", "_compacted"):
        fs.delete(made(f"{path}/{name}"), True)
    return many


def parquet_sink(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), mode: str = "append", once: bool = False) -> StreamingQuery:
    """OP-56."""
    writer = df.writeStream.format("parquet").outputMode(mode).options(checkpointLocation=checkpoint, **DENSE)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def kafka_rows(df: DataFrame, key_col: str | None = None, value_format: str = "json") -> DataFrame:
    """OP-57: what the Kafka sink writes."""
    if value_format != "json":
        raise ValueError(f"unsupported format {value_format!r}")
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key_col).cast("string").alias("key"), value) if key_col else df.select(value)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, key_col: str | None = None) -> StreamingQuery:
    """OP-57."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}
    return kafka_rows(df, key_col).writeStream.format("kafka").options(**options).start()


def console_sink(df: DataFrame, rows: int = 20, truncate: bool = False, mode: str = "append", checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """OP-58."""
    writer = df.writeStream.format("console").outputMode(mode).option("numRows", rows).option("truncate", truncate)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


class MultiSink:
    """OP-59: several sinks, each with its own checkpoint, stopped together."""

    def __init__(self, checkpoints: str):
        self.checkpoints, self.queries = checkpoints, []

    def _next(self, name: str) -> str:
        return f"{self.checkpoints}/{name}-{len(self.queries)}"

    def add_parquet(self, df: DataFrame, path: str, **options) -> MultiSink:
        self.queries.append(parquet_sink(df, path, self._next("parquet"), **options))
        return self

    def add_console(self, df: DataFrame, **options) -> MultiSink:
        self.queries.append(console_sink(df, checkpoint=self._next("console"), **options))
        return self

    def add_kafka(self, df: DataFrame, servers: str, topic: str, key_col: str | None = None) -> MultiSink:
        self.queries.append(kafka_sink(df, servers, topic, self._next("kafka"), key_col))
        return self

    def add_viral(self, df: DataFrame, path: str, **options) -> MultiSink:
        """OP-60: viral posts alone."""
        return self.add_parquet(df.filter(F.col("engagement_tier") == "viral"), path, **options)

    def wait(self) -> None:
        """Until every query has ended, as those started with ``once`` do."""
        for query in self.queries:
            query.awaitTermination()

    def stop_all(self) -> None:
        for query in self.queries:
            query.stop()


def fan_out(df: DataFrame, paths: dict[str, str], checkpoint: str) -> StreamingQuery:
    """OP-59 with one read of the source: ``paths`` maps a SQL condition to the Parquet table its rows go to.

    A batch has a partition of its own (``batch_id``), which a retry replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for condition, path in paths.items():
            batch.filter(condition).write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
