"""Job frames as streams: the batch operators' expressions under event time, watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import folds
from folio.operators import jobs as J
from folio.storage import scratch_path
from folio.streaming.folds import folded

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet files of a folder as a stream, in the schema that they have."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def replay(rows: DataFrame, arrival: str, slices: int, closing: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """A table as a stream of `slices` micro-batches, in order of `arrival` (a number), and closing as one more.

    Each slice covers as long a time as any other and is one file, so a trigger takes one; with a
    folder given, a slice that is there already is not written again.
    """
    spark = rows.sparkSession
    folder = folder or scratch_path(spark, "replay")
    for n, part in enumerate([*sliced(rows, arrival, slices), *([] if closing is None else [closing])]):
        part.repartition(1).write.mode("ignore").parquet(f"{folder}/slice={n:04d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def sliced(rows: DataFrame, arrival: str, slices: int) -> list[DataFrame]:
    """The slices of replay(): by floor((arrival - first) * slices / (last - first + 1))."""
    first, last = rows.agg(F.min(arrival), F.max(arrival)).first()
    if first is None:
        return [rows]
    number = F.floor((F.col(arrival) - first) * slices / F.lit(last - first + 1))
    return [rows.where(number == n) for n in range(slices)]


@contextmanager
def _state_in_rocks_db(spark: SparkSession) -> Iterator[None]:
    """Timers and list state need it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(stream: DataFrame, mode: str = "append", path: str | None = None, keep: list | None = None) -> DataFrame:
    """Run a stream over all that is there, then read its result.

    append goes to a parquet sink with exactly-once file commits; complete writes each epoch to a
    folder of its own, so an epoch that is run again overwrites itself, and the last holds the
    result. An update-mode result would have to be merged by a key, so that mode is refused. With
    the path of an earlier run it goes on from its checkpoint. keep gets the progress reports.
    """
    spark = stream.sparkSession
    if mode not in ("append", "complete"):
        raise ValueError("append or complete mode only")
    path = path or scratch_path(spark, "stream")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode)
    with _state_in_rocks_db(spark):
        if mode == "append":
            query = writer.format("parquet").option("path", f"{path}/data").start()
        else:
            query = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch:09d}")).start()
        query.awaitTermination()
    if keep is not None:
        keep += query.recentProgress
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/data")
    epochs = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return epochs.where(F.col("epoch") == epochs.agg(F.max("epoch")).first()[0]).select(*stream.columns)


def job_state(frames: DataFrame) -> DataFrame:
    """Running state of each job, in update or complete mode."""
    return frames.groupBy("token").agg(*J.job_state_aggregates())


def once_per_key(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row to arrive of each key within the watermark: pages, or records of jobs."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def abandoned(polls: DataFrame, grace: str, delay: str) -> DataFrame:
    """Sessions of polls: a job is abandoned when a session ends, `grace` after its last poll."""
    return polls.withWatermark("ts", delay).groupBy("token", F.session_window("ts", grace).alias("w")).agg(F.count("*").alias("polls"))


def tumbling(rows: DataFrame, width: str, delay: str, *counters: Column) -> DataFrame:
    """Counters by event-time window of `ts`; a row whose window the watermark has closed is dropped."""
    windows = rows.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(*counters)
    return windows.select(F.col("w.start").alias("start"), *[c for c in windows.columns if c != "w"])


def isolated(frames: DataFrame, jobs: DataFrame) -> DataFrame:
    """Frames of known jobs only: a stream joined with a static table."""
    return frames.join(jobs.select("token"), "token", "left_semi")


def admission(requests: DataFrame, hourly: int, window: int, delay: str) -> DataFrame:
    """requests(req_id, ip, at): admitted unless `hourly` admitted starts lie in the window before; times in microseconds."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = f"req_id {kinds['req_id']}, ip {kinds['ip']}, at bigint, admitted boolean"
    return folded(requests, "ip", "at", "req_id", schema, lambda: folds.Hour(hourly, window), delay)


def uploads(parts: DataFrame, most_pages: int, ttl: int, exists: int, delay: str) -> DataFrame:
    """parts(token, part, parts, pages, at): a row when an upload is complete, rejected or dropped, as folds.Uploads tells."""
    return folded(parts, "token", "at", "part", folds.Uploads.schema, lambda: folds.Uploads(most_pages, ttl, exists), delay)


def lifecycle(events: DataFrame, grace: int, keep: int, delay: str) -> DataFrame:
    """events(token, seq, kind, at, done_at): a row when a job is forgotten, as folds.Lifecycle tells."""
    return folded(events, "token", "at", "seq", folds.Lifecycle.schema, lambda: folds.Lifecycle(grace, keep), delay)
