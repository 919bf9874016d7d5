"""Requests as a stream: micro-batches by size or waiting time, a bounded intake, and counters without a second pass."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gather(StatefulProcessor):
    """Of each key the rows that wait, fewer than ``most``, and how many batches there were.

    Rows leave in batches of ``most``; what is left over leaves when the first
    of it has waited ``wait_ms``.
    """

    def __init__(self, columns: list[str], rest: T.StructType, most: int, wait_ms: int):
        self.columns, self.rest, self.most, self.wait_ms = columns, rest, most, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rest)
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def numbered(self, key, rows: list[tuple], ended: str) -> pd.DataFrame:
        first = self.count.get()[0] if self.count.exists() else 0
        self.count.update((first + -(-len(rows) // self.most),))
        out = pd.DataFrame(rows, columns=self.columns, dtype=object)
        out.insert(0, "lane", key[0])
        out["batch"] = [first + k // self.most for k in range(len(rows))]
        out["place"] = [k % self.most for k in range(len(rows))]
        out["ended"] = ended
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        before = len(held)
        for part in rows:
            part = part[self.columns].astype(object)
            held += list(part.where(part.notna(), None).itertuples(index=False, name=None))
        full = len(held) // self.most * self.most
        if full:
            yield self.numbered(key, held[:full], "full")
        if not before or full:  # another row is the first of those that wait
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held[full:]:
            self.waiting.put(held[full:])
            if not before or full:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if held:
            yield self.numbered(key, held, "waited")

    def close(self) -> None:
        pass


def micro_batches(stream: DataFrame, lane: str, *, most: int = 6, wait_ms: int = 50) -> DataFrame:
    """Rows with (lane, batch, place, ended): those of a lane in batches of at most ``most``.

    A batch is full, or its first row has waited ``wait_ms`` of processing
    time (or more, as timers are looked at when the stream is triggered).  What
    waits is kept in state, fewer than ``most`` rows a lane, and survives a restart.
    The session must use the RocksDB state store (``ROCKSDB``).
    """
    columns = [c for c in stream.columns if c != lane]
    rest = T.StructType([stream.schema[c] for c in columns])
    out = T.StructType([T.StructField("lane", stream.schema[lane].dataType), *rest.fields, T.StructField("batch", T.LongType()), T.StructField("place", T.LongType()), T.StructField("ended", T.StringType())])
    return stream.groupBy(lane).transformWithStateInPandas(statefulProcessor=Gather(columns, rest, most, wait_ms), outputStructType=out, outputMode="append", timeMode="ProcessingTime")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run_until(stream: DataFrame, out: str, checkpoint: str, rows: int, *, every: str = "100 milliseconds", seconds: float = 600) -> DataFrame:
    """Append a stream to Parquet in ``out`` until so many rows are there; timers need triggers beyond the last input."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
    try:
        ends, written = time.time() + seconds, -1
        while time.time() < ends and written < rows:  # with timers a query is never idle, so there is nothing else to wait for
            if query.exception():
                raise query.exception()
            written = spark.read.schema(stream.schema).parquet(out).count() if exists(spark, f"{out}/_spark_metadata") else 0
            if written < rows:
                time.sleep(0.2)
        if written < rows:
            raise TimeoutError(f"{written} of {rows} rows after {seconds} s")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def drained(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Work off what a file stream has, as many files at a time as its ``maxFilesPerTrigger`` lets in.

    The next files are read when a batch is written, so a slow ``work`` holds the
    intake back.  A batch is written to the folder of its number, in place of what a run
    that was killed left there, and its files are fixed in the checkpoint before it
    starts; so each row is in ``out`` once however often the run is started again.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Counters(StreamingQueryListener):
    """Sums of what ``observed`` counts, batch by batch, as a stream goes on.

    ``with Counters(spark, name) as c: ...`` and then ``c.totals``: on leaving, events of
    queries that ended inside are waited for.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.batches: dict[tuple, dict] = {}
        self.running: set = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.changed:
            self.running.add(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:  # a batch that is run again counts once
            with self.changed:
                self.batches[event.progress.id, event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            self.running.discard(event.runId)
            self.changed.notify_all()

    def __enter__(self) -> Counters:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        with self.changed:
            self.changed.wait_for(lambda: not self.running, timeout=60)
        self.spark.streams.removeListener(self)

    @property
    def totals(self) -> dict:
        out: dict = {}
        for counts in self.batches.values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def observed(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """The rows as they are; the aggregates ``counts`` of those that pass go to the query's progress under ``name``."""
    return df.observe(name, *(c.alias(k) for k, c in counts.items()))


def table_stream(spark: SparkSession, folder: str, table: str, *, files: int = 1) -> DataFrame:
    """A table's Parquet file, or the files of its folder, as a stream that takes in so many files at a time."""
    path = f"{folder}/{table}.parquet"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def batched_events(spark: SparkSession, folder: str, shared: str) -> DataFrame:
    """events as requests of eight lanes, in micro-batches."""
    run = f"{shared}/requests-{uuid.uuid4().hex}"
    events = table_stream(spark, folder, "events").select((F.col("user_id") % 8).alias("lane"), "event_id")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        return run_until(micro_batches(events, "lane"), f"{run}/out", f"{run}/checkpoint", spark.read.parquet(f"{folder}/events.parquet").count())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def counted_events(spark: SparkSession, folder: str, shared: str) -> DataFrame:
    """(event_type, n, all_n, odd_n): events worked off file by file, with the stream's own counters in every row."""
    run = f"{shared}/drained-{uuid.uuid4().hex}"
    events = table_stream(spark, folder, "events").select("event_id", "event_type", "user_id")
    counted = observed(events, "intake", all_n=F.count(F.lit(1)), odd_n=F.count_if(F.col("user_id") % 2 == 1))
    with Counters(spark, "intake") as counters:
        drained(counted, lambda batch: batch.select("event_id", "event_type"), f"{run}/out", f"{run}/checkpoint")
    rows = spark.read.parquet(f"{run}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns({k: F.lit(v).cast("long") for k, v in counters.totals.items()})
