"""State machines over streams of status events, messages that work once, and counts of a running stream.

Each runs over all that is new in a folder and goes on from its checkpoint, so a restart neither loses nor repeats anything. Sinks
name their files by batch and replace them, so a batch that runs again leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Machine:
    """Statuses with those that may follow each, the one before the first event, and those that set the time of completion."""

    follow: dict[str, frozenset[str]]
    start: str
    complete: frozenset[str] = field(default_factory=frozenset)

    def step(self, status: str, new: str | None) -> str | None:
        """Why a status can't follow, or None where it may."""
        if new not in self.follow:
            return "unknown status"
        return None if new in self.follow[status] else "not allowed"


def _chain(*names: str, error: str = "ERROR") -> dict[str, frozenset[str]]:
    """Each status is followed by the next one or by an error; after an error the chain begins again."""
    out = {a: frozenset((b, error)) for a, b in zip(names, names[1:], strict=False)}
    return out | {names[-1]: frozenset(), error: frozenset(names[1:2])}


#: The statuses of a case, of a run and of a case's analysis beforehand.
CASE = Machine(_chain("NEW", "EXTRACTING", "TRANSFORMING", "CODIFYING", "REVIEW", "READY", "EXPORTED") | {"CODIFYING": frozenset(("REVIEW", "READY", "ERROR"))}, "NEW", frozenset(("EXPORTED",)))
RUN = Machine({"STARTED": frozenset(("SUCCESS", "FAILED", "ERROR")), "SUCCESS": frozenset(), "FAILED": frozenset(("STARTED",)), "ERROR": frozenset(("STARTED",))}, "STARTED", frozenset(("SUCCESS", "FAILED", "ERROR")))
_ANALYSIS = ("pending", "in_progress", "complete", "incomplete", "requires_info")
ANALYSIS = Machine({s: frozenset(_ANALYSIS) for s in _ANALYSIS}, "pending", frozenset(("complete",)))

OUTPUT = "key string, event_id long, ts timestamp, before string, status string, completed_at timestamp, reason string"


class Transitions(StatefulProcessor):
    """Takes the events of a key in order of (ts, event_id): an allowed one moves the status, sets the time of completion or clears it;
    others leave both and give their reason. An event that is not after the last one of an earlier batch is `repeated` where it is
    that one, else `late`; of equal events of a batch the first one counts."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, completed_at timestamp, ts timestamp, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")  # of one key in one batch
        status, done, last = self.machine.start, None, None
        if self.state.exists():
            status, done, ts, event = self.state.get()
            last = (pd.Timestamp(ts), event)
        out = []
        for ts, event, new in zip(events["ts"], events["event_id"], events["status"], strict=True):
            before, at = status, (ts, event)
            if last is not None and at <= last:
                reason = "repeated" if at == last else "late"
            else:
                reason, last = self.machine.step(status, new), at
                if reason is None:
                    status, done = new, ts if new in self.machine.complete else None
            out.append((str(key[0]), event, ts, before, new, done, reason))
        self.state.update((status, None if done is None else pd.Timestamp(done).to_pydatetime(), last[0].to_pydatetime(), int(last[1])))
        frame = pd.DataFrame(out, columns=["key", "event_id", "ts", "before", "status", "completed_at", "reason"])
        frame["completed_at"] = pd.to_datetime(frame["completed_at"])
        yield frame

    def close(self) -> None:
        pass


def _reader(spark: SparkSession, source: str, schema: StructType, files: int):
    there = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile():  # a stream reads folders
        reader, source = reader.option("pathGlobFilter", there.getName()), there.getParent().toString()
    return reader.parquet(source)


def _by_batch(df: DataFrame, number: int, path: str) -> None:
    df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame([], schema).schema
    return spark.read.schema(known).parquet(path).select(*known.names)


def transitions(spark: SparkSession, source: str, schema: StructType, folder: str, machine: Machine, events: Callable[[DataFrame], DataFrame], files: int = 64) -> tuple[DataFrame, DataFrame]:
    """Runs a machine over the new events of a folder; returns all accepted and all rejected events so far. `events` turns the source into
    (key string, event_id long, ts timestamp, status string); rows without a key, an id or a time are rejected. A batch
    takes `files` files, which bounds what a key has in it."""
    rows = events(_reader(spark, source, schema, files))
    whole = F.col("key").isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull()
    accepted, rejected = f"{folder}/accepted", f"{folder}/rejected"

    def emit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            _by_batch(batch.where("reason is null").drop("reason"), number, accepted)
            _by_batch(batch.where("reason is not null"), number, rejected)
        finally:
            batch.unpersist()

    def broken(batch: DataFrame, number: int) -> None:
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        bad = batch.where(~whole).select("key", "event_id", "ts", none("before", "string"), "status", none("completed_at", "timestamp"), F.lit("no key, id or time").alias("reason"))
        _by_batch(bad, number, f"{folder}/broken")

    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        moved = rows.where(whole).groupBy("key").transformWithStateInPandas(Transitions(machine), OUTPUT, "update", "none")
        for df, put, name in ((moved, emit, "moved"), (rows, broken, "broken")):
            df.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)
    schema_of = OUTPUT.replace(", reason string", "")
    return _stored(spark, accepted, schema_of), _stored(spark, rejected, OUTPUT).unionByName(_stored(spark, f"{folder}/broken", OUTPUT))


def current(accepted: DataFrame) -> DataFrame:
    """key, status, completed_at, updated_at: where each key is now."""
    last = F.max_by(F.struct("status", "completed_at", "ts"), F.struct("ts", "event_id")).alias("s")
    return accepted.groupBy("key").agg(last).select("key", "s.status", "s.completed_at", F.col("s.ts").alias("updated_at"))


# ---- messages that work once --------------------------------------------------------------------


def idempotency_key(kind: Column, key: Column, time: Column) -> Column:
    """A message's own key, else one of its kind and time."""
    return F.coalesce(key.cast("string"), F.concat(kind, F.lit("_"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def once(spark: SparkSession, source: str, schema: StructType, folder: str, key: Column, time: str, delay: str, work: Callable[[DataFrame], DataFrame], files: int = 64) -> DataFrame:
    """Work on each idempotency key once, over the new messages of a folder; returns all output so far. A key that comes again within
    `delay` of its first message's time does nothing, in the same batch or a later one. A message that is older than the
    latest time seen so far by more than delay is late and does nothing, as its key may have been forgotten."""
    rows = _reader(spark, source, schema, files).withColumn("idempotency_key", key).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    fresh = work(rows.dropDuplicatesWithinWatermark(["idempotency_key"]))
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        put = lambda batch, number: _by_batch(batch, number, f"{folder}/done")
        fresh.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)
    return _stored(spark, f"{folder}/done", fresh.schema)


# ---- counts of a running stream -----------------------------------------------------------------

COUNTS = "stage string, batch long, total long, queued long, errors long"


class Counts(StreamingQueryListener):
    """Keeps the counts that each batch of an observed stage reports."""

    def __init__(self):
        self.seen: dict[tuple[str, int], tuple] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for stage, row in event.progress.observedMetrics.items():
            if row["total"]:  # a batch without rows reports nulls or nothing
                self.seen[stage, event.progress.batchId] = (stage, event.progress.batchId, row["total"], row["queued"] or 0, row["errors"] or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(rows: DataFrame, stage: str, failed: Column) -> DataFrame:
    """The rows, with their number, that of the queued and that of the failed ones observed under the stage's name."""
    return rows.observe(stage, F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(failed, F.lit(False))).alias("queued"), F.count_if(failed).alias("errors"))


def counted(spark: SparkSession, source: str, schema: StructType, folder: str, stage: str, failed: Column, files: int = 1) -> DataFrame:
    """Queues the new messages of a folder, failed ones aside, and returns the counts of every batch so far as a table."""
    rows = observed(_reader(spark, source, schema, files), stage, failed)
    counts = Counts()
    spark.streams.addListener(counts)
    try:
        put = lambda batch, number: _by_batch(batch.withColumn("failed", F.coalesce(failed, F.lit(False))), number, f"{folder}/{stage}")
        rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint-{stage}").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counts)
    if counts.seen:
        spark.createDataFrame(list(counts.seen.values()), COUNTS).coalesce(1).write.mode("append").parquet(f"{folder}/counts")
    return _stored(spark, f"{folder}/counts", COUNTS).dropDuplicates(["stage", "batch"])
