"""Structured Streaming: ingest with checks and idempotence, alerts, windows, and call pairing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from tracequill.operators import folds
from tracequill.operators.rules import alert_bodies
from tracequill.sources.audit_log import ENVELOPE, VIOLATION
from tracequill.sources.ingest import validated

#: The column that holds a line that isn't a JSON object of the schema.
RAW = "_malformed"


def events(spark: SparkSession, folder: str, schema: StructType = ENVELOPE, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of JSON event files; a line that isn't JSON arrives as nulls with the line itself in RAW, and fails the checks."""
    whole = StructType([*schema.fields, StructField(RAW, StringType())])
    return spark.readStream.schema(whole).option("maxFilesPerTrigger", files_per_trigger).option("columnNameOfCorruptRecord", RAW).json(folder)


#: Directories into which a batch's events are dealt by the hashes of their ids.
BUCKETS = 64


def _bucket(ids: str = "event_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, store: str, schema: StructType, number: int, buckets: list[int]) -> DataFrame:
    """Ids in these buckets of the store, from other batches; empty where nothing was stored yet. Other buckets' files aren't opened, and of files only the ids are read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).select("event_id")
    found = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType()), StructField("bucket", IntegerType())])).parquet(store)
    return found.where(F.col("bucket").isin(buckets) & (F.col("batch") != str(number))).select("event_id")


def ingest(stream: DataFrame, store: str, quarantine: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Appends good events to the store, one of each id whenever it comes, and every bad line to the quarantine.

    An event is new if the store lacks its id, however late it is or however often it was sent; a batch's ids are compared with those buckets of the store that they fall into. The number of
    buckets is the store's and stays. The checkpoint stands for the consumer group.
    """
    schema = StructType([f for f in stream.schema.fields if f.name != RAW])

    def put(batch: DataFrame, number: int) -> None:
        # the batch number is part of the path and the write replaces it, so a batch that is run again changes nothing
        checked = validated(batch).withColumn("bucket", _bucket(buckets=buckets)).persist()
        good = checked.where("reason IS NULL").select(*schema.names, "bucket").dropDuplicates(["event_id"])
        touched = [r[0] for r in checked.where("reason IS NULL").select("bucket").distinct().collect()]  # at most `buckets` numbers
        good = good.join(stored(batch.sparkSession, store, schema, number, touched), "event_id", "left_anti").select(*schema.names, "bucket")
        good.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        checked.where("reason IS NOT NULL").drop("bucket").write.mode("overwrite").json(f"{quarantine}/batch={number}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alerts(stream: DataFrame, store: str, outbox: str, checkpoint: str, secret: str | None = None, least: str = "MEDIUM") -> StreamingQuery:
    """Appends violations to the store and the bodies of their alerts, by channel, to the outbox; nothing is sent. stream: VIOLATION rows."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.where("rule_name IS NOT NULL AND session_id IS NOT NULL").persist()
        rows.select(*VIOLATION.names).write.mode("overwrite").parquet(f"{store}/batch={number}")
        alert_bodies(rows, secret, least).write.mode("overwrite").parquet(f"{outbox}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type by tumbling window; a window is emitted when the watermark has passed it."""
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    rows = stream.withColumn("event_time", at).withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", width), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


def paired_calls(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Tool calls with their results, by session and call id; state is kept for the interval only."""
    a = starts.select("session_id", "tool_call_id", F.col("event_time").alias("start_time")).withWatermark("start_time", within)
    b = ends.select(F.col("session_id").alias("s2"), F.col("tool_call_id").alias("t2"), F.col("event_time").alias("end_time")).withWatermark("end_time", within)
    return a.join(b, F.expr(f"session_id = s2 AND tool_call_id = t2 AND end_time >= start_time AND end_time <= start_time + interval {within}")).select("session_id", "tool_call_id", "start_time", "end_time")


class _Kept(StatefulProcessor):
    """Keeps a key's few times as list state, and forgets them by a timer once the watermark has passed all that they could count for."""

    def __init__(self, step: Callable[[tuple, list[int], int], tuple[list[int], bool]], span: int, id_column: str, name: str) -> None:
        self.step, self.span, self.id_column, self.name = step, span, id_column, name

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["timestamp_ns", self.id_column], ignore_index=True)
        kept, verdicts = [int(t[0]) for t in self.times.get()] if self.times.exists() else [], []
        for at in batch["timestamp_ns"]:
            kept, verdict = self.step(key, kept, int(at))
            verdicts.append(verdict)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.times.clear()
        if kept:
            self.times.put([(t,) for t in kept])
            self.handle.registerTimer((kept[-1] + self.span) // 1_000_000 + 1)
        yield batch.assign(**{self.name: verdicts})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def _with_state(stream: DataFrame, keys: list[str], step, span: int, id_column: str, name: str, late: str) -> DataFrame:
    """The stream's rows with the verdict of a step over each key's times. Rows of a batch are taken in order, rows later than the watermark are dropped. Lists and timers need the state store set here."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.where("timestamp_ns IS NOT NULL").withColumn("event_time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("event_time", late)
    schema = StructType([*rows.schema.fields, StructField(name, BooleanType())])
    return rows.groupBy(*keys).transformWithStateInPandas(_Kept(step, span, id_column, name), schema, "Append", "EventTime").drop("event_time")


def throttled_alerts(stream: DataFrame, cooldown_s: int = 600, late: str = "1 hour") -> DataFrame:
    """Alerts of a stream of violations that are sent, as folds.alert_throttle finds them in a batch."""
    span = cooldown_s * folds.SECOND
    rows = stream.select("rule_name", "session_id", "event_id", "timestamp_ns", "action")
    return _with_state(rows, ["rule_name", "session_id"], lambda _, kept, at: folds.throttled(kept, at, span), span, "event_id", "sent", late).where("sent").drop("sent")


def limited_requests(stream: DataFrame, keys: list[str], limits: dict[str, int] | int, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Requests of a stream with `admitted`, as folds.admissions finds them in a batch: state is the times of admitted requests within the seconds."""
    span = seconds * folds.SECOND

    def step(key: tuple, kept: list[int], at: int) -> tuple[list[int], bool]:
        limit = limits if isinstance(limits, int) else limits.get(key[-1])
        return (kept, True) if limit is None else folds.admitted(kept, at, limit, span)

    return _with_state(stream, keys, step, span, "request_id", "admitted", late)
