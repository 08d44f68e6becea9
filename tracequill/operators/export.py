"""Export formats for log stores: one text per row, ready for a text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.operators.metrics import scoped
from tracequill.sources import outbox
from tracequill.sources.audit_log import typed


def iso_time(ns: Column) -> Column:
    """UTC time with microseconds if there are any; null for 0."""
    at = F.timestamp_micros(((ns - F.pmod(ns, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long"))
    whole = ns % 1_000_000_000 < 1000
    return F.when(ns > 0, F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")))


def normalised(events: DataFrame, org: str | None = None, from_ns: int | None = None, to_ns: int | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Envelope, payload and security fields at the top level; a bound of 0 is no bound."""
    e = scoped(events, org)
    if from_ns:
        e = e.where(F.col("timestamp_ns") >= from_ns)
    if to_ns:
        e = e.where(F.col("timestamp_ns") <= to_ns)
    if kinds:
        e = e.where(F.col("event_type").isin(*kinds))
    p = lambda n: F.col(f"p.{n}").alias(n)
    security = lambda n: F.col(f"p.security.{n}")
    no = lambda c: F.coalesce(c, F.lit(False))
    return typed(e).select(
        "event_id", "schema_version", "org_id", "session_id", "agent_id", "run_id", "parent_run_id", "event_type", "provider", "model", "interception_layer", "timestamp_ns", iso_time(F.col("timestamp_ns")).alias("timestamp_iso"), "sequence_number", "previous_hash", "current_hash", F.array_join("pii_detected", ",").alias("pii_detected"),
        *map(p, ("latency_ms", "total_tokens", "prompt_tokens", "completion_tokens", "finish_reason", "http_status", "tool_name", "tool_call_id", "error_message", "error_code", "total_llm_calls", "total_tool_calls", "session_duration_ms")),
        security("injection_score").alias("security_injection_score"), security("injection_label").alias("security_injection_label"), *[no(security(f"{n}_detected")).alias(f"security_{n}_detected") for n in ("credential", "rce", "ssrf")],
        no(security("crescendo.detected")).alias("security_crescendo_detected"), security("crescendo.drift_score").alias("security_crescendo_drift"), no(security("output.detected")).alias("security_output_detected"),
    )


def ndjson(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


#: Rows that a hash part of an export holds on average.
PART_ROWS = 100_000


def _batched(rows: DataFrame, size: int, part_rows: int = PART_ROWS) -> DataFrame:
    """part and batch: batches of at most `size` rows within hash parts, whose number grows with the rows, so that no order over all rows is needed."""
    parts = -(-max(1, rows.count()) // part_rows)  # one number
    part = F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int")
    w = Window.partitionBy("part").orderBy("timestamp_ns", "event_id")
    return rows.withColumn("part", part).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def splunk_line(rows: DataFrame, index: str) -> Column:
    """The event-collector envelope of a row."""
    return F.to_json(F.struct((F.col("timestamp_ns") / 1e9).alias("time"), F.lit("tracequill").alias("source"), F.lit("agent:audit").alias("sourcetype"), F.lit(index).alias("index"), F.struct(*rows.columns).alias("event")))


def elastic_line(rows: DataFrame, index: str) -> Column:
    """The action line and the document line of a row, each with its newline."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("event_id").alias("_id")).alias("index")))
    return F.concat(action, F.lit("\n"), F.to_json(F.struct(*rows.columns)), F.lit("\n"))


#: What makes a store's line of a row, and what stands between the lines of a body.
STORES = {"splunk": (splunk_line, "\n"), "elastic": (elastic_line, "")}


def deliver(rows: DataFrame, path: str, store: str = "splunk", index: str = "agents", size: int = 500, dry_run: bool = True, mode: str = "append") -> None:
    """Writes the bodies that a store takes to a folder (sources/outbox.py), each event once; by default only their counts. Rows stay in their tasks: nothing is shuffled."""
    line, separator = STORES[store]
    outbox.register(rows.sparkSession)
    rows.select(line(rows, index).alias("line")).write.format(outbox.NAME).option("path", path).option("size", size).option("separator", separator).option("dry_run", str(dry_run).lower()).mode(mode).save()


def splunk(rows: DataFrame, index: str = "agents", size: int = 500, part_rows: int = PART_ROWS) -> DataFrame:
    """Event-collector envelopes, joined by line in batches."""
    out = _batched(rows, size, part_rows).withColumn("line", splunk_line(rows, index))
    return out.groupBy("part", "batch").agg(F.count("*").alias("events"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp_ns", "event_id", "line"))), lambda x: x["line"]), "\n").alias("body"))


def elastic(rows: DataFrame, index: str = "agents", size: int = 500, part_rows: int = PART_ROWS) -> DataFrame:
    """Bulk bodies: an action line and a document line for each event, and a newline at the end."""
    out = _batched(rows, size, part_rows).withColumn("line", elastic_line(rows, index))
    return out.groupBy("part", "batch").agg(F.count("*").alias("events"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp_ns", "event_id", "line"))), lambda x: x["line"]), "").alias("body"))
