"""The audit log and its side tables, derived from the driver's `events` table.

Each user is a session, users of the same remainder by 12 an agent, by 2 an organisation. The
rules are plain column expressions, so that the same log can be stated in SQL (plans/oracle.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a payload holds, for from_json: parsed once, then plain columns.
PAYLOAD = T.StructType(
    [
        T.StructField("latency_ms", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_input", T.StringType()),
        T.StructField("http_status", T.LongType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("total_llm_calls", T.LongType()),
        T.StructField("total_tool_calls", T.LongType()),
        T.StructField("session_duration_ms", T.DoubleType()),
        T.StructField("token_usage", T.StructType([T.StructField("total", T.LongType())])),
        T.StructField("security", T.StructType([
            T.StructField("injection_score", T.DoubleType()), T.StructField("injection_label", T.StringType()), *(T.StructField(n, T.BooleanType()) for n in ("credential_detected", "rce_detected", "ssrf_detected")),
            T.StructField("crescendo", T.StructType([T.StructField("detected", T.BooleanType()), T.StructField("drift_score", T.DoubleType())])), T.StructField("output", T.StructType([T.StructField("detected", T.BooleanType())])),
        ])),
    ]
)
#: The event envelope; payload and security stay JSON text.
ENVELOPE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("event_id", "schema_version", "org_id", "session_id", "agent_id", "provider", "model", "interception_layer", "run_id", "parent_run_id", "event_type", "payload", "payload_hash")),
        T.StructField("pii_detected", T.ArrayType(T.StringType())),
        T.StructField("security", T.StringType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("previous_hash", T.StringType()),
        T.StructField("current_hash", T.StringType()),
    ]
)
#: Event types that ingest accepts, those of the extended set, and fields that every event has.
EVENT_TYPES = ("LLM_CALL_START", "LLM_CALL_END", "TOOL_CALL_START", "TOOL_CALL_END", "AGENT_FINISH", "SYSTEM_ERROR", "CHECKPOINT", "AGENT_THOUGHT")
EXTENDED_TYPES = (*EVENT_TYPES, "MEMORY_WRITE_BLOCKED", "MEMORY_WRITE_SCANNED")
REQUIRED = ("event_id", "schema_version", "org_id", "session_id", "agent_id", "provider", "model", "interception_layer", "run_id", "event_type", "payload", "timestamp_ns", "sequence_number", "previous_hash")


#: A policy violation as it is sent.
VIOLATION = T.StructType([*(T.StructField(n, T.StringType()) for n in ("event_id", "rule_name", "action", "reason", "event_type", "session_id", "agent_id", "org_id")), T.StructField("timestamp_ns", T.LongType())])
#: Rule names of the violations made from the driver's events.
RULE_NAMES = ("prompt-injection-block", "tool-call-loop-protection", "output-threat-detected", "credential-leak-alert", "system-prompt-mutation", "context-injection-alert", "rce-in-tool-args", "ssrf-private-ip-alert", "canary-leak", "pii-in-llm-request", "markov-anomalous-transition", "high-latency-alert")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, in the envelope's columns plus k, the number that most fields come from."""
    raw = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = raw.select("event_id", "user_id", F.col("event_type").alias("kind"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), k.alias("k"))
    rows = rows.withColumn("seq", (F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1).cast("long"))
    user, k = F.col("user_id"), F.col("k")
    session = _text("sess_", user.cast("string"))
    kind = F.when(F.col("kind") == "view", "LLM_CALL_START").when(F.col("kind") == "click", "LLM_CALL_END").when(F.col("kind") == "signup", "TOOL_CALL_START").when(F.col("kind") == "error", "SYSTEM_ERROR").when(k % 10 == 0, "AGENT_FINISH").otherwise("TOOL_CALL_END")
    hundredths = F.lpad((k % 100).cast("string"), 2, "0")
    payload = _text(
        '{"latency_ms":', F.round(F.col("value") * 100).cast("long").cast("string"), ',"total_tokens":', (k * 10).cast("string"), ',"tool_name":"tool_', (k % 3).cast("string"), '","tool_input":"path=/data/', k.cast("string"),
        '","http_status":', F.when(k % 7 == 0, "503").when(k % 7 == 1, "401").otherwise("200"), ',"finish_reason":"', F.when(k % 2 == 0, "stop").otherwise("length"), '","token_usage":{"total":', (k * 7).cast("string"),
        '},"security":{"injection_score":0.', hundredths, ',"credential_detected":', F.when(k % 29 == 0, "true").otherwise("false"), ',"rce_detected":', F.when(k % 31 == 0, "true").otherwise("false"), "}}",
    )
    link = lambda n: F.sha2(_text("link|", user.cast("string"), "|", n.cast("string")), 256)
    return rows.select(
        _text("ev_", F.col("event_id").cast("string")).alias("event_id"),
        F.lit("1.0").alias("schema_version"),
        _text("org_", (user % 2).cast("string")).alias("org_id"),
        session.alias("session_id"),
        _text("agent_", (user % 12).cast("string")).alias("agent_id"),
        F.when(k % 2 == 0, "openai").otherwise("anthropic").alias("provider"),
        F.when(k % 5 == 0, "unknown").when(k % 5 == 1, "").otherwise(_text("model_", (k % 5).cast("string"))).alias("model"),
        F.lit("proxy").alias("interception_layer"),
        _text("run_", user.cast("string"), "_", F.floor(F.col("seq") / 2).cast("string")).alias("run_id"),
        _text("run_", (user + 2).cast("string"), "_", F.floor(F.col("seq") / 2).cast("string")).alias("parent_run_id"),
        kind.alias("event_type"),
        payload.alias("payload"),
        F.when(k % 13 != 0, F.sha2(payload, 256)).alias("payload_hash"),
        F.when((k % 10 == 0) | (k % 10 == 3), F.array(F.lit("US_SSN"))).when(k % 10 == 1, F.array(F.lit("EMAIL_ADDRESS"))).otherwise(F.array().cast("array<string>")).alias("pii_detected"),
        F.lit(None).cast("string").alias("security"),
        (F.col("us") * 1000).alias("timestamp_ns"),
        F.col("seq").alias("sequence_number"),
        F.when(k == 97, "tampered").when(F.col("seq") == 0, _text("GENESIS_", session)).otherwise(link(F.col("seq") - 1)).alias("previous_hash"),
        link(F.col("seq")).alias("current_hash"),
        k.alias("k"),
    )


def typed(events: DataFrame) -> DataFrame:
    """Payload fields as columns: the JSON is parsed once per row."""
    p = F.from_json("payload", PAYLOAD)
    return events.withColumn("p", p).withColumns({"latency_ms": F.col("p.latency_ms"), "total_tokens": F.col("p.total_tokens"), "tool_name": F.col("p.tool_name"), "injection_score": F.col("p.security.injection_score")})


def tokens(mode: str = "literal") -> Column:
    """Tokens of a parsed payload: the flat field, or, coalesced, the nested one where that is missing."""
    return F.col("p.total_tokens") if mode == "literal" else F.coalesce("p.total_tokens", "p.token_usage.total")


def violations(events: DataFrame) -> DataFrame:
    """Policy violations: events whose number is over 80."""
    k = F.col("k")
    return events.where(k > 80).select(
        F.element_at(F.array(*[F.lit(n) for n in RULE_NAMES]), k % 12 + 1).alias("rule_name"), F.when(k > 95, "BLOCK").otherwise("ALERT").alias("action"), F.lit("threshold").alias("reason"), "event_type", "session_id", "agent_id", "org_id", "timestamp_ns", "event_id",
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("is_false_positive"),
    )


def tool_observations(events: DataFrame) -> DataFrame:
    """The log of tool baseline operations: every tool call is an observation, and some numbers approve or deny."""
    k = F.col("k")
    return typed(events).where("event_type = 'TOOL_CALL_START'").select("org_id", "agent_id", "tool_name", "timestamp_ns", "event_id", F.when(k % 17 == 0, "approve").when(k % 23 == 0, "deny").otherwise("observe").alias("op"))
