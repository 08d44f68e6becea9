"""Compliance reports, the audit report, the forensic timeline, and the scanner benchmark."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequill.operators import chain
from tracequill.operators.metrics import cents, is_, scoped
from tracequill.sources.audit_log import typed

#: Kinds of personal data that point to health data; controls by framework with their kind of evidence.
PHI = ("PERSON", "DATE_OF_BIRTH", "MEDICAL_LICENSE", "US_SSN", "PHONE_NUMBER")
CONTROLS = (
    ("owasp_asi_2026", "ASI-1", "injection"), ("owasp_asi_2026", "ASI-2", "tool_abuse"), ("owasp_asi_2026", "ASI-3", "output_safety"), ("owasp_asi_2026", "ASI-4", "pii"),
    ("eu_ai_act", "Art.9", "injection"), ("eu_ai_act", "Art.12", "record_keeping"), ("eu_ai_act", "Art.13", "transparency"), ("eu_ai_act", "Art.15", "robustness"),
    ("hipaa", "(a)(2)(i)", "identity"), ("hipaa", "(b)", "record_keeping"), ("hipaa", "(c)(1)", "chain_integrity"), ("hipaa", "(e)(1)", "pii"),
    ("soc2", "CC6.1", "injection"), ("soc2", "CC6.7", "pii"), ("soc2", "CC7.2", "anomalies"), ("soc2", "CC7.3", "violations"),
    ("gdpr", "Art.5(1)(f)", "chain_integrity"), ("gdpr", "Art.25", "pii"), ("gdpr", "Art.30", "record_keeping"), ("gdpr", "Art.32", "injection"),
)


#: Parts of rule names that tell what a rule is about.
KEYWORDS = {"injection": ("injection", "prompt", "crescendo", "delimiter"), "tool": ("tool", "rce", "ssrf", "schema"), "output": ("output", "canary", "relay"), "credential": ("credential", "pii", "secret", "token")}


def about(rule: Column, kind: str) -> Column:
    """Whether a rule's name holds a keyword of the kind."""
    return F.regexp_like(F.lower(rule), F.lit("|".join(KEYWORDS[kind])))


def _joined(values: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(values)), ",")


def _kinds() -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pii_detected")))), ",")


def _valid_chains(events: DataFrame, org: str | None) -> DataFrame:
    return chain.first_failures(chain.links(events, org)).select("session_id", F.col("valid").alias("chain_valid"))


def _first(rows: Column, n: int, field: str) -> Column:
    """A field of the first n of (sequence_number, ...) structs, in order; nulls are left out before."""
    return F.slice(F.transform(F.array_sort(F.filter(rows, lambda x: x[field].isNotNull())), lambda x: x[field]), 1, n)


def compliance_eu(events: DataFrame, org: str | None = None) -> DataFrame:
    """Record-keeping by session: usage period, tools, models and providers used, inputs, kinds of personal data, and the first three outputs (200 characters each)."""
    outputs = F.collect_list(F.when(is_("AGENT_FINISH"), F.struct("sequence_number", F.substring(F.coalesce(F.get_json_object("payload", "$.final_output"), F.lit("")), 1, 200).alias("said"))))
    e = typed(scoped(events, org)).groupBy("session_id").agg(
        F.count("*").alias("events"), F.min("timestamp_ns").alias("from_ns"), F.max("timestamp_ns").alias("to_ns"), ((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e6).alias("duration_ms"), _joined(F.when(is_("TOOL_CALL_START"), F.col("tool_name"))).alias("tools"), F.count_if(is_("TOOL_CALL_START")).alias("tool_calls"),
        F.count_if(is_("LLM_CALL_START")).alias("inputs"), F.count_if(is_("LLM_CALL_END")).alias("outputs"), _kinds().alias("pii_types"), _joined(F.coalesce("model", F.lit("unknown"))).alias("models"), _joined(F.coalesce("provider", F.lit("unknown"))).alias("providers"), F.count_if(is_("AGENT_FINISH")).alias("finished"), outputs.alias("said"),
    )
    return e.withColumn("final_outputs", F.array_join(_first(F.col("said"), 3, "said"), "|")).drop("said").join(_valid_chains(events, org), "session_id").withColumn("compliant", F.col("chain_valid"))


def compliance_gdpr(events: DataFrame, org: str | None = None) -> DataFrame:
    """Automated decisions by session: the first five answers (200 characters each), a trace of the first twenty decisions, personal data, and whether every event with such data keeps the hash of its payload (true if there is none)."""
    has = F.size("pii_detected") > 0
    answers = F.collect_list(F.when(is_("LLM_CALL_END"), F.struct("sequence_number", F.nullif(F.substring(F.get_json_object("payload", "$.response_text"), 1, 200), F.lit("")).alias("said"))))
    steps = F.collect_list(F.when(F.col("event_type").isin("LLM_CALL_END", "TOOL_CALL_START", "AGENT_FINISH"), F.struct("sequence_number", F.concat_ws(":", F.col("sequence_number").cast("string"), "event_type", "model").alias("step"))))
    e = scoped(events, org).groupBy("session_id").agg(
        _kinds().alias("pii_types"), F.count_if(has).alias("pii_events"), F.coalesce(F.every(F.when(has, F.coalesce(F.col("payload_hash") != "", F.lit(False)))), F.lit(True)).alias("hashes_kept"), F.count_if(is_("AGENT_FINISH")).alias("decisions"), answers.alias("said"), steps.alias("steps")
    )
    e = e.withColumns({"reasoning": F.array_join(_first(F.col("said"), 5, "said"), "|"), "decision_trace": F.array_join(_first(F.col("steps"), 20, "step"), ",")}).drop("said", "steps")
    return e.join(_valid_chains(events, org), "session_id").withColumn("compliant", F.col("chain_valid"))


def compliance_hipaa(events: DataFrame, org: str | None = None) -> DataFrame:
    """Audit controls by session: events with signs of health data, agents, and the first twenty tool calls with personal data."""
    phi = F.arrays_overlap("pii_detected", F.array(*[F.lit(x) for x in PHI]))
    access = is_("TOOL_CALL_START") & (F.size("pii_detected") > 0)
    log = F.collect_list(F.when(access, F.struct("sequence_number", F.concat_ws(":", "timestamp_ns", F.get_json_object("payload", "$.tool_name"), F.array_join("pii_detected", "+")).alias("access"))))
    e = scoped(events, org).groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(phi).alias("phi_events"), F.coalesce(F.bool_or(phi), F.lit(False)).alias("phi_seen"), F.count_if(access).alias("tool_accesses"), _joined(F.col("agent_id")).alias("agent_ids"), log.alias("log"))
    return e.withColumn("access_log", F.array_join(_first(F.col("log"), 20, "access"), ",")).drop("log").join(_valid_chains(events, org), "session_id").withColumn("compliant", F.col("chain_valid"))


def compliance_soc2(events: DataFrame, org: str | None = None) -> DataFrame:
    failed = chain.first_failures(chain.links(events, org)).select("session_id", F.col("valid").alias("chain_valid"))
    e = typed(scoped(events, org)).groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(is_("SYSTEM_ERROR")).alias("errors"), F.coalesce(F.sum("p.token_usage.total"), F.lit(0)).alias("tokens"))
    rate = cents(F.col("errors") / F.greatest("events", F.lit(1)) * 100)
    return e.join(failed, "session_id").select("session_id", "events", "errors", "tokens", rate.alias("error_rate_pct"), "chain_valid", (F.col("chain_valid") & (F.col("errors") == 0)).alias("compliant"))


def violation_counts(violations: DataFrame, org: str | None = None, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """Violations by rule and action, without false positives."""
    return _between(scoped(violations, org), from_ns, to_ns).where("is_false_positive IS NULL OR NOT is_false_positive").groupBy("rule_name", "action").agg(F.count("*").alias("count"))


def top_violations(violations: DataFrame, org: str | None = None, n: int = 200) -> DataFrame:
    """The latest blocks and alerts that aren't false positives: a list of n."""
    v = scoped(violations, org).where("action IN ('BLOCK', 'ALERT') AND (is_false_positive IS NULL OR NOT is_false_positive)")
    return v.orderBy(F.desc("timestamp_ns"), "event_id").limit(n).select("event_id", "rule_name", "action", "reason", "event_type", "session_id", "agent_id", "timestamp_ns")


def _between(df: DataFrame, from_ns: int | None, to_ns: int | None) -> DataFrame:
    return df.where(F.col("timestamp_ns").between(from_ns, to_ns)) if from_ns is not None and to_ns is not None else df


def period(first_day: str | None = None, last_day: str | None = None, now_ns: int = 0, session: str | None = None) -> tuple[int, int]:
    """A report's period in nanoseconds from ISO days: the 30 days before now if none is given (for a session, from 2020 on); the last day counts to its end."""
    day = lambda d: int(datetime.fromisoformat(d).replace(tzinfo=timezone.utc).timestamp()) * 10**9
    end = day(last_day) + 86_400 * 10**9 - 1 if last_day else now_ns
    return day(first_day) if first_day else day("2020-01-01") if session else end - 30 * 86_400 * 10**9, end


def detected_between(anomalies: DataFrame, events: DataFrame, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """The anomalies found within a period, with detected_ns: the time of their event, or, for those of a whole session, of its last one. Without both bounds, all of them."""
    last = events.groupBy("session_id").agg(F.max("timestamp_ns").alias("_last"))
    of = events.select("session_id", "sequence_number", F.col("timestamp_ns").alias("_at")).dropDuplicates(["session_id", "sequence_number"])
    rows = anomalies.join(of, ["session_id", "sequence_number"], "left").join(last, "session_id", "left").withColumn("detected_ns", F.coalesce("_at", "_last")).select(*anomalies.columns, "detected_ns")
    return rows.where(F.col("detected_ns").between(from_ns, to_ns)) if from_ns is not None and to_ns is not None else rows


def audit_period(events: DataFrame, anomalies: DataFrame, violations: DataFrame, org: str | None, from_ns: int, to_ns: int) -> DataFrame:
    """audit_summary() of a period, its anomalies those detected in it."""
    return audit_summary(events, detected_between(anomalies, events, from_ns, to_ns), violations, org, from_ns, to_ns)


def audit_summary(events: DataFrame, anomalies: DataFrame, violations: DataFrame, org: str | None = None, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """The one row of measures that the controls are judged by. A rule with blocks and alerts counts in both."""
    e = _between(scoped(events, org), from_ns, to_ns).agg(
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("agent_id").alias("agents"), F.count_if(is_("LLM_CALL_START")).alias("llm_calls"), F.count_if(is_("TOOL_CALL_START")).alias("tool_calls"), F.count_if(is_("SYSTEM_ERROR")).alias("errors"),
        F.count_if(is_("MEMORY_WRITE_BLOCKED")).alias("memory_blocked"), F.count_if(F.size("pii_detected") > 0).alias("pii_events"),
    )
    v = violation_counts(violations, org, from_ns, to_ns)
    hit = lambda k, a: F.coalesce(F.sum(F.when(about(F.col("rule_name"), k) & (F.col("action") == a), F.col("count"))), F.lit(0))
    of = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("count"))), F.lit(0))
    vs = v.agg(of("BLOCK").alias("blocks"), of("ALERT").alias("alerts"), *[hit(k, a).alias(f"{k}_{a.lower()}s") for k in KEYWORDS for a in ("BLOCK", "ALERT")])
    a = scoped(anomalies, org).agg(F.count("*").alias("anomalies"))
    status = chain.org_status(_between(events, from_ns, to_ns), org).agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("chain_sessions"), F.coalesce(F.sum("valid_sessions"), F.lit(0)).alias("chain_valid"))
    return e.crossJoin(F.broadcast(vs)).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(status))  # one row each


def audit_controls(spark: SparkSession, summary: DataFrame) -> DataFrame:
    """Every control with its status and what shows it."""
    controls = spark.createDataFrame(list(CONTROLS), "framework string, control string, evidence string")
    n = lambda c: F.col(c).cast("string")
    said = lambda *parts: F.concat(*[n(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    verdict = lambda status, *parts: F.struct(F.lit(status).alias("status"), said(*parts).alias("shown_by"))
    more = lambda c: F.col(c) > 0
    judged = {
        "injection": F.when(F.col("llm_calls") == 0, verdict("fail", "No LLM calls recorded in this period")).when(more("injection_blocks"), verdict("pass", "$injection_blocks", " injection attempts blocked")).when(more("injection_alerts"), verdict("partial", "$injection_alerts", " injection alerts, no blocks")).otherwise(verdict("pass", "No injection attempts in ", "$llm_calls", " LLM calls")),
        "tool_abuse": F.when(more("tool_blocks"), verdict("pass", "$tool_blocks", " tool abuse attempts blocked")).when(more("tool_alerts"), verdict("partial", "$tool_alerts", " tool alerts, no blocks")).otherwise(verdict("pass", "$tool_calls", " tool calls without abuse")),
        "output_safety": F.when(more("output_blocks"), verdict("pass", "$output_blocks", " unsafe outputs blocked")).when(more("output_alerts"), verdict("partial", "$output_alerts", " output alerts, no blocks")).otherwise(verdict("pass", "No unsafe outputs")),
        "pii": F.when(more("pii_events"), verdict("partial", "$pii_events", " events with personal data; check masking")).otherwise(verdict("pass", "No personal data detected")),
        "record_keeping": F.when(F.col("sessions") == 0, verdict("fail", "No sessions recorded in this period")).otherwise(F.struct(F.lit("pass").alias("status"), F.concat(n("sessions"), F.lit(" sessions, "), (F.col("llm_calls") + F.col("tool_calls")).cast("string"), F.lit(" events recorded")).alias("shown_by"))),
        "transparency": F.when(F.col("llm_calls") == 0, verdict("fail", "No LLM calls recorded")).otherwise(verdict("pass", "All ", "$llm_calls", " LLM calls kept with their metadata")),
        "robustness": F.when(more("anomalies") & (F.col("blocks") == 0), verdict("partial", "$anomalies", " anomalies, no blocks")).when(more("blocks"), verdict("pass", "$blocks", " requests blocked")).otherwise(verdict("pass", "No anomalies in this period")),
        "identity": F.when(F.col("sessions") == 0, verdict("fail", "No sessions with an agent's identity")).otherwise(verdict("pass", "$sessions", " sessions with agent and session ids")),
        "chain_integrity": F.when(F.col("chain_sessions") == 0, verdict("fail", "No events to check")).when(F.col("chain_valid") < F.col("chain_sessions"), F.struct(F.lit("fail").alias("status"), F.concat(F.lit("Links broken in "), (F.col("chain_sessions") - F.col("chain_valid")).cast("string"), F.lit(" of "), n("chain_sessions"), F.lit(" sessions")).alias("shown_by"))).otherwise(verdict("pass", "Links hold in all ", "$chain_sessions", " sessions")),
        "anomalies": F.when(more("anomalies"), verdict("pass", "$anomalies", " anomalies logged for review")).otherwise(verdict("pass", "No anomalies; monitoring active")),
        "violations": F.when(F.col("blocks") + F.col("alerts") > 0, verdict("pass", "$blocks", " blocks and ", "$alerts", " alerts on record")).otherwise(verdict("pass", "No violations in this period")),
    }
    out = verdict("pass", "Control checked")
    for kind, v in judged.items():
        out = F.when(F.col("evidence") == kind, v).otherwise(out)
    return controls.crossJoin(F.broadcast(summary)).withColumn("v", out).select("framework", "control", "evidence", "v.status", "v.shown_by")


def audit_overall(summary: DataFrame) -> DataFrame:
    s = F.when(F.col("sessions") == 0, "fail").when(F.col("chain_valid") < F.col("chain_sessions"), "fail").when((F.col("blocks") > 0) | (F.col("pii_events") > 0), "partial").otherwise("pass")
    return summary.select("sessions", "chain_sessions", "chain_valid", "blocks", "pii_events", s.alias("status"))


#: Labels and levels of event types in a timeline.
LABELS = {"LLM_CALL_START": ("LLM Request", "debug"), "LLM_CALL_END": ("LLM Response", "debug"), "TOOL_CALL_START": ("Tool Invoked", "info"), "TOOL_CALL_END": ("Tool Result", "info"), "AGENT_FINISH": ("Agent Finished", "success"), "SYSTEM_ERROR": ("Error", "error"), "CHECKPOINT": ("Integrity Checkpoint", "debug")}
_DETAILS = "messages array<struct<role:string,content:string>>, tools_available array<struct<name:string>>, temperature double, max_tokens long, response_text string, tool_calls array<struct<name:string>>, finish_reason string, latency_ms double, tool_name string, tool_call_id string, tool_output_masked string, final_output string, http_status string, error_message string, events_covered long, token_usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>"


def last_user(messages: Column) -> Column:
    """The content of the last user message; empty if there is none."""
    said = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], F.lit(""))


def timeline(events: DataFrame, org: str | None = None) -> DataFrame:
    """Every event with its label, level, summary and details (JSON), in the words of its type."""
    k, p = F.col("event_type"), lambda f: F.col("d")[f]
    label, level = k, F.lit("info")
    for kind, (name, how) in LABELS.items():
        label, level = F.when(k == kind, name).otherwise(label), F.when(k == kind, how).otherwise(level)
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    n_of = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    tools = F.when(n_of(p("tools_available")) > 0, F.concat(F.lit(", "), n_of(p("tools_available")).cast("string"), F.lit(" tools available"))).otherwise("")
    said = (
        F.when(k == "LLM_CALL_START", F.concat(F.lit("Request to "), "provider", F.lit(": "), n_of(p("messages")).cast("string"), F.lit(" messages"), tools, F.lit(". Last user: '"), text(last_user(p("messages")), 80), F.lit("...'")))
        .when((k == "LLM_CALL_END") & (n_of(p("tool_calls")) > 0), F.concat(F.lit("Decided to call: "), F.array_join(p("tool_calls")["name"], ", ", "?")))
        .when(k == "LLM_CALL_END", F.concat(F.lit("Response: '"), text(p("response_text"), 100), F.lit("...' (finish: "), F.coalesce(p("finish_reason"), F.lit("None")), F.lit(")")))
        .when(k == "TOOL_CALL_START", F.concat(F.lit("Calling tool: "), F.coalesce(p("tool_name"), F.lit("?"))))
        .when(k == "TOOL_CALL_END", F.concat(F.lit("Tool "), F.coalesce(p("tool_name"), F.lit("?")), F.lit(" returned: '"), text(p("tool_output_masked"), 80), F.lit("...'")))
        .when(k == "AGENT_FINISH", F.concat(F.lit("Agent finished: '"), text(p("final_output"), 120), F.lit("...'")))
        .when(k == "SYSTEM_ERROR", F.concat(F.lit("Error "), F.coalesce(p("http_status"), F.lit("")), F.lit(": "), text(p("error_message"), 100)))
        .when(k == "CHECKPOINT", F.concat(F.lit("Merkle checkpoint: "), F.coalesce(p("events_covered"), F.lit(0)).cast("string"), F.lit(" events verified")))
        .otherwise(k)
    )
    details = (
        F.when(k == "LLM_CALL_START", F.to_json(F.struct(n_of(p("messages")).alias("message_count"), n_of(p("tools_available")).alias("tool_count"), p("temperature").alias("temperature"), p("max_tokens").alias("max_tokens"))))
        .when(k == "LLM_CALL_END", F.to_json(F.struct(p("finish_reason").alias("finish_reason"), p("latency_ms").alias("latency_ms"), p("token_usage")["prompt_tokens"].alias("prompt_tokens"), p("token_usage")["completion_tokens"].alias("completion_tokens"), p("tool_calls")["name"].alias("tool_calls"))))
        .when(k.isin("TOOL_CALL_START", "TOOL_CALL_END"), F.to_json(F.struct(p("tool_name").alias("tool_name"), p("tool_call_id").alias("tool_call_id"))))
        .otherwise(F.col("payload"))
    )
    rows = scoped(events, org).withColumn("d", F.from_json("payload", _DETAILS))
    return rows.select("session_id", "sequence_number", "event_id", "event_type", label.alias("label"), level.alias("severity"), "timestamp_ns", said.alias("summary"), details.alias("details"), F.array_join("pii_detected", ",").alias("pii_detected"), "run_id", "parent_run_id")


def data_access(events: DataFrame, org: str | None = None) -> DataFrame:
    """Tools of each session: calls, first and last use, first input, place by first appearance."""
    e = typed(scoped(events, org).where(is_("TOOL_CALL_START"))).groupBy("session_id", "tool_name").agg(F.count("*").alias("call_count"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.min_by("p.tool_input", "sequence_number").alias("sample_input"), F.min("sequence_number").alias("first_seq"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("first_seq")).cast("long")).drop("first_seq")


def risk_flags(events: DataFrame, org: str | None = None) -> DataFrame:
    """What a reader should look at, the most severe first within a session: a broken chain, errors of providers, personal data in requests and tool results."""
    e = scoped(events, org)
    pii = F.col("event_type").isin("LLM_CALL_START", "TOOL_CALL_END") & (F.size("pii_detected") > 0)
    flag = (
        F.when(is_("SYSTEM_ERROR"), F.struct(F.lit("high").alias("flag"), F.lit("PROVIDER_ERROR").alias("flag_type"), F.concat(F.lit("LLM provider error: "), F.coalesce(F.get_json_object("payload", "$.error_message"), F.lit("unknown"))).alias("description")))
        .when(pii, F.struct(F.lit("medium").alias("flag"), F.lit("PII_DETECTED").alias("flag_type"), F.concat(F.lit("PII detected in "), "event_type", F.lit(": "), F.array_join("pii_detected", ", ")).alias("description")))
    )
    rows = e.select("session_id", "sequence_number", "event_id", flag.alias("f")).where("f IS NOT NULL").select("session_id", "sequence_number", "event_id", "f.*")
    broken = _valid_chains(events, org).where("NOT chain_valid").select("session_id", F.lit(None).cast("long").alias("sequence_number"), F.lit(None).cast("string").alias("event_id"), F.lit("critical").alias("flag"), F.lit("CHAIN_INTEGRITY_VIOLATION").alias("flag_type"), F.lit("Hash chain integrity check failed").alias("description"))
    rank = F.when(F.col("flag") == "critical", 0).when(F.col("flag") == "high", 1).otherwise(2)
    return rows.unionByName(broken).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(rank, "sequence_number")).cast("long"))


def replay(events: DataFrame, anomalies: DataFrame, org: str | None = None) -> DataFrame:
    """The forensic bundle, one row per session: totals, chain check, timeline, data accesses, risk flags and anomalies, lists in order."""
    total = F.coalesce(F.sum(F.when(is_("LLM_CALL_END"), F.get_json_object("payload", "$.token_usage.total_tokens").try_cast("long"))), F.lit(0))
    first = lambda c: F.min_by(c, "sequence_number").alias(c)
    ends = (F.min_by("timestamp_ns", "sequence_number"), F.max_by("timestamp_ns", "sequence_number"))
    e = scoped(events, org).groupBy("session_id").agg(
        first("org_id"), first("agent_id"), first("provider"), first("model"), ends[0].alias("started_at_ns"), ends[1].alias("ended_at_ns"), ((ends[1] - ends[0]) / 1e6).alias("duration_ms"), F.count("*").alias("total_events"),
        F.count_if(is_("LLM_CALL_START")).alias("llm_call_count"), F.count_if(is_("TOOL_CALL_START")).alias("tool_call_count"), F.count_if(is_("SYSTEM_ERROR")).alias("error_count"), F.count_if(F.size("pii_detected") > 0).alias("pii_exposure_count"), total.alias("total_tokens"),
    )
    listed = lambda rows, by, name: rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*by, *[c for c in rows.columns if c not in ("session_id", *by)]))).alias(name))
    checks = chain.first_failures(chain.links(events, org)).select("session_id", F.col("valid").alias("chain_valid"), "failed_at", "failure")
    parts = [
        listed(timeline(events, org), ("sequence_number",), "timeline"), listed(data_access(events, org), ("place",), "data_access_map"), listed(risk_flags(events, org), ("place",), "risk_flags"),
        listed(scoped(anomalies, org).select("session_id", "rule_id", "severity", "measure", "sequence_number"), ("rule_id", "sequence_number"), "anomalies"),
    ]
    out = e.join(checks, "session_id", "left")
    for p in parts:
        out = out.join(p, "session_id", "left")
    return out


def confusion(cases: DataFrame) -> DataFrame:
    """Rates of a scanner over labelled cases: expected (attack or clean), detected, blocked."""
    bad, hit = F.col("expected") == "attack", F.col("detected")
    c = cases.agg(F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0)).cast("decimal(18,9)"), 6).cast("double")
    c = c.withColumns({"tpr": ratio("tp", "fn"), "fpr": ratio("fp", "tn"), "precision": ratio("tp", "fp")})
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    right = (F.col("tp") + F.col("tn")) / F.nullif(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(0))
    six = lambda x: F.round(x.cast("decimal(18,9)"), 6).cast("double")
    return c.withColumns({"f1": six(f1), "accuracy": six(F.coalesce(right, F.lit(0.0)))})


#: Fixed value: the category of attacks that are held out of the headline rates.
HELD_OUT = "paraphrase_attack"


def category_rates(cases: DataFrame) -> DataFrame:
    """Attacks by category, with the shares detected and blocked. cases: category, expected, detected, blocked."""
    four = lambda c: F.round((F.count_if(c) / F.count("*")).cast("decimal(18,9)"), 4).cast("double")
    return cases.where("expected = 'attack'").groupBy("category").agg(F.count("*").alias("total"), F.count_if("detected").alias("detected_cases"), F.count_if("blocked").alias("blocked_cases"), four(F.col("detected")).alias("detection_rate"), four(F.col("blocked")).alias("block_rate"))


def layer_coverage(cases: DataFrame) -> DataFrame:
    """The share of the attacks found to which each layer gave more than 0.1. cases: expected, detected, layers (map of name to score)."""
    found = cases.where("expected = 'attack' AND detected")
    n = found.agg(F.count("*").alias("n"))
    hits = found.select(F.explode("layers").alias("layer", "score")).groupBy("layer").agg(F.count_if(F.col("score") > 0.1).alias("hits"))
    return hits.crossJoin(F.broadcast(n)).select("layer", F.round((F.col("hits") / F.col("n")).cast("decimal(18,9)"), 4).cast("double").alias("coverage"))  # n is one row


def benchmark_report(cases: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """The headline rates without the held-out attacks, with their own rate, the share of attacks that hold a known phrase, and latencies. cases: text, category, expected, detected, latency_ms."""
    six = lambda x: F.round(F.coalesce(x, F.lit(0.0)).cast("decimal(18,9)"), 6).cast("double")
    attack, held = F.col("expected") == "attack", F.col("category") == HELD_OUT
    known = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower("text"), p))
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    extra = cases.agg(F.count_if(attack & held).alias("paraphrase_count"), F.count_if(attack & held & F.col("detected")).alias("paraphrase_detected"), six(share(attack & held & F.col("detected"), attack & held)).alias("paraphrase_tpr"), six(share(attack & known, attack)).alias("contamination"), *[F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY latency_ms)").alias(f"latency_{n}_ms") for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))], six(F.avg("latency_ms")).alias("latency_mean_ms"))
    return confusion(cases.where(~(attack & held))).crossJoin(F.broadcast(extra))  # one row each


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """Interpolated 50th, 95th, and 99th percentiles, and the value at place floor(0.95 n), from 0, of the sorted ones (the last at most)."""
    known = rows.where(F.col(column).isNotNull())
    n = known.count()  # one number
    share = (min(int(n * 0.95), n - 1) + 0.5) / n if n else 0.5
    wanted = [("cont", 0.5, "p50"), ("cont", 0.95, "p95"), ("cont", 0.99, "p99"), ("disc", share, "p95_rank")]
    return known.agg(*[F.expr(f"percentile_{how}({q}) WITHIN GROUP (ORDER BY {column})").alias(name) for how, q, name in wanted], F.count("*").alias("n"))
