"""Session, agent, model, and violation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.sources.audit_log import tokens, typed


def is_(kind: str) -> Column:
    return F.col("event_type") == kind


def cents(value: Column) -> Column:
    """Rounded to two places by way of a decimal, so that all engines agree."""
    return F.round(value.cast("decimal(18,4)"), 2).cast("double")


def scoped(df: DataFrame, org: str | None = None, **equal) -> DataFrame:
    """Optional filters: those that are None are left out of the plan."""
    for name, value in {"org_id": org, **equal}.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def measures(mode: str = "literal") -> list[Column]:
    return [
        F.count_if(is_("LLM_CALL_START")).alias("llm_calls"),
        F.count_if(is_("TOOL_CALL_START")).alias("tool_calls"),
        F.count_if(is_("SYSTEM_ERROR")).alias("errors"),
        F.coalesce(F.sum(F.when(is_("LLM_CALL_END"), tokens(mode))), F.lit(0)).alias("total_tokens"),
        cents(F.avg(F.when(is_("LLM_CALL_END"), F.col("latency_ms")))).alias("avg_latency_ms"),
        F.count_if(F.size("pii_detected") > 0).alias("pii_events"),
    ]


def session_summary(events: DataFrame, org: str | None = None, session: str | None = None) -> DataFrame:
    return (
        typed(scoped(events, org, session_id=session))
        .groupBy("session_id", "org_id")
        .agg(
            F.min("agent_id").alias("agent_id"),
            F.min("provider").alias("provider"),
            F.min("model").alias("model"),
            F.min("timestamp_ns").alias("first_ns"),
            F.max("timestamp_ns").alias("last_ns"),
            F.count("*").alias("event_count"),
            F.count_if(is_("LLM_CALL_START")).alias("llm_call_count"),
            F.count_if(is_("TOOL_CALL_START")).alias("tool_call_count"),
            F.sum(F.when(is_("LLM_CALL_END"), F.col("total_tokens"))).alias("total_tokens"),
            F.bool_and(F.col("current_hash").isNotNull()).alias("chain_complete"),
            F.bool_or(is_("SYSTEM_ERROR")).alias("has_errors"),
        )
    )


def list_sessions(events: DataFrame, org: str | None = None, agent: str | None = None, provider: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of sessions, the latest first."""
    s = session_summary(scoped(events, agent_id=agent, provider=provider), org)
    s = s.withColumns({"total_tokens": F.coalesce("total_tokens", F.lit(0)), "first_us": F.expr("first_ns div 1000"), "last_us": F.expr("last_ns div 1000")}).drop("first_ns", "last_ns")
    return s.orderBy(F.desc("last_us"), "session_id").offset(offset).limit(limit)


def overview(events: DataFrame, anomalies: DataFrame, violations: DataFrame, org: str | None = None) -> DataFrame:
    """One row: three aggregates of one row each, side by side."""
    e = typed(scoped(events, org)).agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("agent_id").alias("agents"), *measures(), F.count_if(is_("MEMORY_WRITE_BLOCKED")).alias("memory_blocked"))
    a = scoped(anomalies, org).agg(F.count("*").alias("anomalies"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe_anomalies"))
    v = scoped(violations, org).agg(F.count("*").alias("violations"), F.count_if(F.col("action") == "BLOCK").alias("blocks"), F.count_if(F.col("action") == "ALERT").alias("alerts"))
    return e.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(v))


def agents(events: DataFrame, anomalies: DataFrame, org: str | None = None) -> DataFrame:
    """Metrics of each agent; anomalies are counted before the join."""
    counts = scoped(anomalies, org).groupBy("agent_id").agg(F.count("*").alias("n"))
    e = typed(scoped(events, org)).groupBy("agent_id").agg(
        F.countDistinct("session_id").alias("sessions"), *measures(), F.coalesce(F.max("injection_score"), F.lit(0.0)).alias("max_injection"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns")
    )
    return e.join(counts, "agent_id", "left").withColumn("anomaly_count", F.coalesce("n", F.lit(0))).drop("n")


def valid_model() -> Column:
    return F.col("model").isNotNull() & ~F.col("model").isin("", "unknown")


def models(events: DataFrame, org: str | None = None) -> DataFrame:
    llm, tool, errors, tok, lat, _ = measures()
    return typed(scoped(events, org)).where(valid_model()).groupBy("model").agg(F.min("provider").alias("provider"), F.countDistinct("session_id").alias("sessions"), llm, errors, tok, lat, F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def violations_summary(violations: DataFrame, org: str | None = None) -> DataFrame:
    return scoped(violations, org).groupBy("rule_name", "action").agg(F.count("*").alias("count"), F.max("timestamp_ns").alias("last_ns"))


def violations_list(violations: DataFrame, org: str | None = None, action: str | None = None, rule: str | None = None, from_ns: int | None = None, to_ns: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = scoped(violations, org, action=action, rule_name=rule)
    if from_ns:
        rows = rows.where(F.col("timestamp_ns") >= from_ns)
    if to_ns:
        rows = rows.where(F.col("timestamp_ns") <= to_ns)
    return rows.orderBy(F.desc("timestamp_ns"), "event_id").offset(offset).limit(limit).select("event_id", "rule_name", "action", "session_id", "agent_id", "timestamp_ns")


def violation_buckets(violations: DataFrame, org: str | None = None, unit: str = "DAY") -> DataFrame:
    """Counts by time bucket and action."""
    at = F.unix_micros(F.date_trunc(unit, F.timestamp_micros(F.expr("timestamp_ns div 1000"))))
    return scoped(violations, org).groupBy(at.alias("bucket_us"), "action").agg(F.count("*").alias("count"))


def observed_tools(events: DataFrame, violations: DataFrame, org: str | None = None, as_of_ns: int = 0, days: int = 30, corrected: bool = False) -> DataFrame:
    """Tools by agent in a trailing window, with the violations of their sessions.

    As the store has it, the join repeats calls for each violation of a session and violations for each call;
    `corrected` counts both before they meet.
    """
    calls = typed(scoped(events, org).where(is_("TOOL_CALL_START") & (F.col("timestamp_ns") > as_of_ns - days * 86_400 * 10**9)))
    by = ["org_id", "agent_id", "session_id"]
    if corrected:
        v = scoped(violations, org).groupBy(*by).agg(F.count("*").alias("v"))
        per = calls.groupBy("tool_name", *by).agg(F.count("*").alias("c"))
        return per.join(v, by, "left").groupBy("agent_id", "tool_name").agg(F.sum("c").alias("call_count"), F.sum(F.coalesce("v", F.lit(0))).alias("violation_count"))
    v = scoped(violations, org).select(*by, F.col("rule_name").alias("v_rule"))
    return calls.join(v, by, "left").groupBy("agent_id", "tool_name").agg(F.count("*").alias("call_count"), F.count("v_rule").alias("violation_count"))


def most_observed_tools(events: DataFrame, violations: DataFrame, org: str | None = None, as_of_ns: int = 0, days: int = 30, top: int = 500) -> DataFrame:
    """The most called tools of agents, named ones only, with when each was seen last: a list of `top`."""
    calls = events.where(F.get_json_object("payload", "$.tool_name").isNotNull())
    last = typed(scoped(calls, org).where(is_("TOOL_CALL_START"))).groupBy("agent_id", "tool_name").agg(F.max("timestamp_ns").alias("last_seen_ns"))
    return observed_tools(calls, violations, org, as_of_ns, days, corrected=True).join(last, ["agent_id", "tool_name"]).orderBy(F.desc("call_count"), "agent_id", "tool_name").limit(top)


def model_counts(events: DataFrame, org: str | None = None, top: int = 20) -> DataFrame:
    return scoped(events, org).where(is_("LLM_CALL_START") & valid_model()).groupBy("model").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "model").limit(top)


def tool_p95(events: DataFrame, org: str | None = None) -> DataFrame:
    """Continuous 95th percentile of tool calls per session."""
    per = scoped(events, org).where(is_("TOOL_CALL_START")).groupBy("session_id").agg(F.count("*").alias("n"))
    return per.agg(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY n)").alias("p95"), F.max("n").alias("most"), F.count("*").alias("sessions"))


def suggestions(events: DataFrame, org: str | None = None) -> DataFrame:
    """Suggested rules: a list of the models in use (disabled) and a cap on tool calls of max(2 p95, p95 + 10), if there are five sessions."""
    p95 = F.col("p95").cast("int")
    cap = tool_p95(events, org).where("sessions >= 5").select(F.lit("suggested-tool-cap").alias("rule_name"), F.greatest(p95 * 2, p95 + 10).cast("string").alias("value"), F.lit(True).alias("enabled"))
    names = model_counts(events, org).agg(F.array_join(F.sort_array(F.collect_list("model")), ",").alias("value")).where("value <> ''")
    return cap.unionByName(names.select(F.lit("suggested-model-allow-list").alias("rule_name"), "value", F.lit(False).alias("enabled")))


def suggestion_report(events: DataFrame, org: str | None = None, as_of_ns: int = 0, days: int = 30, enough: int = 10) -> DataFrame:
    """Suggested rules with the evidence for them, ready to load (JSON), over a trailing window, and on each row how many events it held and whether they are too few.

    id and what goes with it are null on the one row of a window that suggests nothing.
    """
    e = scoped(events, org).where(F.col("timestamp_ns") > as_of_ns - days * 86_400 * 10**9)
    total = e.agg(F.count("*").alias("total_events"), F.lit(days).cast("long").alias("window_days"), (F.count("*") < enough).alias("insufficient_data"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rule = lambda name, kind, fld, op, value, reason, on: F.to_json(F.struct(F.lit(name).alias("name"), F.array(F.lit(kind)).alias("event_types"), F.array(F.struct(F.lit(fld).alias("field"), F.lit(op).alias("op"), value.alias("value"))).alias("conditions"), F.lit("BLOCK").alias("action"), reason.alias("reason"), F.lit(on).alias("enabled")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("less"), "model")))
    m = model_counts(e).agg(listed.alias("m")).where(F.size("m") > 0)
    names, rest = F.col("m.model"), F.size("m") - 3
    top = F.array_join(F.transform(F.slice("m", 1, 3), lambda x: text(x["model"], " (", -x["less"], " calls)")), ", ")
    models = m.select(
        F.lit("model-allowlist").alias("id"), text("Detected: ", top, F.when(rest > 0, text(" +", rest, " more")).otherwise("")).alias("evidence"),
        rule("unapproved-model-block", "LLM_CALL_START", "model", "not_in", names, text("Model outside those in use: ", F.array_join(names, ", ")), False).alias("rule"), F.lit(False).alias("enabled"),
    )
    p95 = F.floor("p95").cast("long")
    cap = F.greatest(p95 * 2, p95 + 10)
    tools = tool_p95(e).where("sessions >= 5").select(
        F.lit("tool-rate-cap").alias("id"), text("p95 = ", p95, " tool calls/session across ", F.col("sessions"), " sessions. Suggested cap: ", cap, ".").alias("evidence"),
        rule("tool-call-loop-protection", "TOOL_CALL_START", "tool_call_count", "gt", cap, text("More than ", cap, " tool calls, by a p95 of ", p95), True).alias("rule"), F.lit(True).alias("enabled"),
    )
    return total.join(models.unionByName(tools), F.lit(True), "left")  # one row, and two at most


def session_features(events: DataFrame, org: str | None = None) -> DataFrame:
    """The five measures of a session that the outlier model reads."""
    e = typed(scoped(events, org)).groupBy("session_id").agg(
        F.count_if(is_("LLM_CALL_START")).alias("llm_call_count"), F.count_if(is_("TOOL_CALL_START")).alias("tools"), F.count_if(is_("SYSTEM_ERROR")).alias("errs"), F.count("*").alias("n"),
        (F.max("timestamp_ns") - F.min("timestamp_ns")).alias("ns"), F.max("injection_score").alias("max_injection_score"),
    )
    return e.select("session_id", "llm_call_count", (F.col("tools") / F.greatest("llm_call_count", F.lit(1))).alias("tool_call_rate"), (F.col("errs") / F.col("n")).alias("error_rate"), (F.col("ns") / 60e9).alias("session_duration_min"), "max_injection_score")


def agent_comparison(agents_: DataFrame, violations: DataFrame, org: str | None = None) -> DataFrame:
    v = scoped(violations, org).groupBy("agent_id").agg(F.count_if(F.col("action") == "BLOCK").alias("b"), F.count_if(F.col("action") == "ALERT").alias("a"))
    return agents_.join(v, "agent_id", "left").select("agent_id", "sessions", "llm_calls", "tool_calls", "errors", F.coalesce("b", F.lit(0)).alias("blocks"), F.coalesce("a", F.lit(0)).alias("alerts"))


def posture(overview_: DataFrame) -> DataFrame:
    """A score of 100 less what blocks, further violations, personal data and a lack of agents cost."""
    b, v, p = F.col("blocks"), F.col("violations"), F.col("pii_events")
    cost = F.least(F.lit(30), b * 5) + F.least(F.lit(15), F.greatest(F.lit(0), F.floor((v - 10) / 5))) + F.least(F.lit(20), p * 3) + F.when(F.col("agents") == 0, 15).otherwise(0)
    return overview_.select(F.greatest(F.lit(0), 100 - cost).cast("long").alias("posture_score"))


def rates(events: DataFrame, minutes: int = 1) -> DataFrame:
    """Events of each type per second, by window."""
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    w = events.groupBy(F.window(at, f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.unix_micros(F.col("w.start")).alias("start_us"), "event_type", (F.col("n") / (60.0 * minutes)).alias("per_second"))


#: Upper bounds of the latency histogram, in milliseconds.
LATENCY_BUCKETS = (50, 100, 250, 500, 1000, 2500, 5000, 10000)


def histogram_quantiles(events: DataFrame, q: float = 0.95, minutes: int = 5) -> DataFrame:
    """A quantile of latency by window from cumulative buckets, with linear interpolation within the bucket."""
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    ends = typed(events).where(is_("LLM_CALL_END")).select(F.window(at, f"{minutes} minutes")["start"].alias("start"), "latency_ms")
    cum = ends.groupBy("start").agg(F.count("*").alias("n"), *[F.count_if(F.col("latency_ms") <= b).alias(f"b{b}") for b in LATENCY_BUCKETS])
    target = F.col("n") * q
    out = F.lit(float(LATENCY_BUCKETS[-1]))
    lows = (0, *LATENCY_BUCKETS[:-1])
    for low, b in reversed(list(zip(lows, LATENCY_BUCKETS, strict=True))):
        before = F.col(f"b{low}") if low else F.lit(0)
        here = F.lit(float(low)) + F.lit(float(b - low)) * (target - before) / F.nullif(F.col(f"b{b}") - before, F.lit(0))
        out = F.when(F.col(f"b{b}") >= target, here).otherwise(out)
    return cum.select(F.unix_micros("start").alias("start_us"), "n", out.alias("quantile_ms"))


def active_sessions(events: DataFrame, as_of_ns: int, ttl_hours: int = 4) -> DataFrame:
    last = events.groupBy("session_id").agg(F.max("timestamp_ns").alias("last"))
    return last.agg(F.count_if((F.col("last") <= as_of_ns) & (F.col("last") > as_of_ns - ttl_hours * 3600 * 10**9)).alias("active_sessions"))


def events_page(events: DataFrame, org: str | None = None, limit: int = 1000, offset: int = 0, kind: str | None = None) -> DataFrame:
    """A page of each session's events; a kind is picked within the page, after paging, so such a page may be short or empty."""
    w = Window.partitionBy("session_id").orderBy("sequence_number")
    page = scoped(events, org).select("session_id", "sequence_number", "event_type", F.row_number().over(w).alias("n")).where(F.col("n").between(offset + 1, offset + limit))
    return scoped(page, event_type=kind).drop("n")


def rule_hours(violations: DataFrame) -> DataFrame:
    """Violations of each rule and action by hour."""
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    w = violations.groupBy("rule_name", "action", F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("increase"))
    return w.select("rule_name", "action", F.unix_micros(F.col("w.start")).alias("hour_us"), "increase")
