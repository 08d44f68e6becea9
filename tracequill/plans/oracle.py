"""The registered queries in SQL, over the driver's tables."""

from __future__ import annotations

LOG = """
base AS (
  SELECT event_id, user_id, event_type AS kind, value, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS seq FROM base
), log0 AS (
  SELECT 'ev_' || event_id AS event_id, '1.0' AS schema_version, 'org_' || (user_id % 2) AS org_id, 'sess_' || user_id AS session_id, 'agent_' || (user_id % 12) AS agent_id,
    CASE WHEN k % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider,
    CASE k % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE 'model_' || (k % 5) END AS model,
    'run_' || user_id || '_' || (seq // 2) AS run_id, 'run_' || (user_id + 2) || '_' || (seq // 2) AS parent_run_id,
    CASE kind WHEN 'view' THEN 'LLM_CALL_START' WHEN 'click' THEN 'LLM_CALL_END' WHEN 'signup' THEN 'TOOL_CALL_START' WHEN 'error' THEN 'SYSTEM_ERROR' ELSE CASE WHEN k % 10 = 0 THEN 'AGENT_FINISH' ELSE 'TOOL_CALL_END' END END AS event_type,
    CAST(round(value * 100) AS BIGINT) AS latency_ms, CAST(k * 10 AS BIGINT) AS total_tokens, CAST(k * 7 AS BIGINT) AS nested_tokens, 'tool_' || (k % 3) AS tool_name, 'path=/data/' || k AS tool_input,
    CAST(CASE k % 7 WHEN 0 THEN 503 WHEN 1 THEN 401 ELSE 200 END AS BIGINT) AS http_status, CASE WHEN k % 2 = 0 THEN 'stop' ELSE 'length' END AS finish_reason,
    CAST('0.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS injection_score, k % 29 = 0 AS credential_detected, k % 31 = 0 AS rce_detected, k % 13 <> 0 AS has_payload_hash,
    CASE WHEN k % 10 = 0 THEN ['US_SSN'] WHEN k % 10 = 1 THEN ['EMAIL_ADDRESS'] WHEN k % 10 = 3 THEN ['US_SSN'] ELSE [] END AS pii_detected,
    us * 1000 AS timestamp_ns, seq AS sequence_number, k,
    CASE WHEN k = 97 THEN 'tampered' WHEN seq = 0 THEN 'GENESIS_sess_' || user_id ELSE sha256('link|' || user_id || '|' || (seq - 1)) END AS previous_hash,
    sha256('link|' || user_id || '|' || seq) AS current_hash
  FROM numbered
), log AS (SELECT * FROM log0), viol AS (
  SELECT ['prompt-injection-block', 'tool-call-loop-protection', 'output-threat-detected', 'credential-leak-alert', 'system-prompt-mutation', 'context-injection-alert', 'rce-in-tool-args', 'ssrf-private-ip-alert', 'canary-leak', 'pii-in-llm-request', 'markov-anomalous-transition', 'high-latency-alert'][k % 12 + 1] AS rule_name, CASE WHEN k > 95 THEN 'BLOCK' ELSE 'ALERT' END AS action, event_type, session_id, agent_id, org_id, timestamp_ns, event_id,
    CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_false_positive
  FROM log WHERE k > 80
)"""
_CENTS = "CAST(round(CAST({} AS DECIMAL(18,4)), 2) AS DOUBLE)"
_SIX = "CAST(round(CAST({} AS DECIMAL(18,9)), 6) AS DOUBLE)"
_LAT = _CENTS.format("avg(latency_ms) FILTER (WHERE event_type = 'LLM_CALL_END')")
_MEASURES = f"""count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm_calls, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tool_calls,
  count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS errors, CAST(coalesce(sum(total_tokens) FILTER (WHERE event_type = 'LLM_CALL_END'), 0) AS BIGINT) AS total_tokens,
  {_LAT} AS avg_latency_ms, count(*) FILTER (WHERE len(pii_detected) > 0) AS pii_events"""
_FLAGS = """anom AS (
  SELECT org_id, agent_id, session_id, 'HIGH_ERROR_RATE' AS rule_id, 'high' AS severity, count(*) AS measure, max(sequence_number) AS sequence_number FROM log WHERE event_type = 'SYSTEM_ERROR' GROUP BY ALL HAVING count(*) >= 3
  UNION ALL SELECT org_id, agent_id, session_id, 'TOOL_CALL_LOOP', 'medium', n, NULL FROM (SELECT org_id, agent_id, session_id, tool_name, count(*) AS n FROM log WHERE event_type = 'TOOL_CALL_START' GROUP BY ALL) WHERE n > 5
  UNION ALL SELECT org_id, agent_id, session_id, 'LONG_LATENCY', 'low', latency_ms, sequence_number FROM log WHERE event_type = 'LLM_CALL_END' AND latency_ms > 30000
  UNION ALL SELECT org_id, agent_id, session_id, 'SENSITIVE_PII_IN_TOOL_OUTPUT', 'high', len(list_intersect(pii_detected, ['US_SSN', 'CREDIT_CARD', 'IBAN_CODE', 'MEDICAL_LICENSE'])), sequence_number FROM log WHERE event_type = 'TOOL_CALL_END' AND list_has_any(pii_detected, ['US_SSN', 'CREDIT_CARD', 'IBAN_CODE', 'MEDICAL_LICENSE'])
  UNION ALL SELECT org_id, agent_id, session_id, 'RUNAWAY_AGENT', 'high', n, NULL FROM (SELECT org_id, agent_id, session_id, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS n, count(*) FILTER (WHERE event_type = 'AGENT_FINISH') AS f FROM log GROUP BY ALL) WHERE n >= 20 AND f = 0
  UNION ALL SELECT org_id, agent_id, session_id, 'MODEL_SWITCH', 'low', n, NULL FROM switched WHERE n > 1
)"""
_SWITCHED = """calls AS (SELECT *, lag(model) OVER (PARTITION BY session_id ORDER BY sequence_number) AS before FROM log WHERE model <> ''),
switched AS (SELECT org_id, agent_id, session_id, count(*) AS n, string_agg(model, '>' ORDER BY sequence_number) AS models FROM calls WHERE before IS NULL OR before <> model GROUP BY ALL)"""
_AGENTS = f"""ag AS (
  SELECT agent_id, count(DISTINCT session_id) AS sessions, {_MEASURES}, coalesce(max(injection_score), 0.0) AS max_injection, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM log WHERE org_id = 'org_0' GROUP BY agent_id
), agents AS (
  SELECT ag.*, coalesce(n, 0) AS anomaly_count FROM ag LEFT JOIN (SELECT agent_id, count(*) AS n FROM anom WHERE org_id = 'org_0' GROUP BY agent_id) USING (agent_id)
), nodes AS (
  SELECT agents.*, coalesce(v, 0) AS violation_count FROM agents LEFT JOIN (SELECT agent_id, count(*) AS v FROM viol WHERE org_id = 'org_0' GROUP BY agent_id) USING (agent_id)
)"""
_EDGES = f"""edges AS (
  SELECT p.agent_id AS source, c.agent_id AS target, count(*) AS call_count, {_CENTS.format('avg(l.latency_ms)')} AS avg_latency_ms, min(c.timestamp_ns) AS first_ns, max(c.timestamp_ns) AS last_ns
  FROM log c JOIN log p ON c.parent_run_id = p.run_id AND c.agent_id <> p.agent_id AND c.org_id = p.org_id
  LEFT JOIN log l ON l.run_id = c.run_id AND l.event_type = 'LLM_CALL_END' AND l.org_id = c.org_id
  WHERE c.event_type = 'LLM_CALL_START' GROUP BY ALL
)"""
_TOOLS = """ops AS (
  SELECT org_id, agent_id, tool_name, timestamp_ns, event_id, CASE WHEN k % 17 = 0 THEN 'approved' WHEN k % 23 = 0 THEN 'denied' END AS op FROM log WHERE event_type = 'TOOL_CALL_START'
), tools AS (
  SELECT org_id, agent_id, tool_name, coalesce(arg_max(op, (timestamp_ns, event_id)) FILTER (WHERE op IS NOT NULL), 'pending') AS status, count(*) AS call_count, min(timestamp_ns) AS first_seen_ns, max(timestamp_ns) AS last_seen_ns FROM ops GROUP BY ALL
)"""
_SESSIONS = """sess AS (
  SELECT session_id, org_id, min(agent_id) AS agent_id, min(provider) AS provider, min(model) AS model, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, count(*) AS event_count,
    count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm_call_count, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tool_call_count,
    CAST(sum(total_tokens) FILTER (WHERE event_type = 'LLM_CALL_END') AS BIGINT) AS total_tokens, bool_and(current_hash IS NOT NULL) AS chain_complete, bool_or(event_type = 'SYSTEM_ERROR') AS has_errors
  FROM log GROUP BY session_id, org_id
)"""
_OVERVIEW = f"""ov AS (
  SELECT * FROM (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT agent_id) AS agents, {_MEASURES}, count(*) FILTER (WHERE event_type = 'MEMORY_WRITE_BLOCKED') AS memory_blocked FROM log WHERE org_id = 'org_0'),
    (SELECT count(*) AS anomalies, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS severe_anomalies FROM anom WHERE org_id = 'org_0'),
    (SELECT count(*) AS violations, count(*) FILTER (WHERE action = 'BLOCK') AS blocks, count(*) FILTER (WHERE action = 'ALERT') AS alerts FROM viol WHERE org_id = 'org_0')
)"""
_LINKS = """links AS (
  SELECT session_id, org_id, sequence_number, previous_hash = coalesce(lag(current_hash) OVER w, 'GENESIS_' || session_id) AS link_ok, coalesce(lag(current_hash) OVER w = previous_hash, true) AS loose_ok
  FROM log WINDOW w AS (PARTITION BY session_id ORDER BY sequence_number)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([LOG.strip(), *parts]) + "\n"


_A = (_SWITCHED, _FLAGS)
_COUNTERS = """counted AS (
  SELECT session_id, sequence_number, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') OVER w AS llm_calls, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') OVER w AS tool_calls, count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') OVER w AS errors,
    CAST(coalesce(sum(total_tokens) FILTER (WHERE event_type = 'LLM_CALL_END') OVER w, 0) AS BIGINT) AS tokens, timestamp_ns - min(timestamp_ns) OVER w AS age_ns
  FROM log WINDOW w AS (PARTITION BY session_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING)
)"""
_FLAG_COLS = "org_id, agent_id, session_id, rule_id, severity, measure, sequence_number"
AS_OF = 1706745600000000000

SQL: dict[str, str] = {
    "session_summary": _with(_SESSIONS) + "SELECT * FROM sess WHERE org_id = 'org_0'",
    "list_sessions": _with(_SESSIONS) + "SELECT session_id, org_id, agent_id, provider, model, event_count, llm_call_count, tool_call_count, coalesce(total_tokens, 0) AS total_tokens, chain_complete, has_errors, first_ns // 1000 AS first_us, last_ns // 1000 AS last_us FROM sess WHERE org_id = 'org_0' ORDER BY last_us DESC, session_id LIMIT 50 OFFSET 5",
    "metrics_overview": _with(*_A, _OVERVIEW) + "SELECT * FROM ov",
    "metrics_agents": _with(*_A, _AGENTS) + "SELECT * FROM agents",
    "metrics_models": _with() + f"SELECT model, min(provider) AS provider, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm_calls, count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS errors, CAST(coalesce(sum(total_tokens) FILTER (WHERE event_type = 'LLM_CALL_END'), 0) AS BIGINT) AS total_tokens, {_LAT} AS avg_latency_ms, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM log WHERE org_id = 'org_0' AND model NOT IN ('', 'unknown') GROUP BY model",
    "violations_summary": _with() + "SELECT rule_name, action, count(*) AS count, max(timestamp_ns) AS last_ns FROM viol WHERE org_id = 'org_0' GROUP BY rule_name, action",
    "violations_list": _with() + "SELECT event_id, rule_name, action, session_id, agent_id, timestamp_ns FROM viol WHERE org_id = 'org_0' AND action = 'BLOCK' ORDER BY timestamp_ns DESC, event_id LIMIT 100",
    "anomalies_list": _with(*_A) + f"SELECT {_FLAG_COLS} FROM anom WHERE severity = 'high'",
    "anomaly_all": _with(*_A) + f"SELECT {_FLAG_COLS} FROM anom",
    "high_error_rate": _with(*_A) + f"SELECT {_FLAG_COLS} FROM anom WHERE rule_id = 'HIGH_ERROR_RATE'",
    "long_latency": _with(*_A) + f"SELECT {_FLAG_COLS} FROM anom WHERE rule_id = 'LONG_LATENCY'",
    "sensitive_pii": _with(*_A) + f"SELECT {_FLAG_COLS} FROM anom WHERE rule_id = 'SENSITIVE_PII_IN_TOOL_OUTPUT'",
    "runaway": _with(*_A) + f"SELECT {_FLAG_COLS} FROM anom WHERE rule_id = 'RUNAWAY_AGENT'",
    "tool_loop": _with() + "SELECT org_id, agent_id, session_id, 'TOOL_CALL_LOOP' AS rule_id, 'medium' AS severity, n AS measure, CAST(NULL AS BIGINT) AS sequence_number, tool_name FROM (SELECT org_id, agent_id, session_id, tool_name, count(*) AS n FROM log WHERE event_type = 'TOOL_CALL_START' GROUP BY ALL) WHERE n > 5",
    "model_switch": _with(_SWITCHED) + "SELECT org_id, agent_id, session_id, 'MODEL_SWITCH' AS rule_id, 'low' AS severity, n AS measure, CAST(NULL AS BIGINT) AS sequence_number, models FROM switched WHERE n > 1",
    "violation_stats_buckets": _with() + "SELECT CAST(timestamp_ns // 86400000000000 * 86400000000 AS BIGINT) AS bucket_us, action, count(*) AS count FROM viol GROUP BY ALL",
    "observed_tools": _with() + f"SELECT c.agent_id, c.tool_name, count(*) AS call_count, count(v.rule_name) AS violation_count FROM log c LEFT JOIN viol v ON v.agent_id = c.agent_id AND v.session_id = c.session_id AND v.org_id = c.org_id WHERE c.event_type = 'TOOL_CALL_START' AND c.timestamp_ns > {AS_OF} - 30 * 86400000000000 GROUP BY c.agent_id, c.tool_name",
    "observed_tools_corrected": _with() + f"SELECT agent_id, tool_name, CAST(sum(c) AS BIGINT) AS call_count, CAST(sum(coalesce(v, 0)) AS BIGINT) AS violation_count FROM (SELECT org_id, agent_id, session_id, tool_name, count(*) AS c FROM log WHERE event_type = 'TOOL_CALL_START' AND timestamp_ns > {AS_OF} - 30 * 86400000000000 GROUP BY ALL) LEFT JOIN (SELECT org_id, agent_id, session_id, count(*) AS v FROM viol GROUP BY ALL) USING (org_id, agent_id, session_id) GROUP BY agent_id, tool_name",
    "policy_model_counts": _with() + "SELECT model, count(*) AS calls FROM log WHERE event_type = 'LLM_CALL_START' AND model NOT IN ('', 'unknown') GROUP BY model ORDER BY calls DESC, model LIMIT 20",
    "policy_tool_p95": _with() + "SELECT quantile_cont(n, 0.95) AS p95, max(n) AS most, count(*) AS sessions FROM (SELECT session_id, count(*) AS n FROM log WHERE event_type = 'TOOL_CALL_START' GROUP BY session_id)",
    "policy_suggestions": _with() + "SELECT 'suggested-tool-cap' AS rule_name, CAST(greatest(2 * CAST(floor(p) AS INTEGER), CAST(floor(p) AS INTEGER) + 10) AS VARCHAR) AS value, true AS enabled FROM (SELECT quantile_cont(n, 0.95) AS p, count(*) AS s FROM (SELECT session_id, count(*) AS n FROM log WHERE event_type = 'TOOL_CALL_START' GROUP BY session_id)) WHERE s >= 5 UNION ALL SELECT 'suggested-model-allow-list', string_agg(DISTINCT model, ',' ORDER BY model), false FROM log WHERE event_type = 'LLM_CALL_START' AND model NOT IN ('', 'unknown')",
    "topology_nodes": _with(*_A, _AGENTS) + "SELECT * FROM nodes",
    "topology_providers_models": _with() + "SELECT agent_id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE model NOT IN ('', 'unknown')), '') AS models FROM log GROUP BY agent_id",
    "topology_edges": _with(_EDGES) + "SELECT * FROM edges",
    "topology_connected": _with(*_A, _AGENTS, _EDGES) + "SELECT * FROM nodes WHERE agent_id IN (SELECT source FROM edges UNION SELECT target FROM edges)",
    "topology_graph": _with(*_A, _AGENTS, _EDGES) + ", r AS (SELECT agent_id, CAST(round(CAST(greatest(0.0, least(1.0, least(0.4, violation_count * CAST(0.05 AS DOUBLE)) + least(0.3, anomaly_count * CAST(0.1 AS DOUBLE)) + CASE WHEN max_injection > 0.4 THEN (max_injection - 0.4) / 0.6 * 0.3 ELSE 0.0 END)) AS DECIMAL(18,9)), 3) AS DOUBLE) AS risk_score FROM nodes), pm AS (SELECT agent_id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE model NOT IN ('', 'unknown')), '') AS models FROM log WHERE org_id = 'org_0' GROUP BY agent_id) SELECT nodes.*, risk_score, CASE WHEN risk_score >= 0.7 THEN 'critical' WHEN risk_score >= 0.4 THEN 'high' WHEN risk_score >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level, providers, models FROM nodes JOIN r USING (agent_id) LEFT JOIN pm USING (agent_id) WHERE agent_id IN (SELECT source FROM edges WHERE source IN (SELECT agent_id FROM ag) UNION SELECT target FROM edges)",
    "observed_tools_top": _with() + f"SELECT agent_id, tool_name, sum(c) AS call_count, CAST(sum(coalesce(v, 0)) AS BIGINT) AS violation_count, max(seen) AS last_seen_ns FROM (SELECT org_id, agent_id, session_id, tool_name, count(*) AS c FROM log WHERE org_id = 'org_0' AND event_type = 'TOOL_CALL_START' AND timestamp_ns > {AS_OF} - 30 * 86400000000000 GROUP BY ALL) LEFT JOIN (SELECT org_id, agent_id, session_id, count(*) AS v FROM viol GROUP BY ALL) USING (org_id, agent_id, session_id) JOIN (SELECT agent_id, tool_name, max(timestamp_ns) AS seen FROM log WHERE org_id = 'org_0' AND event_type = 'TOOL_CALL_START' GROUP BY ALL) USING (agent_id, tool_name) GROUP BY agent_id, tool_name ORDER BY call_count DESC, agent_id, tool_name LIMIT 500",
    "suggestion_report": _with() + f""", e AS (SELECT * FROM log WHERE org_id = 'org_0' AND timestamp_ns > {AS_OF} - 30 * 86400000000000), m AS (SELECT model, count(*) AS calls, row_number() OVER (ORDER BY count(*) DESC, model) AS r FROM e WHERE event_type = 'LLM_CALL_START' AND model NOT IN ('', 'unknown') GROUP BY model), c AS (SELECT CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS p, count(*) AS s FROM (SELECT session_id, count(*) AS n FROM e WHERE event_type = 'TOOL_CALL_START' GROUP BY session_id)), g AS (
      SELECT 'model-allowlist' AS id, 'Detected: ' || string_agg(model || ' (' || calls || ' calls)', ', ' ORDER BY r) FILTER (WHERE r <= 3) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS evidence, '{{"name":"unapproved-model-block","event_types":["LLM_CALL_START"],"conditions":[{{"field":"model","op":"not_in","value":[' || string_agg('"' || model || '"', ',' ORDER BY r) || ']}}],"action":"BLOCK","reason":"Model outside those in use: ' || string_agg(model, ', ' ORDER BY r) || '","enabled":false}}' AS rule, false AS enabled FROM m WHERE r <= 20 HAVING count(*) > 0
      UNION ALL SELECT 'tool-rate-cap', 'p95 = ' || p || ' tool calls/session across ' || s || ' sessions. Suggested cap: ' || greatest(2 * p, p + 10) || '.', '{{"name":"tool-call-loop-protection","event_types":["TOOL_CALL_START"],"conditions":[{{"field":"tool_call_count","op":"gt","value":' || greatest(2 * p, p + 10) || '}}],"action":"BLOCK","reason":"More than ' || greatest(2 * p, p + 10) || ' tool calls, by a p95 of ' || p || '","enabled":true}}', true FROM c WHERE s >= 5
    ) SELECT t.*, g.* FROM (SELECT count(*) AS total_events, CAST(30 AS BIGINT) AS window_days, count(*) < 10 AS insufficient_data FROM e) t LEFT JOIN g ON true""",
    "agent_risk": _with(*_A, _AGENTS) + ", r AS (SELECT agent_id, CAST(round(CAST(greatest(0.0, least(1.0, least(0.4, violation_count * CAST(0.05 AS DOUBLE)) + least(0.3, anomaly_count * CAST(0.1 AS DOUBLE)) + CASE WHEN max_injection > 0.4 THEN (max_injection - 0.4) / 0.6 * 0.3 ELSE 0.0 END)) AS DECIMAL(18,9)), 3) AS DOUBLE) AS risk_score FROM nodes) SELECT *, CASE WHEN risk_score >= 0.7 THEN 'critical' WHEN risk_score >= 0.4 THEN 'high' WHEN risk_score >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level FROM r",
    "agent_comparison": _with(*_A, _AGENTS) + "SELECT agent_id, sessions, llm_calls, tool_calls, errors, coalesce(b, 0) AS blocks, coalesce(a, 0) AS alerts FROM agents LEFT JOIN (SELECT agent_id, count(*) FILTER (WHERE action = 'BLOCK') AS b, count(*) FILTER (WHERE action = 'ALERT') AS a FROM viol WHERE org_id = 'org_0' GROUP BY agent_id) USING (agent_id)",
    "posture_score": _with(*_A, _OVERVIEW) + "SELECT CAST(greatest(0, 100 - least(30, blocks * 5) - least(15, greatest(0, floor((violations - 10) / 5.0))) - least(20, pii_events * 3) - CASE WHEN agents = 0 THEN 15 ELSE 0 END) AS BIGINT) AS posture_score FROM ov",
    "chain_links": _with(_LINKS) + "SELECT session_id, sequence_number, link_ok FROM links",
    "chain_failures": _with(_LINKS) + "SELECT session_id, count(*) AS events, bool_and(link_ok) AS valid, min(sequence_number) FILTER (WHERE NOT link_ok) AS failed_at, CASE WHEN NOT bool_and(link_ok) THEN 'link' END AS failure FROM links GROUP BY session_id",
    "chain_status_org": _with(_LINKS) + "SELECT org_id, count(*) AS sessions, count(*) FILTER (WHERE ok) AS valid_sessions FROM (SELECT org_id, session_id, bool_and(loose_ok) AS ok FROM links GROUP BY ALL) GROUP BY org_id",
    "baseline_running": _with() + f", s AS (SELECT org_id, agent_id, session_id, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tool, max(timestamp_ns) - min(timestamp_ns) AS ns, count(*) FILTER (WHERE event_type = 'AGENT_FINISH') AS f FROM log GROUP BY ALL) SELECT org_id, agent_id, count(*) AS session_count, {_CENTS.format('avg(llm)')} AS mean_llm, {_CENTS.format('avg(tool)')} AS mean_tool, {_CENTS.format('avg(ns / 1e6)')} AS mean_ms FROM s WHERE f > 0 GROUP BY org_id, agent_id",
    "baseline_drift": _with() + f", s AS (SELECT org_id, agent_id, session_id, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm, count(*) FILTER (WHERE event_type = 'AGENT_FINISH') AS f FROM log GROUP BY ALL), b AS (SELECT org_id, agent_id, count(*) AS n, {_CENTS.format('avg(llm)')} AS m FROM s WHERE f > 0 GROUP BY ALL) SELECT session_id, llm, {_CENTS.format('(llm - m) / (m * 0.5)')} AS z, abs((llm - m) / (m * 0.5)) > 3 AS drifts FROM s JOIN b USING (org_id, agent_id) WHERE n >= 5 AND m <> 0",
    "rolling_injection": _with() + ", r AS (SELECT session_id, sequence_number, count(*) OVER w AS n, CAST(round(CAST(avg(injection_score) OVER w AS DECIMAL(18,6)), 4) AS DOUBLE) AS rolling_mean FROM log WHERE event_type = 'LLM_CALL_START' WINDOW w AS (PARTITION BY session_id ORDER BY sequence_number ROWS 4 PRECEDING)) SELECT session_id, sequence_number, rolling_mean, CASE WHEN rolling_mean >= 0.6 THEN 'BLOCK' WHEN rolling_mean >= 0.35 THEN 'ALERT' ELSE 'PASS' END AS verdict FROM r WHERE n >= 3",
    "running_counters": _with(_COUNTERS) + "SELECT * FROM counted",
    "budget_limits": _with(_COUNTERS) + "SELECT session_id, rule_name, min(sequence_number) AS sequence_number FROM (SELECT *, CASE WHEN tokens >= 5000 THEN 'token-budget-exceeded' WHEN llm_calls >= 10 THEN 'llm-call-budget-exceeded' END AS rule_name FROM counted) WHERE rule_name IS NOT NULL GROUP BY session_id, rule_name",
    "markov_scores": _with() + f""", s AS (
      SELECT agent_id, session_id, sequence_number, timestamp_ns, event_type, lag(event_type) OVER (PARTITION BY session_id ORDER BY sequence_number) AS before FROM log
    ), pri(a, b, n) AS (VALUES ('LLM_CALL_START', 'LLM_CALL_END', 70), ('LLM_CALL_END', 'TOOL_CALL_START', 40), ('LLM_CALL_END', 'AGENT_FINISH', 55), ('LLM_CALL_END', 'LLM_CALL_START', 15), ('TOOL_CALL_END', 'LLM_CALL_START', 90), ('TOOL_CALL_START', 'TOOL_CALL_END', 85), ('LLM_CALL_START', 'SYSTEM_ERROR', 5), ('TOOL_CALL_START', 'SYSTEM_ERROR', 3), ('AGENT_FINISH', 'LLM_CALL_START', 5), ('CHECKPOINT', 'LLM_CALL_START', 8)
    ), c AS (
      SELECT *, count(*) OVER (PARTITION BY agent_id, before, event_type ORDER BY timestamp_ns, session_id, sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) OVER (PARTITION BY agent_id, before ORDER BY timestamp_ns, session_id, sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS of_all
      FROM s WHERE before IS NOT NULL
    ), p AS (
      SELECT c.*, seen + coalesce(pri.n, 0) AS x, of_all + coalesce(t.n, 0) AS y FROM c LEFT JOIN pri ON pri.a = before AND pri.b = event_type LEFT JOIN (SELECT a, sum(n) AS n FROM pri GROUP BY a) t ON t.a = before
    ), q AS (SELECT session_id, sequence_number, before, event_type, {_SIX.format('CASE WHEN y = 0 THEN 1.0 / 8 ELSE (CAST(x AS DOUBLE) + 0.01) / (CAST(y AS DOUBLE) + 0.08) END')} AS probability FROM p)
    SELECT *, probability < 0.05 AS anomalous FROM q""",
    "session_features": _with() + "SELECT session_id, llm AS llm_call_count, tools / greatest(llm, 1) AS tool_call_rate, errs / n AS error_rate, ns / 60e9 AS session_duration_min, mi AS max_injection_score FROM (SELECT session_id, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tools, count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS errs, count(*) AS n, max(timestamp_ns) - min(timestamp_ns) AS ns, max(injection_score) AS mi FROM log GROUP BY session_id)",
    "baselines_summary": _with(_TOOLS) + "SELECT agent_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'denied') AS denied, count(*) AS total, max(last_seen_ns) AS last_seen_ns, count(*) FILTER (WHERE status = 'approved') > 0 AS enforcement_active FROM tools WHERE org_id = 'org_0' GROUP BY agent_id",
    "tool_baselines": _with(_TOOLS) + "SELECT * FROM tools",
    "agent_tools": _with(_TOOLS) + "SELECT agent_id, tool_name, status, call_count, row_number() OVER (PARTITION BY agent_id ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END, call_count DESC, tool_name) AS place FROM tools WHERE org_id = 'org_0'",
    "tool_not_in_baseline": _with(_TOOLS) + "SELECT l.event_id, l.agent_id, l.tool_name FROM log l WHERE event_type = 'TOOL_CALL_START' AND EXISTS (SELECT 1 FROM tools t WHERE t.org_id = l.org_id AND t.agent_id = l.agent_id AND status = 'approved') AND NOT EXISTS (SELECT 1 FROM tools t WHERE t.org_id = l.org_id AND t.agent_id = l.agent_id AND t.tool_name = l.tool_name AND status = 'approved')",
    "rate_windows": _with() + "SELECT event_id, agent_id, count(*) OVER w AS in_window, count(*) OVER w > 5 AS limited FROM log WINDOW w AS (PARTITION BY agent_id ORDER BY timestamp_ns // 1000 RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)",
    "event_rates": _with() + "SELECT CAST(timestamp_ns // 60000000000 * 60000000 AS BIGINT) AS start_us, event_type, count(*) / 60.0 AS per_second FROM log GROUP BY ALL",
    "histogram_quantiles": _with() + """, b AS (SELECT CAST(timestamp_ns // 86400000000000 * 86400000000 AS BIGINT) AS start_us, count(*) AS n, count(*) FILTER (WHERE latency_ms <= 50) AS b50, count(*) FILTER (WHERE latency_ms <= 100) AS b100, count(*) FILTER (WHERE latency_ms <= 250) AS b250, count(*) FILTER (WHERE latency_ms <= 500) AS b500, count(*) FILTER (WHERE latency_ms <= 1000) AS b1000, count(*) FILTER (WHERE latency_ms <= 2500) AS b2500, count(*) FILTER (WHERE latency_ms <= 5000) AS b5000, count(*) FILTER (WHERE latency_ms <= 10000) AS b10000 FROM log WHERE event_type = 'LLM_CALL_END' GROUP BY ALL), t AS (SELECT *, n * CAST(0.95 AS DOUBLE) AS g FROM b)
    SELECT start_us, n, CASE WHEN b50 >= g THEN 50.0 * g / nullif(b50, 0) WHEN b100 >= g THEN 50 + 50.0 * (g - b50) / nullif(b100 - b50, 0) WHEN b250 >= g THEN 100 + 150.0 * (g - b100) / nullif(b250 - b100, 0) WHEN b500 >= g THEN 250 + 250.0 * (g - b250) / nullif(b500 - b250, 0) WHEN b1000 >= g THEN 500 + 500.0 * (g - b500) / nullif(b1000 - b500, 0) WHEN b2500 >= g THEN 1000 + 1500.0 * (g - b1000) / nullif(b2500 - b1000, 0) WHEN b5000 >= g THEN 2500 + 2500.0 * (g - b2500) / nullif(b5000 - b2500, 0) WHEN b10000 >= g THEN 5000 + 5000.0 * (g - b5000) / nullif(b10000 - b5000, 0) ELSE 10000.0 END AS quantile_ms FROM t""",
    "active_sessions": _with() + "SELECT count(*) FILTER (WHERE l <= 1706486400000000000 AND l > 1706486400000000000 - 14400000000000) AS active_sessions FROM (SELECT session_id, max(timestamp_ns) AS l FROM log GROUP BY session_id)",
    "policy_eval": _with(_COUNTERS) + """, e AS (SELECT l.*, c.tool_calls AS tool_call_count, c.llm_calls AS llm_call_count, c.age_ns // 1000000 AS session_duration_ms FROM log l JOIN counted c USING (session_id, sequence_number)), v AS (
      SELECT session_id, sequence_number, 0 AS place, 'tool-call-loop-protection' AS rule_name, 'BLOCK' AS action FROM e WHERE event_type = 'TOOL_CALL_START' AND tool_call_count > 50
      UNION ALL SELECT session_id, sequence_number, 1, 'runaway-llm-call-protection', 'BLOCK' FROM e WHERE event_type = 'LLM_CALL_START' AND llm_call_count > 100
      UNION ALL SELECT session_id, sequence_number, 2, 'pii-in-tool-output', 'ALERT' FROM e WHERE event_type = 'TOOL_CALL_END' AND len(pii_detected) > 0
      UNION ALL SELECT session_id, sequence_number, 3, 'pii-in-llm-request', 'ALERT' FROM e WHERE event_type = 'LLM_CALL_START' AND len(pii_detected) > 0
      UNION ALL SELECT session_id, sequence_number, 4, 'sensitive-pii-types-critical', 'ALERT' FROM e WHERE event_type IN ('LLM_CALL_START', 'TOOL_CALL_START', 'TOOL_CALL_END') AND list_contains(pii_detected, 'US_SSN')
      UNION ALL SELECT session_id, sequence_number, 5, 'high-latency-alert', 'ALERT' FROM e WHERE event_type = 'LLM_CALL_END' AND latency_ms > 30000
      UNION ALL SELECT session_id, sequence_number, 6, 'provider-5xx-error', 'ALERT' FROM e WHERE event_type = 'SYSTEM_ERROR' AND http_status >= 500
      UNION ALL SELECT session_id, sequence_number, 7, 'provider-auth-error', 'ALERT' FROM e WHERE event_type = 'SYSTEM_ERROR' AND http_status IN (401, 403)
      UNION ALL SELECT session_id, sequence_number, 8, 'long-session-warning', 'ALERT' FROM e WHERE event_type = 'LLM_CALL_START' AND session_duration_ms > 3600000
      UNION ALL SELECT session_id, sequence_number, 9, 'prompt-injection-block', 'BLOCK' FROM e WHERE event_type = 'LLM_CALL_START' AND injection_score >= 0.8
      UNION ALL SELECT session_id, sequence_number, 10, 'prompt-injection-alert', 'ALERT' FROM e WHERE event_type = 'LLM_CALL_START' AND injection_score >= 0.5 AND injection_score < 0.8
      UNION ALL SELECT session_id, sequence_number, 11, 'credential-leak-alert', 'ALERT' FROM e WHERE event_type = 'LLM_CALL_START' AND credential_detected
      UNION ALL SELECT session_id, sequence_number, 12, 'rce-in-tool-args', 'BLOCK' FROM e WHERE event_type = 'TOOL_CALL_START' AND rce_detected
      UNION ALL SELECT session_id, sequence_number, 15, 'context-injection-block', 'BLOCK' FROM e WHERE event_type = 'LLM_CALL_START' AND injection_score >= 0.6
      UNION ALL SELECT session_id, sequence_number, 16, 'context-injection-alert', 'ALERT' FROM e WHERE event_type = 'LLM_CALL_START' AND injection_score >= 0.35
    ), c AS (SELECT *, min(place) FILTER (WHERE action = 'BLOCK') OVER (PARTITION BY session_id, sequence_number) AS stop FROM v)
    SELECT session_id, sequence_number, rule_name, action, CAST(place AS BIGINT) AS place FROM c WHERE stop IS NULL OR place <= stop""",
    "tool_permissions": _with() + "SELECT session_id, sequence_number, 'deny-tool-2' AS rule_name, 'BLOCK' AS action, CAST(0 AS BIGINT) AS place FROM log WHERE event_type = 'TOOL_CALL_START' AND tool_name = 'tool_2' UNION ALL SELECT session_id, sequence_number, 'agent-1-allow-list', 'ALERT', CAST(1 AS BIGINT) FROM log WHERE event_type = 'TOOL_CALL_START' AND agent_id = 'agent_1' AND tool_name NOT IN ('tool_0', 'tool_2')",
    "compliance_soc2": _with(_LINKS) + f"SELECT session_id, events, errors, tokens, {_CENTS.format('errors / greatest(events, 1) * 100')} AS error_rate_pct, ok AS chain_valid, ok AND errors = 0 AS compliant FROM (SELECT session_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS errors, CAST(coalesce(sum(nested_tokens), 0) AS BIGINT) AS tokens FROM log GROUP BY session_id) JOIN (SELECT session_id, bool_and(link_ok) AS ok FROM links GROUP BY session_id) USING (session_id)",
    "data_access_map": _with() + "SELECT session_id, tool_name, call_count, first_ns, last_ns, sample_input, row_number() OVER (PARTITION BY session_id ORDER BY q) AS place FROM (SELECT session_id, tool_name, count(*) AS call_count, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, arg_min(tool_input, sequence_number) AS sample_input, min(sequence_number) AS q FROM log WHERE event_type = 'TOOL_CALL_START' GROUP BY session_id, tool_name)",
    "benchmark_confusion": _with() + f", c AS (SELECT k % 3 = 0 AS bad, injection_score >= 0.5 AS hit FROM log), n AS (SELECT count(*) FILTER (WHERE bad AND hit) AS tp, count(*) FILTER (WHERE NOT bad AND hit) AS fp, count(*) FILTER (WHERE bad AND NOT hit) AS fn, count(*) FILTER (WHERE NOT bad AND NOT hit) AS tn FROM c) SELECT *, {_SIX.format('tp / (tp + fn)')} AS tpr, {_SIX.format('fp / (fp + tn)')} AS fpr, {_SIX.format('tp / (tp + fp)')} AS precision, {_SIX.format('2 * tp / (2 * tp + fp + fn)')} AS f1, {_SIX.format('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM n",
    "ingest_validation": _with() + "SELECT event_id, CASE WHEN k % 11 = 0 THEN 'run_id,payload' WHEN k % 13 = 0 THEN 'payload' ELSE '' END AS missing, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'missing_fields' WHEN event_type = 'SYSTEM_ERROR' AND k % 5 = 0 THEN 'unknown_event_type' WHEN org_id <> 'org_0' THEN 'wrong_org' END AS reason FROM log",
    "ingest_dedup": _with() + "SELECT DISTINCT event_id, session_id FROM log WHERE k % 4 <> 0",
    "idle_sessions": _with() + "SELECT session_id, CAST(min(us) AS BIGINT) AS start_us, count(*) AS events FROM (SELECT session_id, us, sum(new) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT session_id, timestamp_ns // 1000 AS us, CASE WHEN timestamp_ns // 1000 - lag(timestamp_ns // 1000) OVER (PARTITION BY session_id ORDER BY timestamp_ns) < 14400000000 THEN 0 ELSE 1 END AS new FROM log)) GROUP BY session_id, g",
    "last_hashes": _with() + "SELECT session_id, arg_max(current_hash, sequence_number) AS last_hash, arg_max(event_id, sequence_number) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS last_error FROM log GROUP BY session_id",
    "prompt_mutation": "WITH m AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS f FROM conversations WHERE role = 'user' AND text IS NOT NULL) SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS sequence_number, substr(sha256(text), 1, 16) AS hash, substr(sha256(f), 1, 16) AS first_hash FROM m WHERE text <> f",
    "toolset_mutation": _with() + ", t AS (SELECT session_id, sequence_number, k % 2 AS a, first_value(k % 2) OVER (PARTITION BY session_id ORDER BY sequence_number) AS f FROM log WHERE event_type = 'LLM_CALL_START') SELECT session_id, sequence_number, CASE WHEN a = 1 THEN 'write_file' ELSE 'send_mail' END AS added, CASE WHEN a = 1 THEN 'send_mail' ELSE 'write_file' END AS removed FROM t WHERE a <> f",
    "spawn_depth": "WITH RECURSIVE s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent FROM orders), d AS (SELECT id, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, depth + 1 FROM s JOIN d ON s.parent = d.id) SELECT 'sess_' || id AS session_id, CAST(min(depth) AS BIGINT) AS depth FROM d GROUP BY id",
    "taint_hits": _with() + "SELECT c.session_id, c.sequence_number, c.tool_name, t.value, CASE WHEN c.tool_name = 'http_tool_1' THEN 'BLOCK' ELSE 'ALERT' END AS action FROM (SELECT session_id, tool_input AS value, min(sequence_number) AS q FROM log WHERE event_type = 'TOOL_CALL_END' GROUP BY ALL) t JOIN (SELECT session_id, sequence_number, CASE WHEN tool_name = 'tool_1' THEN 'http_tool_1' ELSE tool_name END AS tool_name, tool_input AS argument FROM log WHERE event_type = 'TOOL_CALL_START') c ON c.session_id = t.session_id AND q < c.sequence_number AND contains(argument, t.value) WHERE length(t.value) >= 8",
    "masked_payloads": _with() + """, p AS (SELECT event_id, k, CASE WHEN k % 2 = 0 THEN '1' ELSE '2' END AS c, CASE WHEN k % 3 = 0 THEN '2' ELSE '3' END AS a FROM log)
      SELECT event_id, '{"note":"mail <EMAIL_ADDRESS> or ' || k || '","deep":{"items":[{"paid":"card ' || CASE c WHEN '1' THEN '<CREDIT_CARD>' ELSE '4111 1111 1111 1112' END || ' of é","n":' || k || '},{"paid":"none","n":' || (k + 1) || '}],"to":"' || CASE a WHEN '2' THEN '<IBAN_CODE>' ELSE 'GB82WEST12345698765433' END || '"},"ok":true}' AS masked,
        concat_ws(',', CASE c WHEN '1' THEN 'CREDIT_CARD' END, 'EMAIL_ADDRESS', CASE a WHEN '2' THEN 'IBAN_CODE' END) AS types,
        sha256('{"deep":{"items":[{"n":' || k || ',"paid":"card 4111 1111 1111 111' || c || ' of \\u00e9"},{"n":' || (k + 1) || ',"paid":"none"}],"to":"GB82WEST1234569876543' || a || '"},"note":"mail user' || k || '@example.org or ' || k || '","ok":true}') AS original_sha256 FROM p""",
}
