"""SQL of reports, alerts, exports, registries and providers, over the same log."""

from __future__ import annotations

from tracequill.plans.oracle import _A, _LINKS, _SIX, AS_OF, LOG, _with
from tracequill.plans.oracle import SQL as ORACLE

_KINDS = {"injection": "injection|prompt|crescendo|delimiter", "tool": "tool|rce|ssrf|schema", "output": "output|canary|relay", "credential": "credential|pii|secret|token"}
_HITS = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE action = '{a}' AND regexp_matches(rule_name, '{p}')), 0) AS BIGINT) AS {k}_{a.lower()}s" for k, p in _KINDS.items() for a in ("BLOCK", "ALERT"))
_AUDIT = f"""vc AS (
  SELECT rule_name, action, count(*) AS n FROM viol WHERE org_id = 'org_0' AND (is_false_positive IS NULL OR NOT is_false_positive) GROUP BY ALL
), audit AS (
  SELECT * FROM (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT agent_id) AS agents, count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm_calls, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tool_calls, count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS errors,
      count(*) FILTER (WHERE event_type = 'MEMORY_WRITE_BLOCKED') AS memory_blocked, count(*) FILTER (WHERE len(pii_detected) > 0) AS pii_events FROM log WHERE org_id = 'org_0'),
    (SELECT CAST(coalesce(sum(n) FILTER (WHERE action = 'BLOCK'), 0) AS BIGINT) AS blocks, CAST(coalesce(sum(n) FILTER (WHERE action = 'ALERT'), 0) AS BIGINT) AS alerts, {_HITS} FROM vc),
    (SELECT count(*) AS anomalies FROM anom WHERE org_id = 'org_0'),
    (SELECT count(*) AS chain_sessions, count(*) FILTER (WHERE ok) AS chain_valid FROM (SELECT session_id, bool_and(loose_ok) AS ok FROM links WHERE org_id = 'org_0' GROUP BY session_id))
)"""
_PERIOD = f"timestamp_ns BETWEEN {AS_OF} - 20 * 86400000000000 AND {AS_OF} - 5 * 86400000000000"
_CHAINS = "JOIN (SELECT session_id, bool_and(link_ok) AS chain_valid, bool_and(link_ok) AS compliant FROM links GROUP BY session_id) USING (session_id)"
_FLAGGED = """flagged AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE flag WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, sequence_number) AS place FROM (
    SELECT session_id, sequence_number, event_id, CASE WHEN event_type = 'SYSTEM_ERROR' THEN 'high' ELSE 'medium' END AS flag, CASE WHEN event_type = 'SYSTEM_ERROR' THEN 'PROVIDER_ERROR' ELSE 'PII_DETECTED' END AS flag_type,
      CASE WHEN event_type = 'SYSTEM_ERROR' THEN 'LLM provider error: unknown' ELSE 'PII detected in ' || event_type || ': ' || pii_detected[1] END AS description
    FROM log WHERE event_type = 'SYSTEM_ERROR' OR event_type IN ('LLM_CALL_START', 'TOOL_CALL_END') AND len(pii_detected) > 0
    UNION ALL SELECT session_id, NULL, NULL, 'critical', 'CHAIN_INTEGRITY_VIOLATION', 'Hash chain integrity check failed' FROM links GROUP BY session_id HAVING NOT bool_and(link_ok)
  )
)"""
_CONTROLS = """, controls(framework, control, evidence) AS (VALUES ('owasp_asi_2026', 'ASI-1', 'injection'), ('owasp_asi_2026', 'ASI-2', 'tool_abuse'), ('owasp_asi_2026', 'ASI-3', 'output_safety'), ('owasp_asi_2026', 'ASI-4', 'pii'), ('eu_ai_act', 'Art.9', 'injection'), ('eu_ai_act', 'Art.12', 'record_keeping'), ('eu_ai_act', 'Art.13', 'transparency'), ('eu_ai_act', 'Art.15', 'robustness'), ('hipaa', '(a)(2)(i)', 'identity'), ('hipaa', '(b)', 'record_keeping'), ('hipaa', '(c)(1)', 'chain_integrity'), ('hipaa', '(e)(1)', 'pii'), ('soc2', 'CC6.1', 'injection'), ('soc2', 'CC6.7', 'pii'), ('soc2', 'CC7.2', 'anomalies'), ('soc2', 'CC7.3', 'violations'), ('gdpr', 'Art.5(1)(f)', 'chain_integrity'), ('gdpr', 'Art.25', 'pii'), ('gdpr', 'Art.30', 'record_keeping'), ('gdpr', 'Art.32', 'injection')
), judged AS (SELECT framework, control, evidence, CASE evidence
  WHEN 'injection' THEN CASE WHEN llm_calls = 0 THEN 'fail|No LLM calls recorded in this period' WHEN injection_blocks > 0 THEN 'pass|' || injection_blocks || ' injection attempts blocked' WHEN injection_alerts > 0 THEN 'partial|' || injection_alerts || ' injection alerts, no blocks' ELSE 'pass|No injection attempts in ' || llm_calls || ' LLM calls' END
  WHEN 'tool_abuse' THEN CASE WHEN tool_blocks > 0 THEN 'pass|' || tool_blocks || ' tool abuse attempts blocked' WHEN tool_alerts > 0 THEN 'partial|' || tool_alerts || ' tool alerts, no blocks' ELSE 'pass|' || tool_calls || ' tool calls without abuse' END
  WHEN 'output_safety' THEN CASE WHEN output_blocks > 0 THEN 'pass|' || output_blocks || ' unsafe outputs blocked' WHEN output_alerts > 0 THEN 'partial|' || output_alerts || ' output alerts, no blocks' ELSE 'pass|No unsafe outputs' END
  WHEN 'pii' THEN CASE WHEN pii_events > 0 THEN 'partial|' || pii_events || ' events with personal data; check masking' ELSE 'pass|No personal data detected' END
  WHEN 'record_keeping' THEN CASE WHEN sessions = 0 THEN 'fail|No sessions recorded in this period' ELSE 'pass|' || sessions || ' sessions, ' || (llm_calls + tool_calls) || ' events recorded' END
  WHEN 'transparency' THEN CASE WHEN llm_calls = 0 THEN 'fail|No LLM calls recorded' ELSE 'pass|All ' || llm_calls || ' LLM calls kept with their metadata' END
  WHEN 'robustness' THEN CASE WHEN anomalies > 0 AND blocks = 0 THEN 'partial|' || anomalies || ' anomalies, no blocks' WHEN blocks > 0 THEN 'pass|' || blocks || ' requests blocked' ELSE 'pass|No anomalies in this period' END
  WHEN 'identity' THEN CASE WHEN sessions = 0 THEN 'fail|No sessions with an agent''s identity' ELSE 'pass|' || sessions || ' sessions with agent and session ids' END
  WHEN 'chain_integrity' THEN CASE WHEN chain_sessions = 0 THEN 'fail|No events to check' WHEN chain_valid < chain_sessions THEN 'fail|Links broken in ' || (chain_sessions - chain_valid) || ' of ' || chain_sessions || ' sessions' ELSE 'pass|Links hold in all ' || chain_sessions || ' sessions' END
  WHEN 'anomalies' THEN CASE WHEN anomalies > 0 THEN 'pass|' || anomalies || ' anomalies logged for review' ELSE 'pass|No anomalies; monitoring active' END
  WHEN 'violations' THEN CASE WHEN blocks + alerts > 0 THEN 'pass|' || blocks || ' blocks and ' || alerts || ' alerts on record' ELSE 'pass|No violations in this period' END END AS v FROM controls, audit)
SELECT framework, control, evidence, split_part(v, '|', 1) AS status, substr(v, instr(v, '|') + 1) AS shown_by FROM judged"""
_NONE = {t: f"CAST(NULL AS {t})" for t in ("BIGINT", "VARCHAR", "DOUBLE")}
_ISO = "CASE WHEN timestamp_ns % 1000000000 = 0 THEN strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f+00:00') END"
_CASES = "cases AS (SELECT CASE WHEN k % 3 = 0 THEN 'attack' ELSE 'clean' END AS expected, CASE k % 4 WHEN 0 THEN 'paraphrase_attack' WHEN 1 THEN 'override' ELSE 'delimiter' END AS category, injection_score >= 0.5 AS detected, injection_score >= 0.8 AS blocked, injection_score AS s, latency_ms, tool_input AS text FROM log)"
_FOUR = "CAST(round(CAST({} AS DECIMAL(18,9)), 4) AS DOUBLE)"
_CONV = "m AS (SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations)"

SQL: dict[str, str] = {
    "alert_severity": _with() + "SELECT event_id, rule_name, severity, CASE severity WHEN 'CRITICAL' THEN 'slack,email,pagerduty,webhook' WHEN 'HIGH' THEN 'slack,email,pagerduty' ELSE 'slack' END AS channels, severity <> 'MEDIUM' AS at_least_high, substr(sha256(rule_name || '|' || session_id || '|' || (timestamp_ns // 3600000000000)), 1, 32) AS dedup_key FROM (SELECT *, CASE WHEN rule_name IN ('system-prompt-mutation', 'canary-leak') THEN 'CRITICAL' WHEN action = 'BLOCK' OR rule_name IN ('tool-call-loop-protection', 'pii-in-llm-request') THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM viol)",
    "forensic_timeline": _with()
    + """SELECT session_id, sequence_number, event_id, event_type, CASE event_type WHEN 'LLM_CALL_START' THEN 'LLM Request' WHEN 'LLM_CALL_END' THEN 'LLM Response' WHEN 'TOOL_CALL_START' THEN 'Tool Invoked' WHEN 'TOOL_CALL_END' THEN 'Tool Result' WHEN 'AGENT_FINISH' THEN 'Agent Finished' ELSE 'Error' END AS label,
      CASE event_type WHEN 'SYSTEM_ERROR' THEN 'error' WHEN 'AGENT_FINISH' THEN 'success' WHEN 'LLM_CALL_START' THEN 'debug' WHEN 'LLM_CALL_END' THEN 'debug' ELSE 'info' END AS severity, timestamp_ns,
      CASE event_type WHEN 'LLM_CALL_START' THEN 'Request to ' || provider || ': 0 messages. Last user: ''...''' WHEN 'LLM_CALL_END' THEN 'Response: ''...'' (finish: ' || finish_reason || ')' WHEN 'TOOL_CALL_START' THEN 'Calling tool: ' || tool_name WHEN 'TOOL_CALL_END' THEN 'Tool ' || tool_name || ' returned: ''...''' WHEN 'AGENT_FINISH' THEN 'Agent finished: ''...''' ELSE 'Error ' || http_status || ': ' END AS summary,
      coalesce(pii_detected[1], '') AS pii_detected, run_id, parent_run_id FROM log""",
    "risk_flags": _with(_LINKS, _FLAGGED) + "SELECT * FROM flagged",
    "replay_totals": _with(_LINKS, _FLAGGED, *_A)
    + """SELECT * FROM (SELECT session_id, arg_min(org_id, sequence_number) AS org_id, arg_min(agent_id, sequence_number) AS agent_id, arg_min(provider, sequence_number) AS provider, arg_min(model, sequence_number) AS model, arg_min(timestamp_ns, sequence_number) AS started_at_ns, arg_max(timestamp_ns, sequence_number) AS ended_at_ns, count(*) AS total_events,
        count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS llm_call_count, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tool_call_count, count(*) FILTER (WHERE event_type = 'SYSTEM_ERROR') AS error_count, count(*) FILTER (WHERE len(pii_detected) > 0) AS pii_exposure_count, count(*) AS timeline_entries FROM log GROUP BY session_id)
      JOIN (SELECT session_id, bool_and(link_ok) AS chain_valid, min(sequence_number) FILTER (WHERE NOT link_ok) AS failed_at FROM links GROUP BY session_id) USING (session_id)
      LEFT JOIN (SELECT session_id, count(DISTINCT tool_name) AS tools_used FROM log WHERE event_type = 'TOOL_CALL_START' GROUP BY session_id) USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS flags FROM flagged GROUP BY session_id) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS anomalies FROM anom GROUP BY session_id) USING (session_id)""",
    "compliance_eu": _with(_LINKS)
    + f"""SELECT * FROM (SELECT session_id, count(*) AS events, min(timestamp_ns) AS from_ns, max(timestamp_ns) AS to_ns, (max(timestamp_ns) - min(timestamp_ns)) / CAST(1e6 AS DOUBLE) AS duration_ms, coalesce(string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) FILTER (WHERE event_type = 'TOOL_CALL_START'), '') AS tools, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START') AS tool_calls,
      count(*) FILTER (WHERE event_type = 'LLM_CALL_START') AS inputs, count(*) FILTER (WHERE event_type = 'LLM_CALL_END') AS outputs, coalesce(string_agg(DISTINCT pii_detected[1], ',' ORDER BY pii_detected[1]), '') AS pii_types, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers,
      count(*) FILTER (WHERE event_type = 'AGENT_FINISH') AS finished, repeat('|', greatest(least(3, count(*) FILTER (WHERE event_type = 'AGENT_FINISH')) - 1, 0)) AS final_outputs FROM log GROUP BY session_id) {_CHAINS}""",
    "compliance_gdpr": _with(_LINKS)
    + f"""SELECT * FROM (SELECT session_id, coalesce(string_agg(DISTINCT pii_detected[1], ',' ORDER BY pii_detected[1]), '') AS pii_types, count(*) FILTER (WHERE len(pii_detected) > 0) AS pii_events, coalesce(bool_and(has_payload_hash) FILTER (WHERE len(pii_detected) > 0), true) AS hashes_kept, count(*) FILTER (WHERE event_type = 'AGENT_FINISH') AS decisions, '' AS reasoning,
      coalesce(array_to_string(list_slice(list(sequence_number || ':' || event_type || ':' || model ORDER BY sequence_number) FILTER (WHERE event_type IN ('LLM_CALL_END', 'TOOL_CALL_START', 'AGENT_FINISH')), 1, 20), ','), '') AS decision_trace FROM log GROUP BY session_id) {_CHAINS}""",
    "compliance_hipaa": _with(_LINKS)
    + f"""SELECT * FROM (SELECT session_id, count(*) AS events, count(*) FILTER (WHERE list_contains(pii_detected, 'US_SSN')) AS phi_events, bool_or(list_contains(pii_detected, 'US_SSN')) AS phi_seen, count(*) FILTER (WHERE event_type = 'TOOL_CALL_START' AND len(pii_detected) > 0) AS tool_accesses, string_agg(DISTINCT agent_id, ',' ORDER BY agent_id) AS agent_ids,
      coalesce(array_to_string(list_slice(list(timestamp_ns || ':' || tool_name || ':' || pii_detected[1] ORDER BY sequence_number) FILTER (WHERE event_type = 'TOOL_CALL_START' AND len(pii_detected) > 0), 1, 20), ','), '') AS access_log FROM log GROUP BY session_id) {_CHAINS}""",
    "audit_period": (_with(*_A, _LINKS.replace("FROM log ", f"FROM log WHERE {_PERIOD} "), _AUDIT) + "SELECT * FROM audit")
    .replace("FROM viol WHERE org_id", f"FROM viol WHERE {_PERIOD} AND org_id").replace("FROM log WHERE org_id = 'org_0')", f"FROM log WHERE {_PERIOD} AND org_id = 'org_0')")
    .replace("FROM anom WHERE org_id = 'org_0'", f"FROM (SELECT a.org_id, coalesce(l.timestamp_ns, z.at) AS timestamp_ns FROM anom a LEFT JOIN log l USING (session_id, sequence_number) JOIN (SELECT session_id, max(timestamp_ns) AS at FROM log GROUP BY session_id) z ON z.session_id = a.session_id) WHERE {_PERIOD} AND org_id = 'org_0'"),
    "audit_summary": _with(*_A, _LINKS, _AUDIT) + "SELECT * FROM audit",
    "audit_overall": _with(*_A, _LINKS, _AUDIT) + "SELECT sessions, chain_sessions, chain_valid, blocks, pii_events, CASE WHEN sessions = 0 OR chain_valid < chain_sessions THEN 'fail' WHEN blocks > 0 OR pii_events > 0 THEN 'partial' ELSE 'pass' END AS status FROM audit",
    "audit_report_controls": _with(*_A, _LINKS, _AUDIT) + _CONTROLS,
    "audit_violations": _with() + "SELECT rule_name, action, count(*) AS count FROM viol WHERE org_id = 'org_0' AND (is_false_positive IS NULL OR NOT is_false_positive) GROUP BY ALL",
    "top_violations": _with() + "SELECT event_id, rule_name, action, 'threshold' AS reason, event_type, session_id, agent_id, timestamp_ns FROM viol WHERE org_id = 'org_0' AND (is_false_positive IS NULL OR NOT is_false_positive) ORDER BY timestamp_ns DESC, event_id LIMIT 200",
    "rule_hours": _with() + "SELECT rule_name, action, CAST(timestamp_ns // 3600000000000 * 3600000000 AS BIGINT) AS hour_us, count(*) AS increase FROM viol GROUP BY ALL",
    "export_normalised": _with()
    + f"""SELECT event_id, schema_version, org_id, session_id, agent_id, run_id, parent_run_id, event_type, provider, model, 'proxy' AS interception_layer, timestamp_ns, {_ISO} AS timestamp_iso, sequence_number, previous_hash, current_hash, coalesce(pii_detected[1], '') AS pii_detected, latency_ms, total_tokens, {_NONE["BIGINT"]} AS prompt_tokens, {_NONE["BIGINT"]} AS completion_tokens,
      finish_reason, http_status, tool_name, {_NONE["VARCHAR"]} AS tool_call_id, {_NONE["VARCHAR"]} AS error_message, {_NONE["VARCHAR"]} AS error_code, {_NONE["BIGINT"]} AS total_llm_calls, {_NONE["BIGINT"]} AS total_tool_calls, {_NONE["DOUBLE"]} AS session_duration_ms, injection_score AS security_injection_score, {_NONE["VARCHAR"]} AS security_injection_label,
      credential_detected AS security_credential_detected, rce_detected AS security_rce_detected, false AS security_ssrf_detected, false AS security_crescendo_detected, {_NONE["DOUBLE"]} AS security_crescendo_drift, false AS security_output_detected FROM log""",
    "export_period": _with() + "SELECT event_id, timestamp_ns FROM log WHERE org_id = 'org_0' AND event_type IN ('LLM_CALL_END', 'SYSTEM_ERROR') AND timestamp_ns BETWEEN 1706745600000000000 - 20 * 86400000000000 AND 1706745600000000000",
    "code_rules": "WITH mk AS (" + ORACLE["markov_scores"] + "), ro AS (" + ORACLE["rolling_injection"] + "), fl AS (" + _with() + """SELECT session_id, sequence_number, lag(injection_score) OVER (PARTITION BY session_id ORDER BY sequence_number) AS b FROM log WHERE event_type = 'LLM_CALL_START'), v AS (
      SELECT session_id, sequence_number, 2 AS place, 'ml-classifier-injection-block' AS rule_name, 'BLOCK' AS action FROM fl WHERE b >= 0.8
      UNION ALL SELECT session_id, sequence_number, CASE verdict WHEN 'BLOCK' THEN 10 ELSE 11 END, 'context-injection-' || lower(verdict), verdict FROM ro WHERE verdict <> 'PASS'
      UNION ALL SELECT session_id, sequence_number, 14, 'markov-anomalous-transition', 'ALERT' FROM mk WHERE anomalous
    ) SELECT session_id, sequence_number, rule_name, action, CAST(place AS BIGINT) AS place FROM (SELECT *, min(place) FILTER (WHERE action = 'BLOCK') OVER (PARTITION BY session_id, sequence_number) AS stop FROM v) WHERE stop IS NULL OR place <= stop""",
    "tool_fingerprints": _with() + """SELECT event_id, substr(sha256(CASE WHEN k % 3 = 2 THEN '{"read_file":{"type":"object"}}' ELSE '{"read_file":{"type":"object"},"write_file":{"a":2,"b":1}}' END), 1, 16) AS fingerprint FROM log WHERE event_type = 'LLM_CALL_START'""",
    "benchmark_percentiles": _with() + "SELECT quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, count(*) AS n, list_sort(list(latency_ms))[least(CAST(floor(CAST(0.95 AS DOUBLE) * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95_rank FROM log WHERE event_type = 'LLM_CALL_END'",
    "benchmark_categories": _with(_CASES) + f"SELECT category, count(*) AS total, count(*) FILTER (WHERE detected) AS detected_cases, count(*) FILTER (WHERE blocked) AS blocked_cases, {_FOUR.format('count(*) FILTER (WHERE detected) / count(*)')} AS detection_rate, {_FOUR.format('count(*) FILTER (WHERE blocked) / count(*)')} AS block_rate FROM cases WHERE expected = 'attack' GROUP BY category",
    "benchmark_layers": _with(_CASES) + f"SELECT layer, {_FOUR.format('count(*) FILTER (WHERE x > 0.1) / count(*)')} AS coverage FROM (SELECT 'structural' AS layer, s AS x FROM cases WHERE expected = 'attack' AND detected UNION ALL SELECT 'normalizer', s / 8 FROM cases WHERE expected = 'attack' AND detected) GROUP BY layer",
    "benchmark_report": _with(_CASES)
    + f""", c AS (SELECT * FROM cases WHERE NOT (expected = 'attack' AND category = 'paraphrase_attack')), n AS (SELECT count(*) FILTER (WHERE expected = 'attack' AND detected) AS tp, count(*) FILTER (WHERE expected = 'clean' AND detected) AS fp, count(*) FILTER (WHERE expected = 'attack' AND NOT detected) AS fn, count(*) FILTER (WHERE expected = 'clean' AND NOT detected) AS tn FROM c)
      SELECT n.*, {_SIX.format("tp / (tp + fn)")} AS tpr, {_SIX.format("fp / (fp + tn)")} AS fpr, {_SIX.format("tp / (tp + fp)")} AS precision, {_SIX.format("2 * tp / (2 * tp + fp + fn)")} AS f1, {_SIX.format("(tp + tn) / (tp + fp + fn + tn)")} AS accuracy, h.* FROM n, (SELECT count(*) FILTER (WHERE expected = 'attack' AND category = 'paraphrase_attack') AS paraphrase_count, count(*) FILTER (WHERE expected = 'attack' AND category = 'paraphrase_attack' AND detected) AS paraphrase_detected,
        {_SIX.format("count(*) FILTER (WHERE expected = 'attack' AND category = 'paraphrase_attack' AND detected) / count(*) FILTER (WHERE expected = 'attack' AND category = 'paraphrase_attack')")} AS paraphrase_tpr, {_SIX.format("count(*) FILTER (WHERE expected = 'attack' AND contains(text, 'data/3')) / count(*) FILTER (WHERE expected = 'attack')")} AS contamination,
        quantile_cont(latency_ms, 0.5) AS latency_p50_ms, quantile_cont(latency_ms, 0.95) AS latency_p95_ms, quantile_cont(latency_ms, 0.99) AS latency_p99_ms, {_SIX.format("avg(latency_ms)")} AS latency_mean_ms FROM cases) h""",
    "merkle_root": "WITH RECURSIVE " + LOG.strip()
    + """, r AS (SELECT session_id, sequence_number // 1000 AS checkpoint, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY session_id, sequence_number // 1000) AS n, current_hash AS h FROM log WINDOW w AS (PARTITION BY session_id, sequence_number // 1000 ORDER BY sequence_number)
      ), t AS (SELECT session_id, checkpoint, 0 AS lvl, pos, n, h FROM r
        UNION ALL SELECT a.session_id, a.checkpoint, a.lvl + 1, a.pos // 2, (a.n + 1) // 2, sha256(unhex(a.h) || unhex(coalesce(b.h, a.h))) FROM t a LEFT JOIN t b ON a.session_id = b.session_id AND a.checkpoint = b.checkpoint AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0 AND a.n > 1
      ) SELECT session_id, checkpoint, events_covered, h AS merkle_root FROM t JOIN (SELECT session_id, checkpoint, max(n) AS events_covered FROM r GROUP BY ALL) USING (session_id, checkpoint) WHERE t.n = 1""",
    "chain_anomalies": _with(_LINKS) + "SELECT session_id, 'CHAIN_INTEGRITY' AS rule_id, 'critical' AS severity, CAST(1 AS BIGINT) AS measure, min(sequence_number) FILTER (WHERE NOT link_ok) AS sequence_number FROM links GROUP BY session_id HAVING NOT bool_and(link_ok)",
    "violations_ingest": _with() + "SELECT event_id, rule_name, action, session_id, agent_id, 'org_9' AS org_id, CAST(NULL AS BOOLEAN) AS is_false_positive FROM viol WHERE org_id = 'org_1'",
    "ingest_counters": _with() + "SELECT count(*) FILTER (WHERE k % 7 <> 0 AND k % 4 <> 0) AS accepted, count(*) FILTER (WHERE k % 7 <> 0) * 2 - count(*) FILTER (WHERE k % 7 <> 0 AND k % 4 <> 0) AS skipped, 2 * count(*) FILTER (WHERE k % 7 = 0) AS errors FROM log",
    "session_events_page": _with() + "SELECT session_id, sequence_number, event_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_number) AS n FROM log) WHERE n > 2 AND n <= 12 AND event_type = 'LLM_CALL_START'",
    "ml_flagged_turns": _with() + "SELECT session_id, sequence_number, 'ml-classifier-injection-block' AS rule_name, 'BLOCK' AS action FROM (SELECT session_id, sequence_number, lag(injection_score) OVER (PARTITION BY session_id ORDER BY sequence_number) AS b FROM log WHERE event_type = 'LLM_CALL_START') WHERE b >= 0.8",
    "rate_tiers": _with() + "SELECT event_id AS request_id, caller, tier, n AS in_window, n > CASE tier WHEN 'read' THEN 300 ELSE 3000 END AS limited FROM (SELECT event_id, agent_id AS caller, CASE WHEN k % 2 = 0 THEN 'read' ELSE 'ingest' END AS tier, count(*) OVER (PARTITION BY agent_id, k % 2 ORDER BY timestamp_ns // 1000 RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM log)",
    "agent_registry": _with()
    + """, ops AS (SELECT org_id, tool_name || '_' || agent_id AS agent_id, CASE WHEN k % 5 = 0 THEN 'register' WHEN k % 11 = 1 THEN 'delete' ELSE 'update' END AS op, 'n' || k AS name, CASE WHEN k % 2 = 0 THEN 'p' || k END AS purpose, timestamp_ns, event_id FROM log
      ), o AS (SELECT *, row_number() OVER (PARTITION BY org_id, agent_id ORDER BY timestamp_ns, event_id) AS i FROM ops
      ), d AS (SELECT org_id, agent_id, coalesce(max(i) FILTER (WHERE op = 'delete'), 0) AS dead FROM o GROUP BY ALL
      ), b AS (SELECT o.org_id, o.agent_id, min(i) AS born FROM o JOIN d USING (org_id, agent_id) WHERE op = 'register' AND i > dead GROUP BY ALL)
      SELECT org_id, agent_id, arg_max(name, i) AS name, arg_max(purpose, i) FILTER (WHERE purpose IS NOT NULL) AS purpose, min(timestamp_ns) AS registered_ns, max(timestamp_ns) AS updated_ns FROM o JOIN b USING (org_id, agent_id) WHERE i = born OR i > born AND op = 'update' GROUP BY org_id, agent_id""",
    "last_user_message": f"WITH {_CONV} SELECT conv_id, coalesce(arg_max(coalesce(text, ''), turn) FILTER (WHERE role = 'user'), '') AS said FROM m GROUP BY conv_id",
    "session_resolution": f"WITH {_CONV}, q AS (SELECT conv_id, arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'user') AS f, count(*) FILTER (WHERE role = 'assistant') > 0 AS again FROM m GROUP BY conv_id), h AS (SELECT conv_id AS request_id, substr(sha256(f), 1, 16) AS first_user_hash, again FROM q)"
    " SELECT request_id, first_user_hash, coalesce(CASE WHEN first_user_hash IS NOT NULL AND again THEN (SELECT max(b.request_id) FROM h b WHERE b.first_user_hash = h.first_user_hash AND b.request_id < h.request_id AND (NOT b.again OR b.request_id = (SELECT min(request_id) FROM h c WHERE c.first_user_hash = h.first_user_hash))) END, request_id) AS session_of FROM h",
    "provider_requests": f"WITH {_CONV} SELECT conv_id, model, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS said_sha256, 'lookup' AS tools, CAST(256 + conv_id % 7 AS BIGINT) AS max_tokens FROM (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'm-openai' WHEN 1 THEN 'm-anthropic' ELSE 'm-ollama' END AS model FROM m WHERE role IN ('user', 'assistant')) GROUP BY conv_id, model",
    "provider_responses": f"WITH {_CONV} SELECT conv_id, turn, sha256(coalesce(text, '')) AS said_sha256, CASE conv_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'tool_calls' WHEN 2 THEN 'length' ELSE 'stop' END AS finish_reason, CASE conv_id % 4 WHEN 3 THEN '' ELSE 'lookup:' || CASE conv_id % 4 WHEN 0 THEN '{{\"q\":1}}' ELSE '{{\"q\":2}}' END END AS calls, CAST(turn + 1 AS BIGINT) AS prompt_tokens, CAST(2 * turn + 2 AS BIGINT) AS total_tokens FROM m WHERE role = 'assistant'",
    "provider_stream": f"WITH {_CONV} SELECT conv_id, turn, sha256(text) AS said_sha256, 'stop' AS finish_reason, CAST(5 AS BIGINT) AS total_tokens FROM m WHERE role = 'assistant' AND length(text) > 0",
    "call_start_events": f"WITH {_CONV} SELECT 'conv_' || conv_id AS session_id, 'ev_' || substr(sha256('o|conv_' || conv_id || '|0|LLM_CALL_START'), 1, 26) AS event_id, 'LLM_CALL_START' AS event_type, CAST(count(*) AS BIGINT) AS n_messages, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS said_sha256 FROM m WHERE role IN ('user', 'assistant') GROUP BY conv_id",
    "tool_pairs": _with() + "SELECT a.session_id, a.run_id, a.sequence_number AS call_seq, b.sequence_number AS result_seq FROM log a JOIN log b ON a.session_id = b.session_id AND a.run_id = b.run_id AND a.event_type = 'TOOL_CALL_START' AND b.event_type = 'TOOL_CALL_END'",
    "alert_bodies": _with() + "SELECT severity, channel, count(*) AS n FROM (SELECT severity, unnest(string_split(CASE severity WHEN 'CRITICAL' THEN 'slack,email,pagerduty,webhook' ELSE 'slack,email,pagerduty' END, ',')) AS channel FROM (SELECT CASE WHEN rule_name IN ('system-prompt-mutation', 'canary-leak') THEN 'CRITICAL' WHEN action = 'BLOCK' OR rule_name IN ('tool-call-loop-protection', 'pii-in-llm-request') THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM viol) WHERE severity <> 'MEDIUM') GROUP BY ALL",
    "report_slices": _with() + "SELECT session_id, coalesce(array_to_string(list_slice(list(event_type ORDER BY sequence_number), 1, 5), ','), '') AS first_five FROM log GROUP BY session_id",
}
