"""The stages of interception in SQL, a recursion over the events of each session, whose rows carry the session's state; credentials followed through a session."""

from __future__ import annotations

from tracequill.plans.oracle import LOG, _with
from tracequill.plans.oracle import SQL as ORACLE

_SIGNALS = """sig AS (
  SELECT session_id, sequence_number AS n, agent_id, event_type AS t, timestamp_ns, injection_score AS score, total_tokens, CASE WHEN CAST(substr(session_id, 6) AS BIGINT) % 13 = 0 THEN 11 ELSE 0 END AS depth,
    CASE WHEN k * 37 % 100 >= 88 THEN 'malicious' WHEN k * 37 % 100 >= 70 THEN 'suspicious' END AS ml, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 41 = 7 THEN 'p2' ELSE 'p1' END AS p, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 43 = 5 THEN 't2' ELSE 't1' END AS d,
    k % 37 = 3 AS bad, k % 37 <> 3 AND k % 19 = 2 AS odd, k * 7 % 100 AS seen, k * 11 % 100 AS felt, k % 11 = 4 AS threat, k % 23 AS flow, k % 9 = 0 AS outside, credential_detected AS cred, rce_detected AS rce
  FROM log
)"""
_IF = lambda cond, rule: f"CASE WHEN {cond} THEN ['{rule}'] ELSE [] END"
_JOIN = " || ".join
_STATE = f"""st AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS prompt, CAST(NULL AS VARCHAR) AS tools, false AS marked, CAST([] AS DOUBLE[]) AS scores, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS calls, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS said FROM sig GROUP BY session_id
  UNION ALL
  SELECT session_id, n, CASE WHEN stop >= 3 THEN coalesce(prompt, p) ELSE prompt END, CASE WHEN stop >= 4 THEN coalesce(tools, d) ELSE tools END,
    CASE WHEN stop = 2 THEN false WHEN stop = 6 AND NOT refused THEN coalesce(ml = 'malicious', false) ELSE marked END, CAST(more AS DOUBLE[]), tokens + CASE WHEN t = 'LLM_CALL_END' THEN total_tokens ELSE 0 END, calls + CASE WHEN stop >= 3 THEN 1 ELSE 0 END, uses,
    CAST(verdicts || {_IF("stop = 6 AND NOT refused AND ml = 'suspicious'", "ml-classifier-injection-alert ALERT")} AS VARCHAR[])
  FROM (SELECT *, stop = 6 AND len(list_filter(verdicts, lambda x: x LIKE '% BLOCK')) > 0 AS refused FROM (SELECT *, CASE t
    WHEN 'LLM_CALL_START' THEN CASE stop WHEN 1 THEN ['spawn-depth-exceeded BLOCK'] WHEN 2 THEN ['ml-classifier-injection-block BLOCK'] WHEN 3 THEN ['system-prompt-mutation BLOCK'] WHEN 4 THEN ['tool-set-mutation BLOCK'] WHEN 5 THEN ['mcp-tool-definition-block BLOCK']
      ELSE {_JOIN([_IF("odd", "mcp-tool-definition-alert ALERT"), _IF("len(more) >= 3 AND mean >= 0.6", "context-injection-block BLOCK"), _IF("len(more) >= 3 AND mean >= 0.35 AND mean < 0.6", "context-injection-alert ALERT"), _IF("tokens >= 6000", "token-budget-exceeded BLOCK"), _IF("calls >= 15", "llm-call-budget-exceeded BLOCK"), _IF("cred", "credential-leak-alert ALERT")])} END
    WHEN 'LLM_CALL_END' THEN {_IF("threat", "output-threat-detected ALERT")}
    WHEN 'TOOL_CALL_START' THEN {_JOIN([_IF("flow = 1", "data-exfiltration-attempt BLOCK"), _IF("flow = 2", "data-flow-suspicious ALERT"), _IF("outside", "tool-not-in-baseline BLOCK"), _IF("NOT outside AND uses > 50", "tool-call-loop-protection BLOCK"), _IF("NOT outside AND rce", "rce-in-tool-args BLOCK")])}
    WHEN 'TOOL_CALL_END' THEN CASE WHEN seen >= 80 THEN ['tool-output-injection-block BLOCK'] ELSE {_JOIN([_IF("seen >= 50", "tool-output-injection-alert ALERT"), _IF("felt >= 80", "tool-output-ml-injection-block BLOCK")])} END
    ELSE [] END AS verdicts
  FROM (SELECT *, round(list_avg(more), 9) AS mean FROM (SELECT *, CASE WHEN stop = 6 THEN list_slice(scores || [score], -5, -1) ELSE scores END AS more, used + CASE WHEN t = 'TOOL_CALL_START' AND NOT outside THEN 1 ELSE 0 END AS uses
  FROM (SELECT sig.*, prompt, tools, marked, scores, tokens, calls, used, CASE WHEN t <> 'LLM_CALL_START' THEN 0 WHEN depth > 10 THEN 1 WHEN marked THEN 2 WHEN p <> prompt THEN 3 WHEN d <> tools THEN 4 WHEN bad THEN 5 ELSE 6 END AS stop FROM st JOIN sig ON sig.session_id = st.session_id AND sig.n = st.n + 1)))))
), passed AS (
  SELECT sig.agent_id, session_id, n AS sequence_number, sig.timestamp_ns, sig.t AS event_type FROM st JOIN sig USING (session_id, n) WHERE len(list_filter(said, lambda x: x LIKE '% BLOCK')) = 0
)"""
_BODY = ORACLE["markov_scores"].removeprefix(_with()).replace(" FROM log\n", " FROM passed\n", 1).rsplit("SELECT *, probability", 1)[0]
#: The rules in the order in which they are asked; those of a policy come after them.
_PLACES = "['spawn-depth-exceeded', 'ml-classifier-injection-block', 'tool-output-injection-block', 'tool-output-injection-alert', 'tool-output-ml-injection-block', 'system-prompt-mutation', 'tool-set-mutation', 'mcp-tool-definition-block', 'mcp-tool-definition-alert', 'context-injection-block', 'context-injection-alert', 'token-budget-exceeded', 'llm-call-budget-exceeded', 'markov-anomalous-transition', 'ml-classifier-injection-alert', 'output-threat-detected', 'data-exfiltration-attempt', 'data-flow-suspicious', 'tool-not-in-baseline', 'isolation-forest-anomaly']"

SQL = {
    "taint_flow": _with() + """, m AS (SELECT *, 'AKIA' || upper(substr(sha256('key' || session_id), 1, 16)) AS a, 'ghp_' || upper(substr(sha256('token' || session_id), 1, 36)) AS b FROM log), w AS (
      SELECT session_id, a AS value, min(sequence_number) - 1 AS since FROM m WHERE event_type = 'LLM_CALL_START' AND CAST(substr(session_id, 6) AS BIGINT) % 3 <> 2 GROUP BY ALL
      UNION ALL SELECT session_id, b, min(sequence_number) FROM m WHERE event_type = 'TOOL_CALL_END' AND k % 4 = 0 GROUP BY ALL
    ) SELECT m.session_id, sequence_number, CASE WHEN k % 5 = 0 THEN 'http_get' ELSE 'lookup' END AS tool_name, value, CASE WHEN k % 5 = 0 OR k % 2 = 0 THEN 'BLOCK' ELSE 'ALERT' END AS action
      FROM m JOIN w ON w.session_id = m.session_id AND value = CASE k % 3 WHEN 0 THEN a WHEN 1 THEN b END AND since < sequence_number WHERE event_type = 'TOOL_CALL_START'""",
    "interception_stages": "WITH RECURSIVE " + LOG.strip() + ", " + _SIGNALS + ", " + _STATE + _BODY + f""", v AS (
      SELECT session_id, n AS sequence_number, split_part(u, ' ', 1) AS rule_name, split_part(u, ' ', 2) AS action FROM (SELECT session_id, n, unnest(said) AS u FROM st)
      UNION ALL SELECT session_id, sequence_number, 'markov-anomalous-transition', 'ALERT' FROM q WHERE probability < 0.05 AND event_type IN ('LLM_CALL_START', 'AGENT_FINISH')
    ) SELECT *, coalesce(CAST(list_position({_PLACES}, rule_name) AS BIGINT), 21) AS place FROM v"""
}
