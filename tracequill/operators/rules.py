"""Declarative rules compiled to columns.

A rule has a name, event types ("*" for all), conditions that must all hold, an action, and may be
off. Rules are tried in order: ALLOW drops all verdicts and ends, BLOCK ends, others add up. Rules that can't be compiled are left out.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    event_types: tuple[str, ...] = ("*",)
    conditions: tuple[tuple[str, str, object], ...] = ()
    enabled: bool = True
    reason: str = ""
    tools: tuple[str, ...] = ()
    except_tools: tuple[str, ...] = ()
    agents: tuple[str, ...] = ()
    arguments: tuple[tuple[str, str, object], ...] = field(default=())


#: The default rules, in order: loops, personal data, latency, provider errors, injection, credentials, execution, network, budgets. Those that are off are found by operators of their own.
DEFAULT = (
    Rule("tool-call-loop-protection", "BLOCK", ("TOOL_CALL_START",), (("tool_call_count", "gt", 50),)),
    Rule("runaway-llm-call-protection", "BLOCK", ("LLM_CALL_START",), (("llm_call_count", "gt", 100),)),
    Rule("pii-in-tool-output", "ALERT", ("TOOL_CALL_END",), (("pii_detected", "not_empty", None),)),
    Rule("pii-in-llm-request", "ALERT", ("LLM_CALL_START",), (("pii_detected", "not_empty", None),)),
    Rule("sensitive-pii-types-critical", "ALERT", ("LLM_CALL_START", "TOOL_CALL_START", "TOOL_CALL_END"), (("pii_detected", "any_in", ["US_SSN", "CREDIT_CARD", "IBAN_CODE", "MEDICAL_LICENSE", "US_PASSPORT"]),)),
    Rule("high-latency-alert", "ALERT", ("LLM_CALL_END",), (("latency_ms", "gt", 30000),)),
    Rule("provider-5xx-error", "ALERT", ("SYSTEM_ERROR",), (("http_status", "gte", 500),)),
    Rule("provider-auth-error", "ALERT", ("SYSTEM_ERROR",), (("http_status", "in", [401, 403]),)),
    Rule("long-session-warning", "ALERT", ("LLM_CALL_START",), (("session_duration_ms", "gt", 3_600_000),)),
    Rule("prompt-injection-block", "BLOCK", ("LLM_CALL_START",), (("injection_score", "gte", 0.80),)),
    Rule("prompt-injection-alert", "ALERT", ("LLM_CALL_START",), (("injection_score", "gte", 0.50), ("injection_score", "lt", 0.80))),
    Rule("credential-leak-alert", "ALERT", ("LLM_CALL_START",), (("credential_detected", "eq", True),)),
    Rule("rce-in-tool-args", "BLOCK", ("TOOL_CALL_START",), (("rce_detected", "eq", True),)),
    Rule("ssrf-cloud-metadata-block", "BLOCK", ("TOOL_CALL_START",), (("ssrf_category", "eq", "cloud_metadata"),)),
    Rule("ssrf-private-ip-alert", "ALERT", ("TOOL_CALL_START",), (("ssrf_detected", "eq", True), ("ssrf_category", "neq", "cloud_metadata"))),
    Rule("context-injection-block", "BLOCK", ("LLM_CALL_START",), (("injection_score", "gte", 0.60),)),
    Rule("context-injection-alert", "ALERT", ("LLM_CALL_START",), (("injection_score", "gte", 0.35),)),
    Rule("token-budget-exceeded", "BLOCK", ("LLM_CALL_START",), enabled=False),
    Rule("llm-call-budget-exceeded", "BLOCK", ("LLM_CALL_START",), enabled=False),
    Rule("system-prompt-mutation", "BLOCK", ("LLM_CALL_START",), enabled=False),
    Rule("spawn-depth-exceeded", "BLOCK", ("LLM_CALL_START",), enabled=False),
)

#: Bundled rules for tools and their arguments. All are off; turn copies on with switched_on().
TOOL_RULES = (
    Rule("block-direct-shell-execution", "BLOCK", ("TOOL_CALL_START",), tools=("execute_shell", "bash", "sh", "run_command", "system_exec", "terminal", "cmd"), enabled=False),
    Rule("block-arbitrary-code-execution", "BLOCK", ("TOOL_CALL_START",), tools=("run_python", "run_code", "eval_code", "execute_code", "repl", "python_exec"), enabled=False),
    Rule("block-database-mutations", "BLOCK", ("TOOL_CALL_START",), tools=("execute_sql", "run_query", "db_write", "db_delete", "db_exec"), enabled=False),
    Rule("block-file-deletion", "BLOCK", ("TOOL_CALL_START",), tools=("delete_file", "remove_file", "unlink", "rm", "move_to_trash"), enabled=False),
    Rule("restrict-data-agent-to-read-only", "BLOCK", ("TOOL_CALL_START",), tools=("*",), agents=("data-agent", "analytics-bot"), except_tools=("search_web", "read_file", "list_directory", "query_db_readonly", "get_schema"), enabled=False),
    Rule("restrict-customer-agent", "BLOCK", ("TOOL_CALL_START",), tools=("*",), agents=("customer-support-agent",), except_tools=("search_knowledge_base", "get_ticket", "create_ticket", "send_email"), enabled=False),
    Rule("block-path-traversal-in-file-ops", "BLOCK", ("TOOL_CALL_START",), tools=("read_file", "write_file", "list_directory", "open_file"), arguments=(("path", "matches_regex", r"\.\."),), enabled=False),
    Rule("block-write-to-system-paths", "BLOCK", ("TOOL_CALL_START",), tools=("write_file", "create_file", "append_file"), arguments=(("path", "matches_regex", "^/(etc|bin|sbin|usr/bin|boot|dev|proc|sys)"),), enabled=False),
    Rule("alert-on-external-url-in-tool", "ALERT", ("TOOL_CALL_START",), tools=("http_request", "web_fetch", "curl", "api_call"), arguments=(("url", "not_empty", None),), enabled=False),
    Rule("alert-on-email-send", "ALERT", ("TOOL_CALL_START",), tools=("send_email", "send_message", "post_to_slack", "create_calendar_event"), enabled=False),
    Rule("alert-on-payment-tool", "ALERT", ("TOOL_CALL_START",), tools=("charge_card", "process_payment", "create_invoice", "transfer_funds"), enabled=False),
)


def switched_on(rules: tuple[Rule, ...], *names: str) -> tuple[Rule, ...]:
    """The rules with those of the names (all, if none is given) turned on."""
    return tuple(replace(r, enabled=True) if not names or r.name in names else r for r in rules)


#: Fields of conditions by name, where they are found and what they count as where they are missing.
FIELDS = {
    "event_type": ("column", None), "pii_detected": ("column", None), "provider": ("column", None), "model": ("column", None), "sequence_number": ("column", 0), "agent_id": ("column", None),
    "tool_name": ("payload", None), "latency_ms": ("payload", None), "finish_reason": ("payload", None), "http_status": ("payload", None), "error_message": ("payload", ""),
    "tool_call_count": ("column", 0), "llm_call_count": ("column", 0), "session_duration_ms": ("column", 0),
    "injection_score": ("security", 0.0), "credential_detected": ("security", False), "rce_detected": ("security", False), "rce_confidence": ("security", 0.0), "ssrf_detected": ("security", False), "ssrf_category": ("security", "none"),
}


def resolve(name: str, columns: list[str]) -> Column:
    """A field by name: a column, a payload field or a security field, with the default of its name; unknown names are null."""
    place, default = FIELDS.get(name, ("", None))
    or_default = lambda c: c if default is None else F.coalesce(c, F.lit(default)) if isinstance(default, (int, float)) and not isinstance(default, bool) else F.coalesce(c, F.lit(str(default).lower() if isinstance(default, bool) else default).cast("string"))
    security = lambda key: F.coalesce(F.get_json_object("security", "$." + key) if "security" in columns else F.lit(None).cast("string"), F.get_json_object("payload", "$.security." + key))
    if name in columns:
        return or_default(F.col(name).cast("string") if isinstance(default, bool) else F.col(name))
    if name.startswith("payload.") or place == "payload":
        return or_default(F.get_json_object("payload", "$." + name.removeprefix("payload.")))
    if name.startswith("security.") or place == "security":
        found = security(name.removeprefix("security."))
        return or_default(found.try_cast("double") if isinstance(default, float) else found)
    return F.lit(default) if isinstance(default, int) else F.lit(None).cast("string")


def compare(c: Column, op: str, value: object, is_array: bool = False) -> Column:
    """One condition. What can't be compared is false; not_in of null is true; '' and 0 and empty lists are empty."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    text, double = c.cast("string"), c.cast("string").try_cast("double")
    words = [x for x in value] if isinstance(value, (list, tuple)) else [value]
    same = lambda v: (double == float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else (text == (str(v).lower() if isinstance(v, bool) else str(v)))
    one_of = lambda: reduce(lambda a, b: a | b, [F.coalesce(same(v), F.lit(False)) for v in words], F.lit(False))
    if is_array:
        has = F.arrays_overlap(c, F.array(*[F.lit(str(v)) for v in words])) if value is not None else F.lit(False)
        out = {"not_empty": F.size(c) > 0, "empty": c.isNull() | (F.size(c) == 0), "any_in": has, "contains": has, "not_contains": ~has}[op]
    elif op in ("gt", "gte", "lt", "lte"):
        if not number:
            raise ValueError(f"{op} needs a number")
        out = {"gt": double > value, "gte": double >= value, "lt": double < value, "lte": double <= value}[op]
    elif op == "eq":
        out = same(value)
    elif op == "neq":
        return ~F.coalesce(same(value), F.lit(False))
    elif op == "in" or op == "any_in":
        out = one_of()
    elif op == "not_in":
        return ~one_of()
    elif op == "contains":
        out = F.contains(text, F.lit(str(value)))
    elif op == "not_contains":
        return ~F.coalesce(F.contains(text, F.lit(str(value))), F.lit(False))
    elif op in ("empty", "not_empty"):
        gone = c.isNull() | text.isin("", "0", "0.0", "false", "[]", "{}")
        return gone if op == "empty" else ~gone
    elif op == "matches_regex":
        out = F.regexp_like(text, F.lit(str(value)))
    else:
        raise ValueError(f"no operator {op}")
    return F.coalesce(out, F.lit(False))


def _holds(rule: Rule, df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    out = F.lit(True) if "*" in rule.event_types else F.col("event_type").isin(*rule.event_types)
    for name, op, value in rule.conditions:
        out = out & compare(resolve(name, df.columns), op, value, kinds.get(name, "").startswith("array"))
    if rule.tools and "*" not in rule.tools:
        out = out & F.col("tool_name").isin(*rule.tools)
    if rule.except_tools:
        out = out & ~F.col("tool_name").isin(*rule.except_tools)
    if rule.agents and "*" not in rule.agents:
        out = out & F.col("agent_id").isin(*rule.agents)
    for name, op, value in rule.arguments:
        out = out & compare(F.get_json_object("tool_input", f"$.{name}"), op, value)
    return F.coalesce(out, F.lit(False))


def _hits(df: DataFrame, rules: tuple[Rule, ...]) -> list[Column]:
    """For each rule that is on and can be compiled, its verdict where it holds."""
    verdicts = []
    for r in rules:
        if not r.enabled:
            continue
        try:
            verdicts.append(F.when(_holds(r, df), F.struct(F.lit(len(verdicts)).alias("place"), F.lit(r.name).alias("rule_name"), F.lit(r.action).alias("action"))))
        except (ValueError, KeyError):
            continue  # a rule that can't be compiled
    return verdicts


def verdict_list(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT) -> Column:
    """What evaluate() says of a row as one column of its own: an array of rule_name and action, in order, empty where no rule holds."""
    none = F.array().cast("array<struct<rule_name:string,action:string>>")
    verdicts = _hits(df, rules)
    if not verdicts:
        return none

    def cut(v: Column) -> Column:
        end = F.array_position(F.transform(v, lambda x: x["action"].isin("ALLOW", "BLOCK")), True).cast("int")
        kept = F.when(end > 0, F.slice(v, 1, end)).otherwise(v)
        return F.when(F.exists(kept, lambda x: x["action"] == "ALLOW"), none).otherwise(F.transform(kept, lambda x: F.struct(x["rule_name"], x["action"])))

    return F.transform(F.array(F.array_compact(F.array(*verdicts))), cut)[0]


def evaluate(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT, keep: tuple[str, ...] = ("session_id", "sequence_number")) -> DataFrame:
    """One row per verdict: the kept columns, rule_name, action and place. All rules are columns of one projection."""
    verdicts = _hits(df, rules)
    if not verdicts:
        return df.select(*keep, F.lit("").alias("rule_name"), F.lit("").alias("action"), F.lit(0).alias("place")).limit(0)
    hits = F.array_compact(F.array(*verdicts))
    end = F.array_position(F.transform(F.col("_v"), lambda v: v["action"].isin("ALLOW", "BLOCK")), True)
    rows = df.select(*keep, hits.alias("_v")).where(F.size("_v") > 0)
    cut = rows.withColumn("_v", F.when(end > 0, F.slice("_v", 1, end.cast("int"))).otherwise(F.col("_v")))
    cut = cut.where(~F.exists("_v", lambda v: v["action"] == "ALLOW"))
    return cut.select(*keep, F.explode("_v").alias("v")).select(*keep, "v.rule_name", "v.action", F.col("v.place").cast("long").alias("place"))


def load(text: str) -> tuple[Rule, ...]:
    """Rules from a JSON list; entries without name or action are left out."""
    out = []
    for r in json.loads(text):
        if r.get("name") and r.get("action"):
            out.append(Rule(r["name"], r["action"], tuple(r.get("event_types", ["*"])), tuple((c["field"], c["op"], c.get("value")) for c in r.get("conditions", [])), r.get("enabled", True), r.get("reason", ""), tuple(r.get("tools", [])), tuple(r.get("except_tools", [])), tuple(r.get("agents", [])), tuple((c["field"], c["op"], c.get("value")) for c in r.get("arg_conditions", []))))
    return tuple(out)


#: Rules by the severity of their alerts.
CRITICAL = ("canary-leak", "canary-token-leak", "data-exfiltration-attempt", "system-prompt-mutation", "credential-in-llm-response")
HIGH = ("spawn-depth-exceeded", "ml-injection-block", "tool-call-loop-protection", "pii-in-llm-request", "rag-poisoning-block", "unicode-stego-block", "rce-attempt", "ssrf-attempt", "data-flow-suspicious")
MEDIUM = ("high-injection-score", "injection-score-alert", "rag-poisoning-alert", "goal-drift-alert", "intent-scope-violation", "consequence-high-risk", "context-injection-alert")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity(rule: Column, action: Column) -> Column:
    """Critical rules first, then what was blocked, then the other named rules; an action that is null counts as an alert."""
    act = F.upper(F.coalesce(action, F.lit("ALERT")))
    return F.when(rule.isin(*CRITICAL), "CRITICAL").when((act == "BLOCK") | rule.isin(*HIGH), "HIGH").when(rule.isin(*MEDIUM) | (act == "ALERT"), "MEDIUM").otherwise("LOW")


def meets(level: Column, least: str = "MEDIUM") -> Column:
    """Whether an alert of this severity is sent at all."""
    return level.isin(*SEVERITIES[SEVERITIES.index(least) :])


def channels(level: Column) -> Column:
    """Where an alert goes."""
    return F.when(level == "CRITICAL", "slack,email,pagerduty,webhook").when(level == "HIGH", "slack,email,pagerduty").when(level == "MEDIUM", "slack").otherwise("")


def dedup_key(rule: Column, session: Column, ns: Column) -> Column:
    """One key per rule, session and hour."""
    hour = F.floor(ns / (3600 * 10**9)).cast("long").cast("string")
    return F.substring(F.sha2(F.concat_ws("|", rule, session, hour), 256), 1, 32)


def signature(body: Column, secret: str) -> Column:
    """HMAC-SHA-256 of a webhook's body, in hex: by its definition, over built-in hashes."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: bytes(b ^ x for b in key.ljust(64, b"\0"))
    inner = F.unhex(F.sha2(F.concat(F.lit(pad(0x36)), F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(pad(0x5C)), inner), 256)


def alert_bodies(alerts: DataFrame, secret: str | None = None, least: str = "MEDIUM") -> DataFrame:
    """What would be sent for each violation: one row per channel with its body and, for webhooks, the signature. Nothing is sent.

    alerts: event_id, rule_name, action, reason, session_id, agent_id, timestamp_ns.
    """
    level = severity(F.col("rule_name"), F.col("action"))
    rows = alerts.withColumn("severity", level).where(meets(F.col("severity"), least)).withColumn("channel", F.explode(F.split(channels(F.col("severity")), ",")))
    title = F.concat(F.lit("["), "severity", F.lit("] "), "rule_name", F.lit(" ("), "action", F.lit(")"))
    fields = F.struct("rule_name", "action", "severity", "reason", "session_id", "agent_id", "timestamp_ns")
    text = F.concat(title, F.lit(": "), F.coalesce("reason", F.lit("")), F.lit(" session="), "session_id", F.lit(" agent="), "agent_id")
    body = (
        F.when(F.col("channel") == "slack", F.to_json(F.struct(text.alias("text"))))
        .when(F.col("channel") == "email", F.concat(F.lit("Subject: "), title, F.lit("\n\n"), text))
        .when(F.col("channel") == "pagerduty", F.to_json(F.struct(F.lit("trigger").alias("event_action"), dedup_key(F.col("rule_name"), F.col("session_id"), F.col("timestamp_ns")).alias("dedup_key"), F.struct(title.alias("summary"), F.lower("severity").alias("severity"), fields.alias("custom_details")).alias("payload"))))
        .otherwise(F.to_json(fields))
    )
    rows = rows.withColumn("body", body)
    sign = F.when(F.col("channel") == "webhook", signature(F.col("body"), secret)) if secret else F.lit(None).cast("string")
    return rows.select("event_id", "severity", "channel", "body", sign.alias("signature"))


#: Rules that code fires, in the order in which a request meets them. The rules of a policy come after them.
ORDER = (
    "spawn-depth-exceeded", "ml-classifier-injection-block", "tool-output-injection-block", "tool-output-injection-alert", "tool-output-ml-injection-block", "system-prompt-mutation", "tool-set-mutation", "mcp-tool-definition-block", "mcp-tool-definition-alert",
    "context-injection-block", "context-injection-alert", "token-budget-exceeded", "llm-call-budget-exceeded", "markov-anomalous-transition", "ml-classifier-injection-alert", "output-threat-detected", "data-exfiltration-attempt", "data-flow-suspicious", "tool-not-in-baseline", "isolation-forest-anomaly",
)


def in_order(verdicts: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Verdicts of several operators (session_id, sequence_number, rule_name, action) as one request meets them: place by the order, others last, none after the first block of an event."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("rule_name"))
    rows = verdicts.select("session_id", "sequence_number", "rule_name", "action", F.when(place > 0, place).otherwise(len(order) + 1).cast("long").alias("place"))
    w = Window.partitionBy("session_id", "sequence_number")
    first = F.min(F.when(F.col("action") == "BLOCK", F.struct("place", "rule_name"))).over(w)
    return rows.withColumn("_stop", first).where("_stop IS NULL OR struct(place, rule_name) <= _stop").drop("_stop")
