"""Order-sensitive and statistical operators over sessions and agents."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.functions.text_scans import credentials
from tracequill.operators import running
from tracequill.operators.metrics import cents, is_, scoped
from tracequill.sources.audit_log import typed

#: Personal data that counts as sensitive.
SENSITIVE = ("US_SSN", "CREDIT_CARD", "IBAN_CODE", "MEDICAL_LICENSE")
#: Prior transition counts.
PRIORS = {
    ("LLM_CALL_START", "LLM_CALL_END"): 70, ("LLM_CALL_END", "TOOL_CALL_START"): 40, ("LLM_CALL_END", "AGENT_FINISH"): 55, ("LLM_CALL_END", "LLM_CALL_START"): 15, ("TOOL_CALL_END", "LLM_CALL_START"): 90,
    ("TOOL_CALL_START", "TOOL_CALL_END"): 85, ("LLM_CALL_START", "SYSTEM_ERROR"): 5, ("TOOL_CALL_START", "SYSTEM_ERROR"): 3, ("AGENT_FINISH", "LLM_CALL_START"): 5, ("CHECKPOINT", "LLM_CALL_START"): 8,
}
STATES = 8


def _by_session(rows: tuple[int, int] | None = None):
    w = Window.partitionBy("session_id").orderBy("sequence_number")
    return w.rowsBetween(*rows) if rows else w


def _flag(rule: str, severity: str, n, seq=None):
    return [F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), n.cast("long").alias("measure"), (seq if seq is not None else F.lit(None)).cast("long").alias("sequence_number")]


#: Thresholds of the session rules.
ERRORS, LOOP, SLOW_MS, CALLS = 3, 5, 30_000, 20
_KEYS = ["org_id", "agent_id", "session_id"]
_FLAGS = [*_KEYS, "rule_id", "severity", "measure", "sequence_number"]


def _event_flags(events: DataFrame) -> DataFrame:
    """Flags of single events: slow calls, and sensitive data in the output of tools."""
    hit = F.size(F.array_intersect("pii_detected", F.array(*[F.lit(x) for x in SENSITIVE])))
    slow = F.get_json_object("payload", "$.latency_ms").try_cast("double")
    found = F.when(is_("LLM_CALL_END") & (slow > SLOW_MS), F.struct(*_flag("LONG_LATENCY", "low", slow, F.col("sequence_number")))).when(is_("TOOL_CALL_END") & (hit > 0), F.struct(*_flag("SENSITIVE_PII_IN_TOOL_OUTPUT", "high", hit, F.col("sequence_number"))))
    return events.select(*_KEYS, found.alias("f")).where("f IS NOT NULL").select(*_KEYS, "f.*")


def _session_flags(events: DataFrame) -> DataFrame:
    """Flags of whole sessions with what they rest on, from one grouping: errors, loops of one tool, runaways, changes of the model."""
    tool = F.when(is_("TOOL_CALL_START"), F.coalesce(F.get_json_object("payload", "$.tool_name"), F.lit("unknown")))
    named = F.coalesce(F.col("model") != "", F.lit(False))  # the models of all events count, whatever their type
    new = named & F.coalesce(F.last(F.when(named, F.col("model")), ignorenulls=True).over(_by_session((Window.unboundedPreceding, -1))) != F.col("model"), F.lit(True))
    rows = events.select(*_KEYS, "sequence_number", "event_type", "model", tool.alias("tool_name"), new.alias("new"))
    # by tool first, so that one more grouping gives the counts of each tool without lists of all calls
    per_tool = rows.groupBy(*_KEYS, "tool_name").agg(F.count("*").alias("n"), F.count_if(is_("SYSTEM_ERROR")).alias("errors"), F.max(F.when(is_("SYSTEM_ERROR"), F.col("sequence_number"))).alias("last_error"), F.count_if(is_("LLM_CALL_START")).alias("calls"), F.count_if(is_("AGENT_FINISH")).alias("ends"), F.collect_list(F.when(F.col("new"), F.struct("sequence_number", "model"))).alias("models"))
    s = per_tool.groupBy(*_KEYS).agg(F.sum("errors").alias("errors"), F.max("last_error").alias("last_error"), F.sum("calls").alias("calls"), F.sum("ends").alias("ends"), F.array_sort(F.flatten(F.collect_list("models"))).alias("models"), F.collect_list(F.when(F.col("tool_name").isNotNull() & (F.col("n") > LOOP), F.struct("tool_name", "n"))).alias("loops"))
    one = lambda cond, *flag, what=None: F.when(cond, F.struct(*_flag(*flag), (what if what is not None else F.lit(None).cast("string")).alias("what")))
    names = F.array_join(F.transform("models", lambda x: x["model"]), ">")
    found = F.array(
        one(F.col("errors") >= ERRORS, "HIGH_ERROR_RATE", "high", F.col("errors"), F.col("last_error")),
        one((F.col("calls") >= CALLS) & (F.col("ends") == 0), "RUNAWAY_AGENT", "high", F.col("calls")),
        one(F.size("models") > 1, "MODEL_SWITCH", "low", F.size("models"), what=names),
    )
    loops = F.transform("loops", lambda x: F.struct(*_flag("TOOL_CALL_LOOP", "medium", x["n"]), x["tool_name"].alias("what")))
    return s.select(*_KEYS, F.explode(F.array_compact(F.concat(found, loops))).alias("f")).select(*_KEYS, "f.*")


def _of_rule(flags: DataFrame, rule: str, what: str | None = None) -> DataFrame:
    return flags.where(F.col("rule_id") == rule).select(*_FLAGS, *([F.col("what").alias(what)] if what else []))


def high_error_rate(events: DataFrame) -> DataFrame:
    return _of_rule(_session_flags(events), "HIGH_ERROR_RATE")


def tool_loop(events: DataFrame) -> DataFrame:
    return _of_rule(_session_flags(events), "TOOL_CALL_LOOP", "tool_name")


def long_latency(events: DataFrame) -> DataFrame:
    return _of_rule(_event_flags(events), "LONG_LATENCY")


def sensitive_pii(events: DataFrame) -> DataFrame:
    return _of_rule(_event_flags(events), "SENSITIVE_PII_IN_TOOL_OUTPUT")


def runaway(events: DataFrame) -> DataFrame:
    return _of_rule(_session_flags(events), "RUNAWAY_AGENT")


def model_switch(events: DataFrame) -> DataFrame:
    """Sessions whose events change the model; runs of the same model count once."""
    return _of_rule(_session_flags(events), "MODEL_SWITCH", "models")


def anomalies(events: DataFrame) -> DataFrame:
    """All session rules as one table of flags: one pass over single events, one over sessions."""
    return _event_flags(events).select(*_FLAGS).unionAll(_session_flags(events).select(*_FLAGS))


def broken_chains(checked: DataFrame) -> DataFrame:
    """The rule on chains: a critical flag for each session whose links fail. checked: the result of chain.first_failures."""
    return checked.where("NOT valid").select("session_id", *_flag("CHAIN_INTEGRITY", "critical", F.lit(1), F.col("failed_at")))


def baselines(events: DataFrame, org: str | None = None) -> DataFrame:
    """Means per agent over its sessions that finished: calls, tool calls, duration."""
    s = scoped(events, org).groupBy("org_id", "agent_id", "session_id").agg(
        F.count_if(is_("LLM_CALL_START")).alias("llm"), F.count_if(is_("TOOL_CALL_START")).alias("tool"), (F.max("timestamp_ns") - F.min("timestamp_ns")).alias("ns"), F.count_if(is_("AGENT_FINISH")).alias("finished")
    )
    return s.where("finished > 0").groupBy("org_id", "agent_id").agg(F.count("*").alias("session_count"), cents(F.avg("llm")).alias("mean_llm"), cents(F.avg("tool")).alias("mean_tool"), cents(F.avg(F.col("ns") / 1e6)).alias("mean_ms"))


def drift(events: DataFrame, org: str | None = None, over: float = 3.0) -> DataFrame:
    """Sessions whose calls are far from their agent's mean: |x - mean| / (mean / 2)."""
    s = scoped(events, org).groupBy("org_id", "agent_id", "session_id").agg(F.count_if(is_("LLM_CALL_START")).alias("llm"))
    b = baselines(events, org).select("org_id", "agent_id", "session_count", "mean_llm")
    z = (F.col("llm") - F.col("mean_llm")) / (F.col("mean_llm") * 0.5)
    return s.join(b, ["org_id", "agent_id"]).where("session_count >= 5 AND mean_llm <> 0").select("session_id", "llm", cents(z).alias("z"), (F.abs(z) > over).alias("drifts"))


def rolling_injection(events: DataFrame, window: int = 5, least: int = 3, alert: float = 0.35, block: float = 0.60) -> DataFrame:
    e = typed(events.where(is_("LLM_CALL_START"))).select("session_id", "sequence_number", "injection_score")
    w = _by_session((-(window - 1), 0))
    e = e.withColumns({"n": F.count("*").over(w), "mean": F.avg(F.col("injection_score").cast("decimal(9,4)")).over(w).cast("double")})
    mean = F.round(F.col("mean").cast("decimal(18,6)"), 4).cast("double")
    return e.where(F.col("n") >= least).select("session_id", "sequence_number", mean.alias("rolling_mean"), F.when(mean >= block, "BLOCK").when(mean >= alert, "ALERT").otherwise("PASS").alias("verdict"))


def running_counters(events: DataFrame) -> DataFrame:
    """Cumulative calls, tokens, errors, and the session's age at each event."""
    w = _by_session((Window.unboundedPreceding, 0))
    e = typed(events)
    return e.select(
        "session_id", "sequence_number",
        F.sum(is_("LLM_CALL_START").cast("long")).over(w).alias("llm_calls"), F.sum(is_("TOOL_CALL_START").cast("long")).over(w).alias("tool_calls"), F.sum(is_("SYSTEM_ERROR").cast("long")).over(w).alias("errors"),
        F.sum(F.when(is_("LLM_CALL_END"), F.col("total_tokens")).otherwise(0)).over(w).alias("tokens"), (F.col("timestamp_ns") - F.min("timestamp_ns").over(w)).alias("age_ns"),
    )


def budget_limits(events: DataFrame, tokens: int = 0, calls: int = 0) -> DataFrame:
    """The first event of a session at which a cap is reached; 0 turns a cap off."""
    c = running_counters(events)
    hit = F.when((F.lit(tokens) > 0) & (F.col("tokens") >= tokens), "token-budget-exceeded").when((F.lit(calls) > 0) & (F.col("llm_calls") >= calls), "llm-call-budget-exceeded")
    return c.withColumn("rule_name", hit).where("rule_name IS NOT NULL").groupBy("session_id", "rule_name").agg(F.min("sequence_number").alias("sequence_number"))


def markov(events: DataFrame, low: float = 0.05) -> DataFrame:
    """Probability of each transition from the agent's counts before it and the priors, smoothed by 0.01 over eight states.

    Each agent starts with the priors, which alone are more than the five observations that its own matrix needs, so no other matrix is ever asked.
    """
    steps = events.select("agent_id", "session_id", "sequence_number", "timestamp_ns", "event_type", F.lag("event_type").over(_by_session()).alias("before")).where("before IS NOT NULL")
    order, one = ["timestamp_ns", "session_id", "sequence_number"], F.lit(1)
    steps = running.running_sums(steps, ["agent_id", "before"], F.col("timestamp_ns"), order, {"of_row": one})
    steps = running.running_sums(steps, ["agent_id", "before", "event_type"], F.col("timestamp_ns"), order, {"of_cell": one})
    prior, total = F.lit(0), F.lit(0)
    for (a, b), n in PRIORS.items():
        prior = F.when((F.col("before") == a) & (F.col("event_type") == b), n).otherwise(prior)
    for a in dict.fromkeys(a for a, _ in PRIORS):
        total = F.when(F.col("before") == a, sum(n for (x, _), n in PRIORS.items() if x == a)).otherwise(total)
    seen, of = F.col("of_cell") + prior, F.col("of_row") + total
    p = F.when(of == 0, 1.0 / STATES).otherwise((seen + 0.01) / (of + 0.01 * STATES))
    out = steps.select("session_id", "sequence_number", "before", "event_type", F.round(p.cast("decimal(18,9)"), 6).cast("double").alias("probability"))
    return out.withColumn("anomalous", F.col("probability") < low)


def isolation_forest(features: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: Spark draws a bounded sample of sessions, the trees are fitted to it, and every session is scored in its task.

    score = 0.5 - 2^(-mean depth / c) is below 0 for outliers.
    """
    names = [c for c in features.columns if c != "session_id"]
    rows = features.select("session_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    drawn = np.array([list(r) for r in rows.orderBy(F.xxhash64("session_id", F.lit(seed))).select(*names).limit(sample).collect()], float)  # at most `sample` rows
    rng = np.random.default_rng(seed)
    deepest = max(1, int(np.ceil(np.log2(max(2, len(drawn))))))

    def average(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
        if depth >= deepest or len(x) < 2 or not len(spread):
            return depth + average(len(x))
        f = int(rng.choice(spread))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        return f, cut, grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1)

    forest = [grow(drawn[rng.permutation(len(drawn))[: max(1, len(drawn) * 3 // 4)]], 0) for _ in range(trees)] if len(drawn) else []
    usual = average(max(2, len(drawn) * 3 // 4)) or 1.0

    def depths(node, x: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        out, left = np.empty(len(x)), x[:, node[0]] < node[1]
        out[left], out[~left] = depths(node[2], x[left]), depths(node[3], x[~left])
        return out

    def run(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        mean = sum((depths(t, x) for t in forest), np.zeros(len(x))) / max(1, len(forest))
        return pd.Series(0.5 - 2.0 ** (-mean / usual))

    raw = F.pandas_udf(run, "double")(*names)
    return rows.select("session_id", raw.alias("raw_score")).select("session_id", "raw_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 - F.col("raw_score"))).alias("anomaly_score"), (F.col("raw_score") < 0).alias("is_anomaly"))


#: Names of tools and of arguments that send data out.
SINK_WORDS = ("curl", "discord", "email", "export", "fetch", "forward", "http", "mail", "notify", "publish", "push", "relay", "request", "send", "slack", "sms", "teams", "upload", "webhook")
SINK_NAMES = f"(?i){'|'.join(SINK_WORDS)}"
SINK_KEYS = ("url", "endpoint", "webhook", "webhook_url", "uri", "destination", "target", "to", "recipient", "address", "server", "api_url", "base_url", "callback", "callback_url")


def is_sink(tool: Column, arguments: Column) -> Column:
    """Whether a tool sends data out, by its name or by the top keys of its JSON arguments."""
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    return F.regexp_like(tool, F.lit(SINK_NAMES)) | F.arrays_overlap(keys, F.array(*[F.lit(k) for k in SINK_KEYS]))


def tainted_values(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """session_id, sequence_number, value: credentials in a session's first system prompt and in the results of its tools. prompts, outputs: session_id, sequence_number, text."""
    w = Window.partitionBy("session_id").orderBy("sequence_number")
    first = prompts.withColumn("n", F.row_number().over(w)).where("n = 1").select("session_id", F.col("sequence_number") - 1, "text")
    rows = first.unionAll(outputs.select("session_id", "sequence_number", "text")).toDF("session_id", "sequence_number", "text")
    return rows.select("session_id", "sequence_number", F.explode(credentials(F.col("text"))).alias("c")).select("session_id", "sequence_number", "c.value", "c.label")


def taint_hits(outputs: DataFrame, calls: DataFrame, sink: str = SINK_NAMES) -> DataFrame:
    """Tool arguments that hold a value tainted earlier in the session: BLOCK in a network sink, else ALERT.

    outputs: session_id, sequence_number, value. calls: session_id, sequence_number, tool_name, argument. The session is the join's key, containment its residue.
    """
    t = outputs.where(F.length("value") >= 8).groupBy("session_id", "value").agg(F.min("sequence_number").alias("t_seq"))
    hit = calls.join(t, "session_id").where((F.col("t_seq") < F.col("sequence_number")) & (F.instr("argument", F.col("value")) > 0))
    out = F.col("sink") if "sink" in calls.columns else F.col("tool_name").rlike(sink)
    return hit.select("session_id", "sequence_number", "tool_name", "value", F.when(out, "BLOCK").otherwise("ALERT").alias("action"))


def spawn_roots(operations: DataFrame) -> DataFrame:
    """session_id, root_id: the top of each session's spawn tree, by pointer doubling with joins.

    A session's parent is that of its first operation, and counts only if it was seen before, as in the fold of trust_scores; so there are no cycles.
    """
    first = operations.groupBy("session_id").agg(F.min(F.struct(*_TRUST_ORDER)).alias("f"))
    seen = first.select("session_id", F.struct("f.seq", "session_id").alias("at"), F.col("f.parent_session_id").alias("up"))
    before = seen.select(F.col("session_id").alias("up"), F.col("at").alias("up_at"))
    up = seen.join(before, "up", "left").select("session_id", F.when(F.col("up_at") < F.col("at"), F.col("up")).otherwise(F.col("session_id")).alias("root_id"))
    up = up.persist()
    while True:
        higher = up.select(F.col("session_id").alias("root_id"), F.col("root_id").alias("next"))
        moved = up.join(higher, "root_id").select("session_id", F.col("next").alias("root_id"), (F.col("next") != F.col("root_id")).alias("moved")).persist()
        if moved.where("moved").isEmpty():
            return up
        up = moved.select("session_id", "root_id")


_TRUST_ORDER = ("seq", "session_id", "op", "action", "injection_score", "parent_session_id")


def trust_scores(operations: DataFrame) -> DataFrame:
    """Trust at the end of each session of a spawn tree.

    operations: seq, session_id, parent_session_id, op (register, violation, canary, clean), action, injection_score. A BLOCK costs 0.05 (0.40 in
    all) and 0.30 times the score, an ALERT 0.09 times the score, a canary 0.60; descendants lose half of a loss over 0.01, or all of a canary's; a clean call gives
    0.005 back. Losses depend on what was before, so a tree is folded in order, batch by batch; only its sessions are held in memory.
    """

    def run(batches):
        root: str | None = None
        trust: dict[str, float] = {}
        fixed: dict[str, float] = {}
        children: dict[str, list[str]] = {}

        def lower(s: str, x: float) -> None:
            trust[s] = max(0.0, min(1.0, trust[s] - x))

        def below(s: str):
            todo = list(children.get(s, ()))
            while todo:
                d = todo.pop()
                yield d
                todo += children.get(d, ())

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(trust), pa.string()), pa.array([round(v, 6) for v in trust.values()], pa.float64())], ["session_id", "trust"])

        for b in batches:
            for now, s, p, op, action, score in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if now != root:
                    if trust:
                        yield ended()
                    root = now
                    trust.clear()
                    fixed.clear()
                    children.clear()
                if s not in trust:
                    if p in trust:
                        children.setdefault(p, []).append(s)
                    trust[s], fixed[s] = trust.get(p, 1.0), 0.0
                score = score if score is not None and score == score else 0.0
                loss = 0.0
                if op == "violation" and action == "BLOCK":
                    step = min(0.05, 0.40 - fixed[s])
                    fixed[s] += step
                    loss = step + 0.30 * score
                elif op == "violation":
                    loss = 0.09 * score
                elif op == "canary":
                    loss = 0.60
                elif op == "clean":
                    trust[s] = min(1.0, trust[s] + 0.005)
                if loss:
                    lower(s, loss)
                    if loss > 0.01:
                        for d in below(s):
                            lower(d, loss if op == "canary" else loss / 2)
        if trust:
            yield ended()

    rows = operations.select(*_TRUST_ORDER).join(spawn_roots(operations), "session_id", "left")
    rows = rows.repartition("root_id").sortWithinPartitions("root_id", *_TRUST_ORDER)
    return rows.select("root_id", "session_id", "parent_session_id", "op", "action", F.col("injection_score").cast("double")).mapInArrow(run, "session_id string, trust double")


def tool_baselines(operations: DataFrame) -> DataFrame:
    """The state of each (org, agent, tool) after its log: the last approval or denial, else pending; observations count."""
    o = F.when(F.col("op") == "approve", "approved").when(F.col("op") == "deny", "denied")
    decided = F.max_by(o, F.when(o.isNotNull(), F.struct("timestamp_ns", "event_id")))
    return operations.groupBy("org_id", "agent_id", "tool_name").agg(F.coalesce(decided, F.lit("pending")).alias("status"), F.count("*").alias("call_count"), F.min("timestamp_ns").alias("first_seen_ns"), F.max("timestamp_ns").alias("last_seen_ns"))


def baselines_summary(tools: DataFrame, org: str | None = None) -> DataFrame:
    t = scoped(tools, org).groupBy("agent_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "denied")], F.count("*").alias("total"), F.max("last_seen_ns").alias("last_seen_ns"))
    return t.withColumn("enforcement_active", F.col("approved") > 0)


def agent_tools(tools: DataFrame, org: str | None = None) -> DataFrame:
    """Tools with the place in which they are listed: pending first, then approved, then the rest, the most used first."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "approved", 1).otherwise(2)
    w = Window.partitionBy("agent_id").orderBy(rank, F.desc("call_count"), "tool_name")
    return scoped(tools, org).select("agent_id", "tool_name", "status", "call_count", F.row_number().over(w).cast("long").alias("place"))


def not_in_baseline(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls of tools that aren't approved, for agents that have some approved tool."""
    ok = tools.where("status = 'approved'").select("org_id", "agent_id", "tool_name")
    strict = ok.select("org_id", "agent_id").distinct()
    return calls.join(strict, ["org_id", "agent_id"], "left_semi").join(ok, ["org_id", "agent_id", "tool_name"], "left_anti")


def mutations(starts: DataFrame, column: str) -> DataFrame:
    """Rows whose value differs from the first of their session. starts: session_id, sequence_number and the column."""
    first = F.first(column, ignorenulls=True).over(_by_session((Window.unboundedPreceding, 0)))
    return starts.withColumn("first_value", first).where(F.col(column) != F.col("first_value")).select("session_id", "sequence_number", F.sha2(F.col(column), 256).substr(1, 16).alias("hash"), F.sha2("first_value", 256).substr(1, 16).alias("first_hash"))


def toolset_changes(starts: DataFrame) -> DataFrame:
    """Tool sets that differ from the session's first: what was added and removed. starts: session_id, sequence_number, tools (array)."""
    first = F.first("tools", ignorenulls=True).over(_by_session((Window.unboundedPreceding, 0)))
    e = starts.withColumn("t0", first).where(F.array_sort("tools") != F.array_sort("t0"))
    return e.select("session_id", "sequence_number", F.array_join(F.array_sort(F.array_except("tools", "t0")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("t0", "tools")), ",").alias("removed"))


def fingerprint(tools_json: str | None) -> str | None:
    """The first 16 hex digits over the sorted names and schemas of a JSON list of tool definitions; the last of a name wins."""
    if tools_json is None:
        return None
    found = {}
    for t in json.loads(tools_json):
        d = t.get("function", t)
        found[d.get("name", "")] = d.get("parameters", d.get("input_schema", {}))
    return hashlib.sha256(json.dumps(found, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def idle_sessions(events: DataFrame, hours: int = 4) -> DataFrame:
    """Stretches of activity of a session, ended by so many idle hours."""
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    w = events.groupBy("session_id", F.session_window(at, f"{hours} hours").alias("w")).agg(F.count("*").alias("events"))
    return w.select("session_id", F.unix_micros(F.col("w.start")).alias("start_us"), "events")


def rate_windows(events: DataFrame, limit: int = 5, seconds: int = 60) -> DataFrame:
    """Requests of a caller within the seconds up to each one; all requests count, admitted or not."""
    rows = events.select("event_id", "agent_id", F.expr("timestamp_ns div 1000").alias("us"))
    return running.sliding_counts(rows, ["agent_id"], F.col("us"), seconds, "in_window").drop("us").withColumn("limited", F.col("in_window") > limit)


#: Tiers of the limiter, in requests a minute.
TIERS = {"read": 300, "ingest": 3000}


def tier_windows(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of a caller and tier within the seconds up to each one, against the tier's limit. requests: request_id, caller, tier, timestamp_ns. All requests count, admitted or not."""
    limit = F.coalesce(*[F.when(F.col("tier") == t, n) for t, n in TIERS.items()])
    rows = requests.select("request_id", "caller", "tier", F.expr("timestamp_ns div 1000").alias("us"))
    return running.sliding_counts(rows, ["caller", "tier"], F.col("us"), seconds, "in_window").drop("us").withColumn("limited", F.col("in_window") > limit)


def flagged_turns(verdicts: DataFrame) -> DataFrame:
    """A turn is blocked if the verdict on the session's turn before it is malicious. verdicts: session_id, sequence_number, label."""
    before = F.lag("label").over(_by_session())
    return verdicts.select("session_id", "sequence_number", before.alias("before")).where("before = 'malicious'").select("session_id", "sequence_number", F.lit("ml-classifier-injection-block").alias("rule_name"), F.lit("BLOCK").alias("action"))


def agent_registry(operations: DataFrame) -> DataFrame:
    """The registry after its log of operations (register, update, delete): the last value of each field since the last registration, without agents deleted since.

    operations: org_id, agent_id, op, name, purpose, tools, owner, timestamp_ns, event_id. A registration of an agent that is registered changes nothing, nor does an update of one that isn't.
    """
    w = Window.partitionBy("org_id", "agent_id").orderBy("timestamp_ns", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op") != "update", F.col("op")), ignorenulls=True).over(before)  # what was last begun or ended
    rows = operations.withColumn("alive", F.coalesce(state == "register", F.lit(False)))
    begins = (F.col("op") == "register") & ~F.col("alive")
    rows = rows.withColumn("life", F.count_if(begins).over(w)).where(begins | (F.col("alive") & F.col("op").isin("update", "delete")))
    at = F.struct("timestamp_ns", "event_id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    lives = rows.groupBy("org_id", "agent_id", "life").agg(*map(latest, ("name", "purpose", "tools", "owner")), F.min("timestamp_ns").alias("registered_ns"), F.max("timestamp_ns").alias("updated_ns"), F.bool_or(F.col("op") == "delete").alias("deleted"))
    return lives.where("NOT deleted").drop("life", "deleted")


def resolved_sessions(requests: DataFrame) -> DataFrame:
    """request_id, first_user_hash and the request that began its session, for requests that name no session.

    requests: request_id, timestamp_ns, messages (structs of role and content). A request with earlier assistant turns goes on with the latest session begun, by a
    request without such turns, by the same first user message; all others begin one.
    """
    first = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"]
    again = F.exists("messages", lambda m: m["role"] == "assistant")
    rows = requests.select("request_id", "timestamp_ns", F.substring(F.sha2(first, 256), 1, 16).alias("first_user_hash"), F.coalesce(again, F.lit(False)).alias("goes_on"))
    at, order = F.col("timestamp_ns"), ["timestamp_ns", "request_id"]
    rows = running.running_sums(rows, ["first_user_hash"], at, order, {"before": F.lit(1)})
    rows = rows.withColumn("begun", F.when(~F.col("goes_on") | (F.col("before") == 0) | F.col("first_user_hash").isNull(), F.col("request_id")))
    rows = running.last_before(rows, ["first_user_hash"], at, order, F.col("begun"), "latest")
    return rows.select("request_id", "first_user_hash", F.coalesce("begun", "latest").alias("session_of"))


def tool_pairs(events: DataFrame, key: str = "tool_call_id") -> DataFrame:
    """Starts and results of tool calls that share a session and a key, which is a column or else a payload field."""
    k = F.col(key) if key in events.columns else F.get_json_object("payload", f"$.{key}")
    side = lambda kind, name: events.where(is_(kind)).select("session_id", k.alias(key), F.col("sequence_number").alias(name))
    return side("TOOL_CALL_START", "call_seq").join(side("TOOL_CALL_END", "result_seq"), ["session_id", key])
