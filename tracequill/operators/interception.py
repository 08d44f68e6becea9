"""The stages that each event of a session passes, in order, when a block ends the later ones and changes what the next events meet.

What a scanner, a join or a rule can say of one event is a column made before (signals). What depends on the verdicts before it, a session's budget, its mean of scores over the calls that got so far, the mark that
the classifier left on the last call let through, is a fold over the session's events in order: a task reads its sorted rows batch by batch and keeps a few numbers a session, so a session of any
length fits. Transitions and outliers only alert, so they are operators over what was let through.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.operators import behaviour, outliers
from tracequill.operators.rules import ORDER
from tracequill.sources.stored import written

PLACES = {name: n + 1 for n, name in enumerate(ORDER)}
#: The place of a policy's rules, after those of code.
POLICY = len(ORDER) + 1


@dataclass(frozen=True)
class Limits:
    """Bounds of the stages; a budget of 0 is none."""

    spawn_depth: int = 10
    window: int = 5
    least: int = 3
    mean_alert: float = 0.35
    mean_block: float = 0.60
    output_alert: float = 0.50
    output_block: float = 0.80
    tokens: int = 0
    calls: int = 0
    tool_call_loop: int = 50
    runaway_calls: int = 100


@dataclass
class Session:
    """What a session's events leave for its next ones."""

    prompt: str | None = None
    tools: str | None = None
    marked: bool = False
    scores: list[float] = field(default_factory=list)
    tokens: int = 0
    calls: int = 0
    tool_calls: int = 0


#: Signals of an event by name and type, and what stands for one that is missing.
SIGNALS = {
    "spawn_depth": ("long", 0), "ml_label": ("string", None), "prompt_hash": ("string", None), "tools_hash": ("string", None), "definitions": ("string", None), "injection_score": ("double", 0.0), "tokens": ("long", 0),
    "output_score": ("double", 0.0), "output_ml_score": ("double", 0.0), "output_threat": ("boolean", False), "taint": ("string", None), "approved": ("boolean", True), "policy": ("array<struct<rule_name:string,action:string>>", None),
}
_RESULT = "session_id string, sequence_number long, agent_id string, event_type string, timestamp_ns long, injection_score double, passed boolean, verdicts array<struct<place:long,rule_name:string,action:string>>"


def _request(s: Session, e, limits: Limits) -> list[tuple[str, str]]:
    """Verdicts on a call of a model; the stages up to the scan of definitions end at their block, those after it are all asked."""
    if limits.spawn_depth and e.spawn_depth > limits.spawn_depth:
        return [("spawn-depth-exceeded", "BLOCK")]
    if s.marked:
        s.marked = False
        return [("ml-classifier-injection-block", "BLOCK")]
    s.calls += 1  # from here on a call counts, blocked or not
    before = s.calls - 1
    for name, now in (("prompt", e.prompt_hash), ("tools", e.tools_hash)):
        first = getattr(s, name)
        if now and first is None:
            setattr(s, name, now)
        elif now and now != first:
            return [("system-prompt-mutation" if name == "prompt" else "tool-set-mutation", "BLOCK")]
    if e.definitions == "high":
        return [("mcp-tool-definition-block", "BLOCK")]
    out = [("mcp-tool-definition-alert", "ALERT")] if e.definitions == "medium" else []
    s.scores = [*s.scores, e.injection_score][-limits.window :]
    mean = round(sum(s.scores) / len(s.scores), 9)
    if len(s.scores) >= limits.least and mean >= limits.mean_alert:
        out.append(("context-injection-block", "BLOCK") if mean >= limits.mean_block else ("context-injection-alert", "ALERT"))
    if limits.tokens and s.tokens >= limits.tokens:
        out.append(("token-budget-exceeded", "BLOCK"))
    if limits.calls and before >= limits.calls:
        out.append(("llm-call-budget-exceeded", "BLOCK"))
    if before > limits.runaway_calls:
        out.append(("runaway-llm-call-protection", "BLOCK"))
    out += e.policy
    if all(action != "BLOCK" for _, action in out):  # only what is sent on is classified
        s.marked = e.ml_label == "malicious"
        if e.ml_label == "suspicious":
            out.append(("ml-classifier-injection-alert", "ALERT"))
    return out


def _result(s: Session, e, limits: Limits) -> list[tuple[str, str]]:
    """Verdicts on a tool's result: by its signs, else by the classifier where that sees more."""
    if e.output_score >= limits.output_block:
        return [("tool-output-injection-block", "BLOCK")]
    out = [("tool-output-injection-alert", "ALERT")] if e.output_score >= limits.output_alert else []
    return [*out, ("tool-output-ml-injection-block", "BLOCK")] if e.output_ml_score >= limits.output_block else out


def _tool(s: Session, e, limits: Limits) -> list[tuple[str, str]]:
    """Verdicts on a tool call: a call outside the baseline isn't counted and no policy is asked. A tainted value for a sink refuses the call, but the other stages are asked too."""
    out = [("data-exfiltration-attempt", "BLOCK")] if e.taint == "BLOCK" else [("data-flow-suspicious", "ALERT")] if e.taint == "ALERT" else []
    if not e.approved:
        return [*out, ("tool-not-in-baseline", "BLOCK")]
    s.tool_calls += 1
    if s.tool_calls > limits.tool_call_loop:
        out.append(("tool-call-loop-protection", "BLOCK"))
    return out + e.policy


def _answer(s: Session, e, limits: Limits) -> list[tuple[str, str]]:
    s.tokens += e.tokens
    return [("output-threat-detected", "ALERT")] if e.output_threat else []


STAGES = {"LLM_CALL_START": _request, "LLM_CALL_END": _answer, "TOOL_CALL_START": _tool, "TOOL_CALL_END": _result}


def staged(signals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The events with `passed` and the `verdicts` of the stages that their session's events depend on, in order (all rules of code but transitions and outliers).

    signals: session_id, sequence_number, agent_id, event_type, timestamp_ns and any of SIGNALS; a missing or null signal says nothing. Rows of a null session are one session; of equal numbers, the earlier
    time and then the type goes first. Other columns are dropped.
    """
    value = lambda n, kind, none: (F.col(n) if n in signals.columns else F.lit(None)).cast(kind) if none is None else F.coalesce(F.col(n).cast(kind) if n in signals.columns else F.lit(None), F.lit(none))
    rows = signals.select("session_id", F.col("sequence_number").cast("long"), "agent_id", "event_type", F.col("timestamp_ns").cast("long"), *[value(n, *v).alias(n) for n, v in SIGNALS.items()])
    columns = [c.split()[0] for c in _RESULT.split(", ")[:6]]

    names = ["session_id", "sequence_number", "agent_id", "event_type", "timestamp_ns", *SIGNALS]
    event = namedtuple("event", names)
    kind = pa.list_(pa.struct([("place", pa.int64()), ("rule_name", pa.string()), ("action", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, s = object(), Session()
        for batch in batches:
            held = {n: c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) or not c.null_count and not pa.types.is_list(c.type) else c.to_pylist() for n, c in zip(names, batch.columns, strict=True)}
            held["policy"] = [[(v["rule_name"], v["action"]) for v in p if v is not None] if p else [] for p in held["policy"]]
            passed, verdicts = [], []
            for e in map(event._make, zip(*held.values(), strict=True)):
                if e.session_id != session:
                    session, s = e.session_id, Session()
                stage = STAGES.get(e.event_type)
                said = stage(s, e, limits) if stage else []
                passed.append(all(action != "BLOCK" for _, action in said))
                verdicts.append([{"place": PLACES.get(rule, POLICY), "rule_name": rule, "action": action} for rule, action in said])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), pa.array(passed, pa.bool_()), pa.array(verdicts, kind)], [*columns, "passed", "verdicts"])

    return rows.repartition("session_id").sortWithinPartitions("session_id", "sequence_number", "timestamp_ns", "event_type").mapInArrow(run, _RESULT)


def _ended(passed: DataFrame) -> DataFrame:
    """The five measures of each session at its first finish, over what was let through up to it."""
    finish = F.col("event_type") == "AGENT_FINISH"
    rows = passed.withColumn("_finished", F.min(F.when(finish, F.col("sequence_number"))).over(behaviour._by_session((behaviour.Window.unboundedPreceding, 0))))
    rows = rows.where("_finished IS NULL OR sequence_number = _finished")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    calls = F.greatest(n("LLM_CALL_START"), F.lit(1))
    ended = F.max(F.when(finish, F.col("timestamp_ns")))
    out = rows.groupBy("session_id").agg(
        ended.alias("ended_ns"), F.max("_finished").alias("sequence_number"), n("LLM_CALL_START").cast("double").alias("llm_call_count"), (n("TOOL_CALL_START") / calls).alias("tool_call_rate"), (n("SYSTEM_ERROR") / calls).alias("error_rate"),
        ((ended - F.min("timestamp_ns")) / 6e10).alias("session_duration_min"), F.max("injection_score").alias("max_injection_score"),
    )
    return out.where("ended_ns IS NOT NULL")


def verdicts(signals: DataFrame, limits: Limits = Limits(), forests: bool = True, low: float = 0.05) -> DataFrame:
    """One row a verdict: session_id, sequence_number, rule_name, action, place, for all rules that code fires and those of a policy that came with the signals.

    Transitions are between events that were let through, and alert at calls and finishes; with `forests`, a session's first finish is held against the forest fitted last.
    The events that went through the stages, and the measures of ended sessions, are read many times over, so each is made once and written to the shared folder.
    """
    events = written(staged(signals, limits), "stages")
    out = events.select("session_id", "sequence_number", F.explode("verdicts").alias("v")).select("session_id", "sequence_number", "v.rule_name", "v.action", "v.place")
    passed = events.where("passed")
    alert = lambda rows, rule: rows.select("session_id", "sequence_number", F.lit(rule).alias("rule_name"), F.lit("ALERT").alias("action"), F.lit(PLACES[rule]).cast("long").alias("place"))
    rare = behaviour.markov(passed, low).where("anomalous AND event_type IN ('LLM_CALL_START', 'AGENT_FINISH')")
    out = out.unionByName(alert(rare, "markov-anomalous-transition"))
    if forests:
        ended = written(_ended(passed), "stages-ended")
        odd = outliers.refitted(ended.drop("sequence_number")).where("is_anomaly").select("session_id")
        out = out.unionByName(alert(ended.join(odd, "session_id", "left_semi"), "isolation-forest-anomaly"))
    return out
