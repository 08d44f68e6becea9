"""Stages of interception: a loop over one session at a time, rules that all fire, and single cases."""

from collections import defaultdict

from pyspark.sql import functions as F

from tracequill.operators import interception, rules
from tracequill.operators.interception import Limits
from tracequill.plans import registry
from tracequill.sources.audit_log import audit_events


def said(spark, rows, limits=Limits(), **columns):
    """Verdicts by place of the row in the list; rows are dicts of signals with a type."""
    names = sorted({k for r in rows for k in r} - {"event_type", "policy"})
    data = [("s", n, "a", r["event_type"], n * 10**9, *[r.get(k) for k in names]) for n, r in enumerate(rows)]
    kinds = "".join(f", {k} {interception.SIGNALS[k][0]}" for k in names)
    df = spark.createDataFrame(data, f"session_id string, sequence_number long, agent_id string, event_type string, timestamp_ns long{kinds}")
    for k, v in columns.items():
        df = df.withColumn(k, v)
    out = {r["sequence_number"]: r for r in interception.staged(df, limits).collect()}
    return [[v["rule_name"] for v in out[n]["verdicts"]] for n in range(len(rows))], [out[n]["passed"] for n in range(len(rows))]


CALL = {"event_type": "LLM_CALL_START"}


def test_mark_is_consumed_and_only_what_is_sent_marks(spark):
    rows = [CALL | {"ml_label": "malicious"}, CALL | {"ml_label": "malicious"}, CALL | {"ml_label": "malicious", "definitions": "high"}, CALL]
    got, passed = said(spark, rows)
    # the second is blocked and so isn't classified, the third isn't sent, so the last meets no mark
    assert got == [[], ["ml-classifier-injection-block"], ["mcp-tool-definition-block"], []]
    assert passed == [True, False, False, True]


def test_first_values_are_held_against(spark):
    rows = [CALL | {"prompt_hash": "a"}, CALL | {"prompt_hash": "b", "tools_hash": "x"}, CALL | {"prompt_hash": "a", "tools_hash": "y"}, CALL | {"tools_hash": "x"}, CALL | {"prompt_hash": None}]
    # the second ends before its tools are seen, so y is the first set
    assert said(spark, rows)[0] == [[], ["system-prompt-mutation"], [], ["tool-set-mutation"], []]


def test_mean_of_calls_that_got_there(spark):
    high = CALL | {"injection_score": 0.9}
    rows = [high, CALL | {"injection_score": 0.9, "definitions": "high"}, high, high]
    assert said(spark, rows)[0] == [[], ["mcp-tool-definition-block"], [], ["context-injection-block"]]
    low = [CALL | {"injection_score": x} for x in (0.35, 0.35, 0.35, 0.0, 0.0)]
    assert said(spark, low)[0] == [[], [], ["context-injection-alert"], [], []]


def test_budgets_count_blocked_calls(spark):
    rows = [CALL, CALL | {"definitions": "high"}, CALL, {"event_type": "LLM_CALL_END", "tokens": 70}, CALL]
    assert said(spark, rows, Limits(calls=2, tokens=50))[0] == [[], ["mcp-tool-definition-block"], ["llm-call-budget-exceeded"], [], ["token-budget-exceeded", "llm-call-budget-exceeded"]]


def test_tools(spark):
    tool, end = {"event_type": "TOOL_CALL_START"}, {"event_type": "TOOL_CALL_END"}
    rows = [tool | {"approved": False, "taint": "BLOCK"}, tool, tool | {"taint": "ALERT"}, end | {"output_score": 0.6, "output_ml_score": 0.9}, end | {"output_score": 0.8, "output_ml_score": 0.9}]
    got, passed = said(spark, rows, Limits(tool_call_loop=1))
    # the call outside the baseline isn't counted
    assert got == [["data-exfiltration-attempt", "tool-not-in-baseline"], [], ["data-flow-suspicious", "tool-call-loop-protection"], ["tool-output-injection-alert", "tool-output-ml-injection-block"], ["tool-output-injection-block"]]
    assert passed == [False, True, False, False, False]


def test_policy_depth_and_runaway(spark):
    policy = F.when(F.col("sequence_number") == 0, F.array(F.struct(F.lit("own").alias("rule_name"), F.lit("BLOCK").alias("action")), F.lit(None)))
    assert said(spark, [CALL | {"ml_label": "malicious"}, CALL], policy=policy) == ([["own"], []], [False, True])
    assert said(spark, [CALL | {"spawn_depth": 11}, CALL | {"spawn_depth": 10}])[0] == [["spawn-depth-exceeded"], []]
    assert said(spark, [CALL] * 4, Limits(runaway_calls=2))[0] == [[], [], [], ["runaway-llm-call-protection"]]


def test_empty_null_and_clashing(spark):
    df = spark.createDataFrame([(None, None, None, None, None, "p", "v")], "session_id string, sequence_number long, agent_id string, event_type string, timestamp_ns long, passed string, verdicts string")
    assert [(r["passed"], r["verdicts"]) for r in interception.staged(df).collect()] == [(True, [])]
    assert interception.verdicts(df.limit(0)).count() == 0
    assert interception.verdicts(df).count() == 0


def test_all_rules_of_code_fire(spark):
    fired = {r["rule_name"] for r in registry.QUERIES["interception_all"](spark, "/root/testdata/sf0.01").select("rule_name").distinct().collect()}
    assert set(rules.ORDER) <= fired
    assert {"rce-in-tool-args", "credential-leak-alert"} <= fired


def test_nothing_after_a_block_that_ends(spark, sf):
    ends = {"spawn-depth-exceeded", "ml-classifier-injection-block", "system-prompt-mutation", "tool-set-mutation", "mcp-tool-definition-block"}
    of = defaultdict(set)
    for r in registry.QUERIES["interception_all"](spark, sf).collect():
        of[r["session_id"], r["sequence_number"]].add(r["rule_name"])
    assert any(v & ends for v in of.values()) and all(len(v) == 1 for v in of.values() if v & ends)


def test_verdict_list_is_evaluate(spark, sf):
    e = registry.typed(audit_events(spark, sf))
    one = rules.evaluate(e).select("session_id", "sequence_number", "rule_name", "action")
    two = e.select("session_id", "sequence_number", F.explode(rules.verdict_list(e)).alias("v")).select("session_id", "sequence_number", "v.*")
    assert one.count() > 0 and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_a_fold_over_a_session_is_made_once(spark, sf):
    """Transitions, measures and verdicts read the events that went through the stages; none folds them again."""
    plan = registry.QUERIES["interception_all"](spark, sf)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
