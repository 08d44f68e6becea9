"""Anomalies of a period, the assembled graph, suggestions of windows with little in them."""

import json

from pyspark.sql import functions as F

from tracequill.operators import behaviour, graph, metrics, reports, rules
from tracequill.sources.audit_log import audit_events, violations


def test_anomalies_are_bound_to_the_period(spark, sf):
    e = audit_events(spark, sf)
    a = behaviour.anomalies(e)
    every = reports.detected_between(a, e)
    assert every.count() == a.count() and every.where("detected_ns IS NULL").count() == 0
    times = sorted(r[0] for r in every.select("detected_ns").collect())
    half = times[len(times) // 2]
    assert reports.detected_between(a, e, times[0], half).count() == sum(t <= half for t in times)
    assert reports.detected_between(a, e, times[-1] + 1, times[-1] + 2).count() == 0
    # an anomaly of a session, whose events all end before the period, isn't one of it
    row = spark.createDataFrame([("s", None), ("s", 1), ("gone", None)], "session_id string, sequence_number long")
    log = spark.createDataFrame([("s", 0, 10), ("s", 1, 20), ("s", 2, 30)], "session_id string, sequence_number long, timestamp_ns long")
    assert sorted((r["sequence_number"] or -1, r["detected_ns"]) for r in reports.detected_between(row, log, 0, 100).collect()) == [(-1, 30), (1, 20)]


def test_graph_is_assembled(spark, sf):
    e = audit_events(spark, sf)
    whole, links = graph.topology(e, behaviour.anomalies(e), violations(e))
    joined, same = graph.topology(e, behaviour.anomalies(e), violations(e), isolated=False, least=10**9)
    assert whole.count() == e.select("agent_id").distinct().count() and links.count() > 0
    assert joined.count() == same.count() == 0
    r = whole.first()
    assert {"risk_score", "risk_level", "providers", "models", "violation_count"} <= set(whole.columns) and r["providers"]


def test_suggestions_load_as_rules_and_say_when_data_is_thin(spark, sf):
    e = audit_events(spark, sf)
    now = e.agg(F.max("timestamp_ns")).first()[0]
    rows = metrics.suggestion_report(e, as_of_ns=now, days=3650).collect()
    assert {r["id"] for r in rows} == {"model-allowlist", "tool-rate-cap"} and not any(r["insufficient_data"] for r in rows)
    loaded = rules.load("[" + ",".join(r["rule"] for r in rows) + "]")
    assert {(r.name, r.enabled) for r in loaded} == {("unapproved-model-block", False), ("tool-call-loop-protection", True)}
    assert all(json.loads(r["rule"])["reason"] for r in rows)
    none = metrics.suggestion_report(e, as_of_ns=now + 10**18, days=1).collect()
    assert [(r["id"], r["total_events"], r["insufficient_data"]) for r in none] == [(None, 0, True)]
    assert metrics.suggestion_report(e.limit(0)).first()["insufficient_data"]
