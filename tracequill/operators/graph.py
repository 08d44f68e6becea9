"""The agent graph: nodes, edges, risk, spawn depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.operators.metrics import agents, cents, is_, scoped, valid_model
from tracequill.sources.audit_log import typed


def nodes(events: DataFrame, anomalies: DataFrame, violations: DataFrame, org: str | None = None) -> DataFrame:
    v = scoped(violations, org).groupBy("agent_id").agg(F.count("*").alias("v"))
    return agents(events, anomalies, org).join(v, "agent_id", "left").withColumn("violation_count", F.coalesce("v", F.lit(0))).drop("v")


def providers_models(events: DataFrame, org: str | None = None) -> DataFrame:
    """Sorted distinct providers and valid models of each agent, joined by commas."""
    e = scoped(events, org).groupBy("agent_id").agg(F.collect_set("provider").alias("p"), F.collect_set(F.when(valid_model(), F.col("model"))).alias("m"))
    return e.select("agent_id", F.array_join(F.sort_array("p"), ",").alias("providers"), F.array_join(F.sort_array("m"), ",").alias("models"))


def edges(events: DataFrame, org: str | None = None, least: int = 1) -> DataFrame:
    """Calls from a parent's agent to another agent, with the latency of the child's run.

    The joins repeat a call for every event of the parent's run and every latency row, and calls are counted after them.
    """
    e = scoped(events, org)
    child = e.where(is_("LLM_CALL_START")).select("org_id", F.col("parent_run_id").alias("key"), F.col("run_id").alias("child_run"), F.col("agent_id").alias("target"), "timestamp_ns")
    parent = e.select("org_id", F.col("run_id").alias("key"), F.col("agent_id").alias("source"))
    ends = typed(e.where(is_("LLM_CALL_END"))).select(F.col("run_id").alias("child_run"), "latency_ms")
    both = child.join(parent, ["org_id", "key"]).where("source <> target").join(ends, "child_run", "left")
    out = both.groupBy("source", "target").agg(F.count("*").alias("call_count"), cents(F.avg("latency_ms")).alias("avg_latency_ms"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    return out.where(F.col("call_count") >= least)


def connected(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes at either end of some edge."""
    ends = edges_.select(F.explode(F.array("source", "target")).alias("agent_id")).distinct()
    return nodes_.join(ends, "agent_id", "left_semi")


def risk_score(violations: Column, anomalies: Column, injection: Column) -> Column:
    i = F.when(injection > 0.4, (injection - 0.4) / 0.6 * 0.3).otherwise(0.0)
    total = F.least(F.lit(0.4), violations * F.lit(0.05)) + F.least(F.lit(0.3), anomalies * F.lit(0.1)) + i
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).cast("decimal(18,9)"), 3).cast("double")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "critical").when(score >= 0.4, "high").when(score >= 0.2, "medium").otherwise("low")


def risk(nodes_: DataFrame) -> DataFrame:
    r = nodes_.select("agent_id", risk_score(F.col("violation_count"), F.col("anomaly_count"), F.col("max_injection")).alias("risk_score"))
    return r.withColumn("risk_level", risk_level(F.col("risk_score")))


def topology(events: DataFrame, anomalies: DataFrame, violations: DataFrame, org: str | None = None, isolated: bool = True, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The assembled graph as nodes and edges: agents with their measures, risk, providers and models, all or only those at some edge, and the edges of at least so many calls."""
    links, of = edges(events, org, least), nodes(events, anomalies, violations, org)
    if not isolated:
        of = connected(of, links)
    score = risk_score(F.col("violation_count"), F.col("anomaly_count"), F.col("max_injection"))
    return of.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"))).join(providers_models(events, org), "agent_id", "left"), links


def spawn_depth(sessions: DataFrame) -> DataFrame:
    """Depth of each session in its spawn tree: roots 0, children of unknown parents 1, else the parent's plus one.

    sessions: session_id, parent_session_id. Pointer doubling: after k joins a session knows its ancestor 2^k levels up, so a chain of a million sessions takes twenty. Sessions
    on a cycle, or below one, have no depth (null).
    """
    s = sessions.select("session_id", "parent_session_id").dropDuplicates(["session_id"])
    known = s.select(F.col("session_id").alias("parent_session_id"), F.lit(True).alias("known"))
    # up: the ancestor reached so far, null at a top; depth: how far up that is, with the 1 of an unknown parent
    reach = s.join(known, "parent_session_id", "left").select("session_id", F.when(F.col("known"), F.col("parent_session_id")).alias("up"), F.when(F.col("parent_session_id").isNull(), 0).otherwise(1).cast("long").alias("depth")).persist()
    levels, n, open_ = 1, reach.count(), reach.where("up IS NOT NULL").count()
    while open_ and levels <= n:  # what is open after n levels goes round in a cycle
        above = reach.select(F.col("session_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = reach.join(above, "up", "left").select("session_id", F.when(F.col("up").isNotNull(), F.col("next")).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).persist()
        open_, levels = moved.where("up IS NOT NULL").count(), levels * 2
        reach.unpersist()
        reach = moved
    return reach.select("session_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
