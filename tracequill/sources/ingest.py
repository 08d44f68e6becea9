"""Checks at the door: required fields, event types, tenant, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.sources.audit_log import EVENT_TYPES, REQUIRED


def validated(events: DataFrame, org: str | None = None, kinds: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """events with missing (array of fields that are null) and reason (null for good rows)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED]))
    e = events.withColumn("missing", missing)
    reason = F.when(F.size("missing") > 0, "missing_fields").when(~F.col("event_type").isin(*kinds), "unknown_event_type")
    if org is not None:
        reason = reason.when(F.col("org_id") != org, "wrong_org")
    return e.withColumn("reason", reason)


def deduplicated(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Events of the batch that the store lacks, one of each id."""
    return batch.dropDuplicates(["event_id"]).join(store.select("event_id"), "event_id", "left_anti")


def violations_in(batch: DataFrame, org: str) -> DataFrame:
    """Violations as they are stored: rows without a rule, a session or an agent are left out, and the tenant is the caller's, whatever they say."""
    return batch.where("rule_name IS NOT NULL AND session_id IS NOT NULL AND agent_id IS NOT NULL").withColumns({"org_id": F.lit(org), "action": F.upper(F.coalesce("action", F.lit("ALERT"))), "is_false_positive": F.lit(None).cast("boolean")})


def counters(checked: DataFrame, store: DataFrame) -> DataFrame:
    """accepted, skipped (duplicates), errors of a batch."""
    good = checked.where("reason IS NULL")
    accepted = deduplicated(good, store).agg(F.count("*").alias("accepted"))
    return accepted.crossJoin(F.broadcast(checked.agg(F.count_if(F.col("reason").isNotNull()).alias("errors"), F.count_if(F.col("reason").isNull()).alias("good")))).select("accepted", (F.col("good") - F.col("accepted")).alias("skipped"), "errors")
