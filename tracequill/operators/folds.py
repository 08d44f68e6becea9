"""Verdicts that depend on the verdicts before them: the same steps for batches (folds in order) and for streams (state)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tracequill.operators import running

SECOND = 1_000_000_000


def throttled(times: list[int], at: int, cooldown: int) -> tuple[list[int], bool]:
    """What is kept (the time of the last alert sent, or nothing) and whether this one is sent: the first, then each at least the cooldown after the last."""
    sent = not times or at - times[0] >= cooldown
    return ([at] if sent else times), sent


def admitted(times: list[int], at: int, limit: int, span: int) -> tuple[list[int], bool]:
    """What is kept (times of admitted requests within the span, so at most the limit's number) and whether this one is admitted."""
    kept = times if not times or times[0] >= at - span else [t for t in times if t >= at - span]
    return (kept + [at], True) if len(kept) < limit else (kept, False)


def folded(rows: DataFrame, keys: list[str], order: list[str], at: str, step: Callable[[dict, list[int], int], tuple[list[int], bool]], name: str) -> DataFrame:
    """The rows with step's verdict, each key's in order. step: the row's keys, what is kept, the time; gives what to keep and the verdict.

    A task reads its sorted rows batch by batch and keeps one key's few times, so a key of any size fits; null keys are keys, a null time is taken as 0.
    """
    schema = StructType([*rows.schema.fields, StructField(name, BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for batch in batches:
            verdicts = []
            for k, t in zip(batch[keys].astype(object).where(batch[keys].notna(), None).itertuples(index=False, name=None), batch[at].fillna(0), strict=True):
                if k != key:
                    key, kept = k, []
                kept, verdict = step(dict(zip(keys, k, strict=True)), kept, int(t))
                verdicts.append(verdict)
            yield batch.assign(**{name: verdicts})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def admissions(requests: DataFrame, keys: list[str], limits: dict[str, int] | int, seconds: int = 60) -> DataFrame:
    """The requests with `admitted`: fewer than the limit of those admitted before lie within the seconds up to it; refused ones don't count.

    requests: request_id, timestamp_ns and the keys, of which the last names the tier if limits are by tier (a tier without a limit refuses nothing). A key's requests fall into runs with over
    the seconds of silence between them; nothing of one run counts in the next, so runs are folded apart and a busy key is spread over as many tasks as it has runs.
    """
    span = seconds * SECOND
    t, order = F.col("timestamp_ns"), ["timestamp_ns", "request_id"]
    rows = running.last_before(requests, keys, t, order, t, "_last")
    begins = F.coalesce((t - F.col("_last") > span).cast("long"), F.lit(0))
    rows = running.running_sums(rows.withColumn("_begins", begins), keys, t, order, {"_run": F.col("_begins")}).withColumn("_run", F.col("_run") + F.col("_begins"))

    def step(key: dict, kept: list[int], at: int) -> tuple[list[int], bool]:
        limit = limits if isinstance(limits, int) else limits.get(key[keys[-1]])
        return (kept, True) if limit is None else admitted(kept, at, limit, span)

    return folded(rows.drop("_last", "_begins"), [*keys, "_run"], order, "timestamp_ns", step, "admitted").drop("_run")


def alert_throttle(violations: DataFrame, cooldown_s: int = 600) -> DataFrame:
    """Alerts of a (rule, session) that are sent: the first, then each at least the cooldown after the last one sent."""
    rows = violations.select("rule_name", "session_id", "event_id", "timestamp_ns", "action")
    step = lambda _, kept, at: throttled(kept, at, cooldown_s * SECOND)
    return folded(rows, ["rule_name", "session_id"], ["timestamp_ns", "event_id"], "timestamp_ns", step, "sent").where("sent").drop("sent")
