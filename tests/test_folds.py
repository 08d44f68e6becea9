"""Verdicts that depend on those before: against plain loops, and streams against batches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracequill.operators import folds
from tracequill.streaming import jobs

SECOND = folds.SECOND
REQUESTS = "request_id string, caller string, tier string, timestamp_ns long"
ALERTS = "event_id string, rule_name string, session_id string, action string, timestamp_ns long"


def requests(n=500, seed=3):
    r = random.Random(seed)
    return [(f"r{i:04}", r.choice(["hot"] * 5 + ["b", None]), r.choice(["read", "ingest", "free"]), r.randrange(0, 2000) * SECOND) for i in range(n)]


def plain_admissions(rows, limits, seconds):
    kept, out = defaultdict(list), {}
    for i, caller, tier, t in sorted(rows, key=lambda x: (x[3], x[0])):
        near = [x for x in kept[caller, tier] if x >= t - seconds * SECOND]
        out[i] = tier not in limits or len(near) < limits[tier]
        kept[caller, tier] = near + [t] * out[i]
    return out


def plain_throttle(rows, cooldown):
    last, out = {}, set()
    for i, rule, session, _, t in sorted(rows, key=lambda x: (x[4], x[0])):
        if (rule, session) not in last or t - last[rule, session] >= cooldown * SECOND:
            last[rule, session] = t
            out.add(i)
    return out


@pytest.mark.parametrize(("limits", "seconds"), [({"read": 2, "ingest": 4}, 60), ({"read": 1, "ingest": 1}, 5), ({"read": 0}, 60)])
def test_admissions(spark, limits, seconds):
    rows = requests()
    df = spark.createDataFrame(rows, REQUESTS).withColumn("key", F.lit("clash")).repartition(4)
    got = folds.admissions(df, ["caller", "tier"], limits, seconds)
    assert got.columns == [*df.columns, "admitted"]
    assert {r["request_id"]: r["admitted"] for r in got.collect()} == plain_admissions(rows, limits, seconds)
    assert folds.admissions(df.limit(0), ["caller", "tier"], limits).count() == 0


def alerts(n=300, seed=4):
    r = random.Random(seed)
    return [(f"e{i:04}", r.choice(["x", "x", "y"]), r.choice(["s", None]), "ALERT", r.randrange(0, 5000) * SECOND) for i in range(n)]


def test_throttle(spark):
    rows = alerts()
    got = folds.alert_throttle(spark.createDataFrame(rows, ALERTS).repartition(3), 600)
    assert {r["event_id"] for r in got.collect()} == plain_throttle(rows, 600)


def streamed(spark, tmp_path, rows, schema, at, job):
    """Rows of a stream that is stopped after a third and after two thirds of the time and goes on from its checkpoint."""
    rows = sorted(rows, key=lambda x: (x[at], x[0]))
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = job(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_throttle_as_a_stream(spark, tmp_path, state_store):
    rows = alerts()
    got = streamed(spark, tmp_path, rows, ALERTS, 4, lambda s: jobs.throttled_alerts(s, 600, "10 minutes"))
    assert sorted(r["event_id"] for r in got) == sorted(plain_throttle(rows, 600))


def test_limiter_as_a_stream(spark, tmp_path, state_store):
    rows = requests()
    got = streamed(spark, tmp_path, rows, REQUESTS, 3, lambda s: jobs.limited_requests(s, ["caller", "tier"], {"read": 2, "ingest": 4}, 60, "1 minute"))
    assert {r["request_id"]: r["admitted"] for r in got} == plain_admissions(rows, {"read": 2, "ingest": 4}, 60) and len(got) == len(rows)
