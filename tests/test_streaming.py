"""Streams give what batches give."""

import hmac

from pyspark.sql import functions as F

from tracequill.operators import export
from tracequill.sources.audit_log import ENVELOPE, VIOLATION, audit_events
from tracequill.streaming import jobs


def test_ingest_is_checked_and_idempotent(spark, sf, tmp_path):
    events = audit_events(spark, sf).drop("k")
    n = events.count()
    events.select([f.name for f in ENVELOPE.fields]).write.json(str(tmp_path / "in"))
    events.limit(20).select([f.name for f in ENVELOPE.fields]).write.mode("append").json(str(tmp_path / "in"))
    (tmp_path / "in" / "bad.json").write_text("no json\nno json\n{\"event_id\": 5\n")
    run = lambda: jobs.ingest(jobs.events(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination(120)
    run()
    stored = lambda: spark.read.parquet(str(tmp_path / "store"))
    assert stored().count() == n == stored().select("event_id").distinct().count()
    bad = spark.read.json(str(tmp_path / "bad"))
    assert bad.count() == 3 and sorted(r[0] for r in bad.select(jobs.RAW).collect()) == ["no json", "no json", '{"event_id": 5']
    # an event that is years late is new all the same; one that the store holds is not, whatever its time
    late = events.limit(1).withColumns({"event_id": F.lit("late"), "timestamp_ns": F.lit(1)}).unionByName(events.limit(1).withColumn("timestamp_ns", F.lit(2)))
    late.select([f.name for f in ENVELOPE.fields]).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert stored().count() == n + 1 and stored().where("event_id = 'late'").count() == 1
    run()
    assert stored().count() == n + 1


def test_a_batch_reads_only_its_buckets(spark, sf, tmp_path):
    schema = ENVELOPE
    events = audit_events(spark, sf).drop("k").select([f.name for f in ENVELOPE.fields])
    run = lambda: jobs.ingest(jobs.events(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "check"), buckets=16).awaitTermination(120)
    events.write.json(str(tmp_path / "in"))
    run()
    one = events.limit(1).withColumns({"bucket": jobs._bucket(buckets=16)})
    bucket = one.first()["bucket"]
    ids = jobs.stored(spark, str(tmp_path / "store"), schema, 1, [bucket])
    assert {r[0].split("bucket=")[1].split("/")[0] for r in ids.select("_metadata.file_path").distinct().collect()} == {str(bucket)}
    assert 0 < ids.count() < spark.read.parquet(str(tmp_path / "store")).count() / 4
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1]
    n = spark.read.parquet(str(tmp_path / "store")).count()
    one.drop("bucket").unionByName(events.limit(1).withColumn("event_id", F.lit("new"))).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "store")).count() == n + 1


def test_alerts_are_prepared(spark, tmp_path):
    rows = [("e1", "canary-leak", "ALERT", "r", "X", "s", "a", "o", 1), ("e2", "other", "LOG", "r", "X", "s", "a", "o", 1), ("e3", None, "BLOCK", "r", "X", "s", "a", "o", 1)]
    spark.createDataFrame(rows, VIOLATION).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(VIOLATION).json(str(tmp_path / "in"))
    jobs.alerts(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check"), "k").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    out = {(r["event_id"], r["channel"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(out) == {("e1", c) for c in ("slack", "email", "pagerduty", "webhook")}
    hook = out["e1", "webhook"]
    assert hook["signature"] == hmac.new(b"k", hook["body"].encode(), "sha256").hexdigest()


def test_windows_equal_batch(spark, sf, tmp_path):
    events = audit_events(spark, sf).drop("k")
    events.select([f.name for f in ENVELOPE.fields]).write.json(str(tmp_path / "in"))
    counts = jobs.windowed_counts(jobs.events(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = jobs.windowed_counts(events)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))


def test_calls_are_paired(spark, tmp_path):
    rows = spark.createDataFrame([("s", "c1", "2024-01-01 00:00:00"), ("s", "c2", "2024-01-01 00:10:00")], "session_id string, tool_call_id string, event_time string")
    rows.write.json(str(tmp_path / "a"))
    rows.limit(1).withColumn("event_time", F.lit("2024-01-01 00:05:00")).write.json(str(tmp_path / "b"))
    read = lambda p: spark.readStream.schema("session_id string, tool_call_id string, event_time timestamp").json(str(tmp_path / p))
    q = jobs.paired_calls(read("a"), read("b")).writeStream.format("memory").queryName("p").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["tool_call_id"] for r in spark.table("p").collect()] == ["c1"]
    assert export.ndjson(rows).count() == 2
