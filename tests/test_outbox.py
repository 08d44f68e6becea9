"""Batches of events as a data source: bodies, commits, retries, dry runs, overwrites."""

import json
import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tracequill.operators import export
from tracequill.sources import outbox
from tracequill.sources.audit_log import audit_events


@pytest.fixture(scope="module")
def rows(spark):
    return export.normalised(audit_events(spark, "/root/testdata/sf0.001"))


def read(spark, path):
    outbox.register(spark)
    return spark.read.format(outbox.NAME).load(str(path)).collect()


def files(path):
    return sorted(x for x in os.listdir(path) if x.startswith("part-"))


def test_bodies_hold_each_event_once(spark, rows, tmp_path):
    export.deliver(rows.repartition(3), str(tmp_path), "elastic", size=50, dry_run=False)
    got = read(spark, tmp_path)
    lines = [json.loads(x) for r in got for x in r["body"].split("\n") if x]
    ids = [x["index"]["_id"] for x in lines[::2]]
    assert sorted(ids) == sorted(r[0] for r in rows.select("event_id").collect()) and [x["event_id"] for x in lines[1::2]] == ids
    assert all(r["body"].endswith("\n") and r["events"] <= 50 for r in got) and len(files(tmp_path)) == 3
    assert outbox.manifests({"path": str(tmp_path)})[0]["events"] == len(ids)


def test_splunk_append_and_overwrite(spark, rows, tmp_path):
    n = rows.count()
    for _ in range(2):
        export.deliver(rows, str(tmp_path), "splunk", size=400, dry_run=False)
    got = read(spark, tmp_path)
    assert sum(r["events"] for r in got) == 2 * n and {json.loads(x)["index"] for r in got for x in r["body"].split("\n")} == {"agents"}
    export.deliver(rows.limit(7), str(tmp_path), "splunk", dry_run=False, mode="overwrite")
    assert [r["events"] for r in read(spark, tmp_path)] == [7] and len(files(tmp_path)) == 1


def test_dry_run_only_counts(spark, rows, tmp_path):
    export.deliver(rows, str(tmp_path / "dry"))
    (m,) = outbox.manifests({"path": str(tmp_path / "dry")})
    assert m["dry_run"] and m["events"] == rows.count() and m["bytes"] > 0 and m["files"] == [] and files(tmp_path / "dry") == []
    assert read(spark, tmp_path / "dry") == []


def test_what_no_manifest_names_does_not_count(spark, tmp_path):
    # a first attempt that is lost after its file was written, then its second one
    lines = [outbox.pa.RecordBatch.from_pydict({"line": ["a", None, "b", "c"]})]
    writer = outbox.Outbox({"path": str(tmp_path), "size": "2"}, overwrite=False)
    writer.write(iter(lines))
    again = writer.write(iter(lines))
    writer.commit([again, None])
    assert len(files(tmp_path)) == 2
    assert sorted((r["batch"], r["events"], r["body"]) for r in read(spark, tmp_path)) == [(0, 2, "a\nb"), (1, 1, "c")]
    third = writer.write(iter(lines))
    writer.abort([third, None])
    assert len(files(tmp_path)) == 2
    outbox.Outbox({"path": str(tmp_path)}, overwrite=True).commit([])
    assert files(tmp_path) == [] and read(spark, tmp_path) == []


def test_a_failed_job_commits_nothing(spark, tmp_path):
    outbox.register(spark)

    def broken(batches):
        for b in batches:
            if TaskContext.get().partitionId() == 1:
                raise ValueError("lost")
            yield b

    df = spark.range(100).repartition(2).select(F.col("id").cast("string").alias("line")).mapInArrow(broken, "line string")
    with pytest.raises(Exception, match="lost"):
        df.write.format(outbox.NAME).option("path", str(tmp_path / "x")).mode("append").save()
    assert outbox.manifests({"path": str(tmp_path / "x")}) == [] and read(spark, tmp_path / "x") == []


def test_empty_and_wrong_size(spark, rows, tmp_path):
    export.deliver(rows.limit(0), str(tmp_path), dry_run=False)
    assert outbox.manifests({"path": str(tmp_path)})[0]["events"] == 0 and read(spark, tmp_path) == []
    with pytest.raises(ValueError):
        outbox.Outbox({"path": str(tmp_path), "size": "0"}, False)
