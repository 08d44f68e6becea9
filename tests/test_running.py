"""Running sums over buckets against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracequill.operators import behaviour, running

SCHEMA = "id long, key string, other long, t long, v long"


def rows(n=400, seed=5):
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "hot", "a", None]), r.choice([1, 2, None]), r.choice([None, -7, *range(0, 90, 3)]), r.choice([1, 1, -2, None])) for i in range(n)]


def before(t, i):
    return (t is not None, t or 0, i)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_sums_and_last_values(spark, width):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("value", F.lit("clash")).repartition(5)
    sums = running.running_sums(df, ["key", "other"], F.col("t"), ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, width=width)
    last = running.last_before(df, ["key"], F.col("t"), ["t", "id"], F.col("v"), "w", width=width)
    assert sums.columns == [*df.columns, "s", "n"] and last.columns == [*df.columns, "w"]
    got, latest = {r["id"]: (r["s"], r["n"]) for r in sums.collect()}, {r["id"]: r["w"] for r in last.collect()}
    assert len(got) == len(latest) == len(data)
    for i, k, o, t, _ in data:
        older = [x for x in data if x[1:3] == (k, o) and before(x[3], x[0]) < before(t, i)]
        assert got[i] == (sum(x[4] or 0 for x in older), len(older))
        values = [x[4] for x in sorted(data, key=lambda x: before(x[3], x[0])) if x[1] == k and before(x[3], x[0]) < before(t, i) and x[4] is not None]
        assert latest[i] == (values[-1] if values else None)


@pytest.mark.parametrize(("seconds", "width"), [(5, 1), (5, 3_000_000), (30, None), (1, 10**9)])
def test_sliding_counts(spark, seconds, width):
    data = rows(300, 9)
    df = spark.createDataFrame(data, SCHEMA).withColumn("us", F.col("t") * 1_000_000)
    got = {r["id"]: r["n"] for r in running.sliding_counts(df, ["key"], F.col("us"), seconds, "n", width=width).collect()}
    assert got == {i: 0 if t is None else sum(1 for x in data if x[1] == k and x[3] is not None and t - seconds <= x[3] <= t) for i, k, _, t, _ in data}


def test_a_hot_key_is_no_single_window(spark, sf):
    """Every window of the plan has the bucket among its keys, but for those over buckets' totals."""
    from tracequill.sources.audit_log import audit_events

    e = audit_events(spark, sf)
    for df in (behaviour.rate_windows(e), behaviour.markov(e)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line.split("Window [")[1] for line in plan.splitlines() if "Window [" in line]
        over_keys = [w for w in windows if "_key0" in w]
        assert over_keys and all("_bucket" in w for w in over_keys)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert running.running_sums(df, ["key"], F.col("t"), ["t"], {"s": F.col("v")}).count() == 0
    assert running.sliding_counts(df, ["key"], F.col("t"), 5, "n").count() == 0
