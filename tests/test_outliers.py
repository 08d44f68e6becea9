"""Forests fitted anew as sessions end."""

import numpy as np
import pytest

from tracequill.operators import outliers

SCHEMA = "session_id string, ended_ns long, org string, a double, b double"


def sessions(n, seed=1):
    r = np.random.default_rng(seed)
    return [(f"s{i:03}", int(r.integers(0, 10**15)) if i % 9 else 5, ["x", "y", None][int(r.integers(0, 3))], float(r.normal()), None if i % 17 == 0 else float(r.normal())) for i in range(n)]


def test_equals_a_loop(spark):
    rows = sessions(120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["session_id"]: r for r in outliers.refitted(df, ["org"]).collect()}
    want = {}
    for org in ("x", "y", None):
        seen, model = [], None
        for s, _, _, a, b in sorted((r for r in rows if r[2] == org), key=lambda r: (r[1], r[0])):
            seen.append((a, b or 0.0))
            if len(seen) % 10 == 0:
                model = np.array(seen)
            if model is not None:
                want[s] = (len(seen), len(model), model, seen[-1])
    assert set(got) == set(want) and 0 < len(got) < len(rows)
    groups = {}
    for s, (n, m, model, point) in want.items():
        assert (got[s]["samples_seen"], got[s]["fitted_on"]) == (n, m)
        groups.setdefault((rows[int(s[1:])][2], m), []).append((n, s, model, point))
    for (_, m), scored in groups.items():
        scored.sort()
        known, new = outliers.isolation_scores(scored[0][2], np.array([p for *_, p in scored]), [42, m // 10])
        raw = new - np.percentile(known, 5)
        assert [got[s]["raw_score"] for _, s, _, _ in scored] == pytest.approx(list(raw))
        assert [got[s]["is_anomaly"] for _, s, _, _ in scored] == list(raw < 0)


def test_few_points_of_a_long_history(spark):
    points = np.random.default_rng(2).normal(size=(1000, 2))
    points[990] = 50
    rows = [(f"s{i:04}", i, "x", *map(float, p)) for i, p in enumerate(points)]
    got = {r["session_id"]: r for r in outliers.refitted(spark.createDataFrame(rows, SCHEMA).drop("org"), points=64).collect()}
    assert len(got) == 991 and min(r["samples_seen"] for r in got.values()) == 10
    late = [r for r in got.values() if r["samples_seen"] > 200]
    assert all(25 <= r["fitted_on"] <= 115 for r in late)
    assert got["s0990"]["is_anomaly"] and got["s0990"]["raw_score"] < np.percentile([r["raw_score"] for r in late], 5)


def test_equal_points_and_empty_tables(spark):
    same = spark.createDataFrame([(f"s{i}", 7, "x", 1.0, 1.0) for i in range(25)], SCHEMA)
    got = outliers.refitted(same, ["org"]).collect()
    assert len(got) == 16 and all(r["raw_score"] == 0 and not r["is_anomaly"] for r in got)
    assert outliers.refitted(same.limit(0), ["org"]).count() == 0
    assert outliers.refitted(same.limit(9).drop('org')).count() == 0
    known, new = outliers.isolation_scores(np.array([[0.0], [1.0], [2.0], [3.0], [2.5], [1.5]]), np.array([[100.0], [1.4]]), 3)
    assert new[0] < new[1] and len(known) == 6
