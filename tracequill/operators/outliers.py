"""Isolation forests that are fitted anew as sessions end: each session is scored by the last one fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.operators import running

#: Sessions between two fits (none is scored before the first), trees, points a tree is grown on, share of sessions taken to be outliers.
REFIT, TREES, POINTS, CONTAMINATION = 10, 100, 256, 0.05


def usual_depth(n: np.ndarray) -> np.ndarray:
    """The mean depth at which a search in a random tree of n points ends."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n < 2, 0.0, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n)


def isolation_scores(fitted: np.ndarray, others: np.ndarray, seed, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the points fitted and of the others, -1 for an outlier to 0. All trees grow together, level by level; the others follow the cuts."""
    rng, m = np.random.default_rng(seed), len(fitted)
    x = np.concatenate([fitted, others])
    depth, alive, node = np.zeros((trees, len(x))), np.ones((trees, len(x)), bool), np.zeros((trees, len(x)), int)
    deepest = int(np.ceil(np.log2(max(2, m))))
    for level in range(deepest + 1):
        nodes = trees << level
        at = node + (np.arange(trees) << level)[:, None]
        t, p = np.nonzero(alive[:, :m])
        held = np.bincount(at[t, p], minlength=nodes)
        low, high = np.full((x.shape[1], nodes), np.inf), np.full((x.shape[1], nodes), -np.inf)
        for f in range(x.shape[1]):
            np.minimum.at(low[f], at[t, p], fitted[p, f])
            np.maximum.at(high[f], at[t, p], fitted[p, f])
        spread = high > low
        ends = (held < 2) | ~spread.any(axis=0) | (level == deepest)
        stop = alive & ends[at]
        depth[stop] = level + usual_depth(held[at[stop]])
        alive &= ~stop
        feature = np.argmax(rng.random(spread.shape) * spread, axis=0)
        which = np.arange(nodes)
        cut = low[feature, which] + rng.random(nodes) * np.where(ends, 0, high[feature, which] - low[feature, which])
        right = x[np.arange(len(x))[None, :], feature[at]] >= cut[at]
        node = np.where(alive, 2 * node + right, 0)
    scores = -(2.0 ** (-depth.mean(axis=0) / max(float(usual_depth(m)), 1.0)))
    return scores[:m], scores[m:]


def refitted(features: DataFrame, keys: list[str] | None = None, refit: int = REFIT, points: int = POINTS, seed: int = 42) -> DataFrame:
    """Scores of ended sessions: session_id, the keys, samples_seen, fitted_on, raw_score (below 0: an outlier), anomaly_score, is_anomaly; sessions before a key's first fit have none.

    features: session_id, ended_ns, the keys and the numbers to read (null is 0). Sessions of a key are numbered by when they ended; at each `refit` of them a forest is fitted to those ended
    so far, itself included, and scores the sessions up to the next fit. A forest reads about `points` of them, drawn by their hashes (all, if they are no more), so that every fit is a
    group of bounded size, whatever the history; how many fits a session takes part in falls with its hash. Raw scores are against the 5th percentile of the points fitted.
    """
    keys = keys or []
    names = [c for c in features.columns if c not in ("session_id", "ended_ns", *keys)]
    rows = features.select("session_id", "ended_ns", *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    rows = running.running_sums(rows, keys, F.col("ended_ns"), ["ended_ns", "session_id"], {"_seen": F.lit(1)}).withColumn("_seen", F.col("_seen") + 1)
    last = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.max("_seen").alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    rows = rows.join(last, same) if keys else rows.crossJoin(F.broadcast(last))  # without keys one row
    share = (F.pmod(F.xxhash64("session_id", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    first, until = F.ceil(F.col("_seen") / refit), F.least(F.floor(F.col("_all") / refit), F.floor(F.lit(float(points)) / refit / share))
    fits = F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))
    own = F.floor(F.col("_seen") / refit)
    both = rows.select(*keys, "session_id", "_seen", *names, F.explode(F.concat(F.transform(fits, lambda v: F.struct(v.alias("v"), F.lit(True).alias("fit"))), F.array(F.struct(own.alias("v"), F.lit(False).alias("fit"))))).alias("_use"))
    both = both.where("_use.v > 0").select(*keys, "session_id", "_seen", *names, F.col("_use.v").alias("_version"), F.col("_use.fit").alias("_fit"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_seen", "session_id"])
        fit, rest = pdf[pdf["_fit"]], pdf[~pdf["_fit"]]
        out = rest[[*keys, "session_id", "_seen"]].rename(columns={"_seen": "samples_seen"})
        known, new = isolation_scores(fit[names].to_numpy(), rest[names].to_numpy(), [seed, int(pdf["_version"].iloc[0])])
        raw = new - (np.percentile(known, 100 * CONTAMINATION) if len(known) else -0.5)
        return out.assign(fitted_on=len(fit), raw_score=raw, anomaly_score=np.clip(0.5 - raw, 0, 1), is_anomaly=raw < 0)

    # a fit costs far more than its few bytes tell: a stated number of partitions is not merged
    both = both.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_version")
    typed_keys = "".join(f"`{k}` {features.schema[k].dataType.simpleString()}, " for k in keys)
    return both.groupBy(*keys, "_version").applyInPandas(run, f"{typed_keys}session_id string, samples_seen long, fitted_on long, raw_score double, anomaly_score double, is_anomaly boolean")
