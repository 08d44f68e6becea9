"""Running sums and last values of a key without one window over all of its rows.

Rows of a key are dealt into buckets of time. What stands before a bucket comes from the buckets' totals, of which there
is one row a bucket, what stands before a row within its bucket from a window over that bucket alone. So a key that holds
a third of all rows is spread over as many tasks as it has buckets; no window holds more than a key's rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An hour in nanoseconds: the width of buckets unless a caller says otherwise.
HOUR = 3_600_000_000_000
#: Stands for a null key, so that null keys meet.
NO_KEY = "\x00"


def _bucketed(rows: DataFrame, keys: list[str], at: Column, width: int) -> tuple[DataFrame, list[str]]:
    """The rows with the columns of their bucket, and these columns' names. Rows without a time form the first bucket of their key, as nulls come first in an order."""
    named = {f"_key{i}": F.coalesce(F.col(k).cast("string"), F.lit(NO_KEY)) for i, k in enumerate(keys)}
    named["_bucket"] = F.coalesce(F.floor(at / F.lit(width)).cast("long"), F.lit(-(1 << 62)))
    return rows.withColumns(named), list(named)


def _before(rows: DataFrame, bucket: list[str], totals: dict[str, Column], across) -> DataFrame:
    """For each bucket what stands before it: across(name, window) of the totals of the key's buckets before."""
    w = Window.partitionBy(*bucket[:-1]).orderBy(bucket[-1]).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*bucket).agg(*[c.alias(n) for n, c in totals.items()])
    return whole.select(*bucket, *[across(n, w).alias(f"_before_{n}") for n in totals])


def running_sums(rows: DataFrame, keys: list[str], at: Column, order: list, sums: dict[str, Column], width: int = HOUR, peers: bool = False) -> DataFrame:
    """The rows with, by name, the sums of whole numbers over the rows of the same keys that come before each; 0 where there are none.

    at is a number that never falls along the order. With peers, the row itself and all rows of an equal order count too; the order is one number then.
    """
    rows, bucket = _bucketed(rows, keys, at, width)
    rows = rows.withColumns({f"_value_{n}": c.cast("long") for n, c in sums.items()})
    local = Window.partitionBy(*bucket).orderBy(*order)
    local = local.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else local.rowsBetween(Window.unboundedPreceding, -1)
    before = _before(rows, bucket, {n: F.sum(f"_value_{n}") for n in sums}, lambda n, w: F.sum(n).over(w))
    out = rows.withColumns({f"_local_{n}": F.sum(f"_value_{n}").over(local) for n in sums}).join(before, bucket, "left")
    none = F.lit(0).cast("long")
    found = {n: F.coalesce(f"_local_{n}", none) + F.coalesce(f"_before_{n}", none) for n in sums}
    return out.withColumns(found).drop(*bucket, *[f"{p}_{n}" for n in sums for p in ("_value", "_local", "_before")])


def last_before(rows: DataFrame, keys: list[str], at: Column, order: list, value: Column, name: str, width: int = HOUR) -> DataFrame:
    """The rows with the last value that isn't null among the rows of the same keys before each; null where there is none. at is as in running_sums."""
    rows, bucket = _bucketed(rows, keys, at, width)
    rows = rows.withColumn("_value", value)
    local = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    before = _before(rows, bucket, {"value": latest}, lambda n, w: F.last(n, ignorenulls=True).over(w))
    out = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(local)).join(before, bucket, "left")
    return out.withColumn(name, F.coalesce("_local", "_before_value")).drop(*bucket, "_value", "_local", "_before_value")


def sliding_counts(rows: DataFrame, keys: list[str], us: Column, seconds: int, name: str, width: int | None = None) -> DataFrame:
    """The rows with the number of rows of the same keys within so many seconds up to each, rows of an equal time included; 0 for rows without a time, which count for none.

    us: microseconds. Each row counts from its time on and stops to count just after the seconds have passed, so a running sum of both is what the window holds. width: of buckets, in
    microseconds; the seconds, an hour at most, by default.
    """
    span = seconds * 1_000_000
    # even numbers are arrivals; what leaves at a time leaves after those that arrive then
    marks = F.array(F.struct((2 * us).alias("at"), F.lit(1).alias("step")), F.struct((2 * (us + span) + 1).alias("at"), F.lit(-1).alias("step")))
    both = rows.withColumn("_mark", F.explode(F.when(us.isNotNull(), marks).otherwise(F.slice(marks, 1, 1))))
    step = F.when(F.col("_mark.at").isNotNull(), F.col("_mark.step")).otherwise(0)
    counted = running_sums(both, keys, F.col("_mark.at"), [F.col("_mark.at")], {name: step}, width=2 * (width or min(span, HOUR // 1000)), peers=True)
    return counted.where("_mark.step = 1").drop("_mark")
