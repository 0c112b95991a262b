"""Array transforms, decayed aggregates, and other small functions of the SQL module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(arr: Column) -> Column:
    """Differences of neighbours; the first is 0, a null neighbour gives null."""
    return F.transform(arr, lambda x, i: F.when(i == 0, F.lit(0).cast("double")).otherwise((x - F.get(arr, i - 1)).cast("double")))


def cum_sum(arr: Column) -> Column:
    """Running sums; a null adds nothing."""
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + F.coalesce(x.cast("double"), F.lit(0.0))
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))

    return F.aggregate(arr, zero, step, lambda acc: acc["out"])


def compact(arr: Column) -> Column:
    """Without repeats of the element before."""
    return F.filter(arr, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(arr, i - 1)))


def decay_weight(ts: Column, as_of: Column, half_life: float) -> Column:
    """2 ** -((as_of - ts) / half_life), times in milliseconds."""
    return F.pow(F.lit(2.0), -(as_of - ts).cast("double") / F.lit(float(half_life)))


def decay_sum(v: Column, ts: Column, as_of: Column, half_life: float) -> Column:
    return F.sum(v * decay_weight(ts, as_of, half_life))


def decay_count(v: Column, ts: Column, as_of: Column, half_life: float) -> Column:
    return F.sum(F.when(v.isNotNull(), decay_weight(ts, as_of, half_life)))


def decay_avg(v: Column, ts: Column, as_of: Column, half_life: float) -> Column:
    return F.try_divide(decay_sum(v, ts, as_of, half_life), decay_count(v, ts, as_of, half_life))


def time_bucket(ts: Column, millis: int) -> Column:
    if millis <= 0:
        raise ValueError("the bucket size must be positive")
    return F.timestamp_millis((F.floor(F.unix_millis(ts) / millis) * millis).cast("bigint"))


def contains_all(arr: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, arr)) == 0
