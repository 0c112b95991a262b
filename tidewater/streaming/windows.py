"""Event-time aggregation, deduplication and per-key buffers on streams; the same calls work on bounded tables."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from ..operators.select import TIME
from ..operators.windows import assigned
from ..plans.filters import compile_filter
from ..plans.schema import types_of


def windowed(df: DataFrame, ts: str, strategy: dict, keys: list[str], aggs: list[Column], lateness: str = "0 seconds") -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark(ts, lateness)
    return df.groupBy(assigned(ts=F.col(ts), **strategy).alias("window"), *keys).agg(*aggs)


def dedup(df: DataFrame, ts: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """The first row of each key within the lateness of a stream, one row of each key of a table."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def limited(df: DataFrame, key: str, count: int, schema: str) -> DataFrame:
    """At most count rows of each key over a stream's life."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for f in frames:
            if seen < count:
                out = f.head(count - seen)
                seen += len(out)
                yield out
        state.update((seen,))

    return df.groupBy(key).applyInPandasWithState(step, schema, "seen int", "append", GroupStateTimeout.NoTimeout)


def history(df: DataFrame, keys: list[str], max_count: int | None = None, max_seconds: int | None = None, include_current: bool = True, buffer_filter: object = None, trigger_filter: object = None, ttl_seconds: int | None = None, lateness: str = "0 seconds", name: str = "buffer") -> DataFrame:
    """operators.buffer.buffered on a stream: each row with the earlier kept rows of its key.

    Rows come in the order of their event time within a micro-batch, batches in the order of arrival. The state of a key
    is bounded by max_count and max_seconds, one of which must be given; ttl_seconds drops keys without new rows.
    """
    if max_count is None and max_seconds is None:
        raise ValueError("a stream's history needs maxCount or maxDurationSeconds")
    if ttl_seconds is not None:
        df = df.withWatermark(TIME, lateness)
    fields, types = df.columns, types_of(df)
    test = lambda f: F.coalesce(compile_filter(f, types), F.lit(False)) if f is not None else F.lit(True)
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(StructType(df.schema.fields)))])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = pickle.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(TIME, kind="stable").to_dict("records")
        known, out, newest = not any(pd.isna(x) for x in k), [], None
        for r in rows:
            keep, trigger = r.pop("__keep"), r.pop("__trigger")
            newest = r[TIME] if newest is None else max(newest, r[TIME])
            if max_seconds is not None:
                past = [q for q in past if q[TIME] >= newest - pd.Timedelta(seconds=max_seconds)]
            if trigger:
                seen = past + ([r] if include_current else [])
                out.append({**r, name: seen[max(0, len(seen) - max_count) :] if max_count is not None else seen})
            if keep and known:
                past = [*past, r]
                past = past[max(0, len(past) - max_count) :] if max_count is not None else past
        state.update((pickle.dumps(past),))
        if ttl_seconds is not None:
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[*fields, name])

    marked = df.withColumn("__keep", test(buffer_filter)).withColumn("__trigger", test(trigger_filter))
    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.EventTimeTimeout
    return marked.groupBy(*keys).applyInPandasWithState(step, schema, "rows binary", "append", timeout)
