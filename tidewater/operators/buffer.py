"""Each row with the earlier rows of its key: the per-key history that sequence and refit functions read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import compile_filter
from ..plans.schema import types_of
from .select import TIME


def buffered(
    df: DataFrame, keys: list[str], max_count: int | None = None, max_seconds: int | None = None, include_current: bool = True, buffer_filter: object = None,
    trigger_filter: object = None, dedup: list[str] | None = None, fields: list[str] | None = None, order: list[str] | None = None, name: str = "buffer",
) -> DataFrame:
    """The rows that trigger_filter passes, with an array of the rows of their key up to them, oldest first.

    buffer_filter chooses the rows that are kept; the row itself comes last with include_current, kept or not. Only rows
    of the last max_seconds are seen, and of these the newest max_count (the row itself included). dedup leaves the
    first row of each of its values. Rows with a null key have no history. Rows of the same time come in the order of
    the columns in `order`; without them that order is undefined. Without max_count and max_seconds an array holds the
    key's whole past, so its size grows with the key.
    """
    types = types_of(df)
    test = lambda f: F.coalesce(compile_filter(f, types), F.lit(False)) if f is not None else F.lit(True)
    fields = list(dict.fromkeys([TIME, *keys, *(fields or [c for c in df.columns if c != TIME]), *(dedup or [])]))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    df = df.withColumn("__keep", test(buffer_filter)).withColumn("__trigger", test(trigger_filter))
    by = Window.partitionBy(*keys)
    past_rows = df.filter(known).withColumn("__at", F.count_if("__keep").over(by.orderBy(TIME, *(order or [])).rowsBetween(Window.unboundedPreceding, 0)))
    micros = F.unix_micros(F.col(TIME).cast("timestamp"))
    # Kept rows are numbered within their key: the newest n are a range of numbers, however many others lie between.
    if max_count is not None:
        frame = by.orderBy("__at").rangeBetween(-max_count, 0)
    elif max_seconds is not None:
        frame = by.orderBy(micros).rangeBetween(-max_seconds * 10**6, 0)
    else:
        frame = by.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    entry = lambda at: F.struct(at.alias("__at"), *fields)
    last = F.col("__at") - F.col("__keep").cast("long")

    def seen(e: Column) -> Column:
        ok = e["__at"] <= last
        if max_count is not None:
            ok = ok & (e["__at"] > last - (max_count - int(include_current)))
        if max_seconds is not None:
            ok = ok & (F.unix_micros(e[TIME].cast("timestamp")) >= micros - max_seconds * 10**6)
        return ok

    past_rows = past_rows.withColumn("__past", F.collect_list(F.when(F.col("__keep"), entry(F.col("__at")))).over(frame)).filter("__trigger")
    past = F.array_sort(F.filter("__past", seen), lambda a, b: (a["__at"] - b["__at"]).cast("int"))
    own = F.array(entry(last + 1)) if include_current and max_count != 0 else F.array()
    with_past = past_rows.withColumn(name, F.concat(past, own) if include_current and max_count != 0 else past)
    without = df.filter(~known & F.col("__trigger")).withColumn("__at", F.lit(0).cast("long")).withColumn("__keep", F.lit(False))
    without = without.withColumn(name, own.cast(with_past.schema[name].dataType))
    out = with_past.drop("__past").unionByName(without)
    if dedup:
        same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in dedup])
        out = out.withColumn(name, F.filter(name, lambda e, i: ~F.exists(F.slice(name, 1, i), lambda p: same(e, p))))
    return out.withColumn(name, F.transform(name, lambda e: F.struct(*[e[c].alias(c) for c in fields]))).drop("__at", "__keep", "__trigger")
