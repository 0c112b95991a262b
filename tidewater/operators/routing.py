"""Union, partition, compare, reshuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import compile_filter
from ..plans.schema import types_of
from .select import select


def union(inputs: dict[str, DataFrame], mappings: list[dict] | None = None, base: str | None = None, tagged: bool = True) -> DataFrame:
    """All rows of all inputs; the schema is the first-seen field of each name, missing ones are null.

    base takes one input's fields only; mappings name the field of each input that an output field comes from.
    """
    if mappings:
        inputs = {n: df.select(*[F.col(i["field"]).alias(m["outputField"]) for m in mappings for i in m["inputs"] if i["input"] == n]) for n, df in inputs.items()}
    kinds: dict[str, str] = {}
    for name in [base] if base else inputs:
        for f in inputs[name].schema.fields:
            kinds.setdefault(f.name, f.dataType.simpleString())
    frames = []
    for name, df in inputs.items():
        cols = [(F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
        frames.append(df.select(*cols, *([F.lit(name).alias("__input")] if tagged else [])))
    return reduce(DataFrame.unionByName, frames)


def partition(df: DataFrame, parts: list[dict], exclusive: bool = True) -> dict[str, DataFrame]:
    """Named outputs by filter; exclusive rows go to the first that fits. `excluded` has the rows that fit none; an
    output without a filter gets none."""
    types = types_of(df)
    fits = [F.lit(False) if p.get("filter") is None else compile_filter(p["filter"], types) for p in parts]
    out = {}
    taken = F.lit(False)
    for p, fit in zip(parts, fits, strict=True):
        rows = df.filter(fit & ~taken if exclusive else fit)
        out[p["name"]] = select(rows, p["select"]) if p.get("select") else rows
        taken = taken | fit
    out["excluded"] = df.filter(~taken)
    return out


def compare(inputs: dict[str, DataFrame], keys: list[str], table: str = "") -> DataFrame:
    """Keys that some input lacks or repeats, or whose fields differ: table, keys, missingInputs, duplicatedInputs,
    differences (field, values by input)."""
    names = list(inputs)
    every = list(dict.fromkeys(c for df in inputs.values() for c in df.columns))
    fields = [c for c in every if c not in keys]
    frames = [df.select(*keys, F.lit(n).alias("__input"), *[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in fields]) for n, df in inputs.items()]
    rows = reduce(DataFrame.unionByName, frames)
    counts = [F.count_if(F.col("__input") == n).alias(f"__n{i}") for i, n in enumerate(names)]
    # Nulls count as a value of their own.
    values = [F.collect_set(F.struct(F.col(c).alias("v"))).alias(f"__v_{c}") for c in fields]
    shown = [F.array_sort(F.collect_set(F.struct("__input", F.col(c).alias("v")))).alias(f"__m_{c}") for c in fields]
    grouped = rows.groupBy(*keys).agg(*counts, *values, *shown)
    pick = lambda test: F.filter(F.array(*[F.when(test(F.col(f"__n{i}")), F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    entry = lambda c: F.when(F.size(f"__v_{c}") > 1, F.struct(F.lit(c).alias("field"), F.transform(f"__m_{c}", lambda e: F.concat_ws("=", e["__input"], F.coalesce(e["v"], F.lit("")))).alias("values")))
    differences = F.filter(F.array(*[entry(c) for c in fields]), lambda x: x.isNotNull()) if fields else F.array()
    out = grouped.select(F.lit(table).alias("table"), *keys, pick(lambda n: n == 0).alias("missingInputs"), pick(lambda n: n > 1).alias("duplicatedInputs"), differences.alias("differences"))
    return out.filter((F.size("missingInputs") > 0) | (F.size("duplicatedInputs") > 0) | (F.size("differences") > 0))


def reshuffle(df: DataFrame, n: int | None = None) -> DataFrame:
    return df.repartition(n) if n else df.repartition(df.sparkSession.sparkContext.defaultParallelism)
