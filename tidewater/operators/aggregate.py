"""Aggregations over groups of one or several inputs; every aggregate is built from mergeable built-in ones, so Spark
combines on the map side before any shuffle."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import expr
from ..plans.filters import compile_filter
from ..plans.schema import types_of

TIME = "__timestamp"
#: Aggregates that also work over the rows of a window.
WINDOWED = ("count", "sum", "avg", "max", "min", "std", "first", "last", "arg_max", "arg_min", "array_agg", "simple_regression")


def value(f: dict, types: dict[str, str], key: str = "field", text: str = "expression") -> Column:
    return expr.compile_expression(f[text], types) if f.get(text) else F.col(f.get(key) or f["name"])


def payload(f: dict) -> Column:
    return F.struct(*f["fields"]) if f.get("fields") else F.col(f.get("field") or f["name"])


def weight(f: dict, types: dict[str, str]) -> Column | None:
    if f.get("weightField") or f.get("weightExpression"):
        return value(f, types, "weightField", "weightExpression").cast("double")
    return None


class Calls:
    """The built-in aggregates, each over a window if there is one: arithmetic on top of them works either way."""

    def __init__(self, window: object = None):
        self.window = window

    def __getattr__(self, name: str):
        call = getattr(F, name)
        return call if self.window is None else lambda *args: call(*args).over(self.window)


def column(op: str, f: dict, types: dict[str, str], cond: Column, window: object = None) -> Column:
    when = lambda c: F.when(cond, c)
    A = Calls(window)  # noqa: N806
    if op == "count":
        return A.count(when(F.lit(1)))
    if op == "sum":
        c = value(f, types)
        kind = "double" if f.get("expression") else types[f.get("field") or f["name"]]
        if kind == "boolean":
            return A.bool_or(when(c))
        if kind == "string":
            return F.array_join(F.array_sort(A.collect_list(when(c))), "")
        total = A.sum(when(c))
        return total if kind.startswith("decimal") else F.coalesce(total, F.lit(0)).try_cast(kind)
    if op == "avg":
        c, w = value(f, types).cast("double"), weight(f, types)
        if w is None:
            return A.avg(when(c))
        ok = cond & c.isNotNull() & w.isNotNull() & (w != 0)
        return F.try_divide(A.sum(F.when(ok, c * w)), A.sum(F.when(ok, w)))
    if op in ("max", "min"):
        return getattr(A, op)(when(value(f, types)))
    if op in ("last", "first"):
        by = A.max_by if op == "last" else A.min_by
        return by(when(payload(f)), when(F.col(f.get("timestampField", TIME))))
    if op in ("arg_max", "arg_min"):
        by = A.max_by if op == "arg_max" else A.min_by
        return by(when(payload(f)), when(value(f, types, "comparingField", "comparingExpression")))
    if op == "std":
        c, w = value(f, types).cast("double"), weight(f, types)
        w = F.lit(1.0) if w is None else F.abs(w)
        ok = cond & c.isNotNull() & ~F.isnan(c) & w.isNotNull()
        n, s1, s2 = (A.sum(F.when(ok, x)) for x in (w, w * c, w * c * c))
        ddof = float(f.get("ddof", 1))
        var = F.when(n > ddof, F.greatest(F.lit(0.0), s2 - s1 * s1 / n) / (n - ddof))
        return var if f.get("outputVar") else F.sqrt(var)
    if op == "simple_regression":
        return simple_regression(f, types, cond, A)
    if op == "array_agg":
        item = A.collect_list(when(F.struct(payload(f).alias("v"))))
        order = f.get("order", "none")
        if order != "none":
            less, more = (-1, 1) if order.lower() == "ascending" or order.lower() == "asc" else (1, -1)
            # Nulls last in either order.
            item = F.array_sort(item, lambda a, b: F.when(a["v"].isNull() & b["v"].isNull(), 0).when(a["v"].isNull(), 1).when(b["v"].isNull(), -1).when(a["v"] < b["v"], less).when(a["v"] > b["v"], more).otherwise(0))
        return F.transform(item, lambda x: x["v"])
    if op == "regression":
        return regression(f, types, cond)
    if op == "any":
        return A.any_value(when(value(f, types)), True)
    raise ValueError(f"unknown aggregate {op!r}")


def simple_regression(f: dict, types: dict[str, str], cond: Column, A: Calls) -> Column:  # noqa: N803
    y = value(f, types).cast("double")
    x = F.col(f["xField"]).cast("double") if f.get("xField") else F.unix_millis(F.col(TIME).cast("timestamp")).cast("double")
    w = weight(f, types)
    w = F.lit(1.0) if w is None else w
    ok = cond & x.isNotNull() & y.isNotNull() & w.isNotNull()
    total = lambda c: A.sum(F.when(ok, c))
    n, sw, sx, sy = A.count(F.when(ok, 1)), total(w), total(w * x), total(w * y)
    cut = f.get("hasIntercept", True)
    sxx, sxy, syy = total(w * x * x), total(w * x * y), total(w * y * y)
    if cut:
        sxx, sxy, syy = sxx - sx * sx / sw, sxy - sx * sy / sw, syy - sy * sy / sw
    slope = F.when((n < 2) | (F.abs(sxx) < 1e-300), float("nan")).otherwise(F.try_divide(sxy, sxx))
    rmse = F.sqrt(F.greatest(F.lit(0.0), syy - F.try_divide(sxy * sxy, sxx)) / sw)
    return F.struct(slope.alias("Slope"), ((sy - slope * sx) / sw if cut else F.lit(0.0)).alias("Intercept"), rmse.alias("RMSE"), n.alias("N"))


def regression(f: dict, types: dict[str, str], cond: Column) -> Column:
    """Least squares on several fields by the Gram matrix: its sums are ordinary aggregates, a small solve ends it."""
    cut, ridge = bool(f.get("hasIntercept", True)), float(f.get("ridge", 0.0))
    xs = [F.col(x).cast("double") for x in f["xFields"]]
    y = value(f, types).cast("double")
    ok = reduce(lambda a, b: a & b, [c.isNotNull() for c in (*xs, y)], cond)
    cols = ([F.lit(1.0)] if cut else []) + xs
    k = len(cols)
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    gram = [total(cols[i] * cols[j]) for i in range(k) for j in range(i, k)]

    @F.pandas_udf("Coefficients array<double>, RMSE double, N bigint")
    def solve(parts):
        import pandas as pd

        out = []
        for p in parts:
            p = np.asarray(p, float)
            a = np.zeros((k, k))
            a[np.triu_indices(k)] = p[: k * (k + 1) // 2]
            a = a + np.triu(a, 1).T
            b, yy, n = p[-k - 2 : -2], p[-2], p[-1]
            if n == 0:
                out.append((None, None, 0))
                continue
            beta = np.linalg.lstsq(a + ridge * np.eye(k), b, rcond=None)[0]
            out.append((beta.tolist(), float(np.sqrt(max(0.0, yy - 2 * beta @ b + beta @ a @ beta) / n)), int(n)))
        return pd.DataFrame(out, columns=["Coefficients", "RMSE", "N"])

    return solve(F.array(*gram, *[total(c * y) for c in cols], total(y * y), F.count(F.when(ok, 1)).cast("double")))


def aggregate(inputs: dict[str, DataFrame] | DataFrame, fields: list[dict], group_fields: list[str] | None = None, filter: object = None, select: list[dict] | None = None, limit: int | None = None, flatten: str | None = None, window: Column | None = None) -> DataFrame:
    """Groups one or several inputs by the same fields; a field with `input` counts only that input's rows.

    Several inputs meet in one union with their name in __input, so a group without rows of an input still appears.
    A window (operators.windows.assigned) is one more group field, named window. limit: the most rows of each group, of
    its first windows.
    """
    group_fields = group_fields or []
    if isinstance(inputs, dict):
        frames = [df.withColumn("__input", F.lit(name)) for name, df in inputs.items()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    else:
        df = inputs
    types = types_of(df)
    cols = []
    for f in fields:
        cond = compile_filter(f["condition"], types) if f.get("condition") is not None else F.lit(True)
        if f.get("input"):
            cond = cond & (F.col("__input") == f["input"])
        cols.append(column(f["op"], f, types, cond).alias(f["name"]))
    out = df.groupBy(*([window.alias("window")] if window is not None else []), *group_fields).agg(*cols)
    group_fields = [*(["window"] if window is not None else []), *group_fields]
    if filter is not None:
        out = out.filter(compile_filter(filter, types_of(out)))
    if select:
        from .select import select as project

        out = project(out, [*({"name": g} for g in group_fields), *select])
    hidden = [f["name"] for f in fields if f.get("ignore")]
    out = out.drop(*hidden)
    if limit is not None and window is not None:
        # Without windows a group has one row.
        keys = [g for g in group_fields if g != "window"]
        out = first_rows(out, keys, [F.col("window").asc()], limit) if keys else out.orderBy("window").limit(limit)
    if flatten:
        from .select import flattened

        out = flattened(out, flatten)
    return out


def first_rows(df: DataFrame, group_fields: list[str], order: list[Column], count: int) -> DataFrame:
    """At most count rows of each group."""
    place = F.row_number().over(Window.partitionBy(*group_fields).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= count).drop("__place")
