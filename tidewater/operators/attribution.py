"""Root causes of a metric's change between two periods: which slices of the dimensions explain it.

Leaves (all dimensions, baseline f and actual v) are aggregated by Spark. The exhaustive search and Adtributor stay
whole DataFrame plans; RiskLoc searches the aggregated leaves, as many as one task holds, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaves(target: DataFrame, baseline: DataFrame, dims: list[str], measure: str) -> DataFrame:
    """dims, f, v: sums of the measure over the baseline and the target."""
    both = baseline.select(*dims, F.col(measure).cast("double").alias("f"), F.lit(0.0).alias("v")).unionByName(target.select(*dims, F.lit(0.0).alias("f"), F.col(measure).cast("double").alias("v")))
    return both.groupBy(*dims).agg(F.sum("f").alias("f"), F.sum("v").alias("v"))


def cuboids(dims: list[str], most: int) -> list[tuple[str, ...]]:
    return [c for k in range(1, min(most, len(dims)) + 1) for c in combinations(dims, k)]


def name(dims: tuple[str, ...] | list[str]):
    return F.concat_ws("&", *[F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dims])


def exhaustive(rows: DataFrame, dims: list[str], max_layer: int = 3, top: int = 10) -> DataFrame:
    """All slices of up to max_layer dimensions with a positive share of the change, the largest first."""
    sets = cuboids(dims, max_layer)
    total = rows.agg(F.sum("f").alias("tf"), F.sum("v").alias("tv"))
    parts = None
    for c in sets:
        part = rows.groupBy(*c).agg(F.sum("f").alias("f"), F.sum("v").alias("v")).select(name(c).alias("slice"), F.lit(len(c)).alias("layer"), "f", "v")
        parts = part if parts is None else parts.unionByName(part)
    # The totals are one row.
    out = parts.join(F.broadcast(total)).withColumn("ep", F.when(F.col("tv") == F.col("tf"), 0.0).otherwise((F.col("v") - F.col("f")) / (F.col("tv") - F.col("tf"))))
    return out.filter("ep > 0").orderBy(F.col("ep").desc(), "slice").limit(top).select("slice", "layer", "f", "v", "ep")


def adtributor(rows: DataFrame, dims: list[str], teep: float = 0.1, tep: float = 0.67, top: int = 3) -> DataFrame:
    """For each dimension the values that explain the change, the most surprising first (Jensen-Shannon)."""
    total = F.broadcast(rows.agg(F.sum("f").alias("tf"), F.sum("v").alias("tv")))
    parts = None
    for d in dims:
        part = rows.groupBy(d).agg(F.sum("f").alias("f"), F.sum("v").alias("v")).select(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), "f", "v")
        parts = part if parts is None else parts.unionByName(part)
    p, q = F.col("f") / F.col("tf"), F.col("v") / F.col("tv")
    term = lambda a: F.when((a > 0) & (p + q > 0), a * F.log(2 * a / (p + q))).otherwise(0.0)
    x = parts.join(total).withColumn("ep", F.when(F.col("tv") == F.col("tf"), 0.0).otherwise((F.col("v") - F.col("f")) / (F.col("tv") - F.col("tf")))).withColumn("surprise", 0.5 * (term(p) + term(q)))
    w = Window.partitionBy("dim").orderBy(F.col("surprise").desc(), "value")
    taken = F.when(F.col("ep") > teep, F.col("ep")).otherwise(0.0)
    x = x.withColumn("before", F.coalesce(F.sum(taken).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # Visited until the explanatory power taken so far passes tep.
    x = x.filter(F.col("before") <= tep)
    got = x.groupBy("dim").agg(F.sum("surprise").alias("surprise"), F.sum(taken).alias("ep"), F.array_sort(F.collect_list(F.when(F.col("ep") > teep, F.struct((-F.col("surprise")).alias("by"), F.coalesce("value", F.lit("null")).alias("value"))))).alias("values"))
    values = F.array_join(F.transform("values", lambda v: v["value"]), ",")
    return got.filter(F.col("ep") > tep).orderBy(F.col("surprise").desc(), "dim").limit(top).select("dim", values.alias("slice_values"), "ep", "surprise")


# --- RiskLoc ------------------------------------------------------------------------------------------------------


def deviation(f: np.ndarray, v: np.ndarray) -> np.ndarray:
    s = f + v
    return np.divide(2 * (f - v), s, out=np.zeros_like(s), where=s != 0)


def cut_point(d: np.ndarray) -> float:
    """Where abnormal deviations begin: the nearer to zero of the sixth distinct one from either end (ties: the lower),
    on the other side of zero."""
    u = np.unique(d)
    lo, hi = u[min(5, len(u) - 1)], u[max(len(u) - 6, 0)]
    return -float(lo if abs(lo) <= abs(hi) else hi)


def abnormal(d: np.ndarray, idle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which leaves are abnormal, and the weight of each in its part; idle: leaves without any value."""
    cut = cut_point(d)
    odd = d < cut if np.signbit(cut) else d > cut
    if not odd.any() and d.any():
        # Few distinct deviations can put the cut beyond all of them; then all on the heavier side of zero are abnormal.
        cut = 0.0
        odd = d > 0 if d[d > 0].sum() > -d[d < 0].sum() else d < 0
    weight = np.where(odd, np.abs(d), np.where(idle, 0, np.abs(cut - d)))
    return odd, np.minimum(weight, 1)


def riskloc(codes: np.ndarray, sizes: list[int], f: np.ndarray, v: np.ndarray, risk: float = 0.5, pep: float = 0.02, max_layer: int = 3, top: int = 3) -> list[tuple[tuple[int, ...], tuple[int, ...], float, float]]:
    """(dimensions, values, risk, share of the change) of each root cause. codes: one column per dimension.

    A leaf's power is its share of the total change; without a change there are no findings. Powers change sign if the
    abnormal leaves' add up to less than nothing. A slice's power is that of all its leaves that no finding holds yet.
    """
    if not len(f) or v.sum() == f.sum():
        return []
    d = deviation(f, v)
    odd, weight = abnormal(d, (f == 0) & (v == 0))
    power = (v - f) / (v.sum() - f.sum())
    if power[odd].sum() < 0:
        power = -power
    least = pep * power[odd].sum()
    alive, out = np.ones(len(d), bool), []
    while len(out) < top and power[odd & alive].sum() >= least:
        best = None
        for layer in range(1, min(max_layer, codes.shape[1]) + 1):
            bar = least
            for dims in combinations(range(codes.shape[1]), layer):
                key = np.ravel_multi_index([codes[:, i] for i in dims], [sizes[i] for i in dims])
                _, key = np.unique(key, return_inverse=True)
                n = int(key.max()) + 1
                add = lambda x: np.bincount(key[alive], x[alive], n)  # noqa: E731, B023
                hits, own = add(odd.astype(float)), add(power)
                w_odd, w_rest = add(np.where(odd, weight, 0)), add(np.where(odd, 0, weight))
                for i in np.argsort(-own, kind="stable"):
                    if own[i] <= bar:
                        break
                    if not hits[i]:
                        continue
                    rows = alive & (key == i)
                    score = w_odd[i] / (w_odd[i] + 1 + w_rest[i]) - ripple(f[rows], v[rows], d[rows])
                    if score >= risk:
                        bar = own[i]
                        best = (dims, tuple(int(codes[np.flatnonzero(rows)[0], x]) for x in dims), float(score), float(own[i]), rows)
                        break
            if best:
                break
        if not best:
            break
        out.append(best[:4])
        alive &= ~best[4]
    return out


def ripple(f: np.ndarray, v: np.ndarray, d: np.ndarray) -> float:
    """How unevenly a slice's leaves moved: deviations from their common rate over those from the baseline, of the leaves
    with both values."""
    ok = (f != 0) & (v != 0)
    base = np.abs(d[ok]).mean() if ok.any() else 0.0
    if not base:
        return 0.0
    f, v = f[ok], v[ok]
    with np.errstate(divide="ignore", invalid="ignore"):
        moved = f * v.sum() / f.sum()
        apart = 2 * (moved - v) / (moved + v)
    return float(np.abs(np.where(np.isfinite(apart), apart, 0.0)).mean() / base)


def locate(rows: DataFrame, dims: list[str], **how: float) -> DataFrame:
    """RiskLoc over leaves(): rank, slice, layer, f, v, risk, ep."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(frames), ignore_index=True).sort_values(dims, ignore_index=True)
        cats = [pd.Categorical(t[c].fillna("null").astype(str)) for c in dims]
        codes = np.stack([c.codes for c in cats], 1).astype(np.int64)
        f, v = t["f"].to_numpy(), t["v"].to_numpy()
        out = []
        for k, (own, values, risk, ep) in enumerate(riskloc(codes, [len(c.categories) for c in cats], f, v, **how)):
            m = np.all([codes[:, i] == x for i, x in zip(own, values, strict=True)], 0)
            out.append((k + 1, "&".join(f"{dims[i]}={cats[i].categories[x]}" for i, x in zip(own, values, strict=True)), len(own), f[m].sum(), v[m].sum(), risk, ep))
        yield pd.DataFrame(out, columns=["rank", "slice", "layer", "f", "v", "risk", "ep"])

    # The search holds all leaves; what comes before stays spread.
    return rows.repartition(1).mapInPandas(run, "rank int, slice string, layer int, f double, v double, risk double, ep double")
