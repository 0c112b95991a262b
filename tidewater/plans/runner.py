"""Declared jobs: sources, transforms and sinks as a graph of named steps, each a lazy DataFrame."""

from __future__ import annotations

import json
from string import Template

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, attribution, buffer, cdc, routing
from ..operators import select as selects
from ..operators import windows
from ..sources import io, outbound
from ..streaming import windows as streams
from . import sqlx
from .filters import compile_filter
from .schema import types_of


class ConfigError(ValueError):
    pass


def load(text: str, args: dict | None = None) -> dict:
    """A JSON or YAML text; ${args.name} parts are filled in."""
    for k, v in (args or {}).items():
        text = text.replace("${args." + k + "}", str(v))
    text = Template(text).safe_substitute({})
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def build(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Every step's output by name, several outputs as name.tag; no sink runs."""
    return executed(spark, [("source", s) for s in config.get("sources", [])] + [("transform", t) for t in config.get("transforms", [])])


def executed(spark: SparkSession, steps: list[tuple[str, dict]]) -> dict:
    """Runs the steps as their inputs, side inputs and the steps they wait for are there; sinks when nothing else is left
    to do, so that a wrong step is found before anything is written."""
    done: dict = {}
    finished, names = set(), {s["name"] for _, s in steps if "name" in s}
    here = lambda i: i in done or i.endswith(".*") and i[:-2] in finished
    for _, s in steps:
        if unknown := [i for i in [*inputs_of(s), *s.get("sideInputs", [])] if i.partition(".")[0] not in names and i not in names]:
            raise ConfigError(f"step {s.get('name')!r} has unknown inputs {unknown}")
    while steps:
        ready = [k for k in steps if all(here(i) for i in [*inputs_of(k[1]), *k[1].get("sideInputs", [])]) and all(w in finished for w in k[1].get("waits", []) if w in names)]
        if not ready:
            raise ConfigError(f"steps wait for unknown or circular inputs: {[s.get('name') for _, s in steps]}")
        for kind, s in [k for k in ready if k[0] != "sink"] or ready:
            done.update({"source": source, "transform": derived, "sink": sink}[kind](spark, s, done))
            steps = [k for k in steps if k[1] is not s]
            finished.add(s.get("name"))
    return done


def source(spark: SparkSession, s: dict, done: dict) -> dict:
    p = s.get("parameters", {})
    df = outbound.act(spark, s["module"].removeprefix("action."), p) if s["module"].startswith("action.") else io.read(spark, s["module"], p)
    if s.get("timestampAttribute"):
        df = df.withColumn(selects.TIME, F.col(s["timestampAttribute"]).cast("timestamp"))
    return {s["name"]: df}


def derived(spark: SparkSession, t: dict, done: dict) -> dict:
    out = transform(spark, t, {i: done[i] for i in [*inputs_of(t), *t.get("sideInputs", [])]})
    return {t["name"]: out} if isinstance(out, DataFrame) else {f"{t['name']}.{k}" if k else t["name"]: v for k, v in out.items()}


def sink(spark: SparkSession, s: dict, done: dict) -> dict:
    """Writes its inputs; an input like name.* goes to one sink for each tag. A stream's query comes back by the sink's
    name (and tag), an action's result too."""
    out = {}
    for i in inputs_of(s):
        names = [n for n in done if n.startswith(i[:-1])] if i.endswith(".*") else [i]
        for n in names:
            tag = n.rpartition(".")[2]
            params = {k: v.replace("${input.tag}", tag) if isinstance(v, str) else v for k, v in s.get("parameters", {}).items()}
            if s["module"].startswith("action."):
                out[s["name"]] = outbound.act(spark, s["module"].removeprefix("action."), params, done[n])
            else:
                query = io.write(done[n], s["module"], params, s.get("name"))
                if query is not None:
                    out[f"{s['name']}.{tag}" if i.endswith(".*") else s["name"]] = query
    return out


def inputs_of(t: dict) -> list[str]:
    return t.get("inputs") or ([t["input"]] if "input" in t else [])


def window_of(t: dict) -> dict | None:
    """The window of a step's strategy, or None for the global one."""
    p = t.get("parameters", {})
    w = (t.get("strategy") or p.get("strategy") or {}).get("window") or p.get("window")
    return None if not w or w.get("type", "global") == "global" else w


def assigned(w: dict) -> Column:
    given = {"kind": w["type"], "zone": w.get("timezone"), "start": w.get("startDate"), **{k: w.get(k) for k in ("size", "unit", "period", "offset", "gap")}}
    return windows.assigned(ts=F.col(selects.TIME), **{k: v for k, v in given.items() if v is not None})


def timed(df: DataFrame, w: dict) -> DataFrame:
    """A stream with the watermark that the window's allowed lateness asks for."""
    return df.withWatermark(selects.TIME, windows.duration(w.get("allowedLateness", 0), w.get("unit", "second"))) if df.isStreaming else df


def failures(rows: DataFrame, t: dict) -> DataFrame:
    """Dead letters: rows with their error in __error, as records of one form for all steps."""
    at = F.col(selects.TIME).cast("timestamp") if selects.TIME in rows.columns else F.lit(None).cast("timestamp")
    kept = [c for c in rows.columns if c != "__error"]
    return rows.select(F.lit(t["name"]).alias("job"), F.lit(t["module"]).alias("module"), F.to_json(F.struct(*kept)).alias("input"), F.col("__error").alias("error"), F.current_timestamp().alias("timestamp"), at.alias("eventtime"))


def transform(spark: SparkSession, t: dict, inputs: dict[str, DataFrame]) -> DataFrame | dict[str, DataFrame]:
    p, module = t.get("parameters", {}), t["module"]
    one = next(iter(inputs.values())) if len(inputs) == 1 else None
    rows = one if one is not None else routing.union(inputs) if module not in ("aggregation", "compare", "beamsql", "sql", "union", "attribution", "query") else None
    if module == "select" and p.get("failFast", t.get("failFast", True)) is False:
        good, bad = selects.split_failures(rows, p.get("select") or p.get("fields") or [], p.get("filter"))
        chosen = [f for f in p.get("select") or p.get("fields") or [] if selects.kind_of(f) != "panic"] or [{"name": c} for c in rows.columns]
        return {"": selects.select(good, chosen, None, p.get("groupFields"), p.get("flattenField")), "failures": failures(bad, t)}
    if module == "select":
        return selects.select(rows, p.get("select") or p.get("fields") or [{"name": c} for c in rows.columns], p.get("filter"), p.get("groupFields"), p.get("flattenField"))
    if module == "filter":
        return rows.filter(compile_filter(p["filter"], types_of(rows)))
    if module == "aggregation":
        fields = p.get("fields") or [{**f, "input": a["input"]} for a in p["aggregations"] for f in a["fields"]]
        w = window_of(t)
        if w:
            inputs = {n: timed(df, w) for n, df in inputs.items()}
        rows = inputs if len(inputs) > 1 else next(iter(inputs.values()))
        return aggregate.aggregate(rows, fields, p.get("groupFields"), p.get("filter"), p.get("select"), p.get("limit"), p.get("flattenField"), assigned(w) if w else None)
    if module == "buffer" and rows.isStreaming:
        if p.get("dedupFields") or p.get("fields") or p.get("orderFields"):
            raise io.NotSupportedError("dedupFields, fields and orderFields of a buffer on a stream")
        return streams.history(rows, p["groupFields"], p.get("maxCount"), p.get("maxDurationSeconds"), p.get("includeCurrent", True), p.get("bufferFilter"), p.get("triggerFilter"), p.get("stateTtlSeconds"), name=p.get("name", "buffer"))
    if module == "buffer":
        return buffer.buffered(rows, p["groupFields"], p.get("maxCount"), p.get("maxDurationSeconds"), p.get("includeCurrent", True), p.get("bufferFilter"), p.get("triggerFilter"), p.get("dedupFields"), p.get("fields"), p.get("orderFields"), p.get("name", "buffer"))
    if module == "partition":
        return routing.partition(rows, p["partitions"], p.get("exclusive", True))
    if module == "union":
        return routing.union(inputs, p.get("mappings"), p.get("baseInput"), tagged=False)
    if module == "compare":
        return routing.compare(inputs, p["primaryKeyFields"], t["name"])
    if module == "reshuffle":
        return routing.reshuffle(rows)
    if module in ("beamsql", "sql"):
        return sqlx.run(spark, p["sql"], inputs, p.get("sqlParameters"), p.get("ddl"))
    if module == "query":
        first, *rest = inputs
        return sqlx.per_record(spark, p["sql"], inputs[first], {n: inputs[n] for n in rest}, p.get("keep"))
    if module == "cdc":
        kind = p.get("format", "ticdc")
        if kind not in ("ticdc", "postgres", "spanner"):
            raise ConfigError(f"step {t['name']!r}: unknown change format {kind!r}")
        out = cdc.from_postgres(rows) if kind == "postgres" else cdc.from_spanner(rows) if kind == "spanner" else cdc.from_canal(rows, p.get("field") or p.get("payloadField", "payload"))
        out = cdc.latest(out) if p.get("accumulate") else out
        if kind == "ticdc" and p.get("failFast", t.get("failFast", True)) is False:
            return {"": out, "failures": failures(cdc.broken(rows, p.get("field") or p.get("payloadField", "payload")), t)}
        return out
    if module == "attribution":
        target, baseline = (inputs[p[k]] for k in ("target", "baseline"))
        run, how = search(p)
        return run(attribution.leaves(target, baseline, p["dimensions"], p["measure"]), p["dimensions"], **how)
    raise io.NotSupportedError(f"transform {module!r}")


#: The parameters of an attribution's engine and output, by section, and what the algorithms call them.
SEARCHES = {"exhaustive": attribution.exhaustive, "adtributor": attribution.adtributor, "riskloc": attribution.locate}
SEARCH_OWN = {"exhaustive": {}, "adtributor": {"teep": "teep", "tep": "tep"}, "riskloc": {"riskThreshold": "risk", "pepThreshold": "pep"}}


def search(p: dict) -> tuple:
    """The search of an attribution step and its arguments, from the step's parameters; others are not supported."""

    def known(section: dict, names: dict | set, where: str) -> dict:
        if unknown := sorted(set(section) - set(names)):
            raise io.NotSupportedError(f"attribution: {where}{', '.join(unknown)}")
        return section

    engine, output = p.get("engine") or {}, p.get("output") or {}
    known(p, {"target", "baseline", "dimensions", "measure", "algorithm", "engine", "output"}, "")
    known(engine, {"algorithm", "guards", *SEARCH_OWN}, "engine.")
    guards = known(engine.get("guards") or {}, {"maxLayer"}, "engine.guards.")
    known(output, {"topK"}, "output.")
    algorithm = engine.get("algorithm", p.get("algorithm", "riskloc"))
    if algorithm not in SEARCHES:
        raise io.NotSupportedError(f"attribution: algorithm {algorithm!r}")
    how = {}
    for a, names in SEARCH_OWN.items():
        own = known(engine.get(a) or {}, names, f"engine.{a}.")
        # The sections of the algorithms not chosen have no effect.
        how |= {names[k]: v for k, v in own.items() if a == algorithm and v is not None}
    if guards.get("maxLayer") is not None and algorithm != "adtributor":
        how["max_layer"] = guards["maxLayer"]
    if output.get("topK") is not None:
        how["top"] = output["topK"]
    for k, v in how.items():
        low, high = {"teep": (0, 1), "tep": (0, 1), "pep": (0, 1), "risk": (0, 1)}.get(k, (1, None))
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v < low or (high is not None and v > high) or (high is None and v != int(v)):
            raise ConfigError(f"attribution: {k} can't be {v!r}")
    return SEARCHES[algorithm], how


def run(spark: SparkSession, config: dict) -> dict:
    """Builds all steps and runs the sinks; streams go on until their queries (the results by sink name) are stopped."""
    return executed(spark, [(kind, s) for kind in ("source", "transform", "sink") for s in config.get(f"{kind}s", [])])
