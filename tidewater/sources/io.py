"""Sources and sinks by module name; those that need a missing connector say so."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.filters import compile_filter
from ..plans.schema import struct_type, types_of
from . import outbound

SOURCES: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}
SINKS: dict[str, Callable[[DataFrame, dict], None]] = {}


class NotSupportedError(NotImplementedError):
    pass


def source(name: str):
    return lambda f: SOURCES.setdefault(name, f)


def sink(name: str):
    return lambda f: SINKS.setdefault(name, f)


@source("create")
def create(spark: SparkSession, p: dict) -> DataFrame:
    """Inline elements, or a half-open sequence from, to by interval; rate makes a stream."""
    if p.get("rate"):
        return spark.readStream.format("rate").option("rowsPerSecond", int(p["rate"])).load()
    if "elements" in p:
        if p.get("schema"):
            kind = struct_type(p["schema"]["fields"])
            return spark.createDataFrame([tuple(e.get(f.name) for f in kind.fields) if isinstance(e, dict) else (e,) for e in p["elements"]], kind)
        return spark.createDataFrame(p["elements"])
    if p.get("intervalUnit"):
        seq = F.sequence(F.lit(p["from"]).cast("timestamp"), F.lit(p["to"]).cast("timestamp"), F.expr(f"interval {int(p.get('interval', 1))} {p['intervalUnit']}"))
        return spark.range(1).select(F.explode(seq).alias("value")).filter(F.col("value") < F.lit(p["to"]).cast("timestamp"))
    return spark.range(int(p["from"]), int(p["to"]), int(p.get("interval", 1))).withColumnRenamed("id", "value")


@source("storage")
def storage(spark: SparkSession, p: dict) -> DataFrame:
    """Parquet, Avro, ORC, CSV, JSON or text files; fields prune columns, filterPrefix drops lines before parsing.

    With streaming, new files of one folder as they appear; their schema must be named or known from files there.
    """
    kind, paths = p.get("format", "parquet"), p["input"] if isinstance(p["input"], list) else [p["input"]]
    schema = struct_type(p["schema"]["fields"]) if p.get("schema") else None
    if p.get("filterPrefix") and kind in ("csv", "json"):
        lines = spark.read.text(paths).filter(~F.startswith("value", F.lit(p["filterPrefix"])))
        if schema is None:
            raise ValueError("filterPrefix needs a schema")
        parse = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": p.get("delimiter", ",")}) if kind == "csv" else F.from_json("value", schema)
        out = lines.select(parse.alias("r")).select("r.*")
    else:
        streaming = bool(p.get("streaming"))
        if streaming and schema is None:
            schema = spark.read.format(kind).load(paths).schema
        reader = (spark.readStream if streaming else spark.read).format(kind)
        if schema:
            reader = reader.schema(schema)
        if kind == "csv":
            reader = reader.options(header=str(bool(p.get("skipHeaderLines", p.get("header", 0)))).lower(), sep=p.get("delimiter", ","))
        if p.get("compression"):
            reader = reader.option("compression", p["compression"])
        if streaming and len(paths) != 1:
            raise ValueError("a stream reads one folder or glob")
        out = reader.load(paths[0] if streaming else paths)
    return out.select(*p["fields"]) if p.get("fields") else out


@source("files")
def files(spark: SparkSession, p: dict) -> DataFrame:
    out = spark.read.format("binaryFile").option("recursiveFileLookup", str(bool(p.get("recursive", False))).lower()).load(p["pattern"])
    out = out if p.get("withContent") else out.drop("content")
    return out.filter(compile_filter(p["filter"], types_of(out))) if p.get("filter") is not None else out


@source("jdbc")
def jdbc(spark: SparkSession, p: dict) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", p["url"]).options(**{k: p[k] for k in ("user", "password", "driver") if k in p})
    if p.get("prepareCalls"):
        reader = reader.option("sessionInitStatement", "; ".join(p["prepareCalls"]))
    if p.get("query"):
        return reader.option("query", p["query"]).load()
    reader = reader.option("dbtable", p["table"])
    if p.get("seekFields") and "lowerBound" in p:
        reader = reader.options(partitionColumn=p["seekFields"][0], lowerBound=p["lowerBound"], upperBound=p["upperBound"], numPartitions=p.get("numPartitions", 16))
    return reader.load()


@source("kafka")
def kafka(spark: SparkSession, p: dict) -> DataFrame:
    reader = (spark.readStream if p.get("streaming", True) else spark.read).format("kafka").option("kafka.bootstrap.servers", p["bootstrapServers"])
    key = "subscribePattern" if p.get("topicPattern") else "subscribe"
    raw = reader.option(key, p.get("topicPattern") or ",".join(p["topics"])).load()
    if p.get("format", "json") == "message":
        return raw
    return raw.select(F.from_json(F.col("value").cast("string"), struct_type(p["schema"]["fields"])).alias("r"), "timestamp").select("r.*", F.col("timestamp").alias("__timestamp"))


@source("iceberg")
def iceberg(spark: SparkSession, p: dict) -> DataFrame:
    return spark.table(p["table"])


@source("request")
def request(spark: SparkSession, p: dict) -> DataFrame:
    return create(spark, {"elements": p["rows"], "schema": p.get("schema")})


@source("http")
def http(spark: SparkSession, p: dict) -> DataFrame:
    """One request per task, following `next` links in the JSON body for loop pagination."""
    from collections.abc import Iterator

    import pandas as pd

    urls = p["url"] if isinstance(p["url"], list) else [p["url"]]

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import urllib.request

        for frame in frames:
            for url in frame["url"]:
                while url:
                    with urllib.request.urlopen(urllib.request.Request(url, headers=p.get("headers", {})), timeout=p.get("timeoutSeconds", 60)) as r:
                        body = json.load(r)
                    items = body
                    for part in filter(None, p.get("itemsPath", "").split(".")):
                        items = items[part]
                    yield pd.DataFrame({"body": [json.dumps(x) for x in (items if isinstance(items, list) else [items])]})
                    url = body.get(p["loop"]["next"]) if p.get("loop") and isinstance(body, dict) else None

    out = spark.createDataFrame([(u,) for u in urls], "url string").repartition(len(urls)).mapInPandas(fetch, "body string")
    return out.select(F.from_json("body", struct_type(p["schema"]["fields"])).alias("r")).select("r.*") if p.get("schema") else out


def read(spark: SparkSession, module: str, params: dict) -> DataFrame:
    if module not in SOURCES:
        try:
            return spark.read.format(module).options(**{k: str(v) for k, v in params.items()}).load()
        except Exception as e:
            raise NotSupportedError(f"source {module!r} needs a connector that is not on the class path") from e
    return SOURCES[module](spark, params)


@sink("storage")
def write_storage(df: DataFrame, p: dict) -> None:
    """Files in a folder; ${field} parts of the path become partition columns, numShards the number of files."""
    path, keys = p["output"], re.findall(r"\$\{(\w+)\}", p["output"])
    if keys:
        path = path[: path.index("${")].rstrip("/")
    if p.get("numShards"):
        df = df.repartition(int(p["numShards"]))
    writer = df.write.mode(p.get("mode", "errorifexists")).format(p.get("format", "parquet"))
    if p.get("compression") or p.get("codec"):
        writer = writer.option("compression", p.get("compression") or p["codec"])
    if p.get("format") == "csv":
        writer = writer.option("header", str(bool(p.get("header", False))).lower())
    (writer.partitionBy(*keys) if keys else writer).save(path)


@sink("debug")
def debug(df: DataFrame, p: dict) -> None:
    df.show(int(p.get("limit", 20)), truncate=False)


@sink("jdbc")
def write_jdbc(df: DataFrame, p: dict) -> None:
    """Appends, or with op INSERT_OR_UPDATE or INSERT_OR_DONOTHING puts rows by keyFields; emptyTable empties the table before."""
    op, options = p.get("op", "INSERT"), {k: p[k] for k in ("user", "password", "driver") if k in p}
    if op in ("INSERT_OR_UPDATE", "INSERT_OR_DONOTHING"):
        if p.get("emptyTable"):
            outbound.execute(df.sparkSession, p["url"], [f"DELETE FROM {p['table']}"], options)
        return outbound.upsert(df, p["url"], p["table"], p.get("keyFields") or [], op == "INSERT_OR_UPDATE", options)
    if op != "INSERT":
        raise NotSupportedError(f"jdbc op {op!r}")
    df.write.format("jdbc").option("url", p["url"]).option("dbtable", p["table"]).options(**options).option("truncate", str(bool(p.get("emptyTable"))).lower()).option("batchsize", p.get("batchSize", 1000)).mode("overwrite" if p.get("emptyTable") else "append").save()


@sink("files")
def write_files(df: DataFrame, p: dict) -> None:
    outbound.write_files(df, p["output"], p.get("content"), p.get("field"))


@sink("http")
def write_http(df: DataFrame, p: dict) -> None:
    outbound.write_http(df, p)


@sink("iceberg")
def write_iceberg(df: DataFrame, p: dict) -> None:
    df.writeTo(p["table"]).append()


@sink("kafka")
def write_kafka(df: DataFrame, p: dict) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", p["bootstrapServers"]).option("topic", p["topic"]).save()


def write(df: DataFrame, module: str, params: dict, name: str | None = None) -> StreamingQuery | None:
    """Writes a table, or starts writing a stream and returns its query."""
    if module not in SINKS:
        raise NotSupportedError(f"sink {module!r} is not available")
    if df.isStreaming:
        return write_stream(df, module, params, name)
    SINKS[module](df, params)


def write_stream(df: DataFrame, module: str, p: dict, name: str | None = None) -> StreamingQuery:
    """Files and topics by Spark's own stream sinks, all others batch by batch.

    trigger is {"type": "processingTime", "interval": "10 seconds"}, {"type": "availableNow"} (all that is there, then
    stop), or nothing for batches as fast as they go. The state goes to checkpointLocation, without it to a folder with
    the sink's name in spark.checkpoint.dir; a query restarted on its folder goes on where it was.
    """
    where = p.get("checkpointLocation")
    if not where and name and df.sparkSession.conf.get("spark.checkpoint.dir", None):
        where = df.sparkSession.conf.get("spark.checkpoint.dir").rstrip("/") + f"/streams/{name}"
    if module == "kafka":
        df = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    writer = df.writeStream.outputMode(p.get("outputMode", "append"))
    if where:
        writer = writer.option("checkpointLocation", where)
    trigger = p.get("trigger") or {}
    if trigger.get("type") == "availableNow":
        writer = writer.trigger(availableNow=True)
    elif trigger.get("type") == "processingTime":
        writer = writer.trigger(processingTime=trigger["interval"])
    elif trigger:
        raise NotSupportedError(f"trigger {trigger.get('type')!r}")
    if module == "storage":
        path, keys = p["output"], re.findall(r"\$\{(\w+)\}", p["output"])
        writer = writer.format(p.get("format", "parquet"))
        if p.get("compression") or p.get("codec"):
            writer = writer.option("compression", p.get("compression") or p["codec"])
        if p.get("format") == "csv":
            writer = writer.option("header", str(bool(p.get("header", False))).lower())
        if keys:
            writer, path = writer.partitionBy(*keys), path[: path.index("${")].rstrip("/")
        return writer.start(path)
    if module == "iceberg":
        return writer.toTable(p["table"])
    if module == "kafka":
        return writer.format("kafka").option("kafka.bootstrap.servers", p["bootstrapServers"]).option("topic", p["topic"]).start()
    return writer.foreachBatch(lambda batch, _: SINKS[module](batch, p)).start()

