"""Sinks that write row by row or by statement: database upserts, one file for each row, HTTP requests; control actions."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RETRIED = {408, 429, 500, 502, 503, 504}


def rendered(template: str) -> Column:
    """A text with ${field} parts as an expression; a null field renders as nothing."""
    parts = re.split(r"\$\{(\w+)\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


# --- database upserts -------------------------------------------------------------------------------------------


def upsert_statement(url: str, table: str, stage: str, columns: list[str], keys: list[str], update: bool, quote: Callable[[str], str]) -> str:
    """One statement that moves all rows of a staging table into a table by key, in the database's dialect."""
    dialect = url.split(":")[1]
    names, rest = ", ".join(map(quote, columns)), [c for c in columns if c not in keys]
    update = update and bool(rest)
    move = f"INTO {table} ({names}) SELECT {names} FROM {stage}"
    if dialect in ("postgresql", "sqlite"):
        then = "UPDATE SET " + ", ".join(f"{quote(c)} = EXCLUDED.{quote(c)}" for c in rest) if update else "NOTHING"
        return f"INSERT {move} WHERE true ON CONFLICT ({', '.join(map(quote, keys))}) DO {then}"
    if dialect in ("mysql", "mariadb"):
        return f"INSERT {move} ON DUPLICATE KEY UPDATE " + ", ".join(f"{quote(c)} = VALUES({quote(c)})" for c in rest) if update else f"INSERT IGNORE {move}"
    same = " AND ".join(f"t.{quote(k)} = s.{quote(k)}" for k in keys)
    matched = " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{quote(c)} = s.{quote(c)}" for c in rest) if update else ""
    values = ", ".join(f"s.{quote(c)}" for c in columns)
    end = ";" if dialect == "sqlserver" else ""
    return f"MERGE INTO {table} t USING {stage} s ON {same}{matched} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values}){end}"


def upsert(df: DataFrame, url: str, table: str, keys: list[str], update: bool = True, options: dict | None = None) -> None:
    """Inserts rows whose keys are new, and updates (or leaves) the others.

    Executors fill a staging table, then one statement moves it: a lost executor or a rerun can't apply half of the
    rows. Of several rows with the same key, the one with the greatest other values goes in. Null keys never match.
    """
    if not keys:
        raise ValueError("an upsert needs keyFields")
    spark, options = df.sparkSession, options or {}
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    real = {c.lower(): c for c in reader.option("dbtable", table).load().columns}
    df = df.select(*[F.col(c).alias(real.get(c.lower(), c)) for c in df.columns])
    keys = [real.get(k.lower(), k) for k in keys]
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else df.dropDuplicates()
    stage = f"stage_{uuid.uuid4().hex[:20]}"
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    try:
        rows.write.format("jdbc").option("url", url).option("dbtable", stage).options(**options).save()
        execute(spark, url, [upsert_statement(url, table, stage, rows.columns, keys, update, quote)], options)
    finally:
        execute(spark, url, [f"DROP TABLE {stage}"], options, strict=False)


def execute(spark: SparkSession, url: str, statements: list[str], options: dict | None = None, strict: bool = True) -> None:
    """Runs statements on the driver's connection, in one transaction."""
    p = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if options and k in options:
            p.setProperty(k, options[k])
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, p)
    try:
        connection.setAutoCommit(False)
        for s in statements:
            connection.createStatement().execute(s)
        connection.commit()
    except Exception:
        connection.rollback()
        if strict:
            raise
    finally:
        connection.close()


# --- files and requests -----------------------------------------------------------------------------------------


def write_files(df: DataFrame, output: str, content: str | None = None, field: str | None = None) -> None:
    """One file for each row: its path and content are templates; without them a field's bytes, or the row as JSON.

    A file appears under its name only when whole, so that a repeated task overwrites it with the same bytes.
    """
    body = F.col(field).cast("binary") if field else (rendered(content) if content is not None else F.to_json(F.struct(*df.columns))).cast("binary")

    def save(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        for r in rows:
            files, path = fs.FileSystem.from_uri(r["path"])
            folder = path.rpartition("/")[0]
            files.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as f:
                f.write(bytes(r["body"] or b""))
            files.move(part, path)

    df.select(rendered(output).alias("path"), body.alias("body")).foreachPartition(save)


def send(request: urllib.request.Request, tries: int, pause: float, timeout: float) -> tuple[int, str]:
    """Status and body; network errors and passing statuses are tried again with doubled pauses."""
    for i in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or i == tries - 1:
                return e.code, e.read().decode("utf-8", "replace")
        except (urllib.error.URLError, TimeoutError) as e:
            if i == tries - 1:
                return 0, str(e)
        time.sleep(pause * 2**i)
    return 0, "no tries"


def write_http(df: DataFrame, p: dict) -> None:
    """Posts rows as JSON, batchSize in a request (an array above one); a request that fails at last fails the task.

    A repeated task sends its rows again: the receiver must be idempotent, as for any such sink.
    """
    size, tries, pause, timeout = int(p.get("batchSize", 1)), int(p.get("maxAttempts", 5)), float(p.get("initialBackoffSeconds", 0.5)), float(p.get("timeoutSeconds", 60))
    headers, method = {"Content-Type": "application/json", **p.get("headers", {})}, p.get("method", "POST")
    body = rendered(p["body"]) if p.get("body") else F.to_json(F.struct(*df.columns))

    def save(rows: Iterator[Row]) -> None:
        def flush(url: str, bodies: list[str]) -> None:
            data = bodies[0] if size == 1 else "[" + ",".join(bodies) + "]"
            status, text = send(urllib.request.Request(url, data=data.encode(), headers=headers, method=method), tries, pause, timeout)
            if not 200 <= status < 300:
                raise OSError(f"{method} {url}: status {status}: {text[:500]}")

        held: dict[str, list[str]] = {}
        for r in rows:
            bodies = held.setdefault(r["url"], [])
            bodies.append(r["body"])
            if len(bodies) == size:
                flush(r["url"], held.pop(r["url"]))
        for url, bodies in held.items():
            flush(url, bodies)

    df.select(rendered(p["endpoint"]).alias("url"), body.alias("body")).foreachPartition(save)


# --- actions ----------------------------------------------------------------------------------------------------


def _file_action(spark: SparkSession, p: dict, fill: Callable[[str], str], rows: list[dict]) -> dict:
    """Writes a small file: the content, or the rows as JSON lines."""
    text = fill(p["content"]) if p.get("content") is not None else "".join(json.dumps(r, default=str) + "\n" for r in rows)
    path = spark._jvm.org.apache.hadoop.fs.Path(fill(p["output"]))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return {"action": "write", "target": fill(p["output"]), "status": "DONE", "detail": f"{len(rows)} rows"}


def _http_action(spark: SparkSession, p: dict, fill: Callable[[str], str], rows: list[dict]) -> dict:
    data = fill(p["body"]).encode() if p.get("body") is not None else None
    request = urllib.request.Request(fill(p["endpoint"]), data=data, headers=p.get("headers", {}), method=p.get("method", "POST" if data else "GET"))
    status, text = send(request, int(p.get("maxAttempts", 5)), 0.5, float(p.get("timeoutSeconds", 60)))
    return {"action": "request", "target": request.full_url, "status": "DONE" if 200 <= status < 300 else "FAILED", "detail": text[:1000]}


ACTIONS = {"storage": _file_action, "http": _http_action}
RESULT = "action string, target string, status string, detail string"


def act(spark: SparkSession, name: str, p: dict, df: DataFrame | None = None) -> DataFrame:
    """A control action once, for each row, or for all rows together; its results are rows.

    Actions run on the driver and are meant for a few triggering rows; above maxRows (10,000) they fail before the
    first one runs, rather than leave rows out.
    """
    if name not in ACTIONS:
        raise NotImplementedError(f"action {name!r} needs a service that is not available")
    trigger, most = p.get("trigger", "once" if df is None else "collect"), int(p.get("maxRows", 10_000))
    rows = [] if df is None or trigger == "once" else [r.asDict(recursive=True) for r in df.head(most + 1)]
    if len(rows) > most:
        raise ValueError(f"action {name!r} got more than {most} rows")
    calls = [[r] for r in rows] if trigger == "perElement" else [rows]
    done = []
    for part in calls:
        known = part[0] if trigger == "perElement" else {"size": len(part)}
        fill = lambda text, known=known: re.sub(r"\$\{(\w+)\}", lambda m: str(known[m[1]]), text)
        done.append(ACTIONS[name](spark, p, fill, part))
    return spark.createDataFrame([tuple(d.values()) for d in done], RESULT)
