"""SQL steps: whole-collection SQL over named inputs, and per-record SQL evaluated once for each row of INPUT."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import translate


def run(spark: SparkSession, sql: str, inputs: dict[str, DataFrame], args: dict | list | None = None, ddl: list[str] | None = None) -> DataFrame:
    """SQL over whole inputs, by their names."""
    for statement in ddl or []:
        spark.sql(statement)
    for name, df in inputs.items():
        df.createOrReplaceTempView(name)
    sql = translate(spark, sql)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def per_record(spark: SparkSession, sql: str, records: DataFrame, tables: dict[str, DataFrame] | None = None, keep: list[str] | None = None) -> DataFrame:
    """SQL evaluated once for each record, which it sees as the one row of INPUT: a lateral join, planned set-at-a-time.

    An aggregate over nothing still gives its row for each record; keep names the record's columns in the result.
    """
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    records.createOrReplaceTempView("__records")
    one = "(SELECT " + ", ".join(f"__o.`{c}` AS `{c}`" for c in records.columns) + ")"
    body = re.sub(r"\bINPUT\b(?!\s*\.)(?:\s+(?:AS\s+)?(?!WHERE\b|GROUP\b|ORDER\b|JOIN\b|LEFT\b|INNER\b|CROSS\b|LIMIT\b|HAVING\b|UNION\b|LATERAL\b|ON\b)([A-Za-z_]\w*))?", lambda m: f"{one} AS {m.group(1) or 'INPUT'}", translate(spark, sql, subscripts=True))
    head = ", ".join(f"__o.`{c}`" for c in keep or [])
    return spark.sql(f"SELECT {head + ', ' if head else ''}__r.* FROM __records AS __o JOIN LATERAL ({body}) AS __r")


def session(spark: SparkSession, statements: list[dict], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Named statements in order; later ones read earlier results. Those with output false are not returned."""
    for name, df in inputs.items():
        df.createOrReplaceTempView(name)
    out = {}
    for s in statements:
        df = spark.sql(translate(spark, s["sql"]))
        df.createOrReplaceTempView(s["name"])
        if s.get("output", True):
            out[s["name"]] = df
    return out
