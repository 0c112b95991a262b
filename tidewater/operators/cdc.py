"""Change data: canal-json envelopes and logical-decoding messages normalised to one record, and the latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANAL = "database string, table string, type string, ts bigint, es bigint, isDdl boolean, pkNames array<string>, data array<map<string,string>>, old array<map<string,string>>"


def from_canal(df: DataFrame, payload: str = "payload") -> DataFrame:
    """table, op, keys, before, after (JSON), commitTimestamp, sequence, source; DDL envelopes and broken payloads are left out."""
    e = df.select(F.from_json(payload, CANAL).alias("e")).filter(F.col("e.type").isNotNull() & ~F.coalesce(F.col("e.isDdl"), F.lit(False)))
    e = e.select("e.*").select("*", F.posexplode_outer("data").alias("at", "row"))
    keys = F.map_filter("row", lambda k, _: F.array_contains("pkNames", k))
    was = F.map_concat(F.map_filter("row", lambda k, _: ~F.coalesce(F.map_contains_key(F.get("old", F.col("at")), k), F.lit(False))), F.coalesce(F.get("old", F.col("at")), F.create_map().cast("map<string,string>")))
    op = F.upper("type")
    return e.select(
        "table", op.alias("op"), F.to_json(keys).alias("keys"), F.when(op == "UPDATE", F.to_json(was)).when(op == "DELETE", F.to_json("row")).alias("before"),
        F.when(op != "DELETE", F.to_json("row")).alias("after"), F.timestamp_millis(F.coalesce("es", "ts")).alias("commitTimestamp"),
        F.concat_ws("/", F.lower(F.hex(F.coalesce("ts", F.lit(0)))), F.lower(F.hex("at"))).alias("sequence"), F.lit("ticdc").alias("source"),
    )


def broken(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows whose payload is no envelope, with the error."""
    return df.filter(F.from_json(payload, CANAL)["type"].isNull()).withColumn("__error", F.lit("the payload is no change envelope"))


def section(c: Column) -> Column:
    return F.lower(F.hex(F.coalesce(c.cast("long"), F.lit(0).cast("long"))))


def from_postgres(df: DataFrame) -> DataFrame:
    """The same record from logical-replication rows (schema, table, op, keysJson, oldValuesJson, newValuesJson, commitLsn,
    commitTimestamp, sequence); truncations are left out, and tables of the schema `public` keep their bare name."""
    name = F.when(F.coalesce("schema", F.lit("public")) == "public", F.col("table")).otherwise(F.concat_ws(".", "schema", "table"))
    return df.filter("op IN ('INSERT', 'UPDATE', 'DELETE')").select(
        name.alias("table"), "op", F.coalesce("keysJson", F.lit("{}")).alias("keys"), F.col("oldValuesJson").alias("before"), F.col("newValuesJson").alias("after"),
        F.col("commitTimestamp").cast("timestamp").alias("commitTimestamp"), F.concat_ws("/", section(F.col("commitLsn")), section(F.col("sequence"))).alias("sequence"), F.lit("postgres").alias("source"),
    )


def from_spanner(df: DataFrame) -> DataFrame:
    """The same record from change-stream rows (tableName, modType, recordSequence, commitTimestamp, mods), one for each mod."""
    rows = df.select("tableName", "modType", "recordSequence", F.col("commitTimestamp").cast("timestamp").alias("at"), F.posexplode("mods").alias("i", "m"))
    return rows.select(
        F.col("tableName").alias("table"), F.col("modType").alias("op"), F.col("m.keysJson").alias("keys"), F.col("m.oldValuesJson").alias("before"), F.when(F.col("modType") != "DELETE", F.col("m.newValuesJson")).alias("after"),
        F.col("at").alias("commitTimestamp"), F.concat_ws("/", section(F.unix_micros("at")), section(F.col("recordSequence")), section(F.col("i"))).alias("sequence"), F.lit("spanner").alias("source"),
    )


def sequence_key(sequence: Column) -> Column:
    """Hexadecimal sections padded to 16, so that text order is numeric order."""
    return F.array_join(F.transform(F.split(sequence, "/"), lambda x: F.lpad(x, 16, "0")), "/")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each table and key; deleted keys are left out."""
    by = F.struct(sequence_key(F.col("sequence")), F.col("commitTimestamp"))
    last = changes.groupBy("table", "keys").agg(F.max_by(F.struct("op", "after", "commitTimestamp", "sequence"), by).alias("c"))
    return last.select("table", "keys", "c.*").filter("op <> 'DELETE'")


def applied(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A table after changes with its columns, op and sequence: upserts replace rows by key, deletes drop them."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), sequence_key(F.col("sequence"))).alias("c")).select(*keys, "c.*")
    kept = table.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter("op <> 'DELETE'").select(*table.columns))
