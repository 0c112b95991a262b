"""Declared fields and Spark types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Type names of configurations and the Spark types they stand for; time is microseconds of the day.
TYPES = {
    "bool": "boolean", "boolean": "boolean", "string": "string", "char": "string", "uuid": "string", "json": "string", "enum": "string", "enumeration": "string", "geography": "string",
    "bytes": "binary", "blob": "binary", "int8": "tinyint", "byte": "tinyint", "int16": "smallint", "short": "smallint", "int32": "int", "int": "int", "integer": "int",
    "int64": "bigint", "long": "bigint", "float8": "float", "float16": "float", "float32": "float", "float": "float", "float64": "double", "double": "double",
    "decimal": "decimal(38,9)", "numeric": "decimal(38,9)", "bigdecimal": "decimal(38,18)", "date": "date", "time": "bigint", "datetime": "timestamp_ntz", "timestamp": "timestamp",
    "matrix": "array<double>",
}


def spark_type(name: str) -> str:
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    return TYPES[name]


def data_type(field: dict) -> T.DataType:
    kind = field.get("type", "string")
    if kind in ("element", "row", "struct", "record"):
        out: T.DataType = T.StructType([struct_field(f) for f in field["fields"]])
    elif kind == "map":
        out = T.MapType(T.StringType(), T.DataType.fromDDL(spark_type(field.get("valueType", "string"))))
    else:
        out = T.DataType.fromDDL(spark_type(kind))
    return T.ArrayType(out) if field.get("mode") == "repeated" else out


def struct_field(field: dict) -> T.StructField:
    extra = {k: field[k] for k in ("symbols", "shape", "default") if k in field}
    if field.get("type") in ("uuid", "json", "time", "geography", "enum", "enumeration", "matrix"):
        extra["logical"] = field["type"]
    return T.StructField(field["name"], data_type(field), field.get("mode") != "required", extra)


def struct_type(fields: list[dict]) -> T.StructType:
    return T.StructType([struct_field(f) for f in fields])


def types_of(df: DataFrame) -> dict[str, str]:
    """Simple type names by field, with the fields of structs by dotted path."""
    out: dict[str, str] = {}

    def walk(prefix: str, kind: T.StructType) -> None:
        for f in kind.fields:
            out[prefix + f.name] = f.dataType.simpleString()
            if isinstance(f.dataType, T.StructType):
                walk(f"{prefix}{f.name}.", f.dataType)

    walk("", df.schema)
    return out
