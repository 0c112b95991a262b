"""Projection: named functions in list order, each seeing the outputs before it, with per-key ordered windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrix
from ..plans import expr
from ..plans.filters import compile_filter
from ..plans.schema import spark_type, types_of
from . import aggregate

TIME = "__timestamp"
UNITS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


class Select:
    def __init__(self, df: DataFrame, group: list[str] | None = None):
        self.df, self.group = df, group

    @property
    def types(self) -> dict[str, str]:
        return types_of(self.df)

    def source(self, f: dict) -> Column:
        return F.col(f.get("field", f["name"]))

    def condition(self, f: dict, key: str = "condition") -> Column:
        return compile_filter(f[key], self.types) if f.get(key) is not None else F.lit(True)

    def window(self, f: dict) -> object:
        """The frame of a stateful function: the last n rows, or a duration in event time, or all rows so far."""
        by = Window.partitionBy(*(self.group or []))
        r = f.get("range") or {}
        if "count" in r:
            off = int(r.get("offset", 0))
            return by.orderBy(TIME).rowsBetween(-(int(r["count"]) - 1) - off, -off)
        if "duration" in r:
            unit = UNITS[r.get("unit", r.get("durationUnit", "second"))]
            return by.orderBy(F.unix_micros(F.col(TIME).cast("timestamp"))).rangeBetween(-int(r["duration"]) * unit, -int(r.get("offset", 0)) * unit)
        return by.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)

    def lagged(self, c: Column, n: int) -> Column:
        return F.lag(c, n).over(Window.partitionBy(*(self.group or [])).orderBy(TIME))


FUNCTIONS: dict[str, Callable[[Select, dict], Column]] = {}


def function(*names: str):
    def register(f: Callable[[Select, dict], Column]):
        FUNCTIONS.update({n: f for n in names})
        return f

    return register


def try_cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


FUNCTIONS["pass"] = lambda s, f: F.col(f["name"])
FUNCTIONS["rename"] = lambda s, f: s.source(f)
FUNCTIONS["constant"] = lambda s, f: F.lit(f["value"]).cast(spark_type(f["type"])) if f.get("type") else F.lit(f["value"])
FUNCTIONS["current_timestamp"] = lambda s, f: F.current_timestamp()
FUNCTIONS["uuid"] = lambda s, f: F.substring(F.uuid(), 1, int(f.get("size", 36)))
FUNCTIONS["base64_encode"] = lambda s, f: F.base64(s.source(f).cast("binary"))
FUNCTIONS["base64_decode"] = lambda s, f: F.unbase64(s.source(f)) if f.get("type", "bytes") == "bytes" else F.unbase64(s.source(f)).cast("string")


@function("cast")
def cast(s: Select, f: dict) -> Column:
    c, kind = s.source(f), s.types.get(f.get("field", f["name"]))
    if f["type"] == "uuid" and kind == "binary":
        h = F.lower(F.hex(c))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    if f["type"] in ("bytes", "blob") and f.get("logical") == "uuid":
        return F.unhex(F.replace(c, F.lit("-"), F.lit("")))
    return try_cast(c, spark_type(f["type"]))


@function("replace")
def replace(s: Select, f: dict) -> Column:
    """Without a default an unmapped value becomes null, or stays with keepUnmapped."""
    c = s.source(f).cast("string")
    out = F.create_map(*[F.lit(str(x)) for kv in f["mapping"].items() for x in kv])[c]
    rest = F.lit(f["default"]).cast("string") if "default" in f else c if f.get("keepUnmapped") else None
    out = F.when(c.isNull() | F.lit(rest is None), out).otherwise(F.coalesce(out, rest)) if rest is not None else out
    return try_cast(out, spark_type(f["type"])) if f.get("type") else out


@function("expression")
def expression(s: Select, f: dict) -> Column:
    stateful = re.search(r"\w\[\d+\]", f["expression"]) is not None
    c = expr.compile_expression(f["expression"], s.types, s.lagged if stateful else None)
    return try_cast(c, spark_type(f["type"])) if f.get("type") else c


@function("lag")
def lag(s: Select, f: dict) -> Column:
    return expr.compile_expression(f["expression"], s.types, s.lagged)


#: Calls in templates: ${utils.group.name(args)}, args being fields, 'texts' or numbers.
TEMPLATE_CALLS: dict[str, Callable[..., Column]] = {
    "string.format": lambda pattern, *xs: F.format_string(literal_of(pattern), *xs),
    "string.uuid": lambda: F.uuid(),
    "string.replaceAll": lambda c, pattern, by: F.regexp_replace(c.cast("string"), pattern, by),
    "string.reverse": lambda c: F.reverse(c.cast("string")),
    "string.sha256": lambda c: F.sha2(c.cast("string"), 256),
    "string.md5": lambda c: F.md5(c.cast("string")),
    "string.base64": lambda c: F.base64(c.cast("binary")),
    "datetime.formatTimestamp": lambda c, pattern, zone=None: F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone) if zone is not None else c.cast("timestamp"), literal_of(pattern)),
    "datetime.formatDate": lambda c, pattern: F.date_format(c.cast("date"), literal_of(pattern)),
    "datetime.currentDate": lambda zone=None: F.to_date(F.from_utc_timestamp(F.current_timestamp(), zone)) if zone is not None else F.current_date(),
    "datetime.currentTimestamp": lambda: F.current_timestamp(),
}


class Text(str):
    """A text argument of a template's call."""


def literal_of(c: Column | Text) -> str:
    if not isinstance(c, Text):
        raise ValueError("a template's pattern must be a text")
    return str(c)


def template_part(part: str) -> Column:
    """A field, or a call of TEMPLATE_CALLS."""
    m = re.fullmatch(r"\s*utils\.(\w+\.\w+)\((.*)\)\s*", part, re.S)
    if not m:
        return F.col(part.strip())
    if m[1] not in TEMPLATE_CALLS:
        raise ValueError(f"unknown template function {m[1]!r}")
    args = []
    for raw in re.findall(r"\s*((?:'[^']*'|\"[^\"]*\"|[^,'\"])+)", m[2]):
        a = raw.strip()
        args.append(Text(a[1:-1]) if a[0] in "'\"" else F.lit(float(a) if "." in a else int(a)) if re.fullmatch(r"-?\d+(\.\d+)?", a) else F.col(a))
    texts_at = {"string.format": (0,), "datetime.formatTimestamp": (1,), "datetime.formatDate": (1,)}.get(m[1], ())
    return TEMPLATE_CALLS[m[1]](*[a if i in texts_at or not isinstance(a, Text) else F.lit(str(a)) for i, a in enumerate(args)])


def template(text: str) -> Column:
    """${field} and ${utils...} parts of a template; a null is empty."""
    parts = re.split(r"\$\{([^}]+)\}", text)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(template_part(p).cast("string"), F.lit("")) for i, p in enumerate(parts)])


@function("text")
def text(s: Select, f: dict) -> Column:
    return try_cast(template(f["text"]), spark_type(f["type"])) if f.get("type") else template(f["text"])


@function("concat")
def concat(s: Select, f: dict) -> Column:
    return F.concat_ws(f.get("delimiter", ""), *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in f["fields"]])


@function("nullif")
def nullif(s: Select, f: dict) -> Column:
    return F.when(~s.condition(f), s.source(f))


@function("hash")
def hashed(s: Select, f: dict) -> Column:
    """SHA-256 or its HMAC over the joined parts: fields, #literals, __timestamp."""
    if "text" in f:
        joined = text(s, {"text": f["text"]})
    else:
        names = f.get("fields") or [f.get("field", f["name"])]
        joined = F.concat_ws(f.get("delimiter", ""), *[F.lit(n[1:]) if n.startswith("#") else F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    if f.get("algorithm", "SHA256").lower() == "hmacsha256":
        key = f["secret"].encode()
        if len(key) > 64:
            import hashlib

            key = hashlib.sha256(key).digest()
        key = key.ljust(64, b"\0")
        pad = lambda x: F.lit(bytes(b ^ x for b in key))
        inner = F.unhex(F.sha2(F.concat(pad(0x36), joined.cast("binary")), 256))
        out = F.sha2(F.concat(pad(0x5C), inner), 256)
    else:
        out = F.sha2(joined, 256)
    return F.substring(out, 1, int(f["size"])) if f.get("size") else out


@function("event_timestamp")
def event_timestamp(s: Select, f: dict) -> Column:
    micros = F.unix_micros(F.col(TIME).cast("timestamp"))
    if f.get("duration"):
        micros = micros + F.lit(int(f["duration"]) * UNITS[f.get("durationUnit", "second")])
    if f.get("cutoff"):
        unit = UNITS[f["cutoff"]]
        micros = (F.floor(micros / unit) * unit).cast("bigint")
    return F.timestamp_micros(micros)


def structured(s: Select, f: dict) -> Column:
    if f.get("each"):
        inner = [x["name"] for x in f["fields"]]
        return F.transform(F.col(f["each"]), lambda e: F.struct(*[e[x].alias(x) for x in inner]))
    return F.struct(*[column(s, x).alias(x["name"]) for x in f["fields"]])


FUNCTIONS["struct"] = structured
FUNCTIONS["json"] = lambda s, f: F.to_json(structured(s, f))
FUNCTIONS["map"] = lambda s, f: F.map_from_arrays(F.array(*[F.lit(x["name"]) for x in f["fields"]]), F.array(*[column(s, x) for x in f["fields"]]))


@function("json_path")
def json_path(s: Select, f: dict) -> Column:
    c = F.get_json_object(s.source(f).cast("string"), f["path"])
    if f.get("fields"):
        from ..plans.schema import data_type

        return F.from_json(c, data_type({"type": "element", "fields": f["fields"], "mode": f.get("mode")}))
    if f.get("mode") == "repeated":
        return F.from_json(c, f"array<{spark_type(f.get('type', 'string'))}>")
    return try_cast(c, spark_type(f.get("type", "string")))


FUNCTIONS["json_extract"] = lambda s, f: F.get_json_object(s.source(f).cast("string"), f["path"])


@function("generate")
def generate(s: Select, f: dict) -> Column:
    """The half-open range from, to by interval; numbers, or dates by a unit of days."""
    bound = lambda v: expr.compile_expression(str(v), s.types) if isinstance(v, str) and not re.fullmatch(r"\d{4}-\d\d-\d\d", v) else F.lit(v)
    step = int(f.get("interval", 1))
    if isinstance(f["from"], str) and re.fullmatch(r"\d{4}-\d\d-\d\d", f["from"]):
        a, b = F.lit(f["from"]).cast("date"), F.lit(f["to"]).cast("date")
        return F.when(a < b, F.sequence(a, F.date_sub(b, 1), F.expr(f"interval {step} {f.get('intervalUnit', 'day')}"))).otherwise(F.array().cast("array<date>"))
    a, b = (bound(f[k]).cast("bigint") for k in ("from", "to"))
    return F.when(a < b, F.sequence(a, b - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


@function("bytes_encode")
def bytes_encode(s: Select, f: dict) -> Column:
    """Big-endian bytes of integers, UTF-8 of strings."""
    kind = s.types[f.get("field", f["name"])]
    width = {"smallint": 4, "int": 8, "bigint": 16}.get(kind)
    c = s.source(f)
    return F.encode(c, "UTF-8") if width is None else F.unhex(F.right(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit(width)))


@function("bytes_decode")
def bytes_decode(s: Select, f: dict) -> Column:
    c, kind = s.source(f), spark_type(f["type"])
    if kind == "string":
        return F.decode(c, "UTF-8")
    unsigned = F.conv(F.hex(c), 16, -10).cast("bigint") if kind == "bigint" else F.conv(F.hex(c), 16, 10).cast("bigint")
    bits = {"smallint": 16, "int": 32}.get(kind)
    return unsigned if bits is None else F.when(unsigned >= 1 << (bits - 1), unsigned - (1 << bits)).otherwise(unsigned).cast(kind)


@function("reshape")
def reshape(s: Select, f: dict) -> Column:
    """Picks an element of a flat row-major matrix by its indices, or keeps the matrix."""
    if not f.get("indices"):
        return s.source(f)
    at = 0
    for size, i in zip(f["shape"], f["indices"], strict=True):
        at = at * size + i
    return F.try_element_at(s.source(f), F.lit(at + 1))


@function("cosine_similarity")
def cosine(s: Select, f: dict) -> Column:
    return matrix.cosine(F.col(f["left"]), F.col(f["right"]))


@function("matrix_multiply")
def multiply(s: Select, f: dict) -> Column:
    return matrix.multiply(f["matrix"], F.col(f["vector"]))


@function("matrix_solve")
def solve(s: Select, f: dict) -> Column:
    return matrix.solve(f["matrix"])(F.col(f["vector"]).cast("array<double>"))


@function("mahalanobis")
def mahalanobis(s: Select, f: dict) -> Column:
    return matrix.mahalanobis(F.col(f["field"]), f["mean"], f.get("precision"), f.get("covariance"))


@function("poly_fit")
def poly_fit(s: Select, f: dict) -> Column:
    y = F.col(f["y"]).cast("array<double>")
    x = F.col(f["x"]).cast("array<double>") if f.get("x") else F.transform(y, lambda _, i: i.cast("double"))
    return matrix.poly_fit(int(f["degree"]))(y, x)


@function("scrape")
def scrape(s: Select, f: dict) -> Column:
    from ..functions import html

    return html.scrape(f["selector"], f.get("attribute"), f.get("pattern"), int(f.get("group", 0)))(s.source(f))


@function("tokenize_encode", "tokenize_decode")
def tokenize(s: Select, f: dict) -> Column:
    """By a tokenizer file that every executor can read."""
    from ..functions import remote

    make = remote.tokenize_encode if kind_of(f) == "tokenize_encode" else remote.tokenize_decode
    return make(f["tokenizer"], bool(f.get("specialTokens", True)))(s.source(f))


@function("http")
def http(s: Select, f: dict) -> Column:
    """The answer to a request whose address and body are templates of the row; null for 404."""
    from ..functions import remote

    ask = remote.http(f.get("method", "POST" if f.get("body") else "GET"), f.get("headers"), float(f.get("timeoutSeconds", 60)), int(f.get("tries", 3)))
    out = ask(template(f["url"]), template(f["body"]) if f.get("body") else F.lit(None).cast("string"))
    return F.get_json_object(out, f["path"]) if f.get("path") else out


@function("panic")
def panic(s: Select, f: dict) -> Column:
    return F.when(s.condition(f) & (F.rand() <= float(f.get("rate", 1.0))), F.raise_error(F.lit(f.get("message", "panic"))))


@function("switch")
def switch(s: Select, f: dict) -> Column:
    out = F.lit(f.get("default"))
    for case in reversed(f["cases"]):
        out = F.when(compile_filter(case["condition"], s.types), F.lit(case["value"])).otherwise(out)
    return out


def kind_of(f: dict) -> str:
    """The function of a field, guessed from its keys where it isn't named."""
    if f.get("func") or f.get("op"):
        return f.get("func") or f["op"]
    for key, name in (("expression", "expression"), ("text", "text"), ("mapping", "replace"), ("value", "constant"), ("path", "json_path"), ("fields", "struct")):
        if key in f:
            return name
    if f.get("type"):
        return "cast"
    return "rename" if f.get("field") else "pass"


def column(s: Select, f: dict) -> Column:
    kind = kind_of(f)
    if kind in aggregate.WINDOWED:
        return aggregate.column(kind, f, s.types, s.condition(f), s.window(f))
    if kind not in FUNCTIONS:
        raise ValueError(f"unknown select function {kind!r}")
    return FUNCTIONS[kind](s, f)


def select(df: DataFrame, fields: list[dict], filter: object = None, group_fields: list[str] | None = None, flatten: str | None = None) -> DataFrame:
    """filter, then the functions, then one row per element of flatten (an empty array keeps one row).

    Fields with ignore are computed for later ones and left out; a TIME column passes through.
    """
    if filter is not None:
        df = df.filter(compile_filter(filter, types_of(df)))
    s = Select(df, group_fields)
    for f in fields:
        c = column(s, f)
        if not (kind_of(f) == "pass"):
            s.df = s.df.withColumn(f["name"], c)
    keep = [f["name"] for f in fields if not f.get("ignore")]
    out = s.df.select(*keep, *([TIME] if TIME in s.df.columns and TIME not in keep else []))
    return flattened(out, flatten) if flatten else out


def split_failures(df: DataFrame, fields: list[dict], filter: object = None) -> tuple[DataFrame, DataFrame]:
    """The rows that no `panic` function meets, and the others with its message in __error.

    A rate below one picks rows by their hash, so that both outputs agree on them, whatever is computed again.
    """
    types = types_of(df)
    if filter is not None:
        df = df.filter(compile_filter(filter, types))
    error = F.lit(None).cast("string")
    for f in reversed([f for f in fields if kind_of(f) == "panic"]):
        met = F.coalesce(compile_filter(f["condition"], types), F.lit(False)) if f.get("condition") is not None else F.lit(True)
        if float(f.get("rate", 1.0)) < 1.0:
            met = met & (F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) < int(float(f["rate"]) * 1_000_000))
        error = F.when(met, F.lit(f.get("message", "panic"))).otherwise(error)
    return df.filter(error.isNull()), df.withColumn("__error", error).filter("__error IS NOT NULL")


def flattened(df: DataFrame, field: str) -> DataFrame:
    head, _, rest = field.partition(".")
    if not rest:
        return df.withColumn(field, F.explode_outer(field))
    return df.withColumn("__e", F.explode_outer(field)).withColumn(head, F.col(head).withField(rest, F.col("__e"))).drop("__e")

