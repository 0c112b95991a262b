"""The SQL dialect of declared steps on Spark SQL: calls that Spark lacks or reads differently are rewritten in place.

A call becomes an expression of built-in functions, so Catalyst sees through it and keeps the arguments' types. Only
model fits, pattern matches and random draws become pandas UDFs, registered when a statement uses them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..functions import matrix, models, seq

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\w*|[A-Za-z_]\w*|.", re.S)
UNITS = {"MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"}
#: strftime's letters as patterns of date_format.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "e": "d", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "z": "xx", "Z": "VV"}
COMMA = "','"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


AFTER_QUALIFY = {"ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", ";"}


class DialectError(ValueError):
    pass


#: Calls by name: {0}, {1} are the arguments, {all} all of them with commas.
TEMPLATES = {
    "SAFE_ADD": "try_add({all})", "SAFE_SUBTRACT": "try_subtract({all})", "SAFE_MULTIPLY": "try_multiply({all})", "SAFE_DIVIDE": "try_divide({all})", "SAFE_NEGATE": "try_subtract(0, {0})",
    "BITAND": "(({0}) & ({1}))", "BITOR": "(({0}) | ({1}))", "BITXOR": "(({0}) ^ ({1}))", "BITNOT": "(~({0}))",
    "IS_NAN": "isnan({0})", "IS_INF": "(abs({0}) = double('infinity'))", "COTH": "(1 / tanh({0}))", "SECH": "(1 / cosh({0}))", "CSCH": "(1 / sinh({0}))",
    "CONTAINS_SUBSTR": "contains(lower({0}), lower({1}))", "ENDS_WITH": "endswith({all})", "STARTS_WITH": "startswith({all})", "STRPOS": "position({1}, {0})", "BYTE_LENGTH": "octet_length({0})",
    "TO_HEX": "lower(hex({0}))", "FROM_HEX": "unhex({0})", "TO_BASE64": "base64({0})", "FROM_BASE64": "unbase64({0})", "SHA256": "sha2({0}, 256)", "SHA512": "sha2({0}, 512)",
    "TO_CODE_POINTS": "if(char_length({0}) > 0, transform(sequence(1, char_length({0})), __i -> ascii(substr({0}, __i, 1))), if({0} IS NULL, NULL, CAST(array() AS ARRAY<INT>)))",
    "CODE_POINTS_TO_STRING": "array_join(transform({0}, __c -> decode(unhex(lpad(hex(__c), 8, '0')), 'UTF-32')), '')",
    "CODE_POINTS_TO_BYTES": "unhex(array_join(transform({0}, __c -> lpad(hex(__c), 2, '0')), ''))",
    "REGEXP_CONTAINS": "regexp_like({all})",
    "CURRENT_DATETIME": "localtimestamp()", "CURRENT_DATE_": "to_date(from_utc_timestamp(current_timestamp(), {0}))",
    "COUNTIF": "count_if({0})", "LOGICAL_AND": "bool_and({0})", "LOGICAL_OR": "bool_or({0})", "ARG_MAX": "max_by({all})", "ARG_MIN": "min_by({all})", "COLLECT": "collect_list({0})", "ARRAY_CONCAT_AGG": "flatten(collect_list({0}))",
    "QUANTILE": "percentile({all})", "APPROX_DISTINCT": "approx_count_distinct({0}, 0.016)",
    "JSON_VALUE": "get_json_object({all})", "JSON_QUERY": "get_json_object({all})", "JSON_EXISTS": "(get_json_object({all}) IS NOT NULL)", "JSON_KEYS": "json_object_keys({0})", "JSON_LENGTH": "json_array_length({0})",
    "JSON_ARRAY": "to_json(array({all}))", "JSON_ARRAYAGG": "to_json(collect_list({0}))", "JSON_OBJECTAGG": "to_json(map_from_entries(collect_list(struct({all}))))",
    "ARRAY_CONCAT": "concat({all})", "ARRAY_LENGTH": "cardinality({0})", "ARRAY_REVERSE": "reverse({0})", "ARRAY_TO_STRING": "array_join({all})",
    "ARRAY_DIFFERENCE": "transform({0}, (__x, __i) -> if(__i = 0, 0D, CAST(__x - get({0}, __i - 1) AS DOUBLE)))", "ARRAY_DIFFERENCE_INT": "transform({0}, (__x, __i) -> if(__i = 0, 0L, CAST(__x - get({0}, __i - 1) AS BIGINT)))",
    "ARRAY_COMPACT": "filter({0}, (__x, __i) -> __i = 0 OR NOT (__x <=> get({0}, __i - 1)))", "AS_DOUBLE_ARRAY": "CAST({0} AS ARRAY<DOUBLE>)",
    "COSINE_SIMILARITY": "try_divide(aggregate(zip_with({0}, {1}, (__x, __y) -> CAST(__x AS DOUBLE) * __y), 0D, (__s, __x) -> __s + __x), sqrt(aggregate({0}, 0D, (__s, __x) -> __s + CAST(__x AS DOUBLE) * __x)) * sqrt(aggregate({1}, 0D, (__s, __x) -> __s + CAST(__x AS DOUBLE) * __x)))",
    "LINREG_PREDICT": "(get({0}, 0) + aggregate(zip_with(slice({0}, 2, size({1})), {1}, (__b, __x) -> __b * __x), 0D, (__s, __x) -> __s + __x))",
    "TIME_BUCKET": "timestamp_millis(CAST(floor(unix_millis({0}) / if(({1}) > 0, {1}, raise_error('the bucket size must be positive'))) * ({1}) AS BIGINT))",
    "MDT_GREATEST_INT64": "greatest({all})", "MDT_GREATEST_FLOAT64": "greatest({all})", "MDT_LEAST_INT64": "least({all})", "MDT_LEAST_FLOAT64": "least({all})", "MDT_GENERATE_UUID": "uuid()",
    "MDT_CONTAINS_ALL_INT64": "(size(array_except({1}, {0})) = 0)", "MDT_CONTAINS_ALL_STRING": "(size(array_except({1}, {0})) = 0)", "MDT_ARRAY_AGG_INT64": "collect_list({0})", "MDT_ARRAY_AGG_STRING": "collect_list({0})",
    **{f"MDT_ARRAY_AGG_DISTINCT_{t}": "array_sort(collect_set({0}))" for t in ("INT64", "STRING", "FLOAT64")}, **{f"MDT_COUNT_DISTINCT_{t}": "count(DISTINCT {0})" for t in ("INT64", "STRING", "FLOAT64")},
}
TEMPLATES["MDT_COSINE_SIMILARITY"] = TEMPLATES["COSINE_SIMILARITY"]

CALLS: dict[str, Callable[[SparkSession, list[str]], str | None]] = {}


def call(*names: str):
    def register(f: Callable[[SparkSession, list[str]], str | None]):
        CALLS.update({n: f for n in names})
        return f

    return register


def literal(arg: str) -> str | None:
    """The value of a string literal, or None."""
    arg = arg.strip()
    if len(arg) < 2 or arg[0] not in "'\"" or arg[-1] != arg[0]:
        return None
    return re.sub(r"\\(.)", r"\1", arg[1:-1].replace("''", "'") if arg[0] == "'" else arg[1:-1])


def given(arg: str, what: str) -> str:
    out = literal(arg)
    if out is None:
        raise DialectError(f"{what} must be a string literal: {arg}")
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- numbers and texts -----------------------------------------------------------------------------------------------


@call("GREATEST", "LEAST")
def extreme(spark: SparkSession, a: list[str], name: str) -> str:
    """Null if any argument is."""
    return f"if({' OR '.join(f'({x}) IS NULL' for x in a)}, NULL, {name.lower()}({', '.join(a)}))"


@call("TRUNC", "TRUNCATE")
def trunc(spark: SparkSession, a: list[str], name: str) -> str | None:
    """Towards zero, to so many decimals; trunc(date, unit) stays Spark's."""
    if len(a) == 2 and literal(a[1]) is not None:
        return None
    d = a[1] if len(a) > 1 else "0"
    return f"(sign({a[0]}) * floor(abs({a[0]}) * pow(10, {d})) / pow(10, {d}))"


@call("LOG")
def log(spark: SparkSession, a: list[str], name: str) -> str | None:
    return f"(ln({a[0]}) / ln({a[1]}))" if len(a) == 2 else f"ln({a[0]})"


@call("RAND_INTEGER")
def rand_integer(spark: SparkSession, a: list[str], name: str) -> str:
    low, high = a if len(a) == 2 else ("0", a[0])
    return f"CAST(floor(rand() * (({high}) - ({low}))) + ({low}) AS BIGINT)"


@call("SPLIT")
def split(spark: SparkSession, a: list[str], name: str) -> str:
    """By a text, not a pattern; by commas if none is named."""
    by = a[1] if len(a) > 1 else "','"
    return f"split({a[0]}, concat('\\\\Q', {by}, '\\\\E'))"


def groups(pattern: str) -> int:
    """1 where a literal pattern has a capturing group, which then is the result."""
    text = literal(pattern)
    return int(text is not None and re.search(r"(?<!\\)\((?!\?)", text) is not None)


@call("REGEXP_EXTRACT", "REGEXP_SUBSTR")
def regexp_extract(spark: SparkSession, a: list[str], name: str) -> str:
    """The match of that number at or after a place, or its first group; null without."""
    text = f"substr({a[0]}, {a[2]})" if len(a) > 2 else a[0]
    return f"get(regexp_extract_all({text}, {a[1]}, {groups(a[1])}), {f'({a[3]}) - 1' if len(a) > 3 else 0})"


@call("REGEXP_EXTRACT_ALL")
def regexp_extract_all(spark: SparkSession, a: list[str], name: str) -> str | None:
    return f"regexp_extract_all({a[0]}, {a[1]}, {groups(a[1])})" if len(a) == 2 else None


@call("TO_BASE32")
def to_base32(spark: SparkSession, a: list[str], name: str) -> str:
    b = f"CAST({a[0]} AS BINARY)"
    bits = f"array_join(transform(sequence(1, octet_length({b})), __i -> lpad(conv(hex(substr({b}, __i, 1)), 16, 2), 8, '0')), '')"
    letters = f"array_join(transform(sequence(0, CAST(ceil(octet_length({b}) * 8 / 5) AS INT) - 1), __i -> substr('{BASE32}', CAST(conv(rpad(substr({bits}, __i * 5 + 1, 5), 5, '0'), 2, 10) AS INT) + 1, 1)), '')"
    return f"if(octet_length({b}) = 0, '', rpad({letters}, CAST(ceil(octet_length({b}) / 5) AS INT) * 8, '='))"


@call("FROM_BASE32")
def from_base32(spark: SparkSession, a: list[str], name: str) -> str:
    s = f"rtrim('=', {a[0]})"
    bits = f"array_join(transform(sequence(1, char_length({s})), __i -> lpad(bin(position(substr({s}, __i, 1), '{BASE32}') - 1), 5, '0')), '')"
    n = f"CAST(floor(char_length({s}) * 5 / 8) AS INT)"
    return f"if({n} < 1, CAST('' AS BINARY), unhex(array_join(transform(sequence(0, {n} - 1), __i -> lpad(conv(substr({bits}, __i * 8 + 1, 8), 2, 16), 2, '0')), '')))"


def ordering(arg: str) -> tuple[str, str | None]:
    """An aggregate's last argument and the order named after it."""
    toks = TOKEN.findall(arg)
    for i, t in enumerate(toks):
        if t.upper() == "ORDER" and "".join(toks[i + 1 :]).lstrip()[:2].upper() == "BY":
            return "".join(toks[:i]).strip(), "".join(toks[i + 1 :]).lstrip()[2:].strip()
    return arg, None


@call("STRING_AGG")
def string_agg(spark: SparkSession, a: list[str], name: str) -> str:
    """Texts joined, by commas if nothing else is named, in the order that the last argument names."""
    # More than one order column leaves its commas among the arguments.
    at = next((i for i, x in enumerate(a) if ordering(x)[1]), None)
    if at is None:
        return f"listagg({a[0]}, {a[1] if len(a) > 1 else COMMA})"
    last, by = ordering(a[at])
    own = [*a[:at], last]
    return f"listagg({own[0]}, {own[1] if len(own) > 1 else COMMA}) WITHIN GROUP (ORDER BY {', '.join([by, *a[at + 1 :]])})"


@call("ARRAY_AGG")
def array_agg(spark: SparkSession, a: list[str], name: str) -> str | None:
    """With ORDER BY one key: nulls of the key last; values of the same key in their own order."""
    value, by = ordering(a[0])
    if by is None or len(a) > 1:
        return None
    m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC))?", by, re.S | re.I)
    less = "1" if (m[2] or "").upper() == "DESC" else "-1"
    order = f"CASE WHEN __a.o IS NULL AND __b.o IS NULL THEN 0 WHEN __a.o IS NULL THEN 1 WHEN __b.o IS NULL THEN -1 WHEN __a.o < __b.o THEN {less} WHEN __a.o > __b.o THEN -({less}) ELSE 0 END"
    return f"transform(array_sort(array_sort(collect_list(named_struct('o', {m[1]}, 'v', {value}))), (__a, __b) -> {order}), __e -> __e.v)"


# --- dates -----------------------------------------------------------------------------------------------------------


def java_pattern(text: str) -> str:
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)", text):
        if m[2]:
            out += "'" + m[2].replace("'", "''") + "'" if re.search(r"[A-Za-z']", m[2]) else m[2]
        elif m[1] == "%":
            out += "%"
        elif m[1] in STRFTIME:
            out += STRFTIME[m[1]]
        else:
            raise DialectError(f"unknown format element %{m[1]}")
    return quoted(out)


@call(*(f"{k}_{op}" for k in ("DATE", "DATETIME", "TIMESTAMP") for op in ("ADD", "SUB")))
def shifted(spark: SparkSession, a: list[str], name: str) -> str | None:
    """x moved by INTERVAL n UNIT; date_add(date, days) stays Spark's."""
    m = re.fullmatch(r"\s*INTERVAL\s+(.+?)\s+([A-Za-z]+?)S?\s*", a[1], re.S | re.I) if len(a) == 2 else None
    if not m:
        return None
    out = f"timestampadd({m[2].upper()}, {'-' if name.endswith('SUB') else ''}({literal(m[1]) or m[1]}), {a[0]})"
    return f"CAST({out} AS DATE)" if name.startswith("DATE_") else out


@call("DATE_DIFF", "DATETIME_DIFF", "TIMESTAMP_DIFF")
def difference(spark: SparkSession, a: list[str], name: str) -> str | None:
    """Whole units between timestamps; unit boundaries between dates."""
    unit = a[2].strip().upper() if len(a) == 3 else ""
    if unit not in UNITS:
        return None
    x, y = (f"date_trunc('{unit}', {c})" for c in a[:2]) if name == "DATE_DIFF" else a[:2]
    return f"timestampdiff({unit}, {y}, {x})"


@call("DATE_TRUNC", "DATETIME_TRUNC", "TIMESTAMP_TRUNC")
def truncated(spark: SparkSession, a: list[str], name: str) -> str | None:
    unit = a[1].strip().upper() if len(a) == 2 else ""
    if unit not in UNITS:
        return None
    out = f"date_trunc('{unit}', {a[0]})"
    return f"CAST({out} AS DATE)" if name == "DATE_TRUNC" else out


@call("FORMAT_DATE", "FORMAT_DATETIME", "FORMAT_TIMESTAMP")
def formatted(spark: SparkSession, a: list[str], name: str) -> str:
    return f"date_format({a[1]}, {java_pattern(given(a[0], 'a format'))})"


@call("PARSE_DATE", "PARSE_DATETIME", "PARSE_TIMESTAMP")
def parsed(spark: SparkSession, a: list[str], name: str) -> str:
    to = {"PARSE_DATE": "to_date", "PARSE_DATETIME": "to_timestamp_ntz", "PARSE_TIMESTAMP": "to_timestamp"}[name]
    return f"{to}({a[1]}, {java_pattern(given(a[0], 'a format'))})"


@call("DATE", "DATETIME")
def made(spark: SparkSession, a: list[str], name: str) -> str | None:
    if name == "DATE":
        return f"make_date({', '.join(a)})" if len(a) == 3 else None
    return f"make_timestamp_ntz({', '.join(a)})" if len(a) == 6 else f"CAST({a[0]} AS TIMESTAMP_NTZ)"


# --- sequences -------------------------------------------------------------------------------------------------------


def field_of(spec: str) -> str:
    """The path of a row's field: a name, '' for the element itself, or the place of a SEQ_COLLECT column."""
    text = literal(spec)
    text = spec.strip() if text is None else text
    if text.isdigit():
        text = "key" if text == "0" else f"v{text}"
    return f".`{text}`" if text else ""


def condition(text: str, fields: list[str]) -> str:
    """A condition of the define language on a row __r; null is false."""

    def ref(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1].isdigit():
            at = int(m[1])
            return f"__r.`{fields[at]}`" if at < len(fields) else "__r" if not fields and at == 0 else f"__r.`v{at}`"
        return f"__r.`{m[1]}`"

    out = re.sub(r"'(?:[^'\\]|\\.)*'|\$(\w+)", ref, text)
    if re.search(r"\bPREV\s*\(", out, re.I):
        raise DialectError(f"PREV has no meaning here: {text}")
    return f"coalesce({out}, false)"


def names_of(spec: str) -> list[str]:
    return [n.strip() for n in given(spec, "fields").split(",") if n.strip() and not n.strip().isdigit()]


def steps_of(spec: str) -> list[str]:
    """The parts between semicolons outside of texts."""
    return [p.strip() for p in re.findall(r"(?:'(?:[^'\\]|\\.)*'|[^;'])+", given(spec, "conditions")) if p.strip()]


@call("SEQ_COLLECT")
def seq_collect(spark: SparkSession, a: list[str], name: str) -> str:
    """Rows (key, v1, v2, ...) in the order of the key, null keys last."""
    fields = ["key", *(f"v{i}" for i in range(1, len(a)))]
    own = ", ".join(f"'{f}', {x}" for f, x in zip(fields, a, strict=True))
    return f"transform(array_sort(collect_list(named_struct('__null', ({a[0]}) IS NULL, {own}))), __e -> named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, __e.{f}' for f in fields)}))"


@call("SEQ_FOLD", "SEQ_FOLD_INT")
def seq_fold(spark: SparkSession, a: list[str], name: str) -> str:
    rows, low, high, kind = a[0], a[1], a[2], "BIGINT" if name == "SEQ_FOLD_INT" else "DOUBLE"
    start, end = f"greatest(1, CAST({low} AS INT))", f"least(size({rows}), CAST({high} AS INT))"
    xs = f"filter(transform(slice({rows}, {start}, greatest(0, {end} - {start} + 1)), __r -> CAST(__r{field_of(a[3])} AS {kind})), __x -> __x IS NOT NULL)"
    total = f"aggregate({xs}, CAST(0 AS {kind}), (__s, __x) -> __s + __x)"
    ops = {"sum": f"if(size({xs}) > 0, {total}, NULL)", "min": f"array_min({xs})", "max": f"array_max({xs})", "count": f"CAST(size({xs}) AS {kind})"}
    if kind == "DOUBLE":
        ops["avg"] = f"try_divide({total}, size({xs}))"
    op = given(a[4], "a fold's op").lower()
    if op not in ops:
        raise DialectError(f"unknown op {op!r} of {name}")
    return ops[op]


@call("SEQ_SPLIT")
def seq_split(spark: SparkSession, a: list[str], name: str) -> str:
    rows, value = a[0], lambda i: f"CAST(get({a[0]}, {i}){field_of(a[1])} AS DOUBLE)"
    breaks = f"filter(sequence(0, size({rows})), __i -> __i = 0 OR __i = size({rows}) OR NOT coalesce({value('__i')} - {value('__i - 1')} <= {a[2]}, false))"
    return f"if(size({rows}) > 0, transform(slice({breaks}, 1, size({breaks}) - 1), (__b, __k) -> slice({rows}, __b + 1, get({breaks}, __k + 1) - __b)), slice(array({rows}), 1, 0))"


@call("SEQ_FUNNEL")
def seq_funnel(spark: SparkSession, a: list[str], name: str) -> str:
    """The furthest step reached within the window from an anchor of the first step."""
    fields = names_of(a[1])
    tests = [condition(t, fields) for t in steps_of(a[4])]
    at = literal(a[2]) if literal(a[2]) is not None else a[2].strip()
    ts = f"__r.`{fields[int(at)]}`" if at.isdigit() and int(at) < len(fields) else f"__r{field_of(a[2])}"
    ts = f"(if(startswith(typeof({ts}), 'timestamp'), 1000D, 1D) * CAST({ts} AS DOUBLE))"
    anchor = [f"get(__a.anchor, {k})" for k in range(len(tests))]
    hits = [tests[0], *(f"({anchor[k - 1]} IS NOT NULL AND {ts} - {anchor[k - 1]} <= {a[3]} AND {tests[k]})" for k in range(1, len(tests)))]
    new = [f"if({hits[0]}, greatest({anchor[0]}, {ts}), {anchor[0]})", *(f"if({hits[k]}, greatest({anchor[k]}, {anchor[k - 1]}), {anchor[k]})" for k in range(1, len(tests)))]
    best = f"greatest(__a.best, {', '.join(f'if({h}, {k + 1}, 0)' for k, h in enumerate(hits))})"
    zero = f"named_struct('anchor', array({', '.join(['CAST(NULL AS DOUBLE)'] * len(tests))}), 'best', 0)"
    return f"aggregate({a[0]}, {zero}, (__a, __r) -> if({ts} IS NULL, __a, named_struct('anchor', array({', '.join(new)}), 'best', {best})), __a -> __a.best)"


@call("SEQ_RETENTION")
def seq_retention(spark: SparkSession, a: list[str], name: str) -> str:
    met = [f"exists({a[0]}, __r -> {condition(c, names_of(a[1]))})" for c in steps_of(a[2])]
    return f"array({', '.join([met[0], *(f'({met[0]} AND {m})' for m in met[1:])])})"


def drift(rows: str, field: str, zero: str, moved: str, fired: str) -> str:
    """1-based index of the first element after whose update `fired` holds, or 0; nulls only count."""
    start = f"named_struct('i', 0, 'at', 0, 's', {zero})"
    x = f"CAST(__x{field} AS DOUBLE)"
    states = f"named_struct('i', __a.i + 1, 'at', __a.at, 's', if({x} IS NULL, __a.s, {moved.replace('__v', x)}))"
    # A one-element array gives the updated state a name, which the test reads.
    step = f"get(transform(array({states}), __n -> named_struct('i', __n.i, 'at', if(__n.at = 0 AND {x} IS NOT NULL AND {fired}, __n.i, __n.at), 's', __n.s)), 0)"
    return f"aggregate({rows}, {start}, (__a, __x) -> {step}, __a -> __a.at)"


@call("SEQ_PAGE_HINKLEY")
def page_hinkley(spark: SparkSession, a: list[str], name: str) -> str:
    zero = "named_struct('n', 0D, 'mean', 0D, 'cum', 0D, 'low', 0D, 'high', 0D)"
    mean = "(__a.s.mean + (__v - __a.s.mean) / (__a.s.n + 1D))"
    cum = f"(__a.s.cum + __v - {mean} - CAST({a[2]} AS DOUBLE))"
    moved = f"named_struct('n', __a.s.n + 1D, 'mean', {mean}, 'cum', {cum}, 'low', least(__a.s.low, {cum}), 'high', greatest(__a.s.high, {cum}))"
    return drift(a[0], field_of(a[1]), zero, moved, f"(__n.s.cum - __n.s.low > {a[3]} OR __n.s.high - __n.s.cum > {a[3]})")


@call("SEQ_CUSUM")
def cusum(spark: SparkSession, a: list[str], name: str) -> str:
    target, slack = (f"CAST({x} AS DOUBLE)" for x in a[2:4])
    moved = f"named_struct('up', greatest(0D, __a.s.up + __v - {target} - {slack}), 'down', greatest(0D, __a.s.down + {target} - __v - {slack}))"
    return drift(a[0], field_of(a[1]), "named_struct('up', 0D, 'down', 0D)", moved, f"(__n.s.up > {a[4]} OR __n.s.down > {a[4]})")


def values(a: list[str]) -> str:
    return f"filter(transform({a[0]}, __x -> CAST(__x{field_of(a[1])} AS DOUBLE)), __x -> __x IS NOT NULL)"


@call("SEQ_EXP_SMOOTH")
def exp_smooth(spark: SparkSession, a: list[str], name: str) -> str:
    w = f"CAST({a[2]} AS DOUBLE)"
    return f"aggregate({values(a)}, CAST(NULL AS DOUBLE), (__s, __x) -> if(__s IS NULL, __x, {w} * __x + (1 - {w}) * __s))"


@call("SEQ_HOLT")
def holt(spark: SparkSession, a: list[str], name: str) -> str:
    alpha, beta = (f"CAST({x} AS DOUBLE)" for x in a[2:4])
    level = f"({alpha} * __x + (1 - {alpha}) * (__s.l + __s.t))"
    trend = f"({beta} * ({level} - __s.l) + (1 - {beta}) * __s.t)"
    step = f"named_struct('n', __s.n + 1, 'l', if(__s.n <= 1, __x, {level}), 't', CASE WHEN __s.n = 0 THEN CAST(NULL AS DOUBLE) WHEN __s.n = 1 THEN __x - __s.l ELSE {trend} END)"
    return f"aggregate({values(a)}, named_struct('n', 0, 'l', CAST(NULL AS DOUBLE), 't', CAST(NULL AS DOUBLE)), (__s, __x) -> {step}, __s -> __s.l + {a[4] if len(a) > 4 else 1} * coalesce(__s.t, 0D))"


@call("SEQ_MATCH", "SEQ_MATCH_STEPS")
def seq_match(spark: SparkSession, a: list[str], name: str) -> str:
    """The pattern is compiled here, once; rows go through a pandas UDF."""
    fields = names_of(a[1])
    define = {}
    for part in steps_of(a[3]):
        symbol, _, test = part.partition(":")
        define[symbol.strip()] = re.sub(r"'(?:[^'\\]|\\.)*'|\$(\d+)", lambda m: m[0] if m[1] is None or int(m[1]) >= len(fields) else f"${fields[int(m[1])]}", test.strip())
    make = seq.seq_match if name == "SEQ_MATCH" else seq.seq_match_steps
    udf = make(given(a[2], "a pattern"), define, fields or None, given(a[4], "a mode") if len(a) > 4 else "longest")
    own = f"{name.lower()}_{hashlib.md5(repr(a[1:]).encode()).hexdigest()[:16]}"
    spark.udf.register(own, udf)
    return f"{own}({a[0]})"


@call("POLY_FIT")
def poly_fit(spark: SparkSession, a: list[str], name: str) -> str:
    """Ascending coefficients over xs, ys; the degree is a number."""
    if not a[2].strip().isdigit():
        raise DialectError(f"the degree of POLY_FIT must be a number: {a[2]}")
    own = f"tw_poly_fit_{a[2].strip()}"
    spark.udf.register(own, matrix.poly_fit(int(a[2])))
    return f"{own}(CAST({a[1]} AS ARRAY<DOUBLE>), CAST({a[0]} AS ARRAY<DOUBLE>))"


@call("ARRAY_CUM_SUM", "ARRAY_CUM_SUM_INT")
def cum_sum(spark: SparkSession, a: list[str], name: str) -> str:
    kind = "BIGINT" if name.endswith("INT") else "DOUBLE"
    zero = f"CAST(0 AS {kind})"
    s = f"(__a.s + coalesce(CAST(__x AS {kind}), {zero}))"
    return f"aggregate({a[0]}, named_struct('s', {zero}, 'out', CAST(array() AS ARRAY<{kind}>)), (__a, __x) -> named_struct('s', {s}, 'out', concat(__a.out, array({s}))), __a -> __a.out)"


@call("DECAY_SUM", "DECAY_AVG", "DECAY_COUNT")
def decayed(spark: SparkSession, a: list[str], name: str) -> str:
    """Sums weighted by 2 ** -((asOf - ts) / halfLife); times are timestamps or milliseconds, halfLife milliseconds."""
    v, ts, half, at = a if name != "DECAY_COUNT" else ("1", *a)
    millis = f"(if(startswith(typeof({ts}), 'timestamp'), 1000D, 1D) * (CAST({at} AS DOUBLE) - CAST({ts} AS DOUBLE)))"
    w = f"if(({v}) IS NULL, NULL, pow(2D, -{millis} / CAST({half} AS DOUBLE)))"
    return {"DECAY_SUM": f"sum(({v}) * {w})", "DECAY_COUNT": f"sum({w})", "DECAY_AVG": f"try_divide(sum(({v}) * {w}), sum({w}))"}[name]


# --- models ----------------------------------------------------------------------------------------------------------


def gram(y: str, xs: str) -> str:
    """Sums of products of (1, xs, y), their upper triangle by rows: ordinary aggregates, however many rows a group has."""
    m = re.fullmatch(r"\s*array\s*\((.*)\)\s*", xs, re.S | re.I)
    if not m:
        raise DialectError(f"the features must be ARRAY[...]: {xs}")
    cols = ["1D", *(f"CAST({x} AS DOUBLE)" for x in arguments(m[1])), f"CAST({y} AS DOUBLE)"]
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return "array(" + ", ".join(f"sum(if({known}, {cols[i]} * {cols[j]}, 0D))" for i in range(len(cols)) for j in range(i, len(cols))) + ")"


@call("LINEAR_REG")
def linear_reg(spark: SparkSession, a: list[str], name: str) -> str:
    spark.udf.register("tw_linear_reg", models.linear_reg)
    return f"tw_linear_reg({gram(a[0], a[1])}, CAST({a[2] if len(a) > 2 else 0} AS DOUBLE))"


@call("BAYES_LINREG")
def bayes_linreg(spark: SparkSession, a: list[str], name: str) -> str:
    spark.udf.register("tw_bayes_linreg", models.bayes_linreg)
    return f"tw_bayes_linreg({gram(a[0], a[1])}, CAST({a[2]} AS DOUBLE), CAST({a[3] if len(a) > 3 else 'NULL'} AS DOUBLE))"


@call("BAYES_PREDICT")
def bayes_predict(spark: SparkSession, a: list[str], name: str) -> str:
    spark.udf.register("tw_bayes_predict", models.bayes_predict)
    return f"tw_bayes_predict({a[0]}, CAST({a[1]} AS ARRAY<DOUBLE>))"


@call("BETA_SAMPLE")
def beta_sample(spark: SparkSession, a: list[str], name: str) -> str:
    spark.udf.register("tw_beta_sample", models.beta_sample)
    return "tw_beta_sample(" + ", ".join(f"CAST({x} AS {k})" for x, k in zip(a, ("DOUBLE", "DOUBLE", "BIGINT"), strict=True)) + ")"


#: Words that may come after a table without a name.
AFTER_TABLE = {"WHERE", "GROUP", "ORDER", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "LIMIT", "HAVING", "UNION", "INTERSECT", "EXCEPT", "LATERAL", "ON", "WINDOW"}

# --- event-time windows ----------------------------------------------------------------------------------------------


def duration(arg: str) -> str:
    """An interval literal as the text that Spark's windows take; they have no calendar units."""
    m = re.fullmatch(r"INTERVAL\s+(?:'\s*(\d+)\s*'|(\d+))\s+([A-Za-z]+)", arg.strip(), re.I)
    unit = m.group(3).upper() if m else ""
    if unit not in UNITS and unit.removesuffix("S") not in UNITS or unit.rstrip("S") in ("MONTH", "QUARTER", "YEAR"):
        raise DialectError(f"a window takes an interval literal of a fixed unit: {arg}")
    return f"'{m.group(1) or m.group(2)} {unit.lower()}'"


@call("TUMBLE", "TUMBLE_START", "TUMBLE_END", "HOP", "HOP_START", "HOP_END", "SESSION", "SESSION_START", "SESSION_END")
def windowed(spark: SparkSession, a: list[str], name: str) -> str:
    """TUMBLE(ts, size [, offset]), HOP(ts, slide, size [, offset]) and SESSION(ts, gap) in GROUP BY; their _START and _END
    in the select list, with the same arguments."""
    kind, _, edge = name.partition("_")
    least, most = {"TUMBLE": (2, 3), "HOP": (3, 4), "SESSION": (2, 2)}[kind]
    if not least <= len(a) <= most:
        raise DialectError(f"{name} takes {least} to {most} arguments")
    times = [duration(x) for x in a[1:]]
    if kind == "TUMBLE" and len(times) == 2:
        times = [times[0], times[0], times[1]]
    elif kind == "HOP":
        times = [times[1], times[0], *times[2:]]
    out = f"{'session_window' if kind == 'SESSION' else 'window'}({', '.join([a[0], *times])})"
    return f"{out}.{edge.lower()}" if edge else out


# --- rewriting -------------------------------------------------------------------------------------------------------


def closing(toks: list[str], at: int) -> int:
    """The place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(toks)):
        depth += (toks[i] in "([") - (toks[i] in ")]") if len(toks[i]) == 1 else 0
        if depth == 0:
            return i
    raise DialectError(f"unclosed {toks[at]} in SQL")


def arguments(text: str) -> list[str]:
    out, depth = [""], 0
    for t in TOKEN.findall(text):
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if t == "," and depth == 0:
            out.append("")
        else:
            out[-1] += t
    return [x.strip() for x in out] if text.strip() else []


def unnested(rows: str, toks: list[str], at: int) -> tuple[str, int]:
    """A lateral explosion for UNNEST(rows) [WITH ORDINALITY | WITH OFFSET] [AS] name [(columns)], whose tail begins at
    `at`; the place after it. An element is the column with the table's name: its fields are name.field."""
    own = [k for k in range(at, len(toks)) if not toks[k].isspace()]
    word = lambda j: toks[own[j]].upper() if j < len(own) else ""
    j, place, first = 0, None, 1
    if word(0) == "WITH" and word(1) in ("ORDINALITY", "OFFSET"):
        place, first, j = "ordinality" if word(1) == "ORDINALITY" else "offset", int(word(1) == "ORDINALITY"), 2
        if place == "offset" and word(2) == "AS":
            place, j = toks[own[3]], 4
    j += word(j) == "AS"
    alias, columns = "unnested", []
    if re.match(r"[A-Za-z_`]", word(j)) and word(j) not in AFTER_TABLE:
        alias, j = toks[own[j]], j + 1
        if word(j) == "(":
            end = closing(toks, own[j])
            columns = arguments("".join(toks[own[j] + 1 : end]))
            j = next((k for k, o in enumerate(own) if o > end), len(own))
    if place:
        *names, place = columns if len(columns) > 1 else [*(columns or [alias]), place]
        rows = f"transform({rows}, (__e, __i) -> named_struct('e', __e, 'i', __i + {first}))"
        if len(names) > 1:
            raise DialectError("UNNEST with a place takes one column for the element")
        out = f"LATERAL inline({rows}) AS {alias}({names[0]}, {place})"
    elif len(columns) > 1:
        out = f"LATERAL inline({rows}) AS {alias}({', '.join(columns)})"
    else:
        out = f"LATERAL explode({rows}) AS {alias}({columns[0] if columns else alias})"
    return out + " ", own[j] if j < len(own) else len(toks)


def level(toks: list[str], at: int = 0) -> list[int]:
    """The places from `at` on that no bracket encloses."""
    out, depth = [], 0
    for i in range(at, len(toks)):
        depth -= toks[i] == ")"
        if depth == 0 and toks[i] != ")":
            out.append(i)
        depth += toks[i] == "("
    return out


def qualified(toks: list[str]) -> list[str]:
    """QUALIFY c becomes a column of the select, which an outer query filters on and leaves out."""
    top = level(toks)
    at = next((i for i in top if toks[i].upper() == "QUALIFY"), None)
    if at is None:
        return toks
    begin = max((i for i in top if i < at and toks[i].upper() == "SELECT"), default=None)
    source = next((i for i in top if begin is not None and begin < i < at and toks[i].upper() == "FROM"), None)
    if source is None:
        raise DialectError("QUALIFY needs a SELECT with FROM before it")
    ends = {word: next((i for i in top if i > at and toks[i].upper() in words), len(toks)) for word, words in (("rest", AFTER_QUALIFY), ("window", {*AFTER_QUALIFY, "WINDOW"}))}
    items = "".join(toks[begin + 1 : source]).strip()
    once = re.match(r"DISTINCT\s+", items, re.I)
    items = items[once.end() :] if once else items
    body = f"{''.join(toks[source:at])} {''.join(toks[ends['window'] : ends['rest']])}"
    new = f"SELECT {'DISTINCT ' if once else ''}* EXCEPT (__qualify) FROM (SELECT {items}, ({''.join(toks[at + 1 : ends['window']]).strip()}) AS __qualify {body}) WHERE __qualify "
    return qualified([*toks[:begin], *TOKEN.findall(new), *toks[ends["rest"] :]])


def translate(spark: SparkSession, sql: str, subscripts: bool = False) -> str:
    """The statement for Spark. With subscripts, a[i] counts from 1 and is null beyond the end (a['k'] stays a map's)."""
    toks, out, i = qualified(TOKEN.findall(sql)), [], 0
    inner = lambda a, b: translate(spark, "".join(toks[a:b]), subscripts)
    primary = None  # where in out the operand that a subscript would take begins
    before = 0  # where the last operand begins, which IN UNNEST takes
    while i < len(toks):
        t = toks[i]
        word = re.match(r"[A-Za-z_`]", t) is not None
        path = word and out and out[-1] == "." and primary is not None
        begin = primary if path else len(out)
        n = i + 1
        while n < len(toks) and toks[n].isspace():
            n += 1
        upper = t.upper()
        if upper not in ("NOT", "IN") and not path and (word or t[0] in "'\"(" or t[0].isdigit()):
            before = begin
        if upper == "IN" and n < len(toks) and toks[n].upper() == "UNNEST":
            start = next(k for k in range(n + 1, len(toks)) if toks[k] == "(")
            end = closing(toks, start)
            own = "".join(out[before:]).strip()
            no = re.search(r"\s+NOT$", own, re.I)
            out[before:] = [f"{'NOT ' if no else ''}array_contains({inner(start + 1, end)}, {own[: no.start()] if no else own})"]
            i, primary = end + 1, None
        elif word and upper == "ARRAY" and n < len(toks) and toks[n] == "[":
            end = closing(toks, n)
            out.append(f"array({inner(n + 1, end)})")
            i, primary = end + 1, begin
        elif upper == "UNNEST" and n < len(toks) and toks[n] == "(":
            end = closing(toks, n)
            new, i = unnested(inner(n + 1, end), toks, end + 1)
            out.append(new)
            primary = None
        elif upper == "SAFE_CAST":
            out.append("TRY_CAST")
            i, primary = i + 1, begin
        elif word and not path and n < len(toks) and toks[n] == "(":
            end = closing(toks, n)
            # Aliases such as "AS date (" do not occur in SQL; every name before a bracket is a call or a keyword.
            args = arguments(inner(n + 1, end)) if upper in TEMPLATES or upper in CALLS else []
            new = TEMPLATES[upper].format(*args, all=", ".join(args)) if upper in TEMPLATES else CALLS[upper](spark, args, upper) if upper in CALLS else None
            out.append(new if new is not None else f"{t}({inner(n + 1, end)})")
            i, primary = end + 1, begin
        elif t == "(":
            end = closing(toks, i)
            out.append(f"({inner(i + 1, end)})")
            i, primary = end + 1, begin
        elif t == "[" and subscripts and primary is not None:
            end = closing(toks, i)
            at, own = inner(i + 1, end), "".join(out[primary:])
            del out[primary:]
            out.append(f"{own}[{at}]" if literal(at) is not None else f"try_element_at({own}, CAST({at} AS INT))")
            i, primary = end + 1, len(out) - 1
        else:
            out.append(t)
            primary = begin if word else primary if t == "." else None
            i += 1
    return "".join(out)
