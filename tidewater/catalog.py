"""The registered queries of the engine's own operators and their SQL for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, html, matrix, seq, text
from .operators import attribution, cdc, routing
from .operators.aggregate import aggregate, first_rows
from .operators.buffer import buffered
from .operators.select import TIME, select
from .operators.windows import assigned
from .plans import runner, sqlx
from .plans.filters import compile_filter
from .plans.schema import types_of
from .streaming import windows as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their event time; event_id makes the order total."""
    return table(spark, sf_dir, "events").withColumn(TIME, F.col("ts").cast("timestamp"))


def filtered(df: DataFrame, f: object) -> DataFrame:
    return df.filter(compile_filter(f, types_of(df)))


def r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


# --- aggregation through declared steps ----------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runner.build(spark, {
        "sources": [{"name": "lines", "module": "storage", "parameters": {"input": f"{sf_dir}/lineitem.parquet"}}],
        "transforms": [
            {"name": "revenue", "module": "select", "input": "lines", "parameters": {
                "filter": "l_shipdate <= '1998-09-02'",
                "select": [{"name": "l_returnflag"}, {"name": "l_linestatus"}, {"name": "l_quantity"}, {"name": "l_discount"}, {"name": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}]}},
            {"name": "summary", "module": "aggregation", "input": "revenue", "parameters": {
                "groupFields": ["l_returnflag", "l_linestatus"],
                "fields": [{"name": "n", "op": "count"}, {"name": "sum_qty", "op": "sum", "field": "l_quantity"}, {"name": "revenue", "op": "sum", "field": "revenue"}, {"name": "avg_disc", "op": "avg", "field": "l_discount"}]}},
        ],
    })
    return done["summary"].select("l_returnflag", "l_linestatus", "n", r(F.col("sum_qty"), 4).alias("sum_qty"), r(F.col("revenue"), 2).alias("revenue"), r(F.col("avg_disc")).alias("avg_disc"))


# --- predicates ----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 25 AND (l_returnflag = 'R' OR l_discount < 0.02)")
def filter_ops(spark, sf_dir):
    f = {"and": [{"key": "l_quantity", "op": ">=", "value": 25}, {"or": [{"key": "l_returnflag", "op": "=", "value": "R"}, {"key": "l_discount", "op": "<", "value": 0.02}]}]}
    return filtered(table(spark, sf_dir, "lineitem"), f).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND o_totalprice / 2 BETWEEN 20000 AND 60000
AND o_orderpriority NOT IN ('1-URGENT') AND o_orderpriority LIKE '_-%'""")
def filter_sql_text(spark, sf_dir):
    f = "NOT (o_orderstatus = 'F') AND o_totalprice / 2 BETWEEN 20000 AND 60000 AND o_orderpriority NOT IN ('1-URGENT') AND o_orderpriority LIKE '_-%'"
    return filtered(table(spark, sf_dir, "orders"), f).select("o_orderkey")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, v IS NULL AS is_null, coalesce(v > 50, false) AS above, coalesce(v <> 0, false) AS differs, coalesce(v <= 50, false) AS not_above FROM e
""")
def filter_null_rules(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    c = lambda f: compile_filter(f, types_of(e))
    return e.select("event_id", c({"key": "v", "op": "=", "value": None}).alias("is_null"), c("v > 50").alias("above"), c({"key": "v", "op": "!=", "value": 0}).alias("differs"), c("NOT (v > 50)").alias("not_above"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(c_name, '[02468]$')")
def filter_match_in(spark, sf_dir):
    f = [{"key": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, {"key": "c_name", "op": "match", "value": "[02468]$"}]
    return filtered(table(spark, sf_dir, "customer"), f).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax")
def filter_valuekey(spark, sf_dir):
    return filtered(table(spark, sf_dir, "lineitem"), {"key": "l_discount", "op": ">", "valueKey": "l_tax"}).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000")
def filter_expression(spark, sf_dir):
    f = {"expression": "l_extendedprice * (1 - l_discount)", "op": ">", "value": 30000}
    return filtered(table(spark, sf_dir, "lineitem"), f).select("l_orderkey", "l_linenumber")


# --- select functions ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, o_custkey::VARCHAR AS cust, TRY_CAST(o_orderpriority[1] AS INTEGER) AS prio, 'x' AS tag, 7::BIGINT AS seven FROM orders""")
def select_rename_cast_const(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("first", F.substring("o_orderpriority", 1, 1))
    return select(df, [{"name": "id", "field": "o_orderkey"}, {"name": "cust", "func": "cast", "field": "o_custkey", "type": "string"}, {"name": "prio", "func": "cast", "field": "first", "type": "int32"}, {"name": "tag", "value": "x", "type": "string"}, {"name": "seven", "value": 7, "type": "int64"}])


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, round(sqrt(l_quantity) + ln(l_extendedprice), 6) AS mixed,
(CASE WHEN l_quantity > 25 AND l_tax < 0.05 THEN 1 ELSE 0 END)::DOUBLE AS flag, greatest(l_discount, l_tax) AS top, (CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 ELSE 0 END)::DOUBLE AS level,
((l_orderkey & 12) | (l_linenumber << 1))::DOUBLE AS bits FROM lineitem""")
def select_expression(spark, sf_dir):
    out = select(table(spark, sf_dir, "lineitem"), [{"name": "l_orderkey"}, {"name": "l_linenumber"}, {"name": "charge", "expression": "l_extendedprice * (1 - l_discount) * (1 + l_tax)"}, {"name": "mixed", "expression": "sqrt(l_quantity) + ln(l_extendedprice)"}, {"name": "flag", "expression": "l_quantity > 25 && l_tax < 0.05 ? 1 : 0"}, {"name": "top", "expression": "max(l_discount, l_tax)"}, {"name": "level", "expression": "switch3(l_quantity >= 40, 3, l_quantity >= 20, 2)"}, {"name": "bits", "expression": "l_orderkey & 12 | l_linenumber << 1"}])
    return out.withColumn("charge", r(F.col("charge"))).withColumn("mixed", r(F.col("mixed")))


@query("""SELECT p_partkey, p_brand || '/' || p_size AS label, CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#12' THEN 'twelve' ELSE 'other' END AS brand,
CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS small, 'part ' || p_name || ' of ' || p_type AS said FROM part""")
def select_concat_nullif_replace(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), [{"name": "p_partkey"}, {"name": "label", "func": "concat", "fields": ["p_brand", "p_size"], "delimiter": "/"}, {"name": "brand", "func": "replace", "field": "p_brand", "mapping": {"Brand#11": "eleven", "Brand#12": "twelve"}, "default": "other"}, {"name": "small", "func": "nullif", "field": "p_size", "condition": "p_size > 25"}, {"name": "said", "text": "part ${p_name} of ${p_type}"}])


@query("SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS h, substr(sha256('k' || c_custkey), 1, 12) AS short, md5(c_name) AS m FROM customer")
def select_hash(spark, sf_dir):
    out = select(table(spark, sf_dir, "customer"), [{"name": "c_custkey"}, {"name": "h", "func": "hash", "fields": ["c_name", "c_mktsegment"], "delimiter": "|"}, {"name": "short", "func": "hash", "fields": ["#k", "c_custkey"], "size": 12}, {"name": "c_name"}])
    return out.withColumn("m", F.md5("c_name")).drop("c_name")


@query("""SELECT o_orderkey, '{"status":"' || o_orderstatus || '","cust":' || o_custkey || '}' AS js, o_custkey AS inner_cust FROM orders""")
def select_struct_json(spark, sf_dir):
    fields = [{"name": "status", "field": "o_orderstatus"}, {"name": "cust", "field": "o_custkey"}]
    out = select(table(spark, sf_dir, "orders"), [{"name": "o_orderkey"}, {"name": "s", "func": "struct", "fields": fields}, {"name": "js", "func": "json", "fields": fields}])
    return out.select("o_orderkey", "js", F.col("s.cust").alias("inner_cust"))


@query("SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def select_json_path(spark, sf_dir):
    out = select(table(spark, sf_dir, "events"), [{"name": "user_id"}, {"name": "k", "func": "json_path", "field": "props", "path": "$.k"}])
    return out.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, unnest(range(0, p_size % 5, 2))::BIGINT AS i FROM part WHERE p_size % 5 > 0")
def select_generate(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("top", F.col("p_size") % 5)
    return select(filtered(df, "top > 0"), [{"name": "p_partkey"}, {"name": "i", "func": "generate", "from": 0, "to": "top", "interval": 2}], flatten="i")


@query("SELECT c_custkey, base64(c_name::BLOB) AS b64, c_name AS back, c_custkey AS num FROM customer")
def select_base64_bytes(spark, sf_dir):
    return select(table(spark, sf_dir, "customer"), [{"name": "c_custkey"}, {"name": "b64", "func": "base64_encode", "field": "c_name"}, {"name": "back", "func": "base64_decode", "field": "b64", "type": "string"}, {"name": "raw", "func": "bytes_encode", "field": "c_custkey", "ignore": True}, {"name": "num", "func": "bytes_decode", "field": "raw", "type": "int64"}])


@query("SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS later FROM events")
def select_timestamp_cutoff(spark, sf_dir):
    out = select(events(spark, sf_dir), [{"name": "event_id"}, {"name": "hour", "func": "event_timestamp", "cutoff": "hour"}, {"name": "later", "func": "event_timestamp", "duration": 90, "durationUnit": "minute"}])
    return out.select("event_id", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), F.date_format("later", "yyyy-MM-dd HH:mm").alias("later"))


@query("""SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN orders o ON o_custkey = c_custkey AND o_totalprice > 200000""")
def flatten_outer(spark, sf_dir):
    own = filtered(table(spark, sf_dir, "orders"), "o_totalprice > 200000").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("o_orderkey"))
    df = table(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return select(df, [{"name": "c_custkey"}, {"name": "o_orderkey"}], flatten="o_orderkey")


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(*) FILTER (l_quantity > 30) AS big, round(coalesce(sum(l_extendedprice) FILTER (l_tax = 0), 0), 2) AS untaxed FROM lineitem GROUP BY ALL""")
def agg_condition(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "lineitem"), [{"name": "big", "op": "count", "condition": "l_quantity > 30"}, {"name": "untaxed", "op": "sum", "field": "l_extendedprice", "condition": {"key": "l_tax", "op": "=", "value": 0}}], ["l_returnflag"])
    return out.withColumn("untaxed", r(F.col("untaxed"), 2))


@query("""
WITH s AS (SELECT l_returnflag, l_quantity AS w, l_extendedprice AS x FROM lineitem)
SELECT l_returnflag, round(sum(w * x) / sum(w), 4) AS wavg, round(stddev_samp(x), 4) AS std,
       round(sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / (sum(w) - 1)), 2) AS wstd FROM s GROUP BY ALL
""")
def agg_weighted(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "lineitem"), [{"name": "wavg", "op": "avg", "field": "l_extendedprice", "weightField": "l_quantity"}, {"name": "std", "op": "std", "field": "l_extendedprice"}, {"name": "wstd", "op": "std", "field": "l_extendedprice", "weightField": "l_quantity"}], ["l_returnflag"])
    return out.select("l_returnflag", r(F.col("wavg"), 4).alias("wavg"), r(F.col("std"), 4).alias("std"), r(F.col("wstd"), 2).alias("wstd"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_type, (value, event_id)) AS top_type FROM events GROUP BY ALL""")
def agg_first_last_arg(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn(TIME, F.struct("ts", "event_id")).withColumn("by", F.struct("value", "event_id"))
    return aggregate(df, [{"name": "last_id", "op": "last", "field": "event_id"}, {"name": "first_id", "op": "first", "field": "event_id"}, {"name": "top_type", "op": "arg_max", "field": "event_type", "comparingField": "by"}], ["user_id"])


@query("""SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY ALL""")
def agg_array(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "orders"), [{"name": "keys", "op": "array_agg", "field": "o_orderkey", "order": "ascending"}], ["o_custkey"])
    return out.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 2) AS rmse, count(*) AS n FROM lineitem GROUP BY ALL""")
def agg_simple_regression(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "lineitem"), [{"name": "g", "op": "simple_regression", "field": "l_extendedprice", "xField": "l_quantity"}], ["l_returnflag"])
    return out.select("l_returnflag", r(F.col("g.Slope"), 4).alias("slope"), r(F.col("g.Intercept"), 2).alias("icpt"), r(F.col("g.RMSE"), 2).alias("rmse"), F.col("g.N").alias("n"))


@query("""WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS y, avg(l_quantity) AS x1, avg(l_discount) AS x2, var_pop(l_extendedprice) AS yy, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2,
covar_pop(l_quantity, l_discount) AS c, covar_pop(l_extendedprice, l_quantity) AS y1, covar_pop(l_extendedprice, l_discount) AS y2 FROM lineitem GROUP BY 1),
b AS (SELECT *, (y1 * v2 - y2 * c) / (v1 * v2 - c * c) AS b1, (y2 * v1 - y1 * c) / (v1 * v2 - c * c) AS b2 FROM m)
SELECT l_returnflag, round(y - b1 * x1 - b2 * x2, 2) AS b0, round(b1, 2) AS b1, round(b2, 2) AS b2, round(sqrt(yy - b1 * y1 - b2 * y2), 2) AS rmse, n FROM b""")
def agg_regression(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "lineitem"), [{"name": "g", "op": "regression", "field": "l_extendedprice", "xFields": ["l_quantity", "l_discount"]}], ["l_returnflag"])
    return out.select("l_returnflag", *[r(F.get("g.Coefficients", F.lit(i)), 2).alias(f"b{i}") for i in range(3)], r(F.col("g.RMSE"), 2).alias("rmse"), F.col("g.N").alias("n"))


@query("""SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, 1::BIGINT AS n_customers FROM customer
UNION ALL SELECT o_custkey, count(*), 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def agg_multi_input(spark, sf_dir):
    inputs = {"orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "customers": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))}
    return aggregate(inputs, [{"name": "n_orders", "op": "count", "input": "orders"}, {"name": "n_customers", "op": "count", "input": "customers"}], ["k"])


@query("""SELECT o_custkey, round(sum(o_totalprice) / count(*), 5) AS mean FROM orders GROUP BY o_custkey HAVING count(*) > 10""")
def agg_post_filter_select_limit(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "orders"), [{"name": "n", "op": "count"}, {"name": "total", "op": "sum", "field": "o_totalprice"}], ["o_custkey"], filter="n > 10", select=[{"name": "mean", "expression": "total / n"}], limit=20)
    return out.withColumn("mean", r(F.col("mean"), 5))


@query("""SELECT event_type, strftime(w, '%Y-%m-%d') AS day, n FROM (
SELECT event_type, date_trunc('day', ts) AS w, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS place FROM events GROUP BY 1, 2) WHERE place <= 3""")
def agg_limit_per_key(spark, sf_dir):
    out = aggregate(events(spark, sf_dir), [{"name": "n", "op": "count"}], ["event_type"], limit=3, window=assigned("fixed", F.col(TIME), 1, "day"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def agg_grouping_sets(spark, sf_dir):
    return sqlx.run(spark, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", {"lineitem": table(spark, sf_dir, "lineitem")})


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q25, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses,
count(DISTINCT l_partkey) AS parts, list_sum(list(DISTINCT l_linenumber))::BIGINT AS lines FROM lineitem GROUP BY 1""")
def sql_quantile_distinct(spark, sf_dir):
    sql = """SELECT l_returnflag, round(QUANTILE(l_quantity, 0.25), 6) AS q25, array_join(MDT_ARRAY_AGG_DISTINCT_STRING(l_linestatus), ',') AS statuses,
    MDT_COUNT_DISTINCT_INT64(l_partkey) AS parts, CAST(aggregate(MDT_ARRAY_AGG_DISTINCT_INT64(CAST(l_linenumber AS BIGINT)), 0L, (a, x) -> a + x) AS BIGINT) AS lines FROM lineitem GROUP BY 1"""
    return sqlx.run(spark, sql, {"lineitem": table(spark, sf_dir, "lineitem")})


@query("""SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size / 100.0), 9) AS c, round(atan2(p_size, 7), 9) AS d, round(asin(p_size / 100.0), 9) AS e,
round(sinh(p_size / 50.0), 9) AS f, round(degrees(p_size), 9) AS g, round(radians(p_size), 9) AS h, round(cbrt(p_size), 9) AS i, round(log2(p_size), 9) AS j, sign(p_size - 25)::INTEGER AS k FROM part""")
def sql_trigonometry(spark, sf_dir):
    sql = """SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size / 100.0D), 9) AS c, round(atan2(p_size, 7), 9) AS d, round(asin(p_size / 100.0D), 9) AS e,
    round(sinh(p_size / 50.0D), 9) AS f, round(degrees(p_size), 9) AS g, round(radians(p_size), 9) AS h, round(cbrt(p_size), 9) AS i, round(log2(p_size), 9) AS j, CAST(sign(p_size - 25) AS INT) AS k FROM part"""
    return sqlx.run(spark, sql, {"part": table(spark, sf_dir, "part")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT year(l_shipdate)::INTEGER AS y, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (year(l_shipdate), l_linestatus)")
def agg_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), "l_linestatus").rollup("y", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.5), 6) AS q50 FROM events GROUP BY ALL")
def agg_distinct_quantile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), r(F.percentile("value", 0.9)).alias("q90"), r(F.percentile("value", 0.5)).alias("q50"))


@query()
def agg_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.016).alias("parts"))


DECAY = "power(2.0, -(epoch_ms(TIMESTAMP '2025-01-01') - epoch_ms(ts)) / 86400000.0 / 365)"


@query(f"SELECT user_id, round(sum(value * {DECAY}), 3) AS s, round(sum(value * {DECAY}) / sum({DECAY}), 3) AS a, round(sum({DECAY}), 3) AS n FROM events GROUP BY ALL")
def agg_decay(spark, sf_dir):
    v, ts, at, half = F.col("value"), F.unix_millis(TIME), F.unix_millis(F.lit("2025-01-01").cast("timestamp")), 86400000.0 * 365
    return events(spark, sf_dir).groupBy("user_id").agg(r(arrays.decay_sum(v, ts, at, half), 3).alias("s"), r(arrays.decay_avg(v, ts, at, half), 3).alias("a"), r(arrays.decay_count(v, ts, at, half), 3).alias("n"))


# --- windows -------------------------------------------------------------------------------------------------------


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in a total order: event_id microseconds added to the event time."""
    e = table(spark, sf_dir, "events")
    return e.withColumn(TIME, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id")))


@query("""SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 6) AS s, round(max(value) OVER w, 6) AS m FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) + event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def win_count_range(spark, sf_dir):
    last3 = {"count": 3}
    out = select(ordered(spark, sf_dir), [{"name": "event_id"}, {"name": "n", "func": "count", "range": last3}, {"name": "s", "func": "sum", "field": "value", "range": last3}, {"name": "m", "func": "max", "field": "value", "range": last3}], group_fields=["user_id"])
    return out.select("event_id", "n", r(F.col("s")).alias("s"), r(F.col("m")).alias("m"))


@query("""SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS a FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) + event_id RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def win_duration_range(spark, sf_dir):
    day = {"duration": 1, "unit": "day"}
    out = select(ordered(spark, sf_dir), [{"name": "event_id"}, {"name": "n", "func": "count", "range": day}, {"name": "a", "func": "avg", "field": "value", "range": day}], group_fields=["user_id"])
    return out.select("event_id", "n", r(F.col("a")).alias("a"))


@query("""SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) + event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 6) AS s FROM events""")
def win_offset(spark, sf_dir):
    out = select(ordered(spark, sf_dir), [{"name": "event_id"}, {"name": "s", "func": "sum", "field": "value", "range": {"count": 3, "offset": 1}}], group_fields=["user_id"])
    return out.select("event_id", r(F.col("s")).alias("s"))


@query("""SELECT event_id, round(value - lag(value, 1) OVER w, 6) AS d, round(value + 2 * lag(value, 2) OVER w, 6) AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) + event_id)""")
def win_lag_expr(spark, sf_dir):
    out = select(ordered(spark, sf_dir), [{"name": "event_id"}, {"name": "d", "func": "lag", "expression": "value - value[1]"}, {"name": "e", "func": "lag", "expression": "value[0] + 2 * value[2]"}], group_fields=["user_id"])
    return out.select("event_id", r(F.col("d")).alias("d"), r(F.col("e")).alias("e"))


RANKS = """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd,
lead(o_orderkey) OVER w AS nx, first_value(o_orderkey) OVER w AS fv, nth_value(o_orderkey, 2) OVER w AS nv FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)"""


@query(RANKS)
def win_rank_family(spark, sf_dir):
    return sqlx.run(spark, RANKS, {"orders": table(spark, sf_dir, "orders")})


FRAMES = """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS run, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS around FROM orders"""


@query(FRAMES)
def win_frames(spark, sf_dir):
    return sqlx.run(spark, FRAMES, {"orders": table(spark, sf_dir, "orders")})


# --- sort, limit, sets, common tables ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_key(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
def sort_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy("c_acctbal", "c_custkey").offset(5).limit(10).select("c_custkey")


SETS = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 {op} SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 0"


def sets(op: str):
    def run(spark, sf_dir):
        return sqlx.run(spark, SETS.format(op=op), {n: table(spark, sf_dir, n) for n in ("customer", "supplier")})

    return run


for _op in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT"):
    _f = sets(_op)
    _f.__name__ = f"set_{_op.lower().replace(' ', '_')}"
    query(SETS.format(op=_op))(_f)

NESTED = """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT c_mktsegment, total FROM spend JOIN customer ON c_custkey = o_custkey)
SELECT c_mktsegment, count(*) AS n, round(max(total), 2) AS top FROM (SELECT * FROM ranked WHERE total > 100000) x GROUP BY c_mktsegment"""


@query(NESTED)
def cte_nested(spark, sf_dir):
    return sqlx.run(spark, NESTED, {n: table(spark, sf_dir, n) for n in ("customer", "orders")})


# --- joins ---------------------------------------------------------------------------------------------------------

JOINS = {
    "join_inner": "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o RIGHT JOIN customer ON c_custkey = o_custkey",
    "join_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 7",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_nationkey > r_regionkey * 5",
    "join_range": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_totalprice BETWEEN a.o_totalprice AND a.o_totalprice * 1.1 AND a.o_orderkey <> b.o_orderkey",
    "lookup_prefix_range": "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber >= 2 AND l_linenumber <= 3",
}


def joins(sql: str):
    def run(spark, sf_dir):
        return sqlx.run(spark, sql, {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem") if n in sql})

    return run


for _name, _sql in JOINS.items():
    _f = joins(_sql)
    _f.__name__ = _name
    query(_sql)(_f)


@query("""SELECT a.event_id, b.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN
(SELECT user_id, epoch_ms(ts) * 100000 + event_id AS k, event_id FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND epoch_ms(a.ts) * 100000 + a.event_id >= b.k""")
def join_asof(spark, sf_dir):
    """The last click of the user at or before each purchase: one ordered pass over both sides' union."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_millis(F.col("ts").cast("timestamp")) * 100000 + F.col("event_id")).alias("k"))
    e = e.filter(F.col("event_type").isin("purchase", "click"))
    w = Window.partitionBy("user_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before", before).filter("event_type = 'purchase'").select("event_id", "before")


@query("SELECT o_orderkey, count(l_linenumber) AS n, round(coalesce(sum(l_quantity), 0), 4) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount > 0.05 GROUP BY o_orderkey")
def lateral_agg(spark, sf_dir):
    sql = "SELECT i.o_orderkey, x.n, round(coalesce(x.q, 0), 4) AS q FROM INPUT i, LATERAL (SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey = i.o_orderkey AND l_discount > 0.05) x"
    return sqlx.per_record(spark, sql, table(spark, sf_dir, "orders"), {"lineitem": table(spark, sf_dir, "lineitem")})


@query("""SELECT o_orderkey, l_linenumber FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 2 AND o_orderkey IN (SELECT o_orderkey FROM orders)""")
def lateral_topn(spark, sf_dir):
    sql = "SELECT o.o_orderkey, x.l_linenumber FROM orders o JOIN LATERAL (SELECT l_linenumber FROM lineitem WHERE l_orderkey = o.o_orderkey ORDER BY l_extendedprice DESC, l_linenumber LIMIT 2) x"
    return sqlx.run(spark, sql, {n: table(spark, sf_dir, n) for n in ("orders", "lineitem")})


@query("SELECT o_custkey, round(total, 2) AS total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) WHERE total > 500000")
def multi_statement_session(spark, sf_dir):
    steps = [{"name": "open_orders", "sql": "SELECT * FROM orders WHERE o_orderstatus <> 'P'", "output": False}, {"name": "spend", "sql": "SELECT o_custkey, sum(o_totalprice) AS total FROM open_orders GROUP BY 1", "output": False}, {"name": "big", "sql": "SELECT o_custkey, round(total, 2) AS total FROM spend WHERE total > 500000"}]
    return sqlx.session(spark, steps, {"orders": table(spark, sf_dir, "orders")})["big"]


# --- routing -------------------------------------------------------------------------------------------------------

PARTS = [{"name": "big", "filter": "o_totalprice > 200000"}, {"name": "open", "filter": "o_orderstatus = 'O'"}]


def counted(parts: dict[str, DataFrame]) -> DataFrame:
    return routing.union({k: v.select("o_orderkey") for k, v in parts.items()}).groupBy(F.col("__input").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'excluded' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY 1")
def partition_exclusive(spark, sf_dir):
    return counted(routing.partition(table(spark, sf_dir, "orders"), PARTS))


@query("""SELECT part, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM (SELECT 'big' AS part, * FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'open', * FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'excluded', * FROM orders WHERE NOT (o_totalprice > 200000 OR o_orderstatus = 'O')) GROUP BY 1""")
def partition_nonexclusive(spark, sf_dir):
    return counted(routing.partition(table(spark, sf_dir, "orders"), PARTS, exclusive=False))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 <> 0)
SELECT k, CASE WHEN a.k IS NULL THEN 'a' WHEN b.k IS NULL THEN 'b' ELSE '' END AS missing, CASE WHEN a.seg <> b.seg THEN 'seg:a=' || a.seg || ',b=' || b.seg ELSE '' END AS diff
FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR a.seg <> b.seg""")
def compare_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    out = routing.compare({"a": c.filter("k % 7 <> 0"), "b": c.filter("k % 11 <> 0").withColumn("seg", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("seg")))}, ["k"])
    shown = F.array_join(F.transform("differences", lambda d: F.concat(d["field"], F.lit(":"), F.array_join(d["values"], ","))), ";")
    return out.select("k", F.array_join("missingInputs", ",").alias("missing"), shown.alias("diff"))


@query("SELECT c_custkey AS k, c_mktsegment AS seg, NULL::DOUBLE AS bal, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 's' FROM supplier")
def union_schema(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return routing.union({"c": c, "s": s}).withColumnRenamed("__input", "src")


# --- SQL functions -------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, upper(p_name) AS u, substr(p_type, 2, 3) AS s, strpos(p_name, 'e') AS pos, replace(p_brand, '#', '-') AS rep, reverse(p_brand) AS rev, lpad(p_size::VARCHAR, 4, '0') AS pad,
regexp_matches(p_name, '[aeiou]{2}') AS rx, contains(lower(p_type), 'brass') AS cs, length(p_name)::INTEGER AS len, concat_ws('-', p_brand, p_type) AS cw, split_part(p_type, ' ', 1) AS sp FROM part""")
def sql_string(spark, sf_dir):
    sql = """SELECT p_partkey, upper(p_name) AS u, substr(p_type, 2, 3) AS s, strpos(p_name, 'e') AS pos, replace(p_brand, '#', '-') AS rep, reverse(p_brand) AS rev, lpad(CAST(p_size AS STRING), 4, '0') AS pad,
    regexp_contains(p_name, '[aeiou]{2}') AS rx, contains_substr(p_type, 'BRASS') AS cs, length(p_name) AS len, concat_ws('-', p_brand, p_type) AS cw, split_part(p_type, ' ', 1) AS sp FROM part"""
    return sqlx.run(spark, sql, {"part": table(spark, sf_dir, "part")})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS sd, round(power(l_quantity, 2), 4) AS p, mod(l_orderkey, 10) AS m, sign(l_discount)::DOUBLE AS sg,
floor(l_extendedprice / 100)::BIGINT AS f, round(degrees(l_tax), 6) AS dg, bit_count(l_orderkey)::INTEGER AS bc FROM lineitem""")
def sql_numeric(spark, sf_dir):
    sql = """SELECT l_orderkey, l_linenumber, round(safe_divide(l_discount, l_tax), 6) AS sd, round(power(l_quantity, 2), 4) AS p, mod(l_orderkey, 10) AS m, sign(l_discount) AS sg,
    CAST(floor(l_extendedprice / 100) AS BIGINT) AS f, round(degrees(l_tax), 6) AS dg, bit_count(l_orderkey) AS bc FROM lineitem"""
    return sqlx.run(spark, sql, {"lineitem": table(spark, sf_dir, "lineitem")})


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, dayofyear(o_orderdate)::INTEGER AS doy, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mon,
strftime(last_day(o_orderdate), '%Y-%m-%d') AS ld, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS dd, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y/%m/%d') AS plus, epoch(o_orderdate)::BIGINT AS ep FROM orders""")
def sql_datetime(spark, sf_dir):
    sql = """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS mon, date_format(last_day(o_orderdate), 'yyyy-MM-dd') AS ld,
    datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS dd, date_format(o_orderdate + INTERVAL 3 MONTH, 'yyyy/MM/dd') AS plus, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS ep FROM orders"""
    return sqlx.run(spark, sql, {"orders": table(spark, sf_dir, "orders")})


CONDITIONAL = """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS c, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS n, if(c_acctbal > 0, 1, 0) AS i,
greatest(c_custkey, 50) AS g, least(c_custkey, 50) AS l, c_mktsegment IS DISTINCT FROM 'MACHINERY' AS d FROM customer"""


@query(CONDITIONAL)
def sql_conditional(spark, sf_dir):
    return sqlx.run(spark, CONDITIONAL, {"customer": table(spark, sf_dir, "customer")})


@query("""WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(q)::INTEGER AS n, q[2] AS second, array_to_string(list_transform(list_reverse(q), lambda x: x::INTEGER), ',') AS rev, list_contains(q, 10.0) AS has FROM a""")
def sql_array(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    sql = "SELECT l_orderkey, cardinality(q) AS n, try_element_at(q, 2) AS second, array_to_string(transform(reverse(q), x -> CAST(CAST(x AS INT) AS STRING)), ',') AS rev, array_contains(q, 10D) AS has FROM arrays"
    return sqlx.run(spark, sql, {"arrays": rows})


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events""")
def sql_json(spark, sf_dir):
    return sqlx.run(spark, "SELECT event_id, get_json_object(props, '$.k') AS k, try_parse_json(props) IS NOT NULL AS ok FROM events", {"events": table(spark, sf_dir, "events")})


@query("""SELECT c_nationkey, greatest(max(c_custkey), 100)::BIGINT AS g, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segs, count(DISTINCT c_mktsegment) AS n,
list_has_all(list(DISTINCT c_mktsegment), ['BUILDING', 'MACHINERY']) AS both_segs FROM customer GROUP BY 1""")
def mdt_functions(spark, sf_dir):
    sql = """SELECT c_nationkey, mdt_greatest_int64(max(c_custkey), 100) AS g, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segs, count(DISTINCT c_mktsegment) AS n,
    mdt_contains_all_string(collect_set(c_mktsegment), array('BUILDING', 'MACHINERY')) AS both_segs FROM customer GROUP BY 1"""
    return sqlx.run(spark, sql, {"customer": table(spark, sf_dir, "customer")})


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS b, count(*) AS n FROM events GROUP BY 1")
def time_bucket(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_format(arrays.time_bucket(F.col(TIME), 6 * 3600 * 1000), "yyyy-MM-dd HH").alias("b")).agg(F.count(F.lit(1)).alias("n"))


# --- sequences -----------------------------------------------------------------------------------------------------


def nearest_second(ts: Column) -> Column:
    """Halves to the even second."""
    return F.rint(F.unix_micros(ts) / 1e6).cast("long")


def histories(spark: SparkSession, sf_dir: str, seconds: Callable[[Column], Column] = F.unix_seconds) -> DataFrame:
    """user_id and its events in order, array<struct<t, event_id, event_type, value>>, t in seconds (the second begun)."""
    item = F.struct(seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type", "value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))


@query("""WITH o AS (SELECT user_id, value, row_number() OVER w AS i, value - lag(value) OVER w AS d, sum(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(coalesce(sum(abs(d)), 0), 4) AS moved, round(sum(c), 4) AS cums FROM o GROUP BY 1""")
def arr_difference_cumsum(spark, sf_dir):
    xs = F.transform("rows", lambda x: x["value"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    return histories(spark, sf_dir).select("user_id", r(total(arrays.difference(xs)), 4).alias("moved"), r(F.aggregate(arrays.cum_sum(xs), F.lit(0.0), lambda s, x: s + x), 4).alias("cums"))


@query("""WITH o AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) FILTER (p IS NULL OR p <> event_type)::INTEGER AS runs, count(DISTINCT event_type)::INTEGER AS kinds FROM o GROUP BY 1""")
def arr_compact_distinct(spark, sf_dir):
    kinds = F.transform("rows", lambda x: x["event_type"])
    return histories(spark, sf_dir).select("user_id", F.size(arrays.compact(kinds)).alias("runs"), F.size(F.array_distinct(kinds)).alias("kinds"))


@query("""WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, round(sum(value) FILTER (i BETWEEN 2 AND 5), 6) AS s, round(max(value) FILTER (i BETWEEN 2 AND 5), 6) AS m, (count(value) FILTER (i BETWEEN 2 AND 5))::DOUBLE AS n FROM o GROUP BY 1""")
def seq_collect_fold(spark, sf_dir):
    fold = lambda op: seq.seq_fold(F.col("rows"), 2, 5, "value", op)
    return histories(spark, sf_dir).select("user_id", r(fold("sum")).alias("s"), r(fold("max")).alias("m"), fold("count").alias("n"))


@query("""WITH o AS (SELECT user_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS gap FROM events)
SELECT user_id, (1 + count(*) FILTER (gap > 86400))::INTEGER AS sessions FROM o GROUP BY 1""")
def seq_split(spark, sf_dir):
    return histories(spark, sf_dir, nearest_second).select("user_id", F.size(seq.seq_split(F.col("rows"), "t", 86400)).alias("sessions"))


def is_type(kind: str) -> Callable[[Column], Column]:
    return lambda row: row["event_type"] == kind


@query("SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS b, bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS c FROM events GROUP BY 1")
def seq_retention(spark, sf_dir):
    got = seq.seq_retention(F.col("rows"), [is_type(k) for k in ("view", "click", "purchase")])
    return histories(spark, sf_dir).select("user_id", got.alias("g")).select("user_id", *[F.get("g", F.lit(i)).alias(n) for i, n in enumerate("abc")])


#: A user's events in the order of histories(), for folds by recursion.
FOLD = """WITH RECURSIVE o AS (SELECT user_id, event_type AS e, value AS x, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
"""


@query(
    FOLD
    + """s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, 0 AS best FROM o UNION ALL
SELECT o.user_id, o.i, CASE WHEN e = 'view' THEN greatest(a, t) ELSE a END, CASE WHEN e = 'click' AND t - a <= 604800 THEN greatest(b, a) ELSE b END, CASE WHEN e = 'purchase' AND t - b <= 604800 THEN greatest(c, b) ELSE c END,
greatest(best, CASE WHEN e = 'view' THEN 1 WHEN e = 'click' AND t - a <= 604800 THEN 2 WHEN e = 'purchase' AND t - b <= 604800 THEN 3 ELSE 0 END) FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT user_id, max(best)::INTEGER AS step FROM s GROUP BY 1"""
)
def seq_funnel(spark, sf_dir):
    return histories(spark, sf_dir).select("user_id", seq.seq_funnel(F.col("rows"), "t", 86400 * 7, [is_type(k) for k in ("view", "click", "purchase")]).alias("step"))


UP = {"UP": "$value > PREV($value)"}
NAMES = ["t", "event_id", "event_type", "value"]


@query()
def seq_match(spark, sf_dir):
    got = seq.seq_match("STRT UP{2,}", UP, NAMES)(F.col("rows"))
    return histories(spark, sf_dir).select("user_id", F.explode(got).alias("m")).select("user_id", "m.*")


@query()
def seq_match_steps(spark, sf_dir):
    got = seq.seq_match_steps("STRT UP{2,}", UP, NAMES)(F.col("rows"))
    return histories(spark, sf_dir).select("user_id", F.explode(got).alias("m")).select("user_id", "m.*")


@query(
    FOLD
    + """s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::DOUBLE AS mean, 0::DOUBLE AS cum, 0::DOUBLE AS low, 0::DOUBLE AS high, 0::DOUBLE AS up, 0::DOUBLE AS down FROM o UNION ALL
SELECT user_id, i, m, z, least(low, z), greatest(high, z), u, d FROM (SELECT o.user_id, o.i, mean + (x - mean) / o.i AS m, cum + x - (mean + (x - mean) / o.i) - 1 AS z, low, high, greatest(0, up + x - 55) AS u, greatest(0, down + 45 - x) AS d FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1))
SELECT user_id, coalesce(min(i) FILTER (cum - low > 100 OR high - cum > 100), 0)::INTEGER AS page_hinkley, coalesce(min(i) FILTER (up > 100 OR down > 100), 0)::INTEGER AS cusum FROM s GROUP BY 1"""
)
def seq_drift(spark, sf_dir):
    xs = F.transform("rows", lambda x: x["value"])
    return histories(spark, sf_dir).select("user_id", seq.seq_page_hinkley(xs, 1.0, 100.0).alias("page_hinkley"), seq.seq_cusum(xs, 50.0, 5.0, 100.0).alias("cusum"))


@query(
    FOLD
    + """s AS (SELECT user_id, i, x::DOUBLE AS e, x::DOUBLE AS l, NULL::DOUBLE AS d FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.i, 0.3::DOUBLE * x + 0.7::DOUBLE * s.e, CASE WHEN o.i = 2 THEN x ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * (l + d) END,
CASE WHEN o.i = 2 THEN x - l ELSE 0.1::DOUBLE * (0.3::DOUBLE * x + 0.7::DOUBLE * (l + d) - l) + 0.9::DOUBLE * d END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT user_id, round(arg_max(e, i), 6) AS smooth, round(arg_max(l + 2 * coalesce(d, 0), i), 6) AS holt FROM s GROUP BY 1"""
)
def seq_smooth(spark, sf_dir):
    xs = F.transform("rows", lambda x: x["value"])
    return histories(spark, sf_dir).select("user_id", r(seq.seq_exp_smooth(xs, 0.3)).alias("smooth"), r(seq.seq_holt(xs, 0.3, 0.1, 2)).alias("holt"))


# --- vectors -------------------------------------------------------------------------------------------------------


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def vec_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # One row by its key.
    seed = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("other")))
    return select(e.join(seed), [{"name": "vec_id"}, {"name": "sim", "func": "cosine_similarity", "left": "embedding", "right": "other"}]).withColumn("sim", r(F.col("sim")))


@query("SELECT vec_id, round(embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE, 5) AS x, round(sqrt((embedding[1]::DOUBLE - 0.1) ** 2 * 2 + (embedding[2]::DOUBLE) ** 2), 5) AS m FROM embeddings")
def mat_multiply_mahalanobis(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.slice("embedding", 1, 2))
    out = select(e, [{"name": "vec_id"}, {"name": "x", "func": "matrix_multiply", "matrix": [[1, 2], [0, 1]], "vector": "v"}, {"name": "m", "func": "mahalanobis", "field": "v", "mean": [0.1, 0], "precision": [[2, 0], [0, 1]]}])
    return out.select("vec_id", r(F.get("x", F.lit(0)), 5).alias("x"), r(F.col("m"), 5).alias("m"))


@query("""WITH o AS (SELECT user_id, value::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x FROM events), u AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id) AS u FROM o),
m AS (SELECT user_id, count(*) AS n, avg(x) AS m, sum(y) AS y, sum(u * u) AS uu, sum(u ** 4) AS u4, sum(u * y) AS uy, sum(u * u * y) AS uuy FROM u GROUP BY 1 HAVING count(*) > 2),
b AS (SELECT *, (uuy - uu * y / n) / (u4 - uu * uu / n) AS b2, uy / uu AS b1 FROM m)
SELECT user_id, round((y - b2 * uu) / n - b1 * m + b2 * m * m, 4) + 0.0::DOUBLE AS c0, round(b1 - 2 * b2 * m, 4) + 0.0::DOUBLE AS c1, round(b2, 4) + 0.0::DOUBLE AS c2 FROM b""")
def poly_fit(spark, sf_dir):
    fit = matrix.poly_fit(2)(F.transform("rows", lambda x: x["value"]), F.transform("rows", lambda x, i: i.cast("double")))
    return histories(spark, sf_dir).select("user_id", fit.alias("fit")).filter("fit IS NOT NULL").select("user_id", *[(r(F.get("fit", F.lit(i)), 4) + 0.0).alias(f"c{i}") for i in range(3)])


# --- event-time windows --------------------------------------------------------------------------------------------


def in_windows(spark: SparkSession, sf_dir: str, **strategy) -> DataFrame:
    out = events(spark, sf_dir).groupBy(assigned(ts=F.col(TIME), **strategy).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumble(spark, sf_dir):
    return in_windows(spark, sf_dir, kind="fixed", size=1, unit="hour")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(k::INTEGER), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, range(3) t(k) GROUP BY ALL""")
def hop(spark, sf_dir):
    return in_windows(spark, sf_dir, kind="sliding", size=3, unit="hour", period=1)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("user_id", assigned("session", F.col(TIME), gap=6, unit="hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def drained(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """All that a streaming query gives for the files that are there."""
    name = f"stream_{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as state:
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn(TIME, F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumble_watermark(spark, sf_dir):
    out = streams.windowed(event_stream(spark, sf_dir), TIME, {"kind": "fixed", "size": 1, "unit": "day"}, ["event_type"], [F.count(F.lit(1)).alias("n")], "1 hour")
    return drained(spark, out, "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    out = streams.dedup(event_stream(spark, sf_dir), TIME, ["user_id", "event_type"], "3650 days")
    return drained(spark, out.select("user_id", "event_type"), "append")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, count(*) AS n FROM orders GROUP BY 1")
def calendar_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(assigned("calendar", F.col("o_orderdate").cast("timestamp"), unit="month").cast("string").alias("m")).agg(F.count(F.lit(1)).alias("n"))


# --- change data, attribution, text --------------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 0")
def cdc_normalize_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = lambda kind, ts, status: F.to_json(F.struct(F.lit("db").alias("database"), F.lit("orders").alias("table"), F.lit(kind).alias("type"), F.lit(ts).cast("bigint").alias("ts"), F.lit(False).alias("isDdl"), F.array(F.lit("k")).alias("pkNames"), F.array(F.create_map(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("status"), status)).alias("data"))).alias("payload")
    envelopes = o.select(text("INSERT", 255, F.col("o_orderstatus"))).unionByName(o.filter("o_orderkey % 2 = 0").select(text("UPDATE", 4096, F.lit("S")))).unionByName(o.filter("o_orderkey % 3 = 0").select(text("DELETE", 65536, F.lit("D"))))
    return cdc.latest(cdc.from_canal(envelopes)).select(F.get_json_object("keys", "$.k").alias("k"), F.get_json_object("after", "$.status").alias("status"))


def periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Lines shipped in 1996 against 1995, with a change of one slice."""
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("y"), "l_extendedprice")
    hit = (F.col("line") == 2) & (F.col("y") == 1996)
    x = x.withColumn("sales", F.when(hit, F.col("l_extendedprice") * 3).otherwise(F.col("l_extendedprice")))
    return x.filter("y = 1996"), x.filter("y = 1995"), ["l_returnflag", "l_linestatus", "line"]


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, l_linenumber AS line, sum(CASE WHEN year(l_shipdate) = 1995 THEN l_extendedprice ELSE 0 END) AS f,
sum(CASE WHEN year(l_shipdate) = 1996 THEN l_extendedprice * (CASE WHEN l_linenumber = 2 THEN 3 ELSE 1 END) ELSE 0 END) AS v FROM lineitem WHERE year(l_shipdate) IN (1995, 1996) GROUP BY ALL),
c AS (SELECT grouping(l_returnflag) AS ga, grouping(l_linestatus) AS gb, grouping(line) AS gc, l_returnflag, l_linestatus, line, sum(f) AS f, sum(v) AS v FROM x GROUP BY CUBE (l_returnflag, l_linestatus, line) HAVING grouping(l_returnflag) + grouping(l_linestatus) + grouping(line) BETWEEN 1 AND 2)
SELECT concat_ws('&', CASE WHEN ga = 0 THEN 'l_returnflag=' || l_returnflag END, CASE WHEN gb = 0 THEN 'l_linestatus=' || l_linestatus END, CASE WHEN gc = 0 THEN 'line=' || line END) AS slice, (3 - ga - gb - gc)::INTEGER AS layer,
round(f, 2) AS f, round(v, 2) AS v, round((v - f) / (SELECT sum(v) - sum(f) FROM x), 6) AS ep FROM c WHERE (v - f) / (SELECT sum(v) - sum(f) FROM x) > 0 ORDER BY ep DESC, slice LIMIT 10""")
def attribution_exhaustive(spark, sf_dir):
    target, baseline, dims = periods(spark, sf_dir)
    out = attribution.exhaustive(attribution.leaves(target, baseline, dims, "sales"), dims, max_layer=2)
    return out.select("slice", "layer", r(F.col("f"), 2).alias("f"), r(F.col("v"), 2).alias("v"), r(F.col("ep")).alias("ep"))


@query()
def attribution_adtributor(spark, sf_dir):
    target, baseline, dims = periods(spark, sf_dir)
    return attribution.adtributor(attribution.leaves(target, baseline, dims, "sales"), dims)


@query()
def attribution_riskloc(spark, sf_dir):
    target, baseline, dims = periods(spark, sf_dir)
    return attribution.locate(attribution.leaves(target, baseline, dims, "sales"), dims)


@query()
def html_scrape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.scrape("title")(F.col("html")).alias("title"), html.scrape("a", "href")(F.col("html")).alias("link"))


@query("""SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) > 2 GROUP BY 1""")
def text_tokens(spark, sf_dir):
    """Lower-cased ASCII words of three letters or more, counted."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")
    return table(spark, sf_dir, "documents").select(words).filter(F.length("token") > 2).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT token, count(*) AS n FROM (SELECT unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS token FROM
(SELECT [t FOR t IN regexp_extract_all(lower(text), '[a-z]+') IF t NOT IN ('the', 'of')] AS w FROM documents)) GROUP BY 1""")
def text_shingles(spark, sf_dir):
    """Word pairs after a tokenizer, a case filter and a stop filter, counted."""
    filters = [{"type": "LowerCaseFilter"}, {"type": "StopFilter", "words": ["the", "of"]}, {"type": "ShingleFilter", "outputUnigrams": False}]
    pairs = text.analyzed(F.lower("text"), {"type": "SimplePatternTokenizer", "pattern": "[a-z]+"}, token_filters=filters)
    return table(spark, sf_dir, "documents").select(F.explode(pairs).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT *, coalesce(value > 10, false) AS keep, epoch_us(ts) + event_id AS t FROM events),
x AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS at FROM e)
SELECT a.event_id, 1 + count(b.event_id) AS n, round(coalesce(a.value, 0) + coalesce(sum(b.value), 0), 4) AS s FROM x a
LEFT JOIN x b ON b.user_id = a.user_id AND b.keep AND b.at <= a.at - a.keep::INT AND b.at > a.at - a.keep::INT - 4 AND b.t >= a.t - 86400000000
GROUP BY a.event_id, a.value""")
def buffer_history(spark, sf_dir):
    """Each event with the kept events of its user: five at most with itself, of the last day."""
    out = buffered(ordered(spark, sf_dir), ["user_id"], max_count=5, max_seconds=86400, buffer_filter="value > 10", fields=["value"])
    total = F.aggregate("buffer", F.lit(0.0), lambda a, e: a + F.coalesce(e["value"], F.lit(0.0)))
    return out.select("event_id", F.size("buffer").cast("long").alias("n"), r(total, 4).alias("s"))


@query("SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 0")
def cdc_postgres_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("k")))

    def change(op: str, lsn: int, status: Column) -> Column:
        new = F.lit(None).cast("string") if op == "DELETE" else F.to_json(F.struct(status.alias("status")))
        return F.struct(F.lit("public").alias("schema"), F.lit("orders").alias("table"), F.lit(op).alias("op"), key.alias("keysJson"), F.lit(None).cast("string").alias("oldValuesJson"), new.alias("newValuesJson"), F.lit(lsn).alias("commitLsn"), F.col("o_orderdate").alias("commitTimestamp"), F.lit(0).alias("sequence"))

    # 9 < 16 as numbers, not as hexadecimal texts.
    rows = o.select(change("INSERT", 9, F.col("o_orderstatus")).alias("c")).unionByName(o.filter("o_orderkey % 2 = 0").select(change("UPDATE", 16, F.lit("S")).alias("c"))).unionByName(o.filter("o_orderkey % 3 = 0").select(change("DELETE", 255, F.lit("")).alias("c")))
    return cdc.latest(cdc.from_postgres(rows.select("c.*"))).select(F.get_json_object("keys", "$.k").alias("k"), F.get_json_object("after", "$.status").alias("status"))


@query("""SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL HAVING count(*) > 1""")
def agg_windowed_step(spark, sf_dir):
    """An aggregation step with a window strategy and a filter after it."""
    step = {"name": "w", "module": "aggregation", "strategy": {"window": {"type": "fixed", "size": 7, "unit": "day"}}, "parameters": {"groupFields": ["event_type"], "fields": [{"name": "n", "op": "count"}, {"name": "s", "op": "sum", "field": "value"}], "filter": "n > 1"}}
    out = runner.transform(spark, step, {"events": events(spark, sf_dir)})
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "event_type", "n", r(F.col("s"), 4).alias("s"))


# --- the SQL dialect -------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') AS digits, len(string_split(p_type, ' '))::INTEGER AS words, trunc(p_retailprice / 7 * 100) / 100 AS cut, CASE WHEN p_size % 3 = 0 THEN NULL ELSE greatest(p_size, 25) END AS top,
hex(encode(p_brand)) AS hex, xor(p_size, 5)::INTEGER AS bits, len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS vowels FROM part""")
def sql_dialect_text(spark, sf_dir):
    sql = """SELECT p_partkey, REGEXP_EXTRACT(p_brand, '#([0-9]+)') AS digits, ARRAY_LENGTH(SPLIT(p_type, ' ')) AS words, TRUNC(p_retailprice / 7, 2) AS cut, GREATEST(IF(MOD(p_size, 3) = 0, NULL, p_size), 25) AS top,
    UPPER(TO_HEX(p_brand)) AS hex, BITXOR(p_size, 5) AS bits, ARRAY_LENGTH(REGEXP_EXTRACT_ALL(p_name, '[aeiou]')) AS vowels FROM part"""
    return sqlx.run(spark, sql, {"part": table(spark, sf_dir, "part")})


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 QUARTER, '%Y-%m-%d') AS later, date_diff('month', DATE '1992-01-15', o_orderdate::DATE)::BIGINT AS months, date_sub('day', TIMESTAMP '1992-01-01', o_orderdate)::BIGINT AS days,
strftime(date_trunc('quarter', o_orderdate), '%d.%m.%Y') AS q, strftime(strptime('17.05.2024', '%d.%m.%Y'), '%Y-%m-%d') AS parsed FROM orders""")
def sql_dialect_dates(spark, sf_dir):
    sql = """SELECT o_orderkey, FORMAT_DATE('%Y-%m-%d', DATE_ADD(DATE(o_orderdate), INTERVAL 2 QUARTER)) AS later, DATE_DIFF(DATE(o_orderdate), DATE '1992-01-15', MONTH) AS months, DATETIME_DIFF(o_orderdate, DATETIME(1992, 1, 1, 0, 0, 0), DAY) AS days,
    FORMAT_DATETIME('%d.%m.%Y', DATETIME_TRUNC(o_orderdate, QUARTER)) AS q, FORMAT_DATE('%F', PARSE_DATE('%d.%m.%Y', '17.05.2024')) AS parsed FROM orders"""
    return sqlx.run(spark, sql, {"orders": table(spark, sf_dir, "orders")})


@query("""WITH o AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS bought, round(sum(CASE WHEN i BETWEEN 2 AND 5 THEN value END), 4) AS middle, max(CASE WHEN i = 3 THEN event_type END) AS third, count(*)::INTEGER AS n FROM o GROUP BY 1""")
def seq_sql(spark, sf_dir):
    """Sequence functions in per-record SQL over each user's history."""
    people = sqlx.run(spark, "SELECT user_id, transform(SEQ_COLLECT(named_struct('ts', ts, 'id', event_id), event_type, value), e -> named_struct('action', e.v1, 'value', e.v2)) AS s FROM events GROUP BY user_id", {"events": table(spark, sf_dir, "events")})
    sql = """SELECT SEQ_RETENTION(s, 'action,value', "$action = 'view'; $action = 'purchase'")[2] AS bought, round(SEQ_FOLD(s, 2, 5, 'value', 'sum'), 4) AS middle, s[3].action AS third, CARDINALITY(s) AS n FROM INPUT"""
    return sqlx.per_record(spark, sql, people, keep=["user_id"])


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b0, round(regr_slope(l_extendedprice, l_quantity), 2) AS b1 FROM lineitem GROUP BY 1")
def linear_reg_sql(spark, sf_dir):
    fits = sqlx.run(spark, "SELECT l_returnflag, LINEAR_REG(l_extendedprice, ARRAY[l_quantity]) AS m FROM lineitem GROUP BY l_returnflag", {"lineitem": table(spark, sf_dir, "lineitem")})
    return sqlx.per_record(spark, "SELECT round(m[1], 2) AS b0, round(m[2], 2) AS b1 FROM INPUT", fits, keep=["l_returnflag"])


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL""")
def sql_tumble(spark, sf_dir):
    sql = "SELECT DATE_FORMAT(TUMBLE_START(ts, INTERVAL '6' HOUR), 'yyyy-MM-dd HH') AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY TUMBLE(ts, INTERVAL '6' HOUR), event_type"
    return sqlx.run(spark, sql, {"events": table(spark, sf_dir, "events")})


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(k::INTEGER), '%Y-%m-%d') AS start, strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(k::INTEGER - 2), '%Y-%m-%d') AS stop, count(*) AS n FROM events, range(2) t(k) GROUP BY ALL""")
def sql_hop(spark, sf_dir):
    hop = "(ts, INTERVAL '1' DAY, INTERVAL '2' DAY)"
    sql = f"SELECT DATE_FORMAT(HOP_START{hop}, 'yyyy-MM-dd') AS start, DATE_FORMAT(HOP_END{hop}, 'yyyy-MM-dd') AS stop, count(*) AS n FROM events GROUP BY HOP{hop}"
    return sqlx.run(spark, sql, {"events": table(spark, sf_dir, "events")})


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def sql_session(spark, sf_dir):
    gap = "(ts, INTERVAL 6 HOUR)"
    sql = f"SELECT user_id, DATE_FORMAT(SESSION_START{gap}, 'yyyy-MM-dd HH:mm:ss') AS start, DATE_FORMAT(SESSION_END{gap}, 'yyyy-MM-dd HH:mm:ss') AS stop, count(*) AS n FROM events GROUP BY user_id, SESSION{gap}"
    return sqlx.run(spark, sql, {"events": table(spark, sf_dir, "events")})


QUALIFIED = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 3 UNION ALL SELECT user_id, count(*), 0 FROM events GROUP BY user_id QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5"


@query(QUALIFIED)
def sql_qualify(spark, sf_dir):
    return sqlx.run(spark, QUALIFIED, {"events": table(spark, sf_dir, "events")})


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(1, len(string_split(p_name, ' ')) + 1))::INTEGER AS place FROM part")
def sql_unnest_ordinality(spark, sf_dir):
    return sqlx.run(spark, "SELECT p_partkey, w.word, w.place FROM part, UNNEST(SPLIT(p_name, ' ')) WITH ORDINALITY AS w(word, place)", {"part": table(spark, sf_dir, "part")})


@query("""SELECT event_id, floor(epoch_us(ts) / 86400e6) AS day, floor((epoch_us(ts) - 1704067200000000) / 3.6e9) AS hours, floor((epoch_us(ts) - 1704067200000000) / 6e7) AS minutes, sign(value - 50)::DOUBLE AS side, round(cbrt(value), 6) AS root, round(log2(value + 1), 6) AS bits FROM events""")
def expr_timestamps_roots(spark, sf_dir):
    fields = [("day", "timestamp_to_date(ts)"), ("hours", "timestamp_diff_hour(ts, 1704067200000000)"), ("minutes", "timestamp_diff_minute(ts, 1704067200000000)"), ("side", "signum(value - 50)"), ("root", "cbrt(value)"), ("bits", "log2(value + 1)")]
    out = select(table(spark, sf_dir, "events"), [{"name": "event_id"}, *({"name": n, "expression": e} for n, e in fields)])
    return out.withColumn("root", r(F.col("root"))).withColumn("bits", r(F.col("bits")))
