import datetime
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import arrays, seq
from tidewater.functions.html import Finder, parsed
from tidewater.operators import attribution, cdc, routing, windows
from tidewater.operators.aggregate import aggregate
from tidewater.operators.select import select
from tidewater.plans import expr, runner, sqlx
from tidewater.plans.filters import FilterError, compile_filter
from tidewater.plans.schema import struct_type, types_of
from tidewater.sources import io
from tidewater.streaming import windows as streams


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


@pytest.fixture(scope="module")
def ten(spark):
    floats = [0.15, 1.15, 2.15, 2.15, 4.15, -5.15, -6.15, -7.15, -8.15, 0.0]
    rows = [(c, i + 1, floats[i], i % 2 == 0, at(i)) for i, c in enumerate("abcdefghij")]
    return spark.createDataFrame(rows, "s string, i int, f double, b boolean, __timestamp timestamp")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict(recursive=True)


def test_aggregates(ten):
    out = one(aggregate(ten, [{"name": "n", "op": "count"}, {"name": "i", "op": "sum"}, {"name": "top", "op": "max", "field": "f"}, {"name": "low", "op": "min", "field": "f"}, {"name": "arg", "op": "arg_max", "field": "s", "comparingField": "f"}, {"name": "last", "op": "last", "fields": ["s", "i"]}, {"name": "some", "op": "count", "condition": "i > 3 AND b = true"}, {"name": "any_b", "op": "sum", "field": "b"}, {"name": "text", "op": "sum", "field": "s"}, {"name": "var", "op": "std", "field": "i", "outputVar": True}]))
    assert (out["n"], out["i"], out["top"], out["low"], out["arg"]) == (10, 55, 4.15, -8.15, "e")
    assert out["last"] == {"s": "j", "i": 10} and out["some"] == 3 and out["any_b"] is True and out["text"] == "abcdefghij"
    assert math.isclose(out["var"], 55 / 6)


def test_aggregate_empty_and_nulls(spark):
    df = spark.createDataFrame([(None, None)], "x int, w double")
    out = one(aggregate(df, [{"name": "s", "op": "sum", "field": "x"}, {"name": "a", "op": "avg", "field": "x", "weightField": "w"}, {"name": "d", "op": "std", "field": "x"}, {"name": "l", "op": "array_agg", "field": "x", "order": "ascending"}, {"name": "r", "op": "simple_regression", "field": "x", "xField": "w"}]))
    assert out["s"] == 0 and out["a"] is None and out["d"] is None and out["l"] == [None] and out["r"]["N"] == 0


def test_regression(spark):
    df = spark.createDataFrame([(float(x), float(z), 2.0 + 3 * x - z) for x in range(5) for z in range(4)], "x double, z double, y double")
    out = one(aggregate(df, [{"name": "g", "op": "regression", "field": "y", "xFields": ["x", "z"]}]))["g"]
    assert [round(c, 6) for c in out["Coefficients"]] == [2, 3, -1] and out["RMSE"] < 1e-6 and out["N"] == 20


VALUES = {"=": (True, False), "!=": (False, True), ">": (False, True), ">=": (True, True), "<": (False, False), "<=": (True, False)}


@pytest.mark.parametrize("op", VALUES)
def test_predicate_table(spark, op):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (None, None), (float("nan"), 1), (float("inf"), 1)], "x double, i int")
    c = compile_filter({"key": "x", "op": op, "value": 1}, types_of(df))
    assert [r[0] for r in df.select(c).collect()] == [*VALUES[op], False, False, False]
    c = compile_filter({"key": "i", "op": op, "value": None}, types_of(df))
    assert [r[0] for r in df.select(c).collect()][:3] == [op == "!=", op == "!=", op == "="]


@pytest.mark.parametrize(
    "text, want",
    [
        ("i > 2 AND NOT (s LIKE 'c%' OR i = 4)", "efghij"), ("i IN (1, 3) OR s NOT IN ('a','b','c','d','e','f','g','h','i')", "acj"), ("i BETWEEN 2 AND 3", "bc"), ("i NOT BETWEEN 2 AND 9", "aj"),
        ("i * 2 + 1 > 17 AND f IS NOT NULL", "ij"), ("NOT b", "bdfhj"), ("b IS TRUE AND (i + 1) / 2 <= 2", "ac"), ("s = 'it''s' OR s >= 'i'", "ij"), ("f > i", ""), ("-5 < f AND f < 0", ""),
    ],
)
def test_sql_filters(ten, text, want):
    assert "".join(r["s"] for r in ten.filter(compile_filter(text, types_of(ten))).orderBy("i").collect()) == want


@pytest.mark.parametrize("text", ["1 = 1", "x > 1", "s LIKE 'a' ESCAPE 'b'", "NOT (b IS TRUE)", "i >", "i BETWEEN 1"])
def test_sql_filter_errors(ten, text):
    with pytest.raises(FilterError):
        compile_filter(text, types_of(ten))


@settings(max_examples=25, deadline=None)
@given(st.recursive(st.one_of(st.integers(0, 9).map(str), st.sampled_from(["i", "f"])), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=6))
def test_expressions_equal_python(spark, text):
    df = spark.createDataFrame([(3, -1.5)], "i int, f double")
    assert math.isclose(df.select(expr.compile_expression(text, types_of(df))).first()[0], eval(text, {"i": 3.0, "f": -1.5}), abs_tol=1e-9)


def test_expression_language(ten):
    got = lambda e: ten.filter("i = 3").select(expr.compile_expression(e, types_of(ten))).first()[0]
    assert got("i > 2 && b ? pow(i, 2) : 0") == 9 and got("switch3(i = 1, 5, i = 3, 7)") == 7 and got("max(i, 2) % 2 + cbrt(8)") == 3
    assert got("0 / 0") is None and got("!(i = 3) || 1 < 2") == 1 and got("timestamp_diff_second(__timestamp, 0)") == at(2).replace(tzinfo=datetime.UTC).timestamp()
    with pytest.raises(expr.ExpressionError):
        expr.compile_expression("nope + 1", types_of(ten))


def test_select(ten):
    out = select(ten, [{"name": "k", "field": "s"}, {"name": "two", "expression": "i * 2", "type": "int32"}, {"name": "m", "func": "replace", "field": "s", "mapping": {"a": "A"}}, {"name": "h", "func": "hash", "field": "s", "algorithm": "HmacSHA256", "secret": "key"}, {"name": "t", "text": "${s}-${i}!"}, {"name": "g", "func": "generate", "from": 0, "to": "i"}, {"name": "c", "func": "switch", "cases": [{"condition": "i > 1", "value": "more"}], "default": "one"}], filter="i <= 2").orderBy("k").collect()
    import hashlib
    import hmac

    assert [r["two"] for r in out] == [2, 4] and [r["m"] for r in out] == ["A", None] and out[1]["t"] == "b-2!" and out[1]["g"] == [0, 1] and out[0]["c"] == "one"
    assert out[0]["h"] == hmac.new(b"key", b"a", hashlib.sha256).hexdigest()


def test_stateful_select(ten):
    out = select(ten.withColumn("g", F.lit(1)), [{"name": "i"}, {"name": "s3", "func": "sum", "field": "i", "range": {"count": 3}}, {"name": "d", "func": "lag", "expression": "i - i[2]"}, {"name": "n", "func": "count", "range": {"duration": 2}, "condition": "b = true"}], group_fields=["g"]).orderBy("i").collect()
    assert [r["s3"] for r in out][:4] == [1, 3, 6, 9] and [r["d"] for r in out][:3] == [None, None, 2.0] and [r["n"] for r in out][:4] == [1, 1, 2, 1]


def test_flatten_and_union(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None)], "k string, v array<int>")
    assert sorted((r["k"], r["v"] or 0) for r in select(df, [{"name": "k"}, {"name": "v"}], flatten="v").collect()) == [("a", 1), ("a", 2), ("b", 0), ("c", 0)]
    a, b = spark.createDataFrame([("x", 1)], "k string, p long"), spark.createDataFrame([("y", 2.5)], "k string, q double")
    assert [tuple(r) for r in routing.union({"a": a, "b": b}).orderBy("k").collect()] == [("x", 1, None, "a"), ("y", None, 2.5, "b")]
    mapped = routing.union({"a": a, "b": b}, [{"outputField": "z", "inputs": [{"input": "a", "field": "k"}, {"input": "b", "field": "k"}]}], tagged=False)
    assert sorted(r["z"] for r in mapped.collect()) == ["x", "y"]


def test_partition_and_compare(ten, spark):
    parts = routing.partition(ten, [{"name": "low", "filter": "i < 4"}, {"name": "even", "filter": "b = false"}, {"name": "none"}])
    assert {k: v.count() for k, v in parts.items()} == {"low": 3, "even": 4, "none": 0, "excluded": 3}
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y"), ("3", None), ("5", "q")], "id string, c string")
    b = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "n"), ("4", "z"), ("5", "q")], "id string, c string")
    got = {r["id"]: r for r in routing.compare({"a": a, "b": b}, ["id"]).collect()}
    assert set(got) == {"2", "3", "4"} and got["2"]["duplicatedInputs"] == ["a"] and got["4"]["missingInputs"] == ["a"] and got["3"]["differences"][0]["field"] == "c"


def rows_of(*amounts):
    return [{"seq": i + 1, "amount": x} for i, x in enumerate(amounts)]


UP = {"UP": "$amount > PREV($amount)"}
HML = {"H": "$amount >= 100", "L": "$amount <= 10", "M": "$amount > 10 AND $amount < 100"}


@pytest.mark.parametrize(
    "amounts, pattern, define, want",
    [
        ((10, 20, 30, 5, 8, 40), "STRT UP{2,}", UP, [[1, 3], [4, 6]]), ((1, 2, 3, 4, 5), "STRT UP{2,}", UP, [[1, 5]]), ((1, 2, 1, 2), "UP+", UP, [[2, 2], [4, 4]]), ((5, 1, 2, 3, 0), "UP{1,2}", UP, [[3, 4]]),
        ((100, 50, 1), "(H|L) M?", HML, [[1, 2], [3, 3]]), ((10, 11, 25, 9), "JUMP", {"JUMP": "$amount > PREV($amount,2)*2"}, [[3, 3]]), ((1, 5), "BIG", {"BIG": "$1 >= 5"}, [[2, 2]]), ((10, None, 20), "UP", UP, []),
    ],
)
def test_pattern_cases(amounts, pattern, define, want):
    assert [[a + 1, b] for a, b, _ in seq.matcher(pattern, define, ["seq", "amount"])(rows_of(*amounts))] == want


def test_pattern_modes_and_errors():
    run = lambda mode: [[a + 1, b] for a, b, _ in seq.matcher("UP+", UP, ["seq", "amount"], mode)(rows_of(1, 2, 3))]
    assert run("shortest") == [[2, 2], [3, 3]] and run("all") == [[2, 2], [2, 3], [3, 3]] and run("overlap") == [[2, 3], [3, 3]]
    for bad in ("UP{3,1}", "UP)", "(UP"):
        with pytest.raises(seq.PatternError):
            seq.matcher(bad, UP, ["amount"])
    with pytest.raises(seq.PatternError):
        seq.matcher("UP", {"UP": "$nope > 1"}, ["amount"])


def test_sequence_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0, 40.0],)], "x array<double>")
    x = F.col("x")
    rows = F.transform(x, lambda v, i: F.struct(i.alias("t"), v.alias("v")))
    first = lambda c: df.select(c).first()[0]
    assert first(arrays.difference(x)) == [0, 1, None, None, 36] and first(arrays.cum_sum(x)) == [1, 3, 3, 7, 47]
    assert first(seq.seq_fold(rows, 0, 9, "v", "avg")) == 47 / 4 and first(seq.seq_fold(rows, 3, 3, "v", "sum")) is None and first(seq.seq_fold(rows, 3, 3, "v", "count")) == 0
    assert [len(s) for s in first(seq.seq_split(rows, "v", 5.0))] == [2, 1, 1, 1]
    assert first(seq.seq_exp_smooth(x, 0.5)) == ((1.5 + 4) / 2 + 40) / 2
    level, trend = 2.0, 1.0
    for v in (4.0, 40.0):
        new = 0.5 * v + 0.5 * (level + trend)
        level, trend = new, 0.5 * (new - level) + 0.5 * trend
    assert math.isclose(first(seq.seq_holt(x, 0.5, 0.5, 2)), level + 2 * trend)
    assert first(seq.seq_cusum(x, 2.0, 0.5, 10.0)) == 5 and first(seq.seq_page_hinkley(x, 0.1, 20.0)) == 5
    big = lambda r: r["v"] > 3
    small = lambda r: r["v"] < 3
    assert first(seq.seq_funnel(rows, "t", 3.0, [small, big])) == 2 and first(seq.seq_funnel(rows, "t", 1.0, [small, big])) == 1
    assert first(seq.seq_retention(rows, [small, big])) == [True, True]


def test_cdc(spark):
    payloads = [
        '{"database":"d","table":"t","type":"INSERT","ts":16,"isDdl":false,"pkNames":["id"],"data":[{"id":"1","v":"a"},{"id":"2","v":"b"}]}',
        '{"database":"d","table":"t","type":"UPDATE","ts":255,"isDdl":false,"pkNames":["id"],"data":[{"id":"1","v":"z"}],"old":[{"v":"a"}]}',
        '{"database":"d","table":"t","type":"DELETE","ts":4096,"isDdl":false,"pkNames":["id"],"data":[{"id":"2","v":"b"}]}', '{"type":"CREATE","isDdl":true}', "broken",
    ]
    out = cdc.from_canal(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    rows = out.collect()
    assert sorted(r["op"] for r in rows) == ["DELETE", "INSERT", "INSERT", "UPDATE"]
    assert next(r["before"] for r in rows if r["op"] == "UPDATE").count('"a"') == 1
    assert [(r["keys"], r["after"]) for r in cdc.latest(out).collect()] == [('{"id":"1"}', '{"id":"1","v":"z"}')]


def test_attribution(spark):
    kind = "region string, category string, sales double"
    base = [(r, c, 100.0) for r in "abc" for c in "xy"]
    target = [(r, c, s * 3 if r == "a" else s) for r, c, s in base]
    leaves = attribution.leaves(spark.createDataFrame(target, kind), spark.createDataFrame(base, kind), ["region", "category"], "sales")
    top = attribution.locate(leaves, ["region", "category"]).collect()
    assert [(r["slice"], r["layer"], r["f"], r["v"]) for r in top] == [("region=a", 1, 200.0, 600.0)]
    assert attribution.exhaustive(leaves, ["region", "category"]).first()["slice"] == "region=a"
    assert attribution.adtributor(leaves, ["region", "category"]).first()["slice_values"] == "a"


def plain_causes(leaves, risk=0.5, pep=0.02, layers=3, top=3):
    """leaves: (values, f, v) -> the slices, {dimension: value}, that the search by risk finds, and their powers."""
    change = sum(v for _, _, v in leaves) - sum(f for _, f, _ in leaves)
    if not leaves or not change:
        return []
    dev = [0.0 if f + v == 0 else 2 * (f - v) / (f + v) for _, f, v in leaves]
    u = sorted(set(dev))
    low, high = (u[5] if len(u) > 5 else u[-1]), (u[-6] if len(u) > 5 else u[0])
    cut = -low if abs(low) <= abs(high) else -high
    right = math.copysign(1, cut) > 0
    odd = [x > cut if right else x < cut for x in dev]
    if not any(odd):
        up, down = sum(x for x in dev if x > 0), -sum(x for x in dev if x < 0)
        if up or down:
            cut, odd = 0.0, [x > 0 if up > down else x < 0 for x in dev]
    weight = [min(1, abs(x)) if o else 0 if f == v == 0 else min(1, abs(cut - x)) for x, o, (_, f, v) in zip(dev, odd, leaves)]
    power = [(v - f) / change for _, f, v in leaves]
    if sum(p for p, o in zip(power, odd) if o) < 0:
        power = [-p for p in power]
    least = pep * sum(p for p, o in zip(power, odd) if o)
    alive, out = set(range(len(leaves))), []
    while len(out) < top and sum(power[i] for i in alive if odd[i]) >= least:
        best = None
        for layer in range(1, min(layers, len(leaves[0][0])) + 1):
            for dims in itertools.combinations(range(len(leaves[0][0])), layer):
                slices = {}
                for i in sorted(alive):
                    slices.setdefault(tuple(leaves[i][0][d] for d in dims), []).append(i)
                for values, rows in sorted(slices.items(), key=lambda x: (-sum(power[i] for i in x[1]), x[0])):
                    own = sum(power[i] for i in rows)
                    if own <= (best[1] if best else least) or not any(odd[i] for i in rows):
                        continue
                    hit, rest = sum(weight[i] for i in rows if odd[i]), sum(weight[i] for i in rows if not odd[i])
                    both = [i for i in rows if leaves[i][1] and leaves[i][2]]
                    even, base = 0.0, sum(abs(dev[i]) for i in both)
                    for i in both:
                        a = leaves[i][1] * sum(leaves[j][2] for j in both) / sum(leaves[j][1] for j in both)
                        even += abs(2 * (a - leaves[i][2]) / (a + leaves[i][2]))
                    if hit / (hit + 1 + rest) - (even / base if base else 0) >= risk:
                        best = (dict(zip(dims, values)), own, rows)
                        break
            if best:
                break
        if not best:
            break
        out.append((best[0], round(best[1], 9)))
        alive -= set(best[2])
    return out


def test_causes_against_plain_search():
    rng = random.Random(4)
    found = 0
    for case in range(60):
        shape = [rng.randrange(2, 5) for _ in range(rng.randrange(1, 4))]
        hit = {d: rng.randrange(n) for d, n in enumerate(shape) if rng.random() < 0.6}
        leaves = []
        for values in itertools.product(*map(range, shape)):
            f = rng.choice([0.0, 10.0, 20.0, 50.0])
            v = f * (rng.choice([0.5, 3.0]) if case % 3 == 0 and rng.random() < 0.3 else 1.0)
            if all(values[d] == x for d, x in hit.items()):
                v = f * (3 if case % 2 else 0.25) if f else rng.choice([0.0, 5.0])
            leaves.append((values, f, v))
        if case == 7:
            leaves = [(x, f, f) for x, f, _ in leaves]
        codes = np.array([x for x, _, _ in leaves])
        got = attribution.riskloc(codes, shape, np.array([f for _, f, _ in leaves]), np.array([v for _, _, v in leaves]))
        want = plain_causes(leaves)
        found += len(want)
        assert [(dict(zip(dims, values)), round(ep, 9)) for dims, values, _, ep in got] == want
    assert found > 20
    assert attribution.cut_point(np.array([-0.5, -0.3, 0.3, 0.5])) == -0.5


def test_limit_keeps_groups(spark):
    rows = spark.createDataFrame([(k, f"2024-01-0{d} 00:00:00") for k in "abc" for d in (1, 2, 3)], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    fields = [{"name": "n", "op": "count"}]
    assert aggregate(rows, fields, ["k"], limit=1).count() == 3
    window = windows.assigned("fixed", F.col("t"), 1, "day")
    got = aggregate(rows, fields, ["k"], limit=2, window=window).select("k", F.dayofmonth("window.start").alias("d")).collect()
    assert sorted(map(tuple, got)) == [(k, d) for k in "abc" for d in (1, 2)]
    assert aggregate(rows, fields, limit=2, window=window).count() == 2


def test_attribution_parameters(spark):
    kind = "region string, category string, sales double"
    base = spark.createDataFrame([(r, c, 100.0) for r in "abcdefghijklm" for c in "xy"], kind)
    target = base.withColumn("sales", F.col("sales") * F.when(F.col("region") < "l", 3).otherwise(1))

    def step(**p):
        t = {"name": "a", "module": "attribution", "parameters": {"target": "t", "baseline": "b", "dimensions": ["region", "category"], "measure": "sales", **p}}
        return runner.transform(spark, t, {"t": target, "b": base}).collect()

    assert len(step(algorithm="exhaustive")) == 10
    assert len(step(engine={"algorithm": "exhaustive", "guards": {"maxLayer": 1}}, output={"topK": 20})) == 13 and {r["layer"] for r in step(engine={"algorithm": "exhaustive", "guards": {"maxLayer": 1}})} == {1}
    assert len(step()) == 2 and len(step(output={"topK": 1})) == 1 and step(engine={"riskloc": {"riskThreshold": 0.99}}) == []
    assert step(engine={"algorithm": "adtributor", "adtributor": {"teep": 0.6}}) == [] != step(algorithm="adtributor")
    for bad in ({"engine": {"algorithm": "squeeze"}}, {"engine": {"guards": {"minSupport": 0.1}}}, {"semantics": {}}, {"output": {"format": "x"}}, {"engine": {"riskloc": {"pruningLayers": 2}}}):
        with pytest.raises(io.NotSupportedError):
            step(**bad)
    with pytest.raises(runner.ConfigError):
        step(output={"topK": 0})


def test_sql_modules(spark):
    users = spark.createDataFrame([(1, [3, 4]), (2, [])], "user_id int, xs array<int>")
    got = sqlx.per_record(spark, "SELECT count(*) AS n, sum(x) AS s FROM INPUT, LATERAL explode(INPUT.xs) AS t(x)", users, keep=["user_id"]).orderBy("user_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 7), (2, 0, None)]
    assert sqlx.run(spark, "SELECT safe_divide(1, 0) AS a, strpos('hello', 'l') AS b, contains_substr('Hello', 'ELL') AS c, :p AS d", {}, {"p": 5}).first()[:] == (None, 3, True, 5)


def test_runner(spark, tmp_path):
    config = """
sources:
  - {name: nums, module: create, parameters: {from: 0, to: 10}}
transforms:
  - {name: parts, module: partition, input: nums, parameters: {partitions: [{name: small, filter: "value < ${args.cut}"}]}}
  - {name: total, module: aggregation, input: parts.small, parameters: {fields: [{name: s, op: sum, field: value}]}}
sinks:
  - {name: out, module: storage, input: "parts.*", parameters: {output: "%s/${input.tag}", format: json}}
""" % tmp_path
    done = runner.run(spark, runner.load(config, {"cut": 4}))
    assert done["total"].first()["s"] == 6 and spark.read.json(f"{tmp_path}/excluded").count() == 6
    with pytest.raises(runner.ConfigError):
        runner.build(spark, {"transforms": [{"name": "a", "module": "filter", "input": "b"}]})
    with pytest.raises(io.NotSupportedError):
        io.write(done["total"], "nowhere", {})


def test_schema_round_trip(spark):
    kind = struct_type([{"name": "a", "type": "int64", "mode": "required"}, {"name": "b", "type": "string", "mode": "repeated"}, {"name": "c", "type": "record", "fields": [{"name": "d", "type": "decimal"}, {"name": "e", "type": "map", "valueType": "double"}]}, {"name": "t", "type": "timestamp"}, {"name": "u", "type": "uuid"}])
    assert kind.simpleString() == "struct<a:bigint,b:array<string>,c:struct<d:decimal(38,9),e:map<string,double>>,t:timestamp,u:string>" and not kind["a"].nullable and kind["u"].metadata == {"logical": "uuid"}


def test_html():
    finder = Finder(parsed("div.main a[href]"))
    finder.feed('<a href="no">x</a><div class="top main"><p><a href="yes">two <b>words</b></a></p></div>')
    assert [(h["attrs"]["href"], "".join(h["text"])) for h in finder.found] == [("yes", "two words")]


def test_streams(spark, tmp_path):
    rows = [(i % 3, at(i * 60)) for i in range(30)]
    spark.createDataFrame(rows, "k int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, ts timestamp").parquet(f"{tmp_path}/in")

    def drained(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = drained(streams.windowed(stream, "ts", {"kind": "fixed", "size": 10, "unit": "minute"}, ["k"], [F.count(F.lit(1)).alias("n")], "1 minute"), "complete", "w")
    assert sum(r["n"] for r in got) == 30 and len(got) == 9
    assert sorted(r["k"] for r in drained(streams.limited(stream, "k", 2, "k int, ts timestamp"), "append", "l")) == [0, 0, 1, 1, 2, 2]
