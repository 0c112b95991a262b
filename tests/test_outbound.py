import datetime
import http.server
import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import cdc
from tidewater.operators import select as selects
from tidewater.operators.buffer import buffered
from tidewater.plans import runner
from tidewater.sources import io, outbound


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def brute(rows, key, count, seconds, current, keep, dedup):
    """rows (key, id, second, x) in order of time."""
    out = {}
    for i, r in enumerate(rows):
        past = [] if r[0] is None else [q for q in rows[:i] if q[0] == r[0] and keep(q)]
        seen = past + ([r] if current else [])
        if seconds is not None:
            seen = [q for q in seen if q[2] >= r[2] - seconds]
        if count is not None:
            seen = seen[max(0, len(seen) - count) :]
        if dedup:
            seen = [q for j, q in enumerate(seen) if q[3] not in [z[3] for z in seen[:j]]]
        out[r[1]] = [q[1] for q in seen]
    return out


@pytest.mark.parametrize("count, seconds, current, dedup", [(None, None, True, False), (2, None, True, False), (3, None, False, False), (None, 4, True, False), (None, 0, False, False), (2, 3, True, True), (None, None, False, True), (1, None, True, False)])
def test_buffer(spark, count, seconds, current, dedup):
    rows = [([None, "a", "b"][i * 7 % 3], i, i // 2, i * 5 % 4) for i in range(40)]
    df = spark.createDataFrame([(k, i, at(s), x) for k, i, s, x in rows], "k string, id int, __timestamp timestamp, x int")
    got = buffered(df, ["k"], count, seconds, current, "x > 0", None, ["x"] if dedup else None, order=["id"]).select("id", F.transform("buffer", lambda e: e["id"]).alias("b")).collect()
    assert {r["id"]: r["b"] for r in got} == brute(rows, "k", count, seconds, current, lambda q: q[3] > 0, dedup)
    some = buffered(df, ["k"], count, seconds, current, None, "x = 1", order=["id"])
    assert sorted(r["id"] for r in some.collect()) == [i for _, i, _, x in rows if x == 1]


def test_upsert(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    outbound.execute(spark, url, ["CREATE TABLE items (id INT PRIMARY KEY, v VARCHAR(10))", "INSERT INTO items VALUES (1, 'one'), (2, 'two')"])
    rows = lambda: sorted(tuple(r) for r in spark.read.format("jdbc").option("url", url).option("dbtable", "items").load().collect())
    new = spark.createDataFrame([(2, "TWO"), (3, "a"), (3, "b")], "id int, v string")
    io.write(new, "jdbc", {"url": url, "table": "items", "op": "INSERT_OR_DONOTHING", "keyFields": ["id"]})
    assert rows() == [(1, "one"), (2, "two"), (3, "b")]
    io.write(new, "jdbc", {"url": url, "table": "items", "op": "INSERT_OR_UPDATE", "keyFields": ["id"]})
    assert rows() == [(1, "one"), (2, "TWO"), (3, "b")]
    with pytest.raises(ValueError):
        io.write(new, "jdbc", {"url": url, "table": "items", "op": "INSERT_OR_UPDATE"})


@pytest.mark.parametrize("url, want", [("jdbc:postgresql://h/d", "ON CONFLICT (`k`) DO UPDATE SET `v` = EXCLUDED.`v`"), ("jdbc:mysql://h/d", "ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"), ("jdbc:sqlserver://h", "WHEN NOT MATCHED THEN INSERT (`k`, `v`) VALUES (s.`k`, s.`v`);")])
def test_dialects(url, want):
    assert outbound.upsert_statement(url, "t", "s", ["k", "v"], ["k"], True, lambda c: f"`{c}`").endswith(want)


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        got, failures = [], 1

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            fail = Handler.failures > 0
            Handler.failures -= 1
            if not fail:
                Handler.got.append((self.path, json.loads(body)))
            self.send_response(503 if fail else 404 if self.path == "/no" else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler
    s.shutdown()


def test_http_sink_and_action(spark, server):
    url, handler = server
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(5)], "i int, k string").coalesce(1)
    io.write(df, "http", {"endpoint": url + "/${k}", "batchSize": 2, "initialBackoffSeconds": 0.01})
    assert sorted((p, r["i"]) for p, rows in handler.got for r in rows) == [("/x", 1), ("/x", 3), ("/y", 0), ("/y", 2), ("/y", 4)]
    with pytest.raises(Exception, match="status 404"):
        io.write(df, "http", {"endpoint": url + "/no"})
    done = outbound.act(spark, "http", {"endpoint": url + "/a", "body": '{"n": ${size}}'}, df).first()
    assert done["status"] == "DONE" and handler.got[-1] == ("/a", {"n": 5})


def test_files_and_actions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    io.write(df, "files", {"output": f"file://{tmp_path}/f/${{k}}.txt", "content": "${k}=${n}"})
    assert {p.name: p.read_text() for p in (tmp_path / "f").iterdir()} == {"a.txt": "a=1", "b.txt": "b="}
    out = runner.run(spark, {"sources": [{"name": "s", "module": "create", "parameters": {"from": 0, "to": 3}}], "sinks": [{"name": "mark", "module": "action.storage", "input": "s", "parameters": {"output": f"file://{tmp_path}/done", "content": "${size} rows"}}]})
    assert (tmp_path / "done").read_text() == "3 rows" and out["mark"].first()["status"] == "DONE"
    with pytest.raises(ValueError):
        outbound.act(spark, "storage", {"output": f"file://{tmp_path}/x", "maxRows": 1}, df)


def test_windowed_step(spark):
    df = spark.createDataFrame([("a", at(i * 20), i) for i in range(9)], "k string, __timestamp timestamp, v int")
    for window, want in (({"type": "fixed", "size": 1, "unit": "minute"}, [3, 3, 3]), ({"type": "session", "gap": 30, "unit": "second"}, [9]), ({"type": "calendar", "size": 1, "unit": "day"}, [9])):
        out = runner.transform(spark, {"name": "t", "module": "aggregation", "strategy": {"window": window}, "parameters": {"groupFields": ["k"], "fields": [{"name": "n", "op": "count"}]}}, {"s": df})
        assert [r["n"] for r in out.orderBy("window").collect()] == want


def test_change_formats(spark):
    pg = spark.createDataFrame([("public", "t", "INSERT", '{"id":1}', None, '{"v":1}', 9, at(0), 0), ("s", "t", "TRUNCATE", None, None, None, 10, at(1), 0), ("public", "t", "UPDATE", '{"id":1}', '{"v":1}', '{"v":2}', 16, at(2), 3)], "schema string, table string, op string, keysJson string, oldValuesJson string, newValuesJson string, commitLsn bigint, commitTimestamp timestamp, sequence bigint")
    out = cdc.from_postgres(pg)
    assert sorted(r["sequence"] for r in out.collect()) == ["10/3", "9/0"] and [r["after"] for r in cdc.latest(out).collect()] == ['{"v":2}']
    sp = spark.createDataFrame([("t", "INSERT", "00000001", at(0), [('{"id":1}', None, '{"v":1}'), ('{"id":2}', None, '{"v":1}')]), ("t", "DELETE", "00000002", at(0), [('{"id":2}', '{"v":1}', "{}")])], "tableName string, modType string, recordSequence string, commitTimestamp timestamp, mods array<struct<keysJson:string,oldValuesJson:string,newValuesJson:string>>")
    assert [r["keys"] for r in cdc.latest(cdc.from_spanner(sp)).collect()] == ['{"id":1}']


@pytest.mark.parametrize(
    "value, tokenizer, chars, filters, want",
    [
        ("The Quick, brown fox's", "StandardTokenizer", [], ["LowerCaseFilter", "StopFilter"], ["quick", "brown", "fox's"]),
        ("<p class='a'>Café &amp; <b>Bar</b></p>", "WhitespaceTokenizer", ["HTMLStripCharFilter"], ["ASCIIFoldingFilter"], ["Cafe", "&amp;", "Bar"]),
        ("abc", {"type": "NGramTokenizer", "minGram": 2, "maxGram": 3}, [], [], ["ab", "abc", "bc"]),
        ("a1b22", {"type": "PatternTokenizer", "pattern": "([0-9]+)", "group": 1}, [], [], ["1", "22"]),
        ("a,b,,c", {"type": "SimplePatternSplitTokenizer", "pattern": ","}, [], [{"type": "ShingleFilter", "max": 3}], ["a", "a b", "a b c", "b", "b c", "c"]),
        ("xay", "KeywordTokenizer", [{"type": "MappingCharFilter", "normMap": {"x": "a", "a": "b", "ay": "z"}}], [], ["az"]),
        ("b a b", "WhitespaceTokenizer", [], ["FingerprintFilter"], ["a b"]),
        ("abcd x", "WhitespaceTokenizer", [], [{"type": "EdgeNGramTokenFilter", "min": 1, "max": 2}], ["a", "ab", "x"]),
        ("a-b aa", "WhitespaceTokenizer", [], [{"type": "PatternReplaceFilter", "pattern": "a", "replacement": "z", "replaceAll": False}], ["z-b", "za"]),
        ("k=v w", "WhitespaceTokenizer", [], [{"type": "PatternCaptureGroupTokenFilter", "patterns": ["(\\w)=(\\w)"]}], ["k", "v", "w"]),
        ("see a@b.co http://x.y/z", "URLEmailTokenizer", [], [{"type": "LengthFilter", "min": 4, "max": 99}], ["a@b.co", "http://x.y/z"]),
        ("", "NGramTokenizer", [], ["UpperCaseFilter"], []), (None, "WhitespaceTokenizer", [], ["StopFilter"], None),
    ],
)
def test_analyzer(spark, value, tokenizer, chars, filters, want):
    full = lambda p: {"type": p} if isinstance(p, str) else p
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.analyzed(F.col("t"), full(tokenizer), list(map(full, chars)), list(map(full, filters)))).first()[0] == want


@pytest.mark.parametrize("count, seconds, ttl", [(3, None, None), (None, 4, 600), (2, 3, None)])
def test_history_on_a_stream_equals_the_table(spark, tmp_path, count, seconds, ttl):
    rows = [("ab"[i % 2], i, at(i), i * 5 % 4) for i in range(30)]
    kind = "k string, id int, __timestamp timestamp, x int"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    step = {"name": "b", "module": "buffer", "parameters": {"groupFields": ["k"], "maxCount": count, "maxDurationSeconds": seconds, "stateTtlSeconds": ttl, "bufferFilter": "x > 0", "triggerFilter": "x < 3"}}
    ids = lambda df: df.select("id", F.transform("buffer", lambda e: e["id"]).alias("b"))
    stream = ids(runner.transform(spark, step, {"s": spark.readStream.schema(kind).parquet(f"{tmp_path}/in")}))
    name = f"h{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got, want = spark.table(name), ids(runner.transform(spark, step, {"s": spark.createDataFrame(rows, kind)}))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_analyzer_on_long_texts(spark):
    df = spark.range(1).select(F.expr("repeat('word other ', 100000)").alias("t"))
    pairs = text.analyzed(F.col("t"), {"type": "WhitespaceTokenizer"}, [{"type": "MappingCharFilter", "normMap": {"o": "0"}}], [{"type": "ShingleFilter", "outputUnigrams": False}])
    assert df.select(F.size(pairs)).first()[0] == 199_999


# --- streams, dead letters and order of steps ----------------------------------------------------------------------


def test_stream_sinks(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/in")
    config = {
        "sources": [{"name": "s", "module": "storage", "parameters": {"input": f"{tmp_path}/in", "streaming": True}}],
        "transforms": [{"name": "f", "module": "filter", "input": "s", "parameters": {"filter": "id >= 5"}}],
        "sinks": [
            {"name": "files", "module": "storage", "input": "f", "parameters": {"output": f"{tmp_path}/out/${{k}}", "trigger": {"type": "availableNow"}, "checkpointLocation": f"{tmp_path}/c1"}},
            {"name": "each", "module": "files", "input": "f", "parameters": {"output": f"{tmp_path}/each/${{id}}.txt", "content": "${k}", "trigger": {"type": "availableNow"}, "checkpointLocation": f"{tmp_path}/c2"}},
        ],
    }
    for _ in range(2):  # The second run finds nothing new.
        done = runner.run(spark, config)
        assert all(done[n].awaitTermination(120) for n in ("files", "each"))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.id, r.k) for r in out.collect()) == [(i, i % 3) for i in range(5, 20)]
    assert len(list((tmp_path / "each").glob("*.txt"))) == 15
    with pytest.raises(io.NotSupportedError):
        io.write(done["f"], "debug", {"trigger": {"type": "never"}})


def test_dead_letters(spark):
    config = {
        "sources": [{"name": "s", "module": "create", "parameters": {"elements": [{"x": i, "p": "{" if i == 2 else '{"type": "INSERT", "table": "t", "pkNames": ["id"], "data": [{"id": "1"}]}'} for i in range(4)]}}],
        "transforms": [
            {"name": "good", "module": "select", "input": "s", "parameters": {"failFast": False, "filter": "x < 3", "fields": [{"name": "x"}, {"name": "stop", "func": "panic", "condition": "x = 1", "message": "one"}]}},
            {"name": "changes", "module": "cdc", "input": "s", "parameters": {"failFast": False, "field": "p"}},
        ],
    }
    done = runner.build(spark, config)
    assert sorted(r.x for r in done["good"].collect()) == [0, 2]
    (bad,) = done["good.failures"].collect()
    assert (bad.job, bad.module, bad.error, json.loads(bad.input)["x"], bad.eventtime) == ("good", "select", "one", 1, None)
    assert done["changes"].count() == 3 and [json.loads(r.input)["x"] for r in done["changes.failures"].collect()] == [2]


def test_panic_rate_agrees(spark):
    good, bad = selects.split_failures(spark.range(1000), [{"name": "p", "func": "panic", "rate": 0.3}])
    assert good.count() + bad.count() == 1000 and good.join(bad, "id").count() == 0 and 200 < bad.count() < 400


def test_waits_and_side_inputs(spark, tmp_path):
    config = {
        "sources": [
            {"name": "back", "module": "storage", "waits": ["out"], "parameters": {"input": f"{tmp_path}/o"}},
            {"name": "s", "module": "create", "parameters": {"elements": [{"x": 1}, {"x": 2}]}},
            {"name": "names", "module": "create", "parameters": {"elements": [{"k": 2, "name": "two"}]}},
        ],
        "transforms": [{"name": "q", "module": "query", "input": "s", "sideInputs": ["names"], "parameters": {"sql": "SELECT n.name FROM INPUT AS i JOIN names AS n ON n.k = i.x", "keep": ["x"]}}],
        "sinks": [{"name": "out", "module": "storage", "input": "q", "parameters": {"output": f"{tmp_path}/o"}}],
    }
    assert [tuple(r) for r in runner.run(spark, config)["back"].collect()] == [(2, "two")]
    with pytest.raises(runner.ConfigError):
        runner.run(spark, {"sinks": [{"name": "a", "module": "debug", "input": "b"}]})
