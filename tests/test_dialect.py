import datetime
import math

import numpy as np
import pytest

from tidewater.plans import sqlx
from tidewater.plans.dialect import DialectError, java_pattern, translate

D = datetime.date
T = datetime.datetime

#: Expressions of the dialect and their values.
SCALARS = [
    ("safe_divide(1, 0)", None), ("SAFE_ADD(1, 2)", 3), ("SAFE_NEGATE(5)", -5), ("BITAND(6, 3)", 2), ("BITXOR(6, 3)", 5), ("BITNOT(0)", -1), ("IS_NAN(double('nan'))", True), ("IS_INF(1D)", False),
    ("contains_substr('Hello', 'ELL')", True), ("STARTS_WITH('abc', 'ab')", True), ("strpos('hello', 'l')", 3), ("BYTE_LENGTH('é')", 2), ("TO_HEX(FROM_HEX('ab01'))", "ab01"),
    ("TO_CODE_POINTS('a😀')", [97, 128512]), ("TO_CODE_POINTS('')", []), ("CODE_POINTS_TO_STRING(ARRAY[97, 233, 128512])", "aé😀"), ("TO_HEX(CODE_POINTS_TO_BYTES(ARRAY[1, 255]))", "01ff"),
    ("TO_BASE32('foobar')", "MZXW6YTBOI======"), ("TO_BASE32('')", ""), ("CAST(FROM_BASE32('MZXW6YTBOI======') AS STRING)", "foobar"), ("CAST(FROM_BASE64(TO_BASE64('abc')) AS STRING)", "abc"),
    ("REGEXP_CONTAINS('abc', 'b+')", True), ("REGEXP_EXTRACT('key=val', '=(.*)')", "val"), ("REGEXP_EXTRACT('abc', 'x')", None), ("REGEXP_EXTRACT('a1b2c3', '[0-9]', 1, 2)", "2"), ("REGEXP_EXTRACT_ALL('a1b22', '[0-9]+')", ["1", "22"]),
    ("GREATEST(1, NULL, 3)", None), ("GREATEST(1, 5, 3)", 5), ("TRUNC(-2.57D, 1)", -2.5), ("TRUNC(2.9D)", 2.0), ("trunc(DATE '2024-05-17', 'MM')", D(2024, 5, 1)), ("LOG(8, 2)", 3.0), ("SPLIT('a.b.c', '.')", ["a", "b", "c"]), ("SPLIT('a,b')", ["a", "b"]),
    ("DATE_ADD(DATE '2024-01-31', INTERVAL 1 MONTH)", D(2024, 2, 29)), ("DATE_SUB(DATE '2024-01-01', INTERVAL 1 QUARTER)", D(2023, 10, 1)), ("date_add(DATE '2024-01-01', 2)", D(2024, 1, 3)),
    ("TIMESTAMP_ADD(TIMESTAMP '2024-01-01 00:00:00', INTERVAL 90 MINUTE)", T(2024, 1, 1, 1, 30)), ("DATE_DIFF(DATE '2024-03-01', DATE '2024-02-29', MONTH)", 1), ("TIMESTAMP_DIFF(TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-02-29 00:00:00', MONTH)", 0),
    ("DATE_TRUNC(DATE '2024-05-17', MONTH)", D(2024, 5, 1)), ("TIMESTAMP_TRUNC(TIMESTAMP '2024-05-17 10:20:30', HOUR)", T(2024, 5, 17, 10)), ("FORMAT_TIMESTAMP('%Y/%m/%d at %H', TIMESTAMP '2024-05-17 10:20:30')", "2024/05/17 at 10"), ("FORMAT_DATE(\"%d it's %%\", DATE '2024-05-17')", "17 it's %"),
    ("PARSE_DATE('%d.%m.%Y', '17.05.2024')", D(2024, 5, 17)), ("DATE(2024, 5, 17)", D(2024, 5, 17)), ("SAFE_CAST('x' AS INT)", None), ("JSON_VALUE('{\"a\": {\"b\": 1}}', '$.a.b')", "1"), ("JSON_EXISTS('{}', '$.a')", False), ("JSON_LENGTH('[1,2]')", 2),
    ("ARRAY_LENGTH(ARRAY_CONCAT(ARRAY[1], ARRAY[2, 3]))", 3), ("ARRAY_TO_STRING(ARRAY_REVERSE(ARRAY['a', 'b']), '-')", "b-a"), ("ARRAY_DIFFERENCE_INT(ARRAY[1, 4, NULL, 9])", [0, 3, None, None]), ("ARRAY_CUM_SUM(ARRAY[1, NULL, 2])", [1.0, 1.0, 3.0]), ("ARRAY_COMPACT(ARRAY[1, 1, 2, 1])", [1, 2, 1]),
    ("round(COSINE_SIMILARITY(ARRAY[1, 0], ARRAY[1, 1]), 6)", 0.707107), ("COSINE_SIMILARITY(ARRAY[0], ARRAY[1])", None), ("LINREG_PREDICT(ARRAY[1D, 2D, 3D], ARRAY[10, 100])", 321.0), ("MDT_CONTAINS_ALL_INT64(ARRAY[1, 2, 3], ARRAY[3, 1])", True),
    ("transform(POLY_FIT(ARRAY[0, 1, 2], ARRAY[1, 3, 5], 1), c -> round(c, 6))", [1.0, 2.0]), ("2 IN UNNEST(ARRAY[1, 2])", True), ("1 = 1 AND lower('A') NOT IN UNNEST(ARRAY['a']) OR false", False), ("'SAFE_ADD(1, [2])' /* GREATEST( */", "SAFE_ADD(1, [2])"),
]


def test_scalars(spark):
    got = sqlx.run(spark, "SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(SCALARS)), {}).first()
    wrong = [(e, g, w) for (e, w), g in zip(SCALARS, got, strict=True) if not (g == w or isinstance(w, float) and g is not None and math.isclose(g, w))]
    assert not wrong


def test_formats():
    assert java_pattern("%Y-%m") == "'yyyy-MM'"
    with pytest.raises(DialectError):
        java_pattern("%Q")


def test_unclosed(spark):
    with pytest.raises(DialectError):
        translate(spark, "SELECT GREATEST(1, 2")


@pytest.fixture(scope="module")
def rows(spark):
    data = [("u", 0, "view", 1.0), ("u", 10, "cart", 2.0), ("u", 20, "view", 4.0), ("u", 35, "buy", 3.0), ("v", 5, "view", None), ("v", 900, "buy", 7.0)]
    return spark.createDataFrame(data, "k string, ts bigint, action string, x double")


SEQUENCES = [
    ("SEQ_FUNNEL(s, 'ts,action', 0, 100, \"$action = 'view'; $action = 'cart'; $action = 'buy'\")", 3, 1), ("SEQ_FUNNEL(s, 'ts,action', 'ts', 1000, \"$1 = 'view'; $1 = 'buy'\")", 2, 2),
    ("SEQ_RETENTION(s, 'ts,action', \"$action = 'view'; $action = 'cart'\")", [True, True], [True, False]), ("SEQ_FOLD(s, 1, 3, 'x', 'sum')", 7.0, 7.0), ("SEQ_FOLD_INT(s, 0, 99, 'ts', 'max')", 35, 900), ("SEQ_FOLD(s, 1, 1, 'x', 'avg')", 1.0, None),
    ("transform(SEQ_SPLIT(s, 'ts', 10), q -> size(q))", [3, 1], [1, 1]), ("SEQ_CUSUM(s, 'x', 1, 0.5, 2)", 3, 2), ("SEQ_PAGE_HINKLEY(s, 'x', 0, 1.4)", 3, 0), ("SEQ_EXP_SMOOTH(s, 'x', 0.5)", 2.875, 7.0), ("SEQ_HOLT(s, 'x', 1, 1, 2)", 1.0, 7.0),
    ("s[2].action", "cart", "buy"), ("s[9].action", None, None), ("ARRAY[s[1].ts, 7][1]", 0, 5),
    ("transform(SEQ_MATCH(s, 'ts,action,x', 'A UP+', 'UP: $x > PREV($x)'), m -> ARRAY[m.startIdx, m.endIdx])", [[1, 3]], []),
    ("transform(SEQ_MATCH_STEPS(s, 'ts,action,x', 'V B', \"V: $1 = 'view'; B: $action = 'buy'\"), m -> m.symbol)", ["V", "B"], ["V", "B"]),
]


def test_sequences(spark, rows):
    people = sqlx.run(spark, "SELECT k, transform(SEQ_COLLECT(ts, action, x), e -> named_struct('ts', e.key, 'action', e.v1, 'x', e.v2)) AS s FROM rows GROUP BY k", {"rows": rows})
    got = sqlx.per_record(spark, "SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _, _) in enumerate(SEQUENCES)) + " FROM INPUT", people, keep=["k"]).orderBy("k").collect()
    for who, at in ((got[0], 1), (got[1], 2)):
        assert [(s[0], g, s[at]) for s, g in zip(SEQUENCES, who[1:], strict=True) if g != s[at]] == []


def test_models(spark):
    xs = [(float(x), float(z), 2.0 + 3 * x - z + 0.1 * ((x * 7 + z) % 3 - 1)) for x in range(6) for z in range(4)]
    df = spark.createDataFrame([*xs, (None, 1.0, 5.0)], "x double, z double, y double")
    sql = "SELECT LINEAR_REG(y, ARRAY[x, z]) AS m, LINEAR_REG(y, ARRAY[x, z], 5) AS ridge, BAYES_LINREG(y, ARRAY[x, z], 0.5, 0.04) AS b, BAYES_PREDICT(BAYES_LINREG(y, ARRAY[x, z], 0.5), ARRAY[1, 2]) AS p, BETA_SAMPLE(2, 3, 7) AS s, DECAY_SUM(y, 0L, 1000, 1000L) AS d FROM t"
    got = sqlx.run(spark, sql, {"t": df}).first()
    a, y = np.array([[1, x, z] for x, z, _ in xs]), np.array([v for *_, v in xs])
    assert np.allclose(got["m"], np.linalg.lstsq(a, y, rcond=None)[0])
    assert np.allclose(got["ridge"], np.linalg.solve(a.T @ a + np.diag([0, 5, 5]), a.T @ y))
    cov = np.linalg.inv(a.T @ a / 0.04 + 0.5 * np.eye(3))
    assert np.allclose(got["b"], [3, 0.04, *(cov @ a.T @ y / 0.04), *cov.ravel()])
    assert abs(got["p"][0] - 3) < 0.2 and got["p"][1] > 0 and 0 < got["s"] < 1
    assert math.isclose(got["d"], (sum(y) + 5) / 2)
    assert sqlx.run(spark, "SELECT LINEAR_REG(y, ARRAY[x]) AS m FROM t WHERE false", {"t": df}).first()["m"] is None


UNNESTS = [
    ("SELECT m.matchNo, m.startIdx, i.s[m.endIdx].x AS x FROM INPUT AS i, UNNEST(SEQ_MATCH(i.s, 'ts,action,x', 'A UP+', 'UP: $x > PREV($x)')) AS m WHERE m.matchNo > 0", [("u", 1, 1, 4.0)]),
    ("SELECT e.action AS a FROM INPUT AS i CROSS JOIN UNNEST(i.s) AS e WHERE e.ts > 15", [("u", "buy"), ("u", "view"), ("v", "buy")]),
    ("SELECT p.n, p.e.ts AS ts FROM INPUT AS i, UNNEST(i.s) WITH ORDINALITY AS p(e, n) WHERE p.n > 1 AND p.n < 4", [("u", 2, 10), ("u", 3, 20), ("v", 2, 900)]),
    ("SELECT t.b, count(*) AS n FROM INPUT AS i, UNNEST(i.s) AS t(a, b, c) GROUP BY t.b HAVING count(*) > 1", [("u", "view", 2)]),
    ("SELECT x FROM INPUT AS i LEFT JOIN UNNEST(filter(i.s, r -> r.x > 5)) AS x ON true", [("u", None), ("v", (900, "buy", 7.0))]),
    ("SELECT off FROM INPUT AS i, UNNEST(i.s) WITH OFFSET AS off WHERE off = 3", [("u", 3)]),
    ("SELECT sum(u.ts) AS t FROM INPUT AS i, UNNEST(SEQ_SPLIT(i.s, 'ts', 10)) WITH ORDINALITY AS q(sess, no), UNNEST(q.sess) AS u WHERE q.no = 2", [("u", 35), ("v", 900)]),
]


@pytest.mark.parametrize("sql, want", UNNESTS)
def test_unnest(spark, rows, sql, want):
    people = sqlx.run(spark, "SELECT k, transform(SEQ_COLLECT(ts, action, x), e -> named_struct('ts', e.key, 'action', e.v1, 'x', e.v2)) AS s FROM rows GROUP BY k", {"rows": rows})
    got = [tuple(tuple(x) if isinstance(x, tuple) else x for x in r) for r in sqlx.per_record(spark, sql, people, keep=["k"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ordered_aggregates(spark, rows):
    sql = "SELECT STRING_AGG(action, '-' ORDER BY ts DESC) AS a, STRING_AGG(action ORDER BY action, ts) AS b, ARRAY_AGG(x ORDER BY ts DESC) AS c, STRING_AGG(DISTINCT k) AS d FROM rows WHERE k = 'u'"
    assert list(sqlx.run(spark, sql, {"rows": rows}).first()) == ["buy-view-cart-view", "buy,cart,view,view", [3.0, 4.0, 2.0, 1.0], "u"]


def test_windows_and_qualify_reject(spark):
    for sql in ("SELECT 1 QUALIFY 1 = 1", "SELECT count(*) FROM t GROUP BY TUMBLE(ts, INTERVAL '1' MONTH)", "SELECT count(*) FROM t GROUP BY HOP(ts, INTERVAL '1' DAY)", "SELECT count(*) FROM t GROUP BY SESSION(ts, x)"):
        with pytest.raises(DialectError):
            translate(spark, sql)


def test_qualify_with_window_distinct_and_order(spark):
    spark.range(10).selectExpr("id", "id % 3 AS g").createOrReplaceTempView("numbers")
    run = lambda sql: [tuple(x) for x in spark.sql(translate(spark, sql)).collect()]
    assert run("SELECT DISTINCT g FROM numbers QUALIFY count(*) OVER w > 3 WINDOW w AS (PARTITION BY g)") == [(0,)]
    assert run("SELECT id FROM (SELECT * FROM numbers QUALIFY row_number() OVER (PARTITION BY g ORDER BY id) = 1) WHERE g > 0 ORDER BY id DESC LIMIT 5") == [(2,), (1,)]
