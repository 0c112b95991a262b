import glob
import os

import duckdb
import pytest

from tidewater import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in found])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name])
        columns = [x[0] for x in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(want.fetchall(), columns)


def check(spark, name, sf):
    """The query's rows over the tables of a folder are its SQL's."""
    df = catalog.QUERIES[name](spark, str(sf))
    c = duckdb.connect()
    for p in sf.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    want = c.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), columns)


def test_split_at_part_seconds(spark, tmp_path):
    """Seconds are the nearest ones, halves the even ones: gaps near a day, and the order within a second."""
    day = 86400
    at = {1: [0.4, day + 0.6], 2: [0.6, day + 1.4], 3: [0.5, day + 1.5], 4: [1.5, day + 2.5], 5: [-0.5, day + 0.5], 6: [0.2, 0.7, day + 1.2], 7: [None, 3.0, 2 * day + 3.5]}
    events = [(10 * u + i, u, t, "view", 1.0) for u, ts in at.items() for i, t in enumerate(ts)]
    spark.createDataFrame(events, "event_id long, user_id long, t double, event_type string, value double").selectExpr("event_id", "timestamp_micros(cast(t * 1000000 as long)) as ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    check(spark, "seq_split", tmp_path)
