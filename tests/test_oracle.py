"""Every registered query equals its DuckDB oracle (rows, columns, values)."""

import duckdb
import pytest

import __spark_entry__ as E
from faultline.plans import ORACLES as PLAN_ORACLES
from faultline.plans import QUERIES
from check_oracle import rows_key, type_mismatches
from faultline.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
ORACLES = PLAN_ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    otypes = {d[0]: d[1] for d in cur.description}
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert type_mismatches({f.name: f.dataType.simpleString() for f in df.schema.fields}, otypes) == []
    assert len(rows) == len(orows)
    assert rows_key(cols, rows, False) == rows_key(ocols, orows, False)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["knia_diagram", "total_count", "correct_count", "accuracy_rate"]
    assert df.count() > 0


def test_windowed_operators_with_many_chunks(spark, con):
    """The chunked prefix sum and as-of attach equal DuckDB's plain window and
    ASOF JOIN when the events are cut into many small chunks."""
    from pyspark.sql import functions as F

    from faultline.functions.chunks import time_chunker
    from faultline.operators import accuracy as acc
    from faultline.operators import sessions as ses
    from faultline.sources.tables import Tables

    ev = Tables(spark, SF).events.select("event_id", "event_type", "ts", "value", "user_id")
    chunk = time_chunker(ev, "ts", rows_per_chunk=50)
    run = acc.running_accuracy(ev.withColumn("ok", F.col("value") <= 100), ["event_type"], ["ts", "event_id"],
                               "ok", chunk(F.col("ts")))
    got = {r["event_id"]: (r["n_seen"], r["n_ok"]) for r in run.collect()}
    want = {r[0]: (r[1], r[2]) for r in con.execute("""
        SELECT event_id, count(*) OVER w, sum(CASE WHEN value <= 100 THEN 1 ELSE 0 END) OVER w FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""").fetchall()}
    assert got == want

    views = ev.where(F.col("event_type") == "view").select("user_id", "ts", "event_id")
    buys = ev.where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id")
    out = ses.asof_attach(buys, views, "user_id", "ts", ["event_id"], chunk=chunk, tiebreak="event_id")
    got = {r["event_id"]: r["match_event_id"] for r in out.collect()}
    want = dict(con.execute("""
        WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
             p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
        SELECT p.event_id, v.event_id FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""").fetchall())
    assert got == want
