"""Streams over several micro-batches equal the batch answer."""

import datetime as dt
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from faultline.streaming import jobs


def _write_batches(root, batches):
    import os

    os.makedirs(f"{root}/events.parquet")
    for i, rows in enumerate(batches):
        t = pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()),
                      "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
                      "user_id": pa.array([r[2] for r in rows], pa.int64()),
                      "event_type": pa.array([r[3] for r in rows], pa.string()),
                      "value": pa.array([r[4] for r in rows], pa.float64())})
        pq.write_table(t, f"{root}/events.parquet/part-{i}.parquet")


def test_latest_streams_across_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    batches = [
        [(1, t0, 1, "view", 5.0), (2, t0 + h, 2, "view", 150.0), (3, t0 + 2 * h, 1, "click", 7.0)],
        [(4, t0 + 3 * 24 * h, 1, "view", 1.0)],            # user 2 idle for > 1 day: evicted
        [(5, t0 + 3 * 24 * h + h, 2, "purchase", 9.0), (6, t0 + 3 * 24 * h + 2 * h, 3, "view", 200.0)],
    ]
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)
    rows = [r for b in batches for r in b]
    want = {}
    for eid, ts, u, et, v in rows:
        if u not in want or (ts, eid) > (want[u][1], want[u][0]):
            want[u] = (eid, ts)

    ev = jobs.file_stream(spark, root, "events", max_files=1)
    a = jobs.latest_stream(spark, ev, "user_id", ["ts", "event_id"], ["event_id", "ts"], jobs.run_dir(spark, "t1"))
    assert {r["user_id"]: (r["event_id"], r["ts"]) for r in a.collect()} == want

    ev = jobs.file_stream(spark, root, "events", max_files=1)
    b = jobs.latest_stream_evicting(spark, ev, "user_id", "ts", "event_id", ["event_id", "ts"], "1 day", "1 hour",
                                    jobs.run_dir(spark, "t2"))
    assert {r["user_id"]: (r["event_id"], r["ts"]) for r in b.collect()} == want

    ev = jobs.file_stream(spark, root, "events", max_files=1)
    from pyspark.sql import functions as F

    c = jobs.accuracy_stream(spark, ev, "event_type", F.col("value") <= 100, jobs.run_dir(spark, "t3"))
    got = {r["event_type"]: (r["total_count"], r["correct_count"]) for r in c.collect()}
    exp = {}
    for _, _, _, et, v in rows:
        n, k = exp.get(et, (0, 0))
        exp[et] = (n + 1, k + int(v <= 100))
    assert got == exp


def test_upsert_and_window_streams_across_batches(spark):
    from pyspark.sql import functions as F

    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    batches = [
        [(1, t0, 1, "view", 5.0), (2, t0 + h, 2, "view", 6.0)],
        [(3, t0 + 3 * h, 1, "click", 7.0), (4, t0 + 3 * h + dt.timedelta(minutes=5), 3, "view", 8.0)],
        [(5, t0 + 6 * h, 1, "view", 9.0)],
    ]
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)

    # M2: the row of user 1 from the last batch replaces the earlier ones; base rows stay
    target = spark.createDataFrame([(1, "old", 0.0), (9, "keep", 0.0)], "user_id long, event_type string, value double")
    src = jobs.file_stream(spark, root, "events", max_files=1).select("user_id", "event_type", "value", "event_id")
    out = jobs.upsert_stream(spark, src, target, "user_id", ["event_id"], jobs.run_dir(spark, "t4"))
    got = {r["user_id"]: (r["event_type"], r["value"]) for r in out.collect()}
    assert got == {1: ("view", 9.0), 2: ("view", 6.0), 3: ("view", 8.0), 9: ("keep", 0.0)}

    # M4: hourly windows, 1 hour watermark; the final watermark is 06:00 - 1h = 05:00, so windows
    # ending at or before 05:00 are emitted and the 06:00 window stays open
    ev = jobs.file_stream(spark, root, "events", max_files=1)
    win = jobs.windowed_usage_stream(spark, ev, "ts", ["event_type"], [F.count(F.lit(1)).alias("n")],
                                     "1 hour", "1 hour", jobs.run_dir(spark, "t5"))
    got = sorted((r["window_start"].hour, r["event_type"], r["n"]) for r in win.collect())
    assert got == [(0, "view", 1), (1, "view", 1), (3, "click", 1), (3, "view", 1)]


def test_upsert_stream_with_compaction(spark):
    t0 = dt.datetime(2024, 1, 1)
    batches = [[(1, t0, 1, "view", 5.0)], [(2, t0, 1, "click", 6.0), (3, t0, 2, "view", 7.0)],
               [(4, t0, 2, "buy", 8.0)]]
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)
    target = spark.createDataFrame([(1, "old", 0.0), (9, "keep", 0.0)], "user_id long, event_type string, value double")
    src = jobs.file_stream(spark, root, "events", max_files=1).select("user_id", "event_type", "value", "event_id")
    out = jobs.upsert_stream(spark, src, target, "user_id", ["event_id"], jobs.run_dir(spark, "t6"), compact_every=1)
    got = {r["user_id"]: (r["event_type"], r["value"]) for r in out.collect()}
    assert got == {1: ("click", 6.0), 2: ("buy", 8.0), 9: ("keep", 0.0)}


def test_latest_stream_with_compaction(spark):
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    batches = [[(1, t0, 1, "view", 1.0)], [(2, t0 + h, 1, "click", 2.0)], [(3, t0 + 2 * h, 2, "view", 3.0)]]
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)
    ev = jobs.file_stream(spark, root, "events", max_files=1)
    out = jobs.latest_stream(spark, ev, "user_id", ["ts", "event_id"], ["event_id"], jobs.run_dir(spark, "t7"),
                             compact_every=2)
    assert {r["user_id"]: r["event_id"] for r in out.collect()} == {1: 2, 2: 3}


def test_streams_do_not_depend_on_number_and_order_of_files(spark):
    from pyspark.sql import functions as F

    from faultline.operators import accuracy as acc

    t0, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    rows = [(i, t0 + i * h / 4, i % 5, None if i % 7 == 0 else ("" if i % 6 == 0 else f"k{i % 2}"), None if i % 4 == 0 else float(i % 200)) for i in range(200)]
    batches = [rows[150:], rows[100:150], rows[50:100], rows[:50]]  # newest first
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)
    results = []
    for n in (1, 1000):
        ev = lambda: jobs.file_stream(spark, root, "events", max_files=n)  # noqa: B023, E731
        win = jobs.windowed_usage_stream(spark, ev(), "ts", ["event_type"], [F.count(F.lit(1)).alias("n")], "1 hour", None, jobs.run_dir(spark, "o1"))
        last = jobs.latest_stream_evicting(spark, ev(), "user_id", "ts", "event_id", ["event_id", "ts"], None, None, jobs.run_dir(spark, "o2"))
        rate = jobs.accuracy_stream(spark, ev(), "event_type", F.col("value") <= 100, jobs.run_dir(spark, "o3"), compact_every=2)
        results.append([sorted(map(str, x.collect())) for x in (win, last, rate)])
    assert results[0] == results[1]
    assert sum(r["n"] for r in win.collect()) == len(rows)
    assert {r["user_id"]: r["event_id"] for r in last.collect()} == {u: max(r[0] for r in rows if r[2] == u) for u in range(5)}
    df = spark.createDataFrame([(k, None if v is None else v <= 100) for _, _, _, k, v in rows], "event_type string, is_correct boolean")
    assert sorted(map(tuple, rate.collect())) == sorted(map(tuple, acc.accuracy_by_key(df, "event_type").collect()))


def test_idle_sessions_leave_the_state_and_late_rows_are_dropped(spark):
    t0, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    batches = [
        [(i, t0 + i * h / 100, i, "view", 1.0) for i in range(1, 41)],       # forty sessions
        [(100, t0 + 48 * h, 1, "view", 2.0)],                                 # two days on: the others are idle
        [(101, t0 + 48 * h + h / 2, 2, "view", 3.0), (103, t0 + 48 * h, 50, "view", 5.0)],
        [(104, t0 + 49 * h, 1, "view", 6.0), (102, t0 + 2 * h, 3, "late", 4.0), (99, t0 + 49 * h, 1, "tie", 7.0), (105, None, 1, "no time", 8.0)],
    ]
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)
    seen = []
    ev = jobs.file_stream(spark, root, "events", max_files=1)
    out = jobs.latest_stream_evicting(spark, ev, "user_id", "ts", "event_id", ["event_id", "ts", "event_type"], "1 day", "1 hour",
                                      jobs.run_dir(spark, "idle"), compact_every=2, progress=seen)
    got = {r["user_id"]: r["event_id"] for r in out.collect()}
    # the table keeps every session; the row that came two days late is not in it
    assert got == {**{i: i for i in range(4, 41)}, 1: 104, 2: 101, 3: 3, 50: 103}
    rows = [p.stateOperators[0].numRowsTotal for p in seen if p.stateOperators]
    assert max(rows) >= 40 and rows[-1] <= 3  # sessions 1, 2 and 50
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in seen if p.stateOperators) == 1


def test_closed_windows_count_late_rows_and_are_emitted_once(spark):
    from pyspark.sql import functions as F

    t0, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    batches = [[(1, t0, 1, "view", 1.0), (2, t0 + 5 * h, 1, "view", 1.0)], [(3, t0 + 10 * h, 1, "view", 1.0), (4, t0 + 4.5 * h, 1, "view", 1.0)],
               [(5, t0 + h / 2, 1, "view", 1.0), (6, t0 + 20 * h, 1, "view", 1.0)], [(7, t0 + 30 * h, 1, "view", 1.0)]]
    root = tempfile.mkdtemp(prefix="faultline-stream-test-")
    _write_batches(root, batches)
    seen = []
    win = jobs.windowed_usage_stream(spark, jobs.file_stream(spark, root, "events", max_files=1), "ts", ["event_type"], [F.count(F.lit(1)).alias("n")],
                                     "1 hour", "1 hour", jobs.run_dir(spark, "closed"), progress=seen)
    # row 5 is late for the window of midnight, row 4 is not for its own
    assert sorted((r["window_start"].hour, r["n"]) for r in win.collect()) == [(0, 1), (4, 1), (5, 1), (10, 1), (20, 1)]
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in seen if p.stateOperators) == 1
