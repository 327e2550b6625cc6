"""Snapshot upserts, the streaming change log, and hot-key inputs."""

import random
import uuid

import pytest

from faultline.operators import sessions as ses
from faultline.operators import upsert as ups
from faultline.session import scratch_path
from faultline.sources import changelog, snapshots


def test_snapshot_upsert_versions(spark):
    root = scratch_path(spark, "test-snap", uuid.uuid4().hex)
    init = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    v0 = snapshots.upsert_into(spark, root, spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string"),
                               "k", initial=init)
    v1 = snapshots.upsert_into(spark, root, spark.createDataFrame([(1, "A", 1), (1, "AA", 2)], "k long, v string, o int"),
                               "k", on_duplicate="last", order=["o"])
    assert (v0, v1) == (0, 1)
    assert snapshots.committed_versions(spark, root) == [0, 1]
    cur = sorted(tuple(r) for r in snapshots.read_current(spark, root).collect())
    assert cur == [(1, "AA"), (2, "B"), (3, "c")]
    old = sorted(tuple(r) for r in spark.read.parquet(snapshots.version_path(root, 0)).collect())
    assert old == [(1, "a"), (2, "B"), (3, "c")]


def test_changelog_replay_is_idempotent(spark):
    root = scratch_path(spark, "test-log", uuid.uuid4().hex)
    b0 = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    b1 = spark.createDataFrame([(2, 21)], "k long, v long")
    changelog.append_batch(b0, root, 0)
    changelog.append_batch(b1, root, 1)
    changelog.append_batch(b1, root, 1)  # replayed micro-batch
    cur = sorted(tuple(r) for r in changelog.current(spark, root, "k").collect())
    assert cur == [(1, 10), (2, 21)]
    assert changelog.compact(spark, root, "k") == 1
    assert sorted(tuple(r) for r in changelog.current(spark, root, "k").collect()) == cur
    changelog.append_batch(spark.createDataFrame([(1, 11), (3, 30)], "k long, v long"), root, 2)
    assert sorted(tuple(r) for r in changelog.current(spark, root, "k").collect()) == [(1, 11), (2, 21), (3, 30)]
    assert changelog.read_log(spark, root, after=1).count() == 2  # readers skip compacted batches


def _hot_rows(n=3000, seed=11):
    random.seed(seed)
    # one key holds a third of all rows
    return [(0 if i % 3 == 0 else random.randint(1, 50), i, random.random()) for i in range(n)]


def test_hot_key_latest_and_dedupe(spark):
    rows = _hot_rows()
    df = spark.createDataFrame(rows, "k long, ts long, v double").repartition(8)
    got = {r["k"]: r["ts"] for r in ses.latest_per_key(df, "k", ["ts"]).collect()}
    want = {}
    for k, ts, _ in rows:
        want[k] = max(want.get(k, -1), ts)
    assert got == want
    last = {r["k"]: r["ts"] for r in ups.dedupe_last(df, "k", ["ts"]).collect()}
    assert last == want


def test_hot_key_asof(spark):
    rows = _hot_rows(1500, 5)
    left = spark.createDataFrame([(k, ts, ts) for k, ts, v in rows if v < 0.5], "k long, ts long, lid long")
    right = spark.createDataFrame([(k, ts, ts) for k, ts, v in rows if v >= 0.5], "k long, ts long, rid long")
    out = ses.asof_attach(right, left, "k", "ts", ["lid"], chunk=lambda c: (c / 100).cast("long"), how="left")
    got = {r["rid"]: r["match_lid"] for r in out.collect()}
    lefts = {}
    for k, ts, v in rows:
        if v < 0.5:
            lefts.setdefault(k, []).append(ts)
    want = {}
    for k, ts, v in rows:
        if v >= 0.5:
            c = [t for t in lefts.get(k, []) if t <= ts]
            want[ts] = max(c) if c else None
    assert got == want


def test_append_returning_reads_back_written_ids(spark):
    from faultline.operators import ingest as ing

    root = scratch_path(spark, "test-append", uuid.uuid4().hex)
    df = spark.createDataFrame([("a",), ("b",)], "input_text string")
    got = ing.append_returning(df, root)
    ids1 = sorted(r["id"] for r in got.collect())
    ids2 = sorted(r["id"] for r in got.collect())
    assert ids1 == ids2 and len(set(ids1)) == 2
    ing.append_returning(df, root)
    table = spark.read.parquet(root)
    assert table.count() == 4 and "write_id" in table.columns


def test_parse_int_prefix(spark):
    from faultline.functions import js

    df = spark.createDataFrame([("12abc",), (" -3",), ("x",), (None,), ("0",)], "s string")
    out = [r["n"] for r in df.select(js.parse_int_prefix("s").alias("n")).collect()]
    assert out == [12, -3, None, None, 0]


def test_accuracy_merge_into_snapshots(spark):
    from faultline.operators import accuracy as acc

    root = scratch_path(spark, "test-acc", uuid.uuid4().hex)
    rows = [("a", True), ("a", False), ("b", True), ("b", True), ("a", True)]
    df = spark.createDataFrame(rows, "d string, is_correct boolean")
    first = acc.accuracy_by_key(spark.createDataFrame(rows[:2], "d string, is_correct boolean"), "d")
    rest = acc.accuracy_by_key(spark.createDataFrame(rows[2:], "d string, is_correct boolean"), "d")
    assert acc.accuracy_merge_into(spark, root, first, "d") == 0
    assert acc.accuracy_merge_into(spark, root, rest, "d") == 1
    got = sorted(tuple(r) for r in snapshots.read_current(spark, root).collect())
    want = sorted(tuple(r) for r in acc.accuracy_by_key(df, "d").collect())
    assert got == want


def test_clustered_layout_prunes(spark):
    from faultline.sources.layout import write_clustered
    from faultline.sources.tables import Tables

    root = scratch_path(spark, "test-layout", uuid.uuid4().hex)
    ev = Tables(spark, "/root/testdata/sf0.001").events
    write_clustered(ev, root, "ts", ["user_id"], partitions=4)
    t = spark.read.parquet(root)
    q = t.where((t.day == "2024-01-03") & (t.user_id == 7))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    want = ev.where((ev.user_id == 7) & (ev.ts.cast("date") == "2024-01-03")).count()
    assert q.count() == want


def test_json_record_sources(spark):
    import os

    from faultline.operators import ingest as ing
    from faultline.sources.tables import json_array_records, read_json_records

    body = '{"records": [{"video": {"video_name": "a", "accident_negligence_rateA": 0}}, {"video_name": "b"}]}'
    recs = json_array_records(spark.createDataFrame([(body,)], "body string"), "body")
    flat = ing.flatten_video_records(recs).orderBy("video_name").collect()
    assert [(r["video_name"], r["rate_a"]) for r in flat] == [("a", 0), ("b", None)]

    d = scratch_path(spark, "test-jsonl", uuid.uuid4().hex)
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/part-0.json", "w") as f:
        f.write('{"video_name": "c"}\n{"broken": \n')
    raw = read_json_records(spark, d)
    out = ing.flatten_video_records(raw).collect()
    assert sorted((r["video_name"] or "") for r in out) == ["", "c"]  # malformed line kept, fields null


def test_bucketed_tables_join_without_shuffle(spark):
    from faultline.operators import upsert as ups
    from faultline.sources.layout import write_bucketed
    from faultline.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    suffix = uuid.uuid4().hex[:8]
    write_bucketed(t.orders.select("o_orderkey", "o_orderstatus"), f"orders_b_{suffix}", "o_orderkey", 8)
    write_bucketed(t.lineitem.select("l_orderkey", "l_linenumber"), f"lineitem_b_{suffix}", "l_orderkey", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.table(f"orders_b_{suffix}")
        child = spark.table(f"lineitem_b_{suffix}")
        out = ups.orphans(child, orders, "l_orderkey", "o_orderkey")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert out.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_concurrent_and_repeated_deltas_are_not_lost_or_doubled(spark, monkeypatch):
    from faultline.operators import accuracy as acc

    root = scratch_path(spark, "test-acc", uuid.uuid4().hex)
    ten = spark.createDataFrame([("a", 10, 5)], "d string, total_count long, correct_count long")
    assert acc.accuracy_merge_into(spark, root, ten, "d", batch_id=0) == 0
    assert acc.accuracy_merge_into(spark, root, ten, "d", batch_id=1) == 1
    assert acc.accuracy_merge_into(spark, root, ten, "d", batch_id=1) == 1  # a retry adds nothing
    assert snapshots.read_current(spark, root).first()["total_count"] == 20
    monkeypatch.setattr(snapshots, "committed_versions", lambda *a: [0])  # a writer that has not seen version 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        acc.accuracy_merge_into(spark, root, ten, "d", batch_id=2)
    monkeypatch.undo()
    assert snapshots.read_current(spark, root).first()["total_count"] == 20
