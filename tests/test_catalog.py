"""Commits, counted writes, catalog defaults, table functions, footers, variants and bodies from files."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from faultline.operators import accuracy as acc
from faultline.operators import replies as rpl
from faultline.operators import reports as rep
from faultline.session import scratch_path
from faultline.sources import catalog, snapshots
from faultline.sources.tables import footer_scan, json_array_records, read_json_bodies

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_dead_writer_blocks_nobody(spark):
    root = scratch_path(spark, "test-dead", uuid.uuid4().hex)
    one = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    assert snapshots.upsert_into(spark, root, one("a"), "k") == 0
    for left in (f"{root}/v={1:012d}", f"{root}/new-dead"):  # killed while writing
        one("half").write.parquet(left)
        os.remove(f"{left.removeprefix('file:')}/_SUCCESS")
    assert snapshots.committed_versions(spark, root) == [0]
    assert snapshots.upsert_into(spark, root, one("b"), "k") == 2
    assert snapshots.upsert_into(spark, root, one("c"), "k") == 3
    assert _rows(snapshots.read_current(spark, root)) == [(1, "c")]
    with pytest.raises(FileExistsError, match="PATH_ALREADY_EXISTS"):
        snapshots.create_version(one("late"), root, 3)
    assert _rows(snapshots.read_current(spark, root)) == [(1, "c")]
    counts = spark.createDataFrame([("d", 3, 1)], "d string, total_count long, correct_count long")
    stats = scratch_path(spark, "test-dead", uuid.uuid4().hex)
    counts.write.parquet(f"{stats}/v={0:012d}")
    os.remove(f"{stats.removeprefix('file:')}/v={0:012d}/_SUCCESS")
    assert [acc.accuracy_merge_into(spark, stats, counts, "d") for _ in range(2)] == [1, 2]
    assert snapshots.read_current(spark, stats).first()["total_count"] == 6


def test_counts_of_the_pass_that_writes(spark):
    root = scratch_path(spark, "test-seen", uuid.uuid4().hex)
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    src = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, "c", 1), (None, "x", 1), (None, "y", 2)], "k long, v string, o int")
    v, counts = snapshots.upsert_into_observed(spark, root, src, "k", ["o"], initial=base)
    assert (v, counts) == (0, {"total_sent": 5, "uploaded": 4, "inserted": 3, "updated": 1})
    assert sorted(map(str, _rows_any(snapshots.read_current(spark, root)))) == sorted(map(str, [(1, "a"), (2, "BB"), (3, "c"), (None, "n"), (None, "x"), (None, "y")]))
    v, counts = snapshots.upsert_into_observed(spark, root, src.limit(0), "k", ["o"])
    assert (v, counts) == (1, {"total_sent": 0, "uploaded": 0, "inserted": 0, "updated": 0})


def _rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_declared_defaults_fill_what_an_insert_leaves_out(spark):
    t = catalog.create_table(spark, catalog.ANALYSIS_FLAGS, "analyses")
    catalog.insert(spark, t, spark.createDataFrame([(1, "x")], "analysis_id long, input_text string"))
    catalog.insert(spark, t, spark.createDataFrame([(None, 2, True)], "input_type string, analysis_id long, llm_used boolean"))
    got = {r.analysis_id: r for r in spark.table(t).collect()}
    assert (got[1].input_type, got[1].has_pdf, got[1].llm_used, got[1].input_text) == ("text", False, False, "x")
    assert (got[2].input_type, got[2].has_video, got[2].llm_used, got[2].input_text) == (None, False, True, None)
    assert got[1].created_at is not None


def test_a_table_function_takes_its_parameter(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string").createOrReplaceTempView("tf_rows")
    f = catalog.table_function(spark, "pick", "want INT DEFAULT 2", "v STRING", "SELECT v FROM tf_rows WHERE k = want")
    assert _rows(spark.sql(f"SELECT * FROM {f}()")) == [("b",), ("c",)]
    assert _rows(spark.sql(f"SELECT * FROM {f}(1)")) == [("a",)]


def test_counts_come_from_the_footers(spark):
    df = rep.row_counts(n=footer_scan(spark, f"{SF}/events.parquet"))
    assert df.first()["n"] == spark.read.parquet(f"{SF}/events.parquet").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    # the session's other reads are as before
    assert "BatchScan" not in spark.read.parquet(f"{SF}/events.parquet")._jdf.queryExecution().executedPlan().toString()


def test_only_the_paths_that_are_read_are_scanned(spark):
    df = E.queries()["video_stored_variant"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "raw_json:struct" in schema and "variant" not in schema.split("\n")[0].replace("__VARIANT_METADATA_KEY", "")
    assert df.count() > 0


def test_bodies_come_from_files(spark):
    path = scratch_path(spark, "test-bodies", uuid.uuid4().hex)
    bodies = ['{"records":[{"a":1},\n {"a":[2]}]}', '{"records":[]}', '{"other":1}', "no json", '{"records":[3,null]}']
    spark.createDataFrame([(b, i) for i, b in enumerate(bodies)], "value string, file int").write.partitionBy("file").text(path)
    assert read_json_bodies(spark, path).count() == 5
    assert sorted(r.raw_json for r in json_array_records(read_json_bodies(spark, path), "body").collect()) == ["3", "null", '{"a":1}', '{"a":[2]}']


def test_replies_are_one_value_and_nothing_more(spark):
    end = rpl.END
    texts = ['{"a":1}', '{"a":1}] {"b":1}', '{"a":1} x', "1,2", "", "null", '"x"', f'1,"{end}"] x', f'{{"a":"{end}"}}', f'1,"{end.replace("~", chr(92) + "u007e")}"]', '{"a":"\\u00e9"}',
             "1]", "[1]", "[1],", '{"a":1}}', ' {"a": [1, {"b":2}]} ']
    import json

    def ok(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.ok for r in df.select("i", rpl.strict_parse(F.col("t")).isNotNull().alias("ok")).orderBy("i").collect()]
    assert got == [ok(t) for t in texts]


def test_whole_numbers_of_video_records(spark):
    from faultline.operators import ingest as ing

    given = ["7", "-3", "007", "+5", " 6", "12.0", "12.000", "33.5", "", "word", "99999999999", "-0", "1e3", "2147483647", "2147483648.0"]
    rows = spark.createDataFrame([(i, '{"video_name":"v","accident_place":"%s"}' % g) for i, g in enumerate(given)], "i int, raw_json string")
    got = {r.i: (r.accident_place, r.odd_values) for r in ing.flatten_video_records(rows, keep=["i"]).collect()}
    want = {"7": 7, "-3": -3, "007": 7, "12.0": 12, "12.000": 12, "-0": 0, "2147483647": 2147483647}
    assert got == {i: (want.get(g), None if g in want else f"accident_place={g}") for i, g in enumerate(given)}
