"""Reconciliation, paging, profiling and streaming on small tables, with hot keys and copies."""

import json
from collections import Counter

from pyspark.sql import functions as F

from veriform.operators import attempts as at
from veriform.operators import profile as pf
from veriform.operators import reconcile as rec
from veriform.operators.paging import with_pages
from veriform.sinks import json_text as js
from veriform.sinks import lines as ln
from veriform.sinks import runs, views
from veriform.sources import records as rc
from veriform.streaming.incremental import convert_stream, read_converted


def test_value_diff_with_copies_and_nulls(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (2, "c"), (3, None), (4, "x")], "k int, v string")
    out = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "n"), (5, None)], "k int, v string")
    assert sorted(map(tuple, rec.missing_rows(src, out, ["k"]).collect())) == [(2, 3, 2, "copies"), (4, 1, 0, "lost"), (5, 0, 1, "added")]
    assert {(r["k"], r["value"], r["surplus"]) for r in rec.value_diff(src, out, ["k"], ["v"]).collect()} == {
        (2, "b", 1), (3, None, 1), (3, "n", -1), (4, "x", 1), (5, None, -1),
    }
    assert rec.value_diff(src, src, ["k"], ["v"]).count() == 0
    two = (spark.createDataFrame([(1, x) for x in v], "k int, v string") for v in ("ab", "xy"))
    assert sorted((r["value"], r["surplus"]) for r in rec.value_diff(*two, ["k"], ["v"]).collect()) == [("a", 1), ("b", 1), ("x", -1), ("y", -1)]


def test_value_diff_against_brute_force(spark):
    rows = [(i % 7 if i % 3 else 0, str(i % 5)) for i in range(300)]
    other = [(i % 7 if i % 4 else 0, str(i % 6)) for i in range(280)]
    want = Counter(rows)
    want.subtract(Counter(other))
    got = rec.value_diff(spark.createDataFrame(rows, "k int, v string"), spark.createDataFrame(other, "k int, v string"), ["k"], ["v"]).collect()
    assert {(r["k"], r["value"]): r["surplus"] for r in got} == {k: n for k, n in want.items() if n}


def test_hot_groups_are_paged_and_whole(spark):
    # One key holds most rows, many of them copies of one row.
    rows = [(0, "same")] * 400 + [(0, str(i)) for i in range(200)] + [(k, "x") for k in range(1, 30)] + [(None, "y")] * 60
    df = spark.createDataFrame(rows, "k int, v string").repartition(4)
    paged = with_pages(df, ["k"], ["v"], 50)
    assert Counter((r["k"], r["v"]) for r in paged.collect()) == Counter(rows)
    assert paged.groupBy("k", "page").count().agg(F.max("count")).first()[0] == 50
    arrays = js.to_json_array(df, ["k"], ["v"], ["v"], 50).collect()
    for key in (0, 3, None):
        pages = sorted((r["page"], r["records"]) for r in arrays if r["k"] == key)
        assert [p for p, _ in pages] == list(range(len(pages)))
        assert [x["v"] for _, t in pages for x in json.loads(t)] == sorted(v for k, v in rows if k == key)
    whole = {r["k"]: r for r in js.to_json_array(df, ["k"], ["v"], ["v"]).collect()}
    assert whole[0]["n"] == 600 and [x["v"] for x in json.loads(whole[0]["records"])] == sorted(v for k, v in rows if k == 0)
    children = js.collect_children(df, ["k"], {"v": "v"}, {"last": F.max("v")}, 50).collect()
    assert {(r["n"], r["last"]) for r in children if r["k"] == 0} == {(600, "same")} and sum(len(r["items"]) for r in children) == len(rows)


def test_layout_of_a_file(spark):
    def summary(*texts):
        return tuple(rec.layout_summary(spark.createDataFrame(list(enumerate(texts)), "place int, line string"), ["a", "b"], "place").first())

    assert summary("a|b", "1|2", "x\\\\|y", "p\\|q|r") == (True, 0, 3, 0, True)
    assert summary("a|c", "1|2") == (False, 0, 1, 0, False)
    assert summary("WRONG|b", "1|2") == (False, 0, 1, 0, False)
    assert summary("1|2", "a|b") == (False, 1, 0, 0, False)
    assert summary("a|b", "a|b", "1") == (True, 1, 1, 1, False)


def test_values_are_written_whole_and_read_back(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.timestamp_micros(F.col("id") * 1_000_037).alias("t")).repartition(3)
        ln.write_csv(df, str(tmp_path / "csv"))
        ln.write_delimited(df, str(tmp_path / "pipe"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    back = rc.read_delimited(spark, str(tmp_path / "csv"), multi_line=False, schema="id long, x double, t timestamp")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert rc.read_delimited(spark, str(tmp_path / "pipe"), "|", multi_line=False).count() == 1000


def test_ranges_of_odd_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.00002), (float("nan"), 0.00004), (1e30, None)], "a double, b double")
    got = {r["name"]: tuple(r)[1:] for r in pf.numeric_ranges(df).collect()}
    assert got == {"a": (1.0, 1e30, 5e29, 1), "b": (0.00002, 0.00004, 0.00003, 0)}


def test_profile_of_texts(spark):
    rows = [("1", "1.5", "2025-01-01", "2025-01-01 10:00:00", "true", "x", "01/31/2025", None), ("-2", "3", "N/A", "2025-01-02", "FALSE", "1", "January 2, 2025", ""),
            ("99999999999999999999", "1e3", "2025-02-03", "2025-01-02 10:00:00", "true", "", "20250101x", " null ")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string")
    got = {r["name"]: (r["data_type"], r["nullable"]) for r in pf.profile_columns(df).collect()}
    assert got == {
        "a": ("float", False), "b": ("float", False), "c": ("date", True), "d": ("datetime", False), "e": ("boolean", False), "f": ("string", True),
        "g": ("string", False), "h": ("string", True),
    }
    nested = pf.nest_profile(pf.profile_columns(df, samples=True))
    profile = nested.select(F.struct(F.col("format"), F.col("columns")).alias("p"), "columns").first()
    assert [c["name"] for c in profile["columns"]] == list("abcdefgh") and profile["columns"][5]["samples"] == ["1", "x"]
    assert nested.select(pf.profile_valid(F.struct("format", "columns")).alias("v")).first()["v"]["ok"]


def test_run_log_replaces_a_repeated_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "success", None)], "id int, status string, note string")
    for run in ("r1", "r1", "r2"):
        runs.write_run_log(df, str(tmp_path / "log"), "2025-02-01", run)
    back = runs.read_run_log(spark, str(tmp_path / "log"), "id int, status string, note string, run_date string, run_id string")
    assert sorted(r["run_id"] for r in back.collect()) == ["r1", "r2"]


def test_output_names(spark):
    df = spark.createDataFrame([("a/b/in.v1.csv",), ("c/in.v1.csv",), ("/x/.hidden",)], "p string")
    plain = [r[0] for r in df.select(runs.output_name(F.col("p"), "20250201-101500")).collect()]
    assert plain == ["in.v1-20250201-101500.txt", "in.v1-20250201-101500.txt", ".hidden-20250201-101500.txt"]
    assert df.select(runs.output_name(F.col("p"), "t", "csv", F.col("p")).alias("n")).distinct().count() == 3


def test_stream_converts_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    args = (spark, str(folder), "*.txt", lambda b: b.withColumn("value", F.upper("value")), str(tmp_path / "out"), str(tmp_path / "state"))
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "skip.log").write_text("no")
    convert_stream(*args).awaitTermination()
    (folder / "b.txt").write_text("three")
    convert_stream(*args).awaitTermination()
    convert_stream(*args).awaitTermination()
    assert sorted(r["value"] for r in read_converted(spark, str(tmp_path / "out")).collect()) == ["ONE\nTWO", "THREE"]


def test_view_names_that_clean_to_one_alias(spark):
    profile = spark.createDataFrame([(0, "Order #", "string"), (1, "order -", "integer"), (2, "1st", "float")], "position int, name string, data_type string")
    assert views.view_ddl(profile, "v", "t").first()["ddl"].split("\n")[2:5] == [
        '  CAST("Order #" AS VARCHAR) AS Order__,', '  CAST("order -" AS INTEGER) AS order___2,', '  CAST("1st" AS FLOAT) AS _1st']


def test_names_with_dots(spark):
    df = spark.createDataFrame([("x", "<output>good</output>")], "`a.b` string, t string")
    vote = F.struct(F.lit(True).alias("isvalid"), F.lit(None).cast("string").alias("invalid_msg"))
    out = at.convert_with_retry(df, lambda i, notes: F.col("t"), lambda o: [vote] * 3)
    assert out.select("`a.b`", "status").first() == ("x", "success")
    assert at.attempts_long(out, ["a.b"]).count() == 1
    assert json.loads(js.to_json_array(df, ["a.b"], ["a.b", "t"], ["t"]).first()["records"])[0]["a.b"] == "x"
