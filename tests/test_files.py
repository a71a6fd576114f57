"""Whole files as a source, named files as a sink, answers that stay, and headers as an assignment."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from veriform.operators import answers, assignment
from veriform.operators import respond as rs
from veriform.plans import calls as pc
from veriform.sinks import named_files as nf
from veriform.sinks import runs
from veriform.sources import folder as fl


def test_files_are_read_in_groups(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.txt").write_bytes(b"x" * i * 100)
    (tmp_path / ".f.txt").write_text("hidden")
    (tmp_path / "g.txt").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "f-broken.txt")
    df = fl.read_files(spark, str(tmp_path), "*.txt", ["f00.txt", "never.txt"], group_bytes=fl.OPEN_BYTES * 4)
    assert df.rdd.getNumPartitions() > 5
    rows = {r["file_path"]: r for r in df.collect()}
    assert len(rows) == 32 and {p.rsplit("/", 1)[0] for p in rows} == {f"file:{tmp_path}"}
    assert {p.rsplit("/", 1)[1] for p, r in rows.items() if r["error"]} == {"f-broken.txt", "never.txt"}
    assert all(r["file_size"] == len(r["content"]) for r in rows.values() if not r["error"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert fl.read_files(spark, f"file:{tmp_path}", "f01.txt").first()["file_path"] == f"file:{tmp_path}/f01.txt"


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert fl.read_files(spark, str(tmp_path)).count() == 0


def outputs(spark, rows):
    return spark.createDataFrame(rows, "output_name string, status string, output string")


def test_outputs_keep_their_names_and_earlier_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    first = runs.write_outputs(outputs(spark, [("a b:c=1%.txt", "success", "é one"), ("b.txt", "failed", "no"), ("c.txt", "success", "")]), folder)
    paths = {r["output_name"]: r["output_path"] for r in first.collect()}
    assert paths == {"a b:c=1%.txt": f"file:{folder}/a b:c=1%.txt", "b.txt": None, "c.txt": f"file:{folder}/c.txt"}
    second = runs.write_outputs(
        outputs(spark, [("d.txt", "success", "two"), ("c.txt", "success", "other"), ("x/y", "success", "z"), (None, "success", "z"), ("n" * 300, "success", "z"), ("a b:c=1%.txt", "success", "é one")]), folder)
    got = {r["output_name"]: r["output_path"] for r in second.collect()}
    bad = {n for n, p in got.items() if p == "save_failed"}
    assert bad == {"c.txt", "x/y", None, "n" * 300}
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.txt")} == {"a b:c=1%.txt": "é one", "c.txt": "", "d.txt": "two"}
    assert [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []


def test_a_name_given_twice_is_not_saved_twice(spark, tmp_path):
    done = runs.write_outputs(outputs(spark, [("a", "success", "1"), ("a", "success", "2"), ("b", "success", "3"), ("b", "success", "3")]), str(tmp_path / "o")).collect()
    assert sorted((r["output_name"], r["output_path"] == "save_failed") for r in done) == [("a", True), ("a", True), ("b", False), ("b", False)]
    assert runs.write_outputs(outputs(spark, []), str(tmp_path / "none")).count() == 0


def test_the_commit_counts_what_tasks_saved(spark, tmp_path):
    fl.register(spark, nf.NamedFiles)
    df = spark.range(50).select(F.when(F.col("id") % 10 == 3, "a/b").otherwise(F.concat("id", F.lit(".txt"))).alias("output_name"), F.lit(b"x").alias("content")).repartition(4)
    df.write.format("named_files").option("lists", str(tmp_path / "l")).mode("append").save(str(tmp_path / "o"))
    done = nf.committed(str(tmp_path / "l"))
    assert (done["saved"], done["failed"], len(done["lists"])) == (45, 5, 4)


def logged(path):
    return path.read_text().splitlines() if path.exists() else []


def test_equal_requests_are_asked_once_and_stored(spark, tmp_path):
    log = str(tmp_path / "log")

    def responder(request, instructions):
        with open(log, "a") as f:
            f.write(request + "\n")
        if request == "bad":
            raise ValueError("no")
        return instructions + request

    rows = [("a", "i"), ("a", "i"), ("a", "j"), ("bad", "i"), ("b", None)]
    df = spark.createDataFrame(rows, "request string, instructions string")
    store = str(tmp_path / "store")
    first = rs.respond(df, "request", "instructions", lambda r, i: responder(r, i or ""), tries=1, store=store)
    assert sorted((r["request"], r["content"], r["error"], r["meta"]["failed"]) for r in first.collect()) == [
        ("a", "ia", None, False), ("a", "ia", None, False), ("a", "ja", None, False), ("b", "b", None, False), ("bad", None, "no", True)]
    assert sorted(logged(tmp_path / "log")) == ["a", "a", "b", "bad"]
    rs.respond(df, "request", "instructions", lambda r, i: responder(r, i or ""), tries=1, store=store)
    assert sorted(logged(tmp_path / "log")) == ["a", "a", "b", "bad", "bad"]
    assert answers.stored(spark, store).count() == 3


def test_a_run_killed_half_way_asks_only_for_the_rest(spark, tmp_path):
    """The transport counts its calls; the task that makes the 41st call of the first run dies with its process."""
    log, store = tmp_path / "log", str(tmp_path / "store")

    def counting(payload, agent, log=str(log), limit=None):
        with open(log, "a") as f:
            f.write(agent["agent_name"] + payload.replace("\n", " ") + "\n")
        if limit and sum(1 for _ in open(log)) > limit:
            os._exit(1)
        return pc.transport(payload, agent)

    texts = [(i, f"text number {i} " * 30) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id int, t string")

    def votes(transport):
        made = rs.Calls(transport, pc.PROVIDERS, tries=1, sleep=pc.no_wait, concurrency=2, store=store, save_every=5)
        return rs.respond_votes(docs, pc.VERIFIERS, [F.concat(F.lit("now\n"), F.col("t"))] * 3, made)

    with pytest.raises(Exception, match="crash|Job aborted|exited"):
        votes(lambda p, a: counting(p, a, limit=40)).collect()
    before = logged(log)
    kept = answers.stored(spark, store).count()
    assert 20 <= kept <= len(before)
    voted = votes(counting)
    after = logged(log)[len(before):]
    assert voted.where("vote_ok_0").count() == 60
    # Two voters for all, a third where these differ; asked again is only what was not stored.
    wanted = 120 + voted.where("vote_asked = 3").count()
    assert len(after) == wanted - kept
    assert len(set(after)) == len(after)
    votes(counting)
    assert len(logged(log)) == len(before) + len(after)


def every_way(costs):
    """The best assignment by trying all."""
    best = None
    options = [[*c, None] for c in costs]
    for way in itertools.product(*options):
        taken = [p for p in way if p is not None]
        if len(taken) == len(set(taken)):
            key = (way.count(None), sum(c[p] for c, p in zip(costs, way, strict=True) if p is not None), [10**9 if p is None else p for p in way])
            if best is None or key < best[0]:
                best = key, list(way)
    return best[1] if best else []


def test_cheapest_is_the_best_of_all_ways():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(0, 5)
        places = rng.sample(range(20), rng.randint(0, 5))
        costs = [{p: rng.randint(0, 3) for p in places if rng.random() < 0.6} for _ in range(n)]
        assert assignment.cheapest(costs) == every_way(costs)


def test_a_header_that_loses_its_target_gets_the_next(spark):
    df = spark.createDataFrame([(1, ["LineTotalNet", "LineTotalNets", "x"]), (2, []), (3, None), (4, [None, "LineTotalNett"])], "id int, `my heads` array<string>")
    out = assignment.assign_headers(df, "my heads", ["LineTotalNett", "LineTotalNets"])
    got = {r["id"]: r["matches"] and [(m["target"], m["header"], m["score"]) for m in r["matches"]] for r in out.collect()}
    assert got[1] == [("LineTotalNett", "LineTotalNet", 2), ("LineTotalNets", "LineTotalNets", 0)]
    assert not got[2] and not got[3] and got[4] == [("LineTotalNett", "LineTotalNett", 0)]
