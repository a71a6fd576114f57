import itertools

import pytest
from pyspark.sql import functions as F

from veriform.operators import attempts as at
from veriform.operators import respond as rs
from veriform.operators import voting as vt

CASES = list(itertools.product([True, False, None], repeat=3))


def reference_run(votes):
    """Votes kept, approvals and decision, written out for one document."""
    if votes[0] is None or votes[1] is None:
        return 2, sum(v is True for v in votes[:2]), False
    kept = votes[:2] if votes[0] == votes[1] else votes
    yes = sum(v is True for v in kept)
    return len(kept), yes, yes >= 2


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean")


def votes():
    return [F.struct(F.col(x).alias("isvalid"), F.when(~F.col(x), F.lit(f"no {x}")).alias("invalid_msg")) for x in "abc"]


def test_early_exit_all_cases(cases):
    got = vt.ask(cases, votes()).select("id", vt.asked().alias("n"), vt.approved().alias("y"), vt.passed().alias("p"), vt.unreadable().alias("u"), vt.feedback().alias("f")).collect()
    for r in got:
        case = CASES[r["id"]]
        assert (r["n"], r["y"], r["p"]) == reference_run(case), case
        assert r["u"] == (case[0] is None or case[1] is None)
        kept = case[: r["n"]]
        assert r["f"] == "\n\n".join(f"no {x}" for x, v in zip("abc", kept, strict=False) if v is False)


def test_early_exit_decides_as_all_three(cases):
    readable = cases.filter("a is not null and b is not null and c is not null")
    early = vt.ask(readable, votes()).select("id", vt.passed().alias("p"))
    full = vt.consensus(vt.to_long(vt.ask_all(readable, votes()), ["id"]), ["id"]).select("id", F.col("passed").alias("p"))
    assert sorted(early.collect()) == sorted(full.collect())


def test_tally_and_rules(cases):
    long = vt.to_long(vt.ask(cases, votes()), ["id"])
    rows = {r["id"]: r for r in vt.tally(long, ["id"]).collect()}
    for i, case in enumerate(CASES):
        n, yes, _ = reference_run(case)
        assert (rows[i]["total"], rows[i]["approved"]) == (n, yes)
        assert [v["agent_idx"] for v in rows[i]["results"]] == list(range(n))
    for rule in vt.RULES:
        assert vt.consensus(long, ["id"], rule).count() == len(CASES)
    with pytest.raises(ValueError):
        vt.decide(F.lit(1), F.lit(2), "other")
    with pytest.raises(ValueError):
        vt.ask(cases, votes()[:2])


def test_retry_note_counts_unreadable_as_against(cases):
    row = vt.ask(cases.filter("a and not b and c is null"), votes()).select(vt.retry_note(2).alias("n")).first()
    assert row["n"] == "Attempt 2 validation failed (1/3 approved).  Issues: no b; Unknown reason"


def judge(out):
    ok = F.contains(out, F.lit("good"))
    vote = F.struct(F.coalesce(ok, F.lit(False)).alias("isvalid"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("bad")).alias("invalid_msg"))
    return [vote, vote, vote]


def test_attempts_and_status(spark):
    plans = {
        "first": ["<output>good</output>"], "second": ["<output>x</output>", "<output>good 2</output>"], "never": ["<output>x</output>"] * 3,
        "none": ["no tags"], "blank": [""], "empty": ["<output></output>", "<output>good</output>"], "third": ["<output>x</output>"] * 2 + ["<OUTPUT>good</OUTPUT>"],
    }
    df = spark.createDataFrame([(k, v + [None] * (3 - len(v))) for k, v in plans.items()], "k string, answers array<string>")
    out = at.convert_with_retry(df, lambda i, notes: F.get("answers", i), judge)
    got = {r["k"]: (r["status"], r["retries"], r["output"], len(r["attempts"])) for r in out.collect()}
    assert got == {
        "first": ("success", 0, "good", 1), "second": ("success", 1, "good 2", 2), "never": ("failed", 3, None, 3), "none": ("conversion_error", 0, None, 1),
        "blank": ("conversion_error", 0, None, 1), "empty": ("success", 1, "good", 2), "third": ("success", 2, "good", 3),
    }
    assert {r["k"]: r["attempt"] for r in at.select_attempt(at.attempts_long(out, ["k"]), ["k"]).collect()} == {"first": 0, "second": 1, "empty": 1, "third": 2}
    # A filter on the result must not write the attempts out again.
    assert out.filter("status = 'success'").count() == 4


def test_notes_reach_the_next_attempt(spark):
    df = spark.createDataFrame([("a",)], "k string")
    out = at.convert_with_retry(df, lambda i, notes: F.concat(F.lit("<output>good if "), notes, F.lit("</output>")) if i else F.lit("<output>x</output>"), judge)
    assert out.first()["output"] == "good if bad\n\nbad"


def test_run_documents_gates(spark):
    df = spark.createDataFrame([("a", "good"), ("b", None), ("c", "evil"), ("d", "odd")], "k string, t string")
    t = F.col("t")
    read = F.struct(F.when(t != "odd", t != "evil").alias("isvalid"), F.lit("m").alias("invalid_msg"))
    out = at.run_documents(df, "t", [read, read, read], lambda i, n: F.concat(F.lit("<output>"), t, F.lit("</output>")), judge)
    assert {r["k"]: r["status"] for r in out.collect()} == {"a": "success", "b": "load_error", "c": "pre-verification_failed", "d": "vote_error"}


def no_wait(_):
    return None


def test_calls_retry_and_never_raise(spark):
    seen = []

    def flaky(request, instructions):
        seen.append(request)
        if len(seen) < 3:
            raise RuntimeError("busy")
        return "done"

    waits = []
    assert rs.call(flaky, "r", "i", 3, 2, waits.append)[:2] == ("done", None) and waits == [1, 2]
    assert rs.call(lambda r, i: 1 / 0, "r", "i", 2, 2, no_wait)[1] == "division by zero"


PROVIDERS = {"local": {"request_format": "openai", "default_model": None}, "b": {"request_format": "google", "default_model": "x/m"}}


@pytest.fixture
def calls():
    """A provider; defined here so that it travels to the workers by value."""

    def transport(payload, agent):
        import json

        body = json.loads(payload)
        if "contents" in body:
            told, request = (c["parts"][0]["text"] for c in body["contents"])
        else:
            told, request = (m["content"] for m in body["messages"])
        assert told == f"as {agent['agent_role']}"
        if request == "boom":
            raise RuntimeError("down")
        if agent["agent_role"] == "converter":
            text = "<output>good</output>" if "again" in request or request.startswith("a") else ("nothing" if request.startswith("n") else "<output>x</output>")
        else:
            text = f"<isvalid>{'bad' not in request and request != 'x'}</isvalid><invalid_msg>again {agent['agent_name']}</invalid_msg>"
        if "contents" in body:
            return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})
        return json.dumps({"choices": [{"message": {"content": text}}]})

    return rs.Calls(transport, PROVIDERS, tries=1, sleep=lambda s: None, rows_per_task=2)


def agents(role, request, providers=(None, "b", None)):
    return [rs.Agent(f"{role}{i}", role, f"as {role}", request, provider=p, temperature=0.2) for i, p in enumerate(providers)]


def test_called_votes(spark, calls):
    df = spark.createDataFrame([(1, "good", "bad", "good"), (2, "good", "good", "boom"), (3, "boom", "good", "{<!--Data-->}")], "id int, a string, b string, c string")
    out = rs.respond_votes(df, agents("voter", ""), [F.col(c) for c in "abc"], calls)
    got = {r["id"]: r for r in out.collect()}
    assert [(got[i]["vote_asked"], got[i]["vote_ok_2"]) for i in (1, 2, 3)] == [(3, True), (2, None), (3, False)]
    assert got[3]["vote_msg_0"] == "Agent error: down" and got[3]["vote_msg_2"] == f"Agent error: {rs.MARKERS_LEFT}"
    meta = got[1]["vote_meta_1"]
    assert (meta["agent_name"], meta["agent_role"], meta["provider"], meta["model"], meta["temperature"], meta["failed"]) == ("voter1", "voter", "b", "x/m", 0.2, False)
    assert got[2]["vote_meta_2"] is None and got[3]["vote_meta_0"]["failed"]


def test_unknown_provider_is_a_vote_against(spark, calls):
    df = spark.createDataFrame([(1, "good")], "id int, a string")
    row = rs.respond_votes(df, agents("voter", "", ("nowhere", None, None)), [F.col("a")] * 3, calls).first()
    assert (row["vote_ok_0"], row["vote_msg_0"], row["vote_asked"]) == (False, "Agent error: Provider 'nowhere' not configured", 3)


def test_called_run(spark, calls):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "n"), (4, None), (5, "bad"), (6, "boom"), (7, "c {<!--Output-->}")], "id int, t string")
    converter = rs.Agent("c", "converter", "as converter", "{<!--Data-->}{<!--PreviousConversionNotes-->}")
    out = rs.run_with_calls(df, "id", "t", agents("verifier", "{<!--Data-->}"), converter, agents("validator", "{<!--Output-->}"), calls, "now")
    assert {r["id"]: (r["status"], r["retries"], r["output"]) for r in out.collect()} == {
        1: ("success", 0, "good"), 2: ("success", 1, "good"), 3: ("conversion_error", 0, None), 4: ("load_error", None, None), 5: ("pre-verification_failed", None, None),
        6: ("pre-verification_failed", None, None), 7: ("pre-verification_failed", None, None),
    }


def test_markers_left_stop_a_conversion(spark, calls):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    converter = rs.Agent("c", "converter", "as converter", "{<!--Data-->} {<!--Output-->}")
    row = rs.run_with_calls(df, "id", "t", agents("verifier", "{<!--Data-->}"), converter, agents("validator", "{<!--Output-->}"), calls, "now").first()
    assert (row["status"], row["notes"]) == ("conversion_error", rs.MARKERS_LEFT)


def test_feedback_searches_each_tag_of_a_vote_a_few_times_only(spark):
    from veriform.plans import voting as pv

    plan = pv.vote_feedback(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 6 <= plan.count("regexp_extract(") <= 12


def test_rows_dealt_once_are_not_dealt_again(spark, calls):
    df = spark.range(10).repartition(5)
    assert calls.dealt(df, again=True) is df and calls.dealt(df).rdd.getNumPartitions() == 6


def test_requests_are_taken_out_of_a_batch_in_small_parts():
    import pyarrow as pa

    from veriform.operators import answers

    batch = pa.RecordBatch.from_pydict({"key": list("abcdef"), "text": ["x" * 40, None, "y" * 40, "z" * 500, "", "é" * 30]})
    got = list(answers.parts(batch.slice(1), "text", 100))
    assert [p.column("key").to_pylist() for p in got] == [["b", "c"], ["d"], ["e", "f"]]
