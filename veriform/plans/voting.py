"""Queries for votes and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import checks as ck
from veriform.operators import voting as vt
from veriform.plans import stand_ins as si
from veriform.plans.checks import FAMILIES_SQL
from veriform.plans.registry import query, table
from veriform.plans.scalars import tag_sql

# Three voters on documents: length, share of letters, hostile content.
LOW, HIGH, LETTERS = 200, 20000, 0.6


def voters(text: str = "t"):
    t = F.col(text)
    length = ck.check((F.length(t) >= LOW) & (F.length(t) <= HIGH), "Length out of range")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    share = ck.check(letters >= LETTERS * F.length(t), "Too few letters")
    return [vt.vote_of(length), vt.vote_of(share), vt.vote_of(ck.no_injection(t))]


VOTES_SQL = f"""select doc_id, quality_key, length(t) between {LOW} and {HIGH} as v0, 'Length out of range' as m0,
  length(regexp_replace(t, '[^\\pL]', '', 'g')) >= {LETTERS} * length(t) as v1, 'Too few letters' as m1,
  nullif(concat_ws(', ', {FAMILIES_SQL}), '') is null as v2, 'Suspicious content: ' || nullif(concat_ws(', ', {FAMILIES_SQL}), '') as m2
from (select doc_id, doc_id as quality_key, {si.PLANTED} as t from documents)"""
LONG_SQL = f"""select doc_id, 0 as agent_idx, v0 as isvalid, case when not v0 then m0 end as invalid_msg from ({VOTES_SQL})
union all select doc_id, 1, v1, case when not v1 then m1 end from ({VOTES_SQL}) union all select doc_id, 2, v2, case when not v2 then m2 end from ({VOTES_SQL})"""


def planted(spark, sf):
    return si.documents_with(spark, sf, "t", si.PLANTED).select("doc_id", "t")


def long_votes(spark, sf):
    """All three votes of every document, one row each."""
    return vt.to_long(vt.ask_all(planted(spark, sf), voters()), ["doc_id"])


@query("consensus", f"select doc_id, count_if(isvalid) as approved, count(*) as total, count_if(isvalid) >= 2 as passed from ({LONG_SQL}) group by doc_id".replace("count_if(isvalid)", "cast(count_if(isvalid) as bigint)"))
def consensus(spark, sf):
    return vt.consensus(long_votes(spark, sf), ["doc_id"])


EARLY = "case when v0 = v1 then null else v2 end"


@query(
    "consensus_early_exit",
    f"select doc_id, case when v0 = v1 then 2 else 3 end as asked, v0::int + v1::int + coalesce({EARLY}, false)::int as approved, v0::int + v1::int + v2::int >= 2 as passed from ({VOTES_SQL})",
)
def consensus_early_exit(spark, sf):
    voted = vt.ask(planted(spark, sf), voters())
    return voted.select("doc_id", vt.asked().alias("asked"), vt.approved().alias("approved"), vt.passed().alias("passed"))


# Answers of three voters: readable, unreadable by rotation, failed calls.
def answer(i: int) -> str:
    yes = {0: "length(text) >= 200", 1: "length(replace(text, 'a', '')) % 3 <> 0", 2: "not contains(text, 'ch')"}[i]
    return f"""case when doc_id % 17 = 0 and (doc_id % 51) / 17 = {i} then concat('<isvalid></isvalid> ', text)
  when {yes} then concat('<verification><isvalid>True</isvalid></verification> ', text)
  else concat('<isvalid>false</isvalid><invalid_msg>voter {i} says no to ', lang, ': ', text, '</invalid_msg>') end"""


def failure(i: int) -> str:
    return f"case when doc_id % 29 = {i} then 'timeout' end"


MESSAGE_SQL = "select doc_id, " + ", ".join(
    f"{answer(i)} as c{i}, {failure(i)} as e{i}" for i in range(3)
) + " from documents"
READ_SQL = "select doc_id, " + ", ".join(
    f"case when e{i} is not null then false else lower(nullif({tag_sql(f'c{i}', '<isvalid>', '</isvalid>')}, '')) = 'true' end as v{i}, "
    f"case when e{i} is not null then 'Agent error: ' || e{i} else nullif({tag_sql(f'c{i}', '<invalid_msg>', '</invalid_msg>')}, '') end as m{i}"
    for i in range(3)
) + f" from ({MESSAGE_SQL})"


def answered(spark, sf):
    docs = table(spark, sf, "documents")
    votes = [vt.vote_of_message(F.expr(answer(i)), F.expr(failure(i))) for i in range(3)]
    return docs, votes


@query("vote_errors", f"select doc_id, v0 as first_valid, m0 as first_msg, v1 as second_valid, m1 as second_msg from ({READ_SQL})")
def vote_errors(spark, sf):
    docs, votes = answered(spark, sf)
    return vt.ask_all(docs, votes).select(
        "doc_id", F.col("vote_ok_0").alias("first_valid"), F.col("vote_msg_0").alias("first_msg"),
        F.col("vote_ok_1").alias("second_valid"), F.col("vote_msg_1").alias("second_msg"),
    )


FATAL = "v0 is null or v1 is null"
ASKED3 = f"not ({FATAL}) and v0 <> v1"


@query(
    "vote_unreadable",
    f"""select doc_id, case when {ASKED3} then 3 else 2 end as asked, coalesce(v0, false)::int + coalesce(v1, false)::int + (case when {ASKED3} then coalesce(v2, false) else false end)::int as approved,
  case when {FATAL} then 'vote_error' when coalesce(v0, false)::int + coalesce(v1, false)::int + (case when {ASKED3} then coalesce(v2, false) else false end)::int >= 2 then 'passed' else 'rejected' end as outcome
from ({READ_SQL})""",
)
def vote_unreadable(spark, sf):
    docs, votes = answered(spark, sf)
    outcome = F.when(vt.unreadable(), "vote_error").when(vt.passed(), "passed").otherwise("rejected")
    return vt.ask(docs, votes).select("doc_id", vt.asked().alias("asked"), vt.approved().alias("approved"), outcome.alias("outcome"))


@query(
    "consensus_rules",
    f"""select doc_id, n >= 2 as two_of_three, n = 3 as unanimous, n * 2 > 3 as majority from (select doc_id, v0::int + v1::int + v2::int as n from ({VOTES_SQL}))""",
)
def consensus_rules(spark, sf):
    voted = vt.ask_all(planted(spark, sf), voters())
    return voted.select(
        "doc_id", vt.passed(rule="2_of_3").alias("two_of_three"), vt.passed(rule="unanimous").alias("unanimous"), vt.passed(rule="majority").alias("majority")
    )


@query(
    "vote_tally",
    f"""select doc_id, cast(count_if(isvalid) as bigint) as approved, count(*) as total, count_if(isvalid) >= 2 as passed,
  string_agg(agent_idx || ':' || isvalid || ':' || coalesce(invalid_msg, ''), ';' order by agent_idx) as results from ({LONG_SQL}) group by doc_id""",
)
def vote_tally(spark, sf):
    shown = F.transform("results", lambda r: F.concat_ws(":", r["agent_idx"].cast("string"), r["isvalid"].cast("string"), F.coalesce(r["invalid_msg"], F.lit(""))))
    return vt.tally(long_votes(spark, sf), ["doc_id"]).select("doc_id", "approved", "total", "passed", F.array_join(shown, ";").alias("results"))


def against(i: int, none: str, text: str) -> str:
    was_asked = f"({ASKED3})" if i == 2 else "true"
    return f"case when {was_asked} and not coalesce(v{i}, {none}) then coalesce(m{i}, '{text}') end"


@query(
    "vote_feedback",
    f"""select doc_id, array_to_string(list_filter([{", ".join(against(i, 'true', '') for i in range(3))}], lambda x: x is not null), chr(10) || chr(10)) as feedback,
  'Attempt 1 validation failed (' || coalesce(v0, false)::int + coalesce(v1, false)::int + (case when {ASKED3} then coalesce(v2, false) else false end)::int || '/' || (case when {ASKED3} then 3 else 2 end)
  || ' approved).  Issues: ' || array_to_string(list_filter([{", ".join(against(i, 'false', 'Unknown reason') for i in range(3))}], lambda x: x is not null), '; ') as retry_note
from ({READ_SQL})""".replace("|| coalesce(v0", "|| (coalesce(v0").replace("false) else false end)::int || '/'", "false) else false end)::int) || '/'"),
)
def vote_feedback(spark, sf):
    docs, votes = answered(spark, sf)
    return vt.ask(docs, votes).select("doc_id", vt.feedback().alias("feedback"), vt.retry_note(1).alias("retry_note"))


@query(
    "majority_accuracy",
    f"""select n, round(p, 4) as voter_accuracy, round(p * p * (3 - 2 * p), 4) as expected, round(measured, 4) as measured from (
select count(*) as n, sum((v0 = good)::int + (v1 = good)::int + (v2 = good)::int) / (3.0::double * count(*)) as p,
  sum((v0::int + v1::int + v2::int >= 2 = good)::int) / count(*)::double as measured
from (select quality = 1 as good, v.* from labels join ({VOTES_SQL}) v using (doc_id)))""".replace("(v0::int + v1::int + v2::int >= 2 = good)", "((v0::int + v1::int + v2::int >= 2) = good)"),
)
def majority_accuracy(spark, sf):
    # Joined first, so that only labelled documents are voted on.
    labelled = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good")).join(planted(spark, sf), "doc_id")
    joined = vt.ask_all(labelled, voters()).select("good", *[F.col(f"vote_ok_{i}").alias(f"v{i}") for i in range(3)], vt.passed().alias("passed"))
    right = sum(((F.col(f"v{i}") == F.col("good")).cast("int") for i in range(3)), F.lit(0))
    facts = joined.agg(
        F.count(F.lit(1)).alias("n"), (F.sum(right) / (3.0 * F.count(F.lit(1)))).alias("p"), (F.count_if(F.col("passed") == F.col("good")) / F.count(F.lit(1))).alias("measured")
    )
    return facts.select(
        "n", F.round("p", 4).alias("voter_accuracy"), F.round(vt.majority_accuracy(F.col("p")), 4).alias("expected"), F.round("measured", 4).alias("measured")
    )


@query("voter_agreement", f"select agent_idx, isvalid, count(*) as n from ({LONG_SQL}) group by agent_idx, isvalid")
def voter_agreement(spark, sf):
    return vt.agreement(long_votes(spark, sf))
