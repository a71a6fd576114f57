"""Queries that run a responder or a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import respond as rs
from veriform.plans import stand_ins as si
from veriform.plans.registry import query, table
from veriform.plans.sources import PER_FILE
from veriform.session import scratch
from veriform.streaming.incremental import convert_stream, read_converted


def answer(request: str, instructions: str) -> str:
    """A responder without a model: the request in tags; fails on requests without text."""
    if not request.strip():
        raise ValueError("empty request")
    return f"<output>{request}</output><isvalid>{len(request) > 100}</isvalid>"


def no_wait(seconds: float) -> None:
    """A local responder needs no pause between tries."""


@query(
    "respond_batch",
    """select doc_id, case when doc_id % 13 <> 0 then '<output>' || text || '</output><isvalid>' || case when length(text) > 100 then 'True' else 'False' end || '</isvalid>' end as content,
  case when doc_id % 13 = 0 then 'empty request' end as error, case when doc_id % 13 = 0 then 2 else 0 end as retry_count, doc_id % 13 = 0 as failed from documents""",
)
def respond_batch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).otherwise(F.lit(" ")).alias("request"), F.lit("Echo.").alias("instructions"))
    answered = rs.respond(docs, "request", "instructions", answer, tries=2, sleep=no_wait)
    return answered.select("doc_id", "content", "error", F.col("meta.retry_count").alias("retry_count"), F.col("meta.failed").alias("failed"))


def answer_again(request: str, instructions: str) -> str:
    return answer(request, instructions).replace("<output>", "<output>again ")


@query(
    "respond_stored",
    """select doc_id, case when doc_id % 13 <> 0 then '<output>' || case when even then '' else 'again ' end || text || '</output><isvalid>' || case when length(text) > 100 then 'True' else 'False' end || '</isvalid>' end as content,
  case when doc_id % 13 = 0 then 'empty request' end as error, doc_id % 13 = 0 as failed
from (select *, bool_or(doc_id % 2 = 0 and doc_id % 13 <> 0) over (partition by text) as even from documents)""",
)
def respond_stored(spark, sf):
    """Half of the documents are asked first; a later run, which would answer otherwise, asks only for what is not stored."""
    store = scratch(spark, "answers")
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).otherwise(F.lit(" ")).alias("request"), F.lit("Echo.").alias("instructions"))
    rs.respond(docs.where(F.col("doc_id") % 2 == 0), "request", "instructions", answer, tries=1, sleep=no_wait, store=store)
    answered = rs.respond(docs, "request", "instructions", answer_again, tries=1, sleep=no_wait, store=store)
    return answered.select("doc_id", "content", "error", F.col("meta.failed").alias("failed"))


# A provider without a model: it reads the request out of either layout and answers by the agent's role.
PROVIDERS = {"local": {"request_format": "openai", "default_model": "lab/echo"}, "other": {"request_format": "anthropic", "default_model": "lab/judge"}}


def transport(payload: str, agent) -> str:
    import json

    body = json.loads(payload)
    request, told = body["messages"][-1]["content"], body.get("system") or body["messages"][0]["content"]
    if agent["agent_role"] not in told:
        raise ValueError("instructions of another agent")
    text = request.partition("\n")[2]
    if agent["agent_role"] == "verify":
        word = "" if agent["agent_name"] == "v0" and len(text) % 29 == 7 else str(len(text) >= int(agent["agent_name"][1:]) * 300)
        content = f"<isvalid>{word}</isvalid><invalid_msg>{agent['agent_name']}</invalid_msg>"
    elif agent["agent_role"] == "convert":
        attempt, (notes, text) = int(request.partition(" ")[0]), text.rsplit("\n", 1)
        if len(text) % 23 == 5:
            raise ValueError("busy")
        wrong = len(text) % 7 > 3 and attempt < len(text) % 7 - 3
        content = text if len(text) % 31 == 3 else f"<output>{'wrong ' * wrong}{text.replace('a', 'A')}</output>{notes and '.'}"
    else:
        content = f"<isvalid>{not text.startswith('wrong ')}</isvalid><invalid_msg>starts wrong</invalid_msg>"
    if "system" in body:
        return json.dumps({"content": [{"type": "text", "text": content}]})
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": content}}]})


VERIFIERS = [rs.Agent(f"v{i}", "verify", "You verify.", "{<!--DateTime-->}\n{<!--Data-->}", provider=(None, "other", "local")[i], temperature=0.1 * i) for i in range(3)]
CONVERTER = rs.Agent("c", "convert", "You convert.", "{<!--RunIndex-->} {<!--DateTime-->}\n{<!--PreviousConversionNotes-->}\n{<!--Data-->}", provider="other", model="lab/writer")
VALIDATORS = [rs.Agent(f"w{i}", "compare", "You compare.", "{<!--DateTime-->}\n{<!--Output-->}", provider=(None, "other", "nowhere")[i]) for i in range(3)]
# Documents whose text is missing, or holds a marker that no one fills.
CALLED = "case when doc_id % 19 = 0 then null when doc_id % 17 = 0 then concat(text, ' {<!--Output-->}') else translate(text, concat(chr(10), chr(13)), '  ') end"


def calling():
    return rs.Calls(transport, PROVIDERS, tries=2, sleep=no_wait, rows_per_task=500)


def called_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(CALLED).alias("t"))


READ_CALLED = f"select doc_id, t, length(t) as n from (select doc_id, {CALLED} as t from documents)"
VERIFY_SQL = f"""select *, case when held then false when n % 29 = 7 then null else true end as v0, not held and n >= 300 as v1, not held and n >= 600 as v2
from (select *, contains(t, '{{<!--Output-->}}') as held from ({READ_CALLED}) where t is not null)"""


@query(
    "called_votes",
    f"""select doc_id, case when v0 <> v1 then 3 else 2 end as asked, v0 as first, v1 as second, case when v0 <> v1 then v2 end as third, case when held then 'Agent error: Unreplaced placeholders in request' else 'v1' end as second_msg,
  'other' as provider, 'lab/judge' as model, cast(0.1 as double) as temperature, 'verify' as agent_role from ({VERIFY_SQL})""",
)
def called_votes(spark, sf):
    from veriform.functions import text as tx

    docs = called_docs(spark, sf).filter("t is not null")
    requests = [tx.render_template(a.request, {tx.DATA: F.col("t"), tx.DATE_TIME: F.lit("now")}) for a in VERIFIERS]
    voted = rs.respond_votes(docs, VERIFIERS, requests, calling())
    meta = F.col("vote_meta_1")
    return voted.select(
        "doc_id", F.col("vote_asked").alias("asked"), F.col("vote_ok_0").alias("first"), F.col("vote_ok_1").alias("second"), F.col("vote_ok_2").alias("third"),
        F.col("vote_msg_1").alias("second_msg"), meta["provider"].alias("provider"), meta["model"].alias("model"), meta["temperature"].alias("temperature"), meta["agent_role"].alias("agent_role"))


@query(
    "called_run",
    f"""select doc_id, status, case when status in ('load_error', 'vote_error', 'pre-verification_failed') then null when status = 'conversion_error' then 0 when status = 'failed' then 3 else tries end as retries,
  case when status = 'success' then md5(trim(replace(t, 'a', 'A'), {si.WS})) end as output
from (select *, greatest(n % 7 - 3, 0) as tries, case when t is null then 'load_error' when v0 is null then 'vote_error' when v0::int + v1::int + case when v0 <> v1 then v2::int else 0 end < 2 then 'pre-verification_failed'
  when n % 23 = 5 or n % 31 = 3 then 'conversion_error' when n % 7 - 3 >= 3 then 'failed' else 'success' end as status
from ({READ_CALLED}) left join (select doc_id, v0, v1, v2 from ({VERIFY_SQL})) using (doc_id))""",
)
def called_run(spark, sf):
    done = rs.run_with_calls(called_docs(spark, sf), "doc_id", "t", VERIFIERS, CONVERTER, VALIDATORS, calling(), "2025-02-01 00:00:00")
    return done.select("doc_id", "status", F.col("retries").cast("bigint").alias("retries"), F.md5("output").alias("output"))


@query("stream_convert", "select replace(line, 'e', '_') as line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by 1")
def stream_convert(spark, sf):
    folder, out, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    docs = table(spark, sf, "documents")

    def convert(batch):
        text = F.regexp_replace("value", r"\n\z", "")
        return batch.select("file_path", F.replace(text, F.lit("e"), F.lit("_")).alias("value"))

    # Two runs over a growing folder: the second sees the new files only.
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).select("text").write.mode("append").option("maxRecordsPerFile", PER_FILE).text(folder)
        convert_stream(spark, folder, "*.txt", convert, out, state).awaitTermination()
    lines = read_converted(spark, out).select(F.explode(F.split("value", "\n", -1)).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
