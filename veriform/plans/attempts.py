"""Queries for conversion attempts, status and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.functions.text import extract_block, parse_output
from veriform.operators import attempts as at
from veriform.operators import checks as ck
from veriform.operators import voting as vt
from veriform.plans import stand_ins as si
from veriform.plans.registry import query, table
from veriform.plans.scalars import tag_sql
from veriform.plans.voting import VOTES_SQL, voters
from veriform.session import materialise, scratch
from veriform.sinks import runs
from veriform.sources import documents as dc

# Converters on pages: the title, then the first heading, then the first paragraph, markup and all.
SOURCES = ("title", "h1", "p")


def piece_sql(i: int) -> str:
    blank = "case when page_id % 5 = 0 then '' else {x} end" if i == 0 else "{x}"
    return blank.format(x=f"regexp_extract(html, '(?is)<{SOURCES[i]}[^>]*>(.*?)</{SOURCES[i]}>', 1)")


# An answer without the section ends the run: attempt 1 of every eleventh page.
def answer_sql(i: int) -> str:
    wrapped = f"concat('<output>', {piece_sql(i)}, '</output>')"
    return f"case when page_id % 11 = 0 then 'no section' else {wrapped} end" if i == 1 else wrapped


def convert(i: int, notes):
    # One regular expression per attempt; the page is read again only for rejected rows.
    return F.expr(answer_sql(i))


MIN_LEN, MAX_LEN = 12, 80


def judges(out):
    return [
        vt.vote_of(ck.not_empty(out)),
        vt.vote_of(ck.check(~out.rlike("[<&]"), "Markup left")),
        vt.vote_of(ck.check((F.length(out) >= MIN_LEN) & (F.length(out) <= MAX_LEN), "Length not in range")),
    ]


def attempt_sql(i: int) -> str:
    """Votes on attempt ``i`` of every page: (page_id, attempt, o, v0, v1, v2, approved, total, feedback, outcome)."""
    return f"""select *, case when o is null then 'conversion_error' when approved >= 2 then 'success' else 'rejected' end as outcome from (
  select page_id, {i} as attempt, o, v0::int + v1::int + case when v0 <> v1 then v2::int else 0 end as approved, case when v0 <> v1 then 3 else 2 end as total,
    array_to_string(list_filter([case when not v0 then 'Empty data' end, case when not v1 then 'Markup left' end,
      case when v0 <> v1 and not v2 then 'Length not in range' end], lambda x: x is not null), chr(10) || chr(10)) as feedback
  from (select page_id, o, o <> '' as v0, not regexp_matches(o, '[<&]') as v1, length(o) between {MIN_LEN} and {MAX_LEN} as v2
    from (select page_id, {tag_sql('a', '<output>', '</output>', '*')} as o from (select page_id, {answer_sql(i)} as a from pages))))"""


ATTEMPTS_CTE = f"""a0 as ({attempt_sql(0)}), a1 as (select x.* from ({attempt_sql(1)}) x join a0 using (page_id) where a0.outcome = 'rejected'),
a2 as (select x.* from ({attempt_sql(2)}) x join a1 using (page_id) where a1.outcome = 'rejected'),
tried as (select * from a0 union all select * from a1 union all select * from a2)"""


def converted(spark, sf):
    return at.convert_with_retry(table(spark, sf, "pages"), convert, judges)


@query(
    "conversion_attempts",
    f"""with {ATTEMPTS_CTE} select page_id, attempt, o as output, case when o is null then 0 else approved end as approved, case when o is null then 0 else total end as total,
  coalesce(feedback, '') as feedback, outcome from tried""".replace("coalesce(feedback, '')", "case when o is null then '' else feedback end"),
)
def conversion_attempts(spark, sf):
    return at.attempts_long(converted(spark, sf), ["page_id"])


@query("first_passing", f"with {ATTEMPTS_CTE} select page_id, attempt, o as output, approved, total from tried where outcome = 'success'")
def first_passing(spark, sf):
    return at.select_attempt(independent_attempts(table(spark, sf, "pages")), ["page_id"])


def independent_attempts(pages):
    """A log of all three attempts of every page, made without stopping at the first approved one."""
    work, kept = pages.select("page_id", "html"), F.lit(True)
    rows = []
    for i in range(len(SOURCES)):
        out = f"o{i}"
        work = vt.ask(work.withColumn(out, parse_output(convert(i, None))), judges(F.col(out)), f"v{i}")
        outcome = F.when(vt.passed(f"v{i}"), "success").otherwise("rejected")
        row = F.struct(
            F.lit(i).alias("attempt"), F.col(out).alias("output"), vt.approved(f"v{i}").alias("approved"), vt.asked(f"v{i}").alias("total"), outcome.alias("outcome")
        )
        # Nothing follows an answer without its section.
        kept = kept & F.col(out).isNotNull()
        rows.append(F.when(kept, row))
    return work.select("page_id", F.inline_outer(F.array_compact(F.array(*rows)))).filter("outcome is not null")


# The whole run on documents: missing text, verification, answers by attempt, validation.
def doc_answer(i: int) -> str:
    # A damaged answer is the text without most of its letters.
    return f"""case when doc_id % 23 = 0 then 'no section' when doc_id % 6 <= {i} then concat('<output>', t, '</output>')
  when doc_id % 6 = 3 then '<output></output>' else concat('<output>', translate(t, 'abcdefghijklmnopqrstuvwx', ''), '</output>') end"""


def doc_convert(i: int, notes):
    return F.expr(doc_answer(i))


def doc_judges(out):
    return [
        vt.vote_of(ck.check(F.length(out) >= 20, "Too short")),
        vt.vote_of(ck.check(F.length(out) * 2 >= F.length("t"), "Text lost")),
        vt.vote_of(ck.not_empty(out)),
    ]


LOADED = f"case when doc_id % 19 = 0 then null else {si.PLANTED} end"


def ran(spark, sf):
    docs = si.documents_with(spark, sf, "t", LOADED).select("doc_id", "t")
    return at.run_documents(docs, "t", voters(), doc_convert, doc_judges)


def doc_vote_sql(i: int) -> str:
    o = f"trim(regexp_extract({doc_answer(i)}, '(?is)<output>(.*)</output>', 1), {si.WS})"
    return f"(length({o}) >= 20)::int + (length({o}) * 2 >= length(t))::int + ({o} <> '')::int >= 2"


STATUS_SQL = f"""select doc_id, case when doc_id % 19 = 0 then 'load_error' when v.v0::int + v.v1::int + v.v2::int < 2 then 'pre-verification_failed'
  when doc_id % 23 = 0 then 'conversion_error' when p0 or p1 or p2 then 'success' else 'failed' end as status,
  case when doc_id % 19 = 0 or v.v0::int + v.v1::int + v.v2::int < 2 then null when doc_id % 23 = 0 or p0 then 0 when p1 then 1 when p2 then 2 else 3 end as retries
from (select doc_id, {doc_vote_sql(0)} as p0, {doc_vote_sql(1)} as p1, {doc_vote_sql(2)} as p2 from (select doc_id, {si.PLANTED} as t from documents)) join ({VOTES_SQL}) v using (doc_id)"""


@query("final_status", STATUS_SQL)
def final_status(spark, sf):
    return ran(spark, sf).select("doc_id", "status", "retries")


# Two runs into the same folders, an hour apart; names hold signs that paths escape, and one in a while is no name.
RUNS = {"r1": "20250201-101500", "r2": "20250201-111500"}
BAD_NAME = "doc_id % 31 = 4"


# What the log must hold: every document of each run, and where each success was written; what is there has the right size.
@query(
    "run_log",
    f"""select doc_id, status, cast(retries as integer) as retries, '2025-02-01' as run_date, run_id, status = 'success' and not {BAD_NAME} as saved, status = 'success' and {BAD_NAME} as not_saved,
  case when status = 'success' and not {BAD_NAME} then doc_id || ' a=b:1%-' || stamp || '.txt' end as output_name
from ({STATUS_SQL}), (values {", ".join(f"('{k}', '{v}')" for k, v in RUNS.items())}) t(run_id, stamp)""",
)
def run_log(spark, sf):
    log, outputs = scratch(spark, "run-log"), scratch(spark, "outputs")
    results = materialise(ran(spark, sf).select("doc_id", "status", "retries", "output", "notes"))
    for run_id, stamp in RUNS.items():
        name = F.when(F.expr(BAD_NAME), F.lit("no/name")).otherwise(runs.output_name(F.concat("doc_id", F.lit(" a=b:1%.csv")), stamp))
        written = runs.write_outputs(results.withColumn("output_name", name), outputs)
        runs.write_run_log(written.withColumn("bytes", F.octet_length("output")).drop("output"), log, "2025-02-01", run_id)
    back = runs.read_run_log(
        spark, log, "doc_id bigint, status string, retries int, notes string, output_name string, output_path string, bytes bigint, run_date string, run_id string")
    files = dc.read_folder(spark, outputs, "*.txt").select(F.col("file_path").alias("output_path"), F.col("file_size").alias("size"))
    found = back.join(files, "output_path", "left").withColumn("saved", F.coalesce(F.col("size") == F.col("bytes"), F.lit(False)))
    return found.select("doc_id", "status", "retries", "run_date", "run_id", "saved", F.coalesce(F.col("output_path") == "save_failed", F.lit(False)).alias("not_saved"),
                        F.when(F.col("saved"), F.col("output_name")).alias("output_name"))


@query("run_summary", f"select status, count(*) as n, round(sum(coalesce(retries, 0)) / count(*), 4) as mean_retries from ({STATUS_SQL}) group by status")
def run_summary(spark, sf):
    return at.run_summary(ran(spark, sf))


# Generation: attempt 1 has no block on some pages; the last rejected one is kept.
def generated_sql(i: int) -> str:
    start, end = "<<<YAML_OUTPUT_START>>>", "<<<YAML_OUTPUT_END>>>"
    none = f"when page_id % 7 = {i} then '' " if i < 3 else "when page_id % 13 = 0 then '' "
    return f"case {none} else concat('{start} ', {piece_sql(i - 1)}, ' {end}') end"


def block_sql(i: int) -> str:
    return f"nullif(trim(regexp_extract(g{i}, '<<<YAML_OUTPUT_START>>>((?s).*?)<<<YAML_OUTPUT_END>>>', 1), {si.WS}), '')"


def block_vote(i: int) -> str:
    return f"(b{i} is not null and (b{i} <> '')::int + (not regexp_matches(b{i}, '[<&]'))::int + (length(b{i}) between {MIN_LEN} and {MAX_LEN})::int >= 2)"


@query(
    "accept_last",
    f"""select page_id, case when p1 or p2 or b3 is not null then 'success' else 'failed' end as status, case when p1 then 1 when p2 then 2 else 3 end as attempts,
  p1 or p2 or coalesce(p3, false) as passed, case when p1 then b1 when p2 then b2 else b3 end as block
from (select *, {block_vote(1)} as p1, {block_vote(2)} as p2, {block_vote(3)} as p3 from (select page_id, {block_sql(1)} as b1, {block_sql(2)} as b2, {block_sql(3)} as b3
  from (select page_id, {generated_sql(1)} as g1, {generated_sql(2)} as g2, {generated_sql(3)} as g3 from pages)))""",
)
def accept_last(spark, sf):
    made = at.generate_with_retry(table(spark, sf, "pages"), lambda i, notes: F.expr(generated_sql(i)), extract_block, judges)
    return made.select("page_id", "status", "attempts", "passed", "block")
