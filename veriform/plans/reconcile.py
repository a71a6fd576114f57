"""Queries that compare outputs with inputs, and the settings of agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import agents as ag
from veriform.operators import pairing
from veriform.operators import profile as pf
from veriform.operators import reconcile as rec
from veriform.operators.checks import json_parses
from veriform.plans.registry import query, table
from veriform.sinks import json_text as js
from veriform.sinks import lines as ln

# The source, and a damaged copy: keys lost, a key twice, keys added, totals and states changed.
SOURCE_SQL = "select o_orderkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as total, strftime(o_orderdate, '%Y-%m-%d') as day from orders"
DAMAGED_SQL = f"""select case when o_orderkey % 211 = 0 then -o_orderkey - 1 else o_orderkey end as o_orderkey, case when o_orderkey % 89 = 0 then null else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 97 = 0 then cast(total + 1 as decimal(18,2)) else total end as total, day from ({SOURCE_SQL}) cross join (values (1), (2)) c(copy)
where o_orderkey % 101 <> 0 and (copy = 1 or o_orderkey % 307 = 0)"""


def source(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


def damaged(spark, sf):
    key = F.col("o_orderkey")
    copies = F.when(key % 307 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = source(spark, sf).filter(key % 101 != 0).withColumn("copy", F.explode(copies))
    return rows.select(
        F.when(key % 211 == 0, -key - 1).otherwise(key).alias("o_orderkey"), F.when(key % 89 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 97 == 0, (F.col("total") + 1).cast("decimal(18,2)")).otherwise(F.col("total")).alias("total"), "day",
    )


@query(
    "missing_rows",
    f"""select coalesce(s.k, d.k) as o_orderkey, coalesce(s.n, 0) as n_source, coalesce(d.n, 0) as n_output,
  case when d.n is null then 'lost' when s.n is null then 'added' else 'copies' end as kind
from (select o_orderkey as k, count(*) as n from ({SOURCE_SQL}) group by 1) s full join (select o_orderkey as k, count(*) as n from ({DAMAGED_SQL}) group by 1) d using (k)
where s.n is distinct from d.n""",
)
def missing_rows(spark, sf):
    return rec.missing_rows(source(spark, sf), damaged(spark, sf), ["o_orderkey"])


def diff_sql(c: str) -> str:
    # Values left over on each side once equal ones have cancelled.
    return f"""select o_orderkey, '{c}' as "column", v as value, cast(sum(side) as bigint) as surplus from (select o_orderkey, cast({c} as varchar) as v, 1 as side from ({SOURCE_SQL})
  union all select o_orderkey, cast({c} as varchar), -1 from ({DAMAGED_SQL})) group by o_orderkey, v having sum(side) <> 0"""


@query("value_diff", " union all ".join(diff_sql(c) for c in ("o_orderstatus", "total", "day")))
def value_diff(spark, sf):
    return rec.value_diff(source(spark, sf), damaged(spark, sf), ["o_orderkey"], ["o_orderstatus", "total", "day"])


LAYOUT = ["o_orderkey", "o_orderstatus", "total", "day"]


def layout_lines(spark, sf):
    """Six files of lines with their places; headers exact, wrong, missing, repeated, at the end, and in other case."""
    rows = source(spark, sf)
    line = ln.delimited_line(rows, LAYOUT)
    hurt = (
        F.when(F.col("o_orderkey") % 103 == 0, F.regexp_replace(line, r"\|[^|]*$", "")).when(F.col("o_orderkey") % 107 == 0, F.concat(line, F.lit("|x")))
        .otherwise(line)
    )
    head = "|".join(LAYOUT)
    heads = [(0, 0, head), (1, 0, "WRONG|" + "|".join(LAYOUT[1:])), (3, 0, head), (3, 1 << 40, head), (4, 1 << 40, head), (5, 0, head.upper())]
    body = rows.select((F.col("o_orderkey") % 6).cast("int").alias("file"), (F.col("o_orderkey") + 1).cast("bigint").alias("place"), hurt.alias("line"))
    # A file without a header at its start begins with its first record.
    least = body.where("file in (2, 4)").groupBy("file").agg(F.min("place").alias("least"))
    body = body.join(F.broadcast(least), "file", "left").select("file", F.when(F.col("place") == F.col("least"), F.lit(0)).otherwise(F.col("place")).cast("bigint").alias("place"), "line")
    return body.unionByName(spark.createDataFrame(heads, "file int, place bigint, line string"))


BAD_SQL = "case when o_orderkey % 103 = 0 then 3 when o_orderkey % 107 = 0 then 5 else 4 end"
FIRST_SQL = "o_orderkey % 6 in (2, 4) and o_orderkey = min(o_orderkey) over (partition by o_orderkey % 6)"


@query(
    "layout_check",
    f"""select reason, count(*) as n from (select case when first then 'Header differs' when {BAD_SQL} <> 4 then 'Expected 4 fields, found ' || {BAD_SQL} else 'fine' end as reason
  from (select *, {FIRST_SQL} as first from orders)
  union all select unnest(['fine', 'Header differs', 'fine', 'Header repeated', 'Header repeated', 'Header differs'])) group by reason""",
)
def layout_check(spark, sf):
    checked = layout_lines(spark, sf).select(rec.layout_check(F.col("line"), LAYOUT, header=F.col("place") == 0).alias("c"))
    return checked.groupBy(F.coalesce("c.reason", F.lit("fine")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "layout_summary",
    f"""select file, file in (0, 3) as header_ok, cast(case when file in (3, 4) then 1 else 0 end as bigint) as repeats, count(*) as records, count(*) filter (where f <> 4) as bad,
  file = 0 and count(*) filter (where f <> 4) = 0 as ok
from (select cast(o_orderkey % 6 as integer) as file, {BAD_SQL} as f, {FIRST_SQL} as first from orders) where not first group by file""",
)
def layout_summary(spark, sf):
    return rec.layout_summary(layout_lines(spark, sf), LAYOUT, "place", ["file"])


@query(
    "format_compliance",
    """select o_orderkey, o_orderkey % 11 <> 0 as date_ok, o_orderkey % 13 <> 0 as total_ok, o_orderkey % 17 <> 0 as json_ok, o_orderkey % 19 <> 0 as type_ok, o_orderkey % 23 <> 0 as csv_ok from orders""",
)
def format_compliance(spark, sf):
    k = F.col("o_orderkey")
    rows = source(spark, sf)
    work = rows.withColumns({
        "d": F.when(k % 11 == 0, F.when(k % 2 == 0, F.lit("2024-02-30")).otherwise(F.regexp_replace("day", "-", "/"))).otherwise(F.col("day")),
        "t": F.when(k % 13 == 0, F.concat(F.lit("$"), F.col("total").cast("string"))).otherwise(F.col("total").cast("string")),
        "j": F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("total").cast("double").alias("total")), js.KEEP_NULLS),
        "c": F.concat_ws(",", F.lit('"a, ""b"""'), F.col("day")),
    })
    work = work.withColumns({
        "j": F.when(k % 17 == 0, F.concat("j", F.lit("}"))).otherwise(F.col("j")),
        "q": F.when(k % 19 == 0, F.regexp_replace("j", r'"id":(\d+)', '"id":"$1"')).otherwise(F.col("j")),
        "c": F.when(k % 23 == 0, F.concat("c", F.lit(',"'))).otherwise(F.col("c")),
    })
    return work.select(
        "o_orderkey", rec.iso_date_ok(F.col("d"))["ok"].alias("date_ok"), rec.two_decimals_ok(F.col("t"))["ok"].alias("total_ok"),
        json_parses(F.col("j"))["ok"].alias("json_ok"), rec.json_type_ok(F.col("q"), "id", "BIGINT")["ok"].alias("type_ok"),
        rec.csv_layout_check(F.col("c"), 2)["ok"].alias("csv_ok"),
    )


PROVIDERS = {
    "local": {"request_format": "openai", "default_model": None},
    "openai": {"request_format": "openai", "default_model": "model-a"},
    "anthropic": {"request_format": "anthropic", "default_model": "model-b"},
    "google": {"request_format": "google", "default_model": "lab/model-c"},
}

# One agent per turn of a conversation: settings given, left out, or unknown.
AGENT = """case turn % 5 when 0 then null when 1 then 'openai' when 2 then 'anthropic' when 3 then 'google' else 'nowhere' end as provider,
  case when conv_id % 3 = 0 then concat('own/', role) end as model, case when conv_id % 4 = 0 then cast(0.2 as double) end as temperature"""
AGENTS_SQL = f"select conv_id, turn, text, {AGENT} from conversations"
RESOLVED_SQL = f"""select conv_id, turn, text, p as use_provider, coalesce(model, case p when 'openai' then 'model-a' when 'anthropic' then 'model-b' when 'google' then 'lab/model-c' end, 'base/model') as use_model,
  coalesce(temperature, 0.7::double) as use_temperature, case p when 'anthropic' then p when 'google' then p when 'nowhere' then null else 'openai' end as request_format,
  case when p = 'nowhere' then 'Provider ''nowhere'' not configured' end as error from (select *, coalesce(provider, 'local') as p from ({AGENTS_SQL}))"""


def agents(spark, sf):
    turns = table(spark, sf, "conversations")
    provider = F.expr("case turn % 5 when 0 then null when 1 then 'openai' when 2 then 'anthropic' when 3 then 'google' else 'nowhere' end")
    made = turns.select(
        "conv_id", "turn", "text", provider.alias("provider"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("own/"), "role")).alias("model"),
        F.when(F.col("conv_id") % 4 == 0, F.lit(0.2)).alias("temperature"),
    )
    return ag.resolve_agents(made, PROVIDERS, default_model="base/model", default_temperature=0.7)


@query("resolve_agents", f"select conv_id, turn, use_provider, use_model, use_temperature, request_format, error from ({RESOLVED_SQL})")
def resolve_agents(spark, sf):
    return agents(spark, sf).select("conv_id", "turn", "use_provider", "use_model", "use_temperature", "request_format", "error")


BASE = "regexp_extract(use_model, '[^/]*$', 0)"


@query(
    "request_payloads",
    f"""select conv_id, turn, cast(case request_format when 'anthropic' then to_json(struct_pack(model := {BASE}, max_tokens := 10000, temperature := use_temperature, "system" := 'Check it.',
    messages := [struct_pack(role := 'user', content := text)]))
  when 'google' then to_json(struct_pack(contents := [struct_pack(role := 'user', parts := [struct_pack("text" := 'Check it.')]), struct_pack(role := 'user', parts := [struct_pack("text" := text)])],
    generationConfig := struct_pack(temperature := use_temperature, maxOutputTokens := 8192)))
  else to_json(struct_pack(model := {BASE}, temperature := use_temperature, stream := false, messages := [struct_pack(role := 'system', content := 'Check it.'), struct_pack(role := 'user', content := text)])) end as varchar) as payload
from ({RESOLVED_SQL}) where error is null""",
)
def request_payloads(spark, sf):
    known = agents(spark, sf).filter("error is null")
    payload = ag.to_request(F.col("request_format"), F.col("use_model"), F.col("use_temperature"), F.lit("Check it."), F.col("text"))
    return known.select("conv_id", "turn", payload.alias("payload"))


@query(
    "response_content",
    "select conv_id, turn, case when conv_id % 10 <> 9 then text end as content from conversations",
)
def response_content(spark, sf):
    fmt = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("google")), (F.col("turn") % 3 + 1).cast("int"))
    text = F.col("text")
    answer = (
        F.when(F.col("conv_id") % 10 == 9, F.lit('{"error": {"message": "busy"}}'))
        .when(fmt == "openai", F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"))).alias("choices"))))
        .when(fmt == "anthropic", F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", ag.from_response(answer, fmt).alias("content"))


DECLARED = [("c_custkey", 0, "integer", False), ("c_name", 2, "string", False), ("c_nationkey", 1, "integer", True), ("c_acctbal", 3, "integer", False), ("c_phone", 4, "string", True)]


@query(
    "profile_check",
    """select * from (values ('c_name', 'position 2 is 1'), ('c_nationkey', 'position 1 is 2'), ('c_phone', 'not in data'), ('c_mktsegment', 'not in profile')) t(name, problem)
union all select 'c_nationkey', 'nullable true is false' from customer having count(*) filter (where c_nationkey is null) = 0
union all select 'c_acctbal', 'type integer is float' from customer having bool_or(c_acctbal <> round(c_acctbal))""",
)
def profile_check(spark, sf):
    declared = spark.createDataFrame(DECLARED, "name string, position int, data_type string, nullable boolean")
    return rec.profile_check(declared, pf.profile_columns(pf.as_text(table(spark, sf, "customer"))))


SPEC = [("CustomerID", "c_custkey", "number"), ("Name", "c_name", "text"), ("Balance", "c_acctbal", "date"), ("Phone", "c_phone", "text"), ("Region", None, "text")]


@query(
    "spec_coverage",
    """select * from (values ('Phone', 'c_phone', 'not in profile'), ('Region', null, 'no source')) t(target, source, problem)
union all select 'Balance', 'c_acctbal', 'float does not fit date' from customer having bool_or(c_acctbal <> round(c_acctbal))""",
)
def spec_coverage(spark, sf):
    spec = spark.createDataFrame(SPEC, "target string, source string, kind string")
    profile = pf.profile_columns(pf.as_text(table(spark, sf, "customer")))
    allowed = {"number": ["integer", "float"], "text": ["string", "integer", "float", "boolean", "date", "datetime"], "date": ["date", "datetime"]}
    return rec.spec_coverage(spec, profile, allowed)


# The required sections that a document's specification has: some left out, some blank.
HAS = [f"case when doc_id % {i + 2} = 0 then null when doc_id % {i + 5} = 0 then ' ' else text end" for i in range(len(rec.SPEC_SECTIONS))]


@query(
    "missing_sections",
    f"select doc_id, array_to_string(list_filter([{', '.join(f"""case when trim(coalesce({h}, '')) = '' then '{s}' end""" for h, s in zip(HAS, rec.SPEC_SECTIONS, strict=True))}], lambda x: x is not null), ',') as missing from documents",
)
def missing_sections(spark, sf):
    sections = F.map_from_arrays(F.array(*[F.lit(s) for s in rec.SPEC_SECTIONS]), F.array(*[F.expr(h) for h in HAS]))
    present = F.map_filter(sections, lambda _, v: v.isNotNull())
    return table(spark, sf, "documents").select("doc_id", F.array_join(rec.missing_sections(present), ",").alias("missing"))


FIELDS = ("o_orderstatus", "total", "day")


def pairs_sql() -> str:
    """Rounds of numbering the rows that are left in their blocks, said with windows."""
    steps = [
        f"src as ({SOURCE_SQL})", f"dam as ({DAMAGED_SQL})",
        "lost0 as (select *, row_number() over (order by o_orderkey, o_orderstatus, total, day) as id from src where o_orderkey not in (select o_orderkey from dam))",
        "added0 as (select *, row_number() over (order by o_orderkey, o_orderstatus, total, day) as id from dam where o_orderkey not in (select o_orderkey from src))",
    ]
    rounds = [None, *FIELDS]
    for r, changed in enumerate(rounds):
        block = [f for f in FIELDS if f != changed]
        for side in ("lost", "added"):
            steps.append(f"{side}_placed{r} as (select *, row_number() over (partition by {', '.join(block)} order by o_orderkey, o_orderstatus, total, day, id) as place from {side}{r})")
        same = " and ".join(f"l.{f} is not distinct from a.{f}" for f in block)
        said = f"'{changed}'" if changed else "cast(null as varchar)"
        steps.append(f"pairs{r} as (select l.o_orderkey as lost_o_orderkey, a.o_orderkey as added_o_orderkey, {said} as changed, l.id as l, a.id as a from lost_placed{r} l join added_placed{r} a on {same} and l.place = a.place)")
        for side in ("lost", "added"):
            steps.append(f"{side}{r + 1} as (select * from {side}{r} where id not in (select {side[0]} from pairs{r}))")
    return f"with {', '.join(steps)} " + " union all ".join(f"select lost_o_orderkey, added_o_orderkey, changed from pairs{r}" for r in range(len(rounds)))


@query("paired_rows", pairs_sql())
def paired_rows(spark, sf):
    return pairing.paired_rows(source(spark, sf), damaged(spark, sf), ["o_orderkey"], FIELDS)
