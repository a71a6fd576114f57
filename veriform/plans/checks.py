"""Queries for the input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import checks as ck
from veriform.operators import mapping as mp
from veriform.operators.profile import as_text
from veriform.plans import stand_ins as si
from veriform.plans.registry import query, table
from veriform.plans.sources import NO_SCRIPT, duck_tag
from veriform.sources import records as rc


def matched(spark, sf):
    return mp.match_frame(si.header_files(spark, sf), "headers", si.TARGET, si.SYNONYMS)


def opened(df, key: str, checked):
    return df.select(key, checked.alias("c")).select(key, "c.ok", "c.reason")


TARGET_LIST = ", ".join(f"({i}, '{t}')" for i, t in enumerate(si.TARGET))


@query(
    "required_all",
    f"""with {si.MATCH_CTE}, w(idx, target) as (values {TARGET_LIST}),
m as (select d.doc_id, string_agg(w.target, ', ' order by w.idx) filter (where matched.target is null) as gone
  from documents d cross join w left join matched on matched.doc_id = d.doc_id and matched.idx = w.idx group by d.doc_id)
select doc_id, gone is null as ok, 'Missing fields: ' || gone as reason from m""",
)
def required_all(spark, sf):
    return opened(matched(spark, sf), "doc_id", ck.required_all(F.col("matches"), si.TARGET))


@query(
    "required_most",
    f"""with {si.MATCH_CTE}, m as (select d.doc_id, count(matched.target) as n from documents d left join matched on matched.doc_id = d.doc_id group by d.doc_id)
select doc_id, n * 2 > 7 as ok, case when n * 2 <= 7 then 'Only ' || n || ' of 7 fields present' end as reason from m""",
)
def required_most(spark, sf):
    return opened(matched(spark, sf), "doc_id", ck.required_most(F.col("matches"), si.TARGET))


@query(
    "mandatory_fields",
    f"""select page_id, t is not null and g is not null as ok, case when t is null and g is null then 'Missing: title, heading' when t is null then 'Missing: title'
  when g is null then 'Missing: heading' end as reason
from (select page_id, case when page_id % 5 <> 0 then {duck_tag('title')} end as t, case when page_id % 7 <> 0 then {duck_tag('h1')} end as g
  from (select page_id, {NO_SCRIPT} as h from pages))""",
)
def mandatory_fields(spark, sf):
    pages = rc.extract_html(table(spark, sf, "pages"), "html", {"title": rc.tag_text("title"), "heading": rc.tag_text("h1")}, ["page_id"])
    title = F.when(F.col("page_id") % 5 != 0, F.col("title"))
    heading = F.when(F.col("page_id") % 7 != 0, F.col("heading")).otherwise(F.lit(" "))
    return opened(pages, "page_id", ck.mandatory({"title": title, "heading": heading}))


# JSON, a small table and mark-up, each broken in some rows.
MIXED = """case event_id % 8 when 0 then props when 1 then concat(props, '}') when 2 then concat('a,b', chr(10), event_type, ',"1,2"')
  when 3 then concat('a,b', chr(10), event_type) when 4 then concat('<e><t>', event_type, '</t></e>') when 5 then concat('<e><t>', event_type, '</e>')
  when 6 then concat('<html><body>', event_type, case when user_id % 3 = 0 then '<p>a<br>b<p>c<!-- </div> --><script>"</b>"</script>' when user_id % 3 = 1 then '<IMG src=x><b>q</B>' else '' end, '</body></html>')
  else case user_id % 5 when 0 then concat('<html><body>', event_type, '</html>') when 1 then concat('</html><html >', event_type) when 2 then concat('<div><b>', event_type, '</div>')
    when 3 then concat('<div><b>', event_type, '</div></b>') else concat('<div>', event_type, '</div></div>') end end"""


@query(
    "parseable",
    """select event_id, event_id % 2 = 0 as ok, case event_id % 8 when 1 then 'Not valid JSON' when 3 then 'Rows do not line up' when 5 then 'Not well-formed XML'
  when 7 then 'Unbalanced tags' end as reason from events""",
)
def parseable(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.expr(MIXED).alias("t"))
    kind = F.floor((F.col("event_id") % 8) / 2)
    checked = (
        F.when(kind == 0, ck.json_parses(F.col("t"))).when(kind == 1, ck.lines_align(F.col("t"), ","))
        .when(kind == 2, ck.xml_parses(F.col("t"))).otherwise(ck.tags_balance(F.col("t")))
    )
    return opened(events, "event_id", checked)


@query("not_empty", f"select doc_id, trim(t, {si.WS}) <> '' as ok, case when trim(t, {si.WS}) = '' then 'Empty data' end as reason from (select doc_id, {si.PLANTED} as t from documents)")
def not_empty(spark, sf):
    return opened(si.documents_with(spark, sf, "t", si.PLANTED), "doc_id", ck.not_empty(F.col("t")))


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# The formula pattern without looking back, which DuckDB cannot.
PLAIN_PATTERNS = {**ck.INJECTION_PATTERNS, "formula": r"""(?m)(^|[,;|\t])["']?(=[A-Za-z(]|@[A-Za-z]|[+-][A-Za-z(])"""}
FAMILIES_SQL = ", ".join(f"case when regexp_matches(t, {sql_text(p)}) then '{f}' end" for f, p in PLAIN_PATTERNS.items())


@query(
    "injection_flags",
    f"select doc_id, f is null as ok, 'Suspicious content: ' || f as reason from (select doc_id, nullif(concat_ws(', ', {FAMILIES_SQL}), '') as f from (select doc_id, {si.PLANTED} as t from documents))",
)
def injection_flags(spark, sf):
    return opened(si.documents_with(spark, sf, "t", si.PLANTED), "doc_id", ck.no_injection(F.col("t")))


@query(
    "corruption_flags",
    rf"select doc_id, not bad as ok, case when bad then 'Invalid or control characters' end as reason from (select doc_id, regexp_matches({si.PLANTED}, '{ck.CONTROL_CHARACTERS}') as bad from documents)",
)
def corruption_flags(spark, sf):
    return opened(si.documents_with(spark, sf, "t", si.PLANTED), "doc_id", ck.no_corruption(F.col("t")))


FIT = {"event_id": "bigint", "user_id": "int", "value": "decimal(18,2)", "event_type": "int", "props": "double", "ts": "timestamp"}


@query(
    "type_fit",
    " union all ".join(
        f"select '{c}' as name, '{k}' as target, count(*) as present, count(try_cast(cast({c} as varchar) as {k})) as fitting, count(*) = count(try_cast(cast({c} as varchar) as {k})) as ok from events"
        for c, k in FIT.items()
    ),
)
def type_fit(spark, sf):
    return ck.type_fit(as_text(table(spark, sf, "events")), FIT)


@query(
    "identifier_check",
    f"""select doc_id, b = '' as ok, case when b <> '' then 'Invalid names: ' || b end as reason from (select doc_id,
  array_to_string(list_filter(string_split({si.HEADER_LINE}, ','), lambda h: not regexp_full_match(h, '[A-Za-z_][A-Za-z0-9_]*')), ', ') as b from documents)""",
)
def identifier_check(spark, sf):
    return opened(si.header_files(spark, sf), "doc_id", ck.identifiers_valid(F.col("headers")))
