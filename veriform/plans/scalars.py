"""Queries for the text and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.functions import text as tx
from veriform.functions import values as vl
from veriform.plans import stand_ins as si
from veriform.plans.registry import query, table

NOW = "2025-02-01 00:00:00"
TEMPLATE = (
    f"Attempt {tx.RUN_INDEX} on {tx.DATE_TIME}\n"
    f"What was wrong before: {tx.PREVIOUS_NOTES}\nRecords to turn:\n{tx.DATA}"
)


def tag_sql(text: str, start: str, end: str, many: str = "*?") -> str:
    return (
        f"case when regexp_matches({text}, '(?is){start}.{many}{end}') "
        f"then trim(regexp_extract({text}, '(?is){start}(.{many}){end}', 1), {si.WS}) end"
    )


@query("tag_first", f"select doc_id, {tag_sql('t', '<output>', '</output>')} as found from (select doc_id, {si.TAGGED} as t from documents)")
def tag_first(spark, sf):
    return si.documents_with(spark, sf, "t", si.TAGGED).select("doc_id", tx.between_tags(F.col("t"), *tx.OUTPUT_TAGS).alias("found"))


@query("tag_outer", f"select doc_id, {tag_sql('t', '<output>', '</output>', '*')} as found from (select doc_id, {si.TAGGED} as t from documents)")
def tag_outer(spark, sf):
    return si.documents_with(spark, sf, "t", si.TAGGED).select("doc_id", tx.parse_output(F.col("t")).alias("found"))


VERDICT_SQL = f"""select doc_id, lower(nullif({tag_sql('t', '<isvalid>', '</isvalid>')}, '')) = 'true' as isvalid,
  nullif({tag_sql('t', '<invalid_msg>', '</invalid_msg>')}, '') as invalid_msg
from (select doc_id, {si.VERDICT} as t from documents)"""


@query("parse_verdict", VERDICT_SQL)
def parse_verdict(spark, sf):
    docs = si.documents_with(spark, sf, "t", si.VERDICT)
    return docs.select("doc_id", tx.parse_verdict(F.col("t")).alias("v")).select("doc_id", "v.isvalid", "v.invalid_msg")


DATA_WITH_MARKERS = "case when doc_id % 6 = 0 then concat(text, ' {<!--RunIndex-->}') when doc_id % 6 = 1 then concat('{<!--Output-->}', text) else text end"


def render_sql(data: str) -> str:
    return (
        f"replace(replace(replace(replace('{TEMPLATE}', '{tx.DATA}', {data}), '{tx.RUN_INDEX}', cast(doc_id % 3 as varchar)), "
        f"'{tx.DATE_TIME}', '{NOW}'), '{tx.PREVIOUS_NOTES}', case when doc_id % 2 = 0 then lang else '' end)"
    )


def rendered(spark, sf):
    docs = si.documents_with(spark, sf, "d", DATA_WITH_MARKERS)
    notes = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    values = {
        tx.DATA: F.col("d"), tx.RUN_INDEX: F.col("doc_id") % 3, tx.DATE_TIME: F.lit(NOW), tx.PREVIOUS_NOTES: notes,
    }
    return docs.select("doc_id", tx.render_template(TEMPLATE, values).alias("request"))


@query("render_prompt", f"select doc_id, {render_sql(DATA_WITH_MARKERS)} as request from documents")
def render_prompt(spark, sf):
    return rendered(spark, sf)


@query(
    "placeholder_check",
    f"select doc_id, contains(r, '{tx.OUTPUT}') as has_placeholders, "
    f"case when contains(r, '{tx.OUTPUT}') then 'Unreplaced placeholders in request' end as invalid_msg "
    f"from (select doc_id, {render_sql(DATA_WITH_MARKERS)} as r from documents)",
)
def placeholder_check(spark, sf):
    left = tx.has_placeholders(F.col("request"))
    return rendered(spark, sf).select(
        "doc_id", left.alias("has_placeholders"), F.when(left, F.lit("Unreplaced placeholders in request")).alias("invalid_msg")
    )


PADDED = f"case when doc_id % 3 = 0 then concat(chr(9), ' ', text, ' ', chr(10)) when doc_id % 3 = 1 then concat('{chr(0xA0)}', text, '{chr(0x3000)}') else text end"


@query("trim_text", f"select doc_id, trim({PADDED}, {si.WS}) as text, trim(concat(' ', lang), {si.WS}) as lang, n_chars from documents")
def trim_text(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.expr(PADDED).alias("text"), F.concat(F.lit(" "), "lang").alias("lang"), "n_chars"
    )
    return vl.trim_text_fields(docs)


@query("upper_names", "select c_custkey, upper(c_name) as name, upper(c_mktsegment) as segment from customer")
def upper_names(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", vl.upper_case(F.col("c_name")).alias("name"), vl.upper_case(F.col("c_mktsegment")).alias("segment")
    )


FULL_NAME = "case when p_partkey % 5 = 0 then 'single' when p_partkey % 5 = 1 then concat(p_name, ' extra  part') else p_name end"


@query(
    "split_name",
    f"select p_partkey, split_part(n, ' ', 1) as first_name, nullif(trim(substr(n, length(split_part(n, ' ', 1)) + 1)), '') as last_name "
    f"from (select p_partkey, {FULL_NAME} as n from part)",
)
def split_name(spark, sf):
    first, last = vl.split_full_name(F.expr(FULL_NAME))
    return table(spark, sf, "part").select("p_partkey", first.alias("first_name"), last.alias("last_name"))


MARKED = "case c_custkey % 6 when 0 then ' ' when 1 then 'null' when 2 then ' N/A ' when 3 then '' when 4 then 'NA' else c_mktsegment end"


@query(
    "null_markers",
    f"select c_custkey, case when upper(trim(s)) not in ('', 'NULL', 'N/A') then s end as segment from (select c_custkey, {MARKED} as s from customer)",
)
def null_markers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", vl.null_if_marker(F.expr(MARKED)).alias("segment"))


def date_text(d: str, fmt) -> str:
    """Orders dates in the known layouts, by key; ``fmt`` writes one layout in the dialect at hand."""
    cases = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss"]
    body = " ".join(f"when {i} then {fmt(d, c)}" for i, c in enumerate(cases))
    return f"case o_orderkey % 9 {body} when 7 then 'soon' else '2024-02-30' end"


def spark_format(d: str, layout: str) -> str:
    return f"date_format({d}, '{layout}')"


def duck_format(d: str, layout: str) -> str:
    for a, b in (("yyyy", "%Y"), ("MMMM", "%B"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"), (" d,", " %-d,")):
        layout = layout.replace(a, b)
    return f"strftime({d}, '{layout}')"


@query(
    "iso_dates",
    "select o_orderkey, strftime(coalesce("
    + ", ".join(f"try_strptime(s, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%d.%m.%Y", "%Y%m%d", "%B %d, %Y", "%Y-%m-%d %H:%M:%S"))
    + f"), '%Y-%m-%d') as order_date from (select o_orderkey, {date_text('o_orderdate', duck_format)} as s from orders)",
)
def iso_dates(spark, sf):
    text = F.expr(date_text("o_orderdate", spark_format))
    return table(spark, sf, "orders").select("o_orderkey", vl.iso_date(text).alias("order_date"))


@query("us_dates", "select o_orderkey, strftime(o_orderdate, '%m/%d/%Y') as order_date from orders")
def us_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", vl.us_date(F.col("o_orderdate")).alias("order_date"))


@query(
    "two_decimals",
    "select o_orderkey, cast(cast(cast(o_totalprice as decimal(18,2)) * 1.085 as decimal(18,2)) as varchar) as total from orders",
)
def two_decimals(spark, sf):
    gross = F.col("o_totalprice").cast("decimal(18,2)") * F.lit("1.085").cast("decimal(4,3)")
    return table(spark, sf, "orders").select("o_orderkey", vl.two_decimals(gross).alias("total"))


MONEY = """case p_partkey % 6
  when 0 then concat('$', cast(cast(p_retailprice as decimal(18,2)) as {s}))
  when 1 then concat('$1,', cast(cast(p_retailprice as decimal(18,2)) as {s}), '/month')
  when 2 then concat(cast(p_size as {s}), ',450 sq ft')
  when 3 then 'call us'
  when 4 then concat('-', cast(p_size as {s}), '.5 USD')
  else concat('USD ', cast(p_size as {s})) end"""


@query(
    "clean_numbers",
    r"select p_partkey, try_cast(nullif(replace(regexp_extract(s, '-?[0-9][0-9,]*([.][0-9]+)?', 0), ',', ''), '') as decimal(18,2)) as amount "
    f"from (select p_partkey, {MONEY.format(s='varchar')} as s from part)",
)
def clean_numbers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", vl.clean_number(F.expr(MONEY.format(s="string"))).alias("amount"))


# Amounts below zero as accounts write them, and minuses that are none.
SIGNED = """case p_partkey % 9
  when 0 then concat('-$1,', cast(cast(p_retailprice as decimal(18,2)) as {s}))
  when 1 then concat('(', cast(cast(p_retailprice as decimal(18,2)) as {s}), ')')
  when 2 then concat(' ($', cast(p_size as {s}), '.25) ')
  when 3 then concat(cast(p_size as {s}), '.75-')
  when 4 then concat('EUR -', cast(p_size as {s}))
  when 5 then concat('-EUR ', cast(p_size as {s}), '.5')
  when 6 then concat('price (net) - ', cast(p_size as {s}))
  when 7 then concat('$', cast(p_size as {s}), '-$90')
  else concat('(', cast(p_size as {s}), ') pieces') end"""


@query(
    "signed_numbers",
    """select p_partkey, cast(case p_partkey % 9 when 0 then -cast('1' || cast(cast(p_retailprice as decimal(18,2)) as varchar) as decimal(18,2)) when 1 then -cast(p_retailprice as decimal(18,2)) when 2 then -(p_size + 0.25)
  when 3 then -(p_size + 0.75) when 4 then -p_size when 5 then -(p_size + 0.5) else p_size end as decimal(18,2)) as amount from part""",
)
def signed_numbers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", vl.clean_number(F.expr(SIGNED.format(s="string"))).alias("amount"))


YES_NO = "case when toxic is null then '?' when doc_id % 3 = 0 then case when quality = 1 then ' Yes' else 'NO' end when doc_id % 3 = 1 then case when quality = 1 then 'True' else 'false' end else cast(quality as {s}) end"


@query(
    "bool_text",
    f"select doc_id, case when lower(trim(s)) in ('yes', 'true', '1') then 'true' when lower(trim(s)) in ('no', 'false', '0') then 'false' end as quality "
    f"from (select doc_id, {YES_NO.format(s='varchar')} as s from labels)",
)
def bool_text(spark, sf):
    flag = vl.to_boolean(F.expr(YES_NO.format(s="string")))
    return table(spark, sf, "labels").select("doc_id", vl.bool_text(flag).alias("quality"))


PHONE = "case c_custkey % 4 when 0 then concat('555-', substr(c_name, 10, 3), '-', right(c_name, 4)) when 1 then concat('555', substr(c_name, 11, 7)) when 2 then 'none' else concat('+1 555 ', right(c_name, 7)) end"


@query(
    "phone_format",
    f"""select c_custkey, case when length(d) = 10 then '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) else s end as phone
from (select c_custkey, s, regexp_replace(s, '[^0-9]', '', 'g') as d from (select c_custkey, {PHONE} as s from customer))""",
)
def phone_format(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", vl.phone(F.expr(PHONE)).alias("phone"))


@query("json_timestamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts from events")
def json_timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", vl.json_timestamp(F.col("ts")).alias("ts"))


HARD = """concat(case doc_id % 4 when 0 then 'a|b' when 1 then concat('say "hi", ', chr(92), 'n') when 2 then 'it''s' else '' end, text)"""


@query(
    "escape_values",
    f"""select doc_id,
  case when contains(t, ',') or contains(t, '"') or contains(t, chr(10)) or contains(t, chr(13)) then '"' || replace(t, '"', '""') || '"' else t end as csv,
  replace(replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(1), chr(92) || '1') as pipe,
  cast(to_json(t) as varchar) as json, '''' || replace(t, '''', '''''') || '''' as sql_text
from (select doc_id, {HARD} as t from documents)""",
)
def escape_values(spark, sf):
    t = F.col("t")
    return si.documents_with(spark, sf, "t", HARD.replace("chr(92)", "char(92)")).select(
        "doc_id", vl.csv_field(t).alias("csv"), vl.escape_field(t).alias("pipe"), vl.json_string(t).alias("json"),
        vl.sql_literal(t).alias("sql_text"),
    )


@query("join_list", "select page_id, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ';') as links from pages")
def join_list(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", vl.join_list(links).alias("links"))


FORMATS = """case doc_id % 9 when 0 then 'Pipe-Delimited' when 1 then 'csv' when 2 then 'JSON lines' when 3 then 'xml' when 4 then 'fixed-width'
  when 5 then 'narrative' when 6 then 'json in csv' when 7 then null else source end"""


@query(
    "format_category",
    f"""select doc_id, case when regexp_matches(f, 'pipe|delimited|csv|tsv') then 'delimited' when contains(f, 'json') then 'json' when contains(f, 'xml') then 'xml'
  when contains(f, 'fixed') then 'fixed_width' when regexp_matches(f, 'text|article|document|narrative|unstructured') then 'text' else 'other' end as category
from (select doc_id, lower(coalesce({FORMATS}, '')) as f from documents)""",
)
def format_category(spark, sf):
    return si.documents_with(spark, sf, "f", FORMATS).select("doc_id", vl.format_category(F.col("f")).alias("category"))


@query(
    "text_sizes",
    f"select doc_id, cast(len(string_split(trim({PADDED}, {si.WS}), chr(10))) as bigint) as line_count, cast(strlen({PADDED}) as bigint) as byte_size from documents",
)
def text_sizes(spark, sf):
    padded = F.expr(PADDED)
    return table(spark, sf, "documents").select("doc_id", vl.line_count(padded).alias("line_count"), vl.byte_size(padded).alias("byte_size"))


SECRET = "case c_custkey % 3 when 0 then c_name when 1 then right(c_name, 8) else c_mktsegment end"


@query(
    "mask_values",
    f"select c_custkey, case when length(s) > 8 then left(s, 4) || '...' || right(s, 4) else '***' end as shown from (select c_custkey, {SECRET} as s from customer)",
)
def mask_values(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", vl.mask(F.expr(SECRET)).alias("shown"))


@query(
    "extract_block",
    f"""select doc_id, trim(case when s > 0 and e > s then substr(t, s + 23, e - s - 23)
  when regexp_matches(t, '(?m)^[\\pL\\pN_]+:') then regexp_extract(t, '(?ms)^[\\pL\\pN_]+:.*', 0) end, {si.WS}) as block
from (select doc_id, t, strpos(t, '<<<YAML_OUTPUT_START>>>') as s, strpos(t, '<<<YAML_OUTPUT_END>>>') as e
  from (select doc_id, {si.BLOCK} as t from documents))""",
)
def extract_block(spark, sf):
    return si.documents_with(spark, sf, "t", si.BLOCK).select("doc_id", tx.extract_block(F.col("t")).alias("block"))


def section_sql(name: str) -> str:
    return f"regexp_extract(t, '(?s){name}:\\s*[|]?\\s*(.*?)(\\n[\\pL\\pN_]+:|\\n?$)', 1)"


@query(
    "section_check",
    f"""select doc_id, nullif(array_to_string(list_filter([
    case when not contains(t, '{tx.DATA}') then '{tx.DATA} stands nowhere' end,
    case when not contains(t, '{tx.OUTPUT}') then '{tx.OUTPUT} stands nowhere' end,
    case when a <> '' and not contains(a, '{tx.DATA}') then 'no {tx.DATA} in {tx.REQUEST_SECTION}' end,
    case when b <> '' and not contains(b, '{tx.OUTPUT}') then 'no {tx.OUTPUT} in {tx.VALIDATION_SECTION}' end], lambda x: x is not null), ', '), '') as issues
from (select doc_id, t, {section_sql(tx.REQUEST_SECTION)} as a, {section_sql(tx.VALIDATION_SECTION)} as b from (select doc_id, {si.SPEC} as t from documents))""",
)
def section_check(spark, sf):
    docs = si.documents_with(spark, sf, "t", si.SPEC)
    return docs.select("doc_id", F.nullif(F.array_join(tx.placeholder_issues(F.col("t")), ", "), F.lit("")).alias("issues"))


PROFILE_ANSWER = """case event_id % 6 when 0 then concat('ok <output> ', props, ' </output>') when 1 then concat('text ', props, ' tail')
  when 2 then concat('<output>', props, ',}</output>') when 3 then 'nothing' when 4 then concat('{"a": ', props, '} and {')
  else concat('<output>{"p": ', props, '}', chr(10), '</output> }') end"""


@query(
    "extract_json",
    rf"""select event_id, case when json_valid(j) then j end as json from (select event_id, coalesce(nullif(regexp_extract(t, '(?s)<output>\s*(\{{.*?\}})\s*</output>', 1), ''),
  nullif(regexp_extract(t, '(?s)\{{.*\}}', 0), '')) as j from (select event_id, {PROFILE_ANSWER} as t from events))""",
)
def extract_json(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.extract_json(F.expr(PROFILE_ANSWER)).alias("json"))
