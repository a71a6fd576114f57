"""Queries for profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import profile as pf
from veriform.plans import stand_ins as si
from veriform.plans.registry import query, table
from veriform.plans.scalars import FORMATS, MARKED, PADDED, date_text, duck_format, spark_format
from veriform.plans.sinks import duck_kind
from veriform.plans.sources import NO_SCRIPT, duck_tag
from veriform.sources import mixed_json as mj
from veriform.sources.documents import detect_encoding

CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "segment")
MISSING = "({c} is null or upper(trim({c})) in ('', 'NULL', 'N/A'))"
CUSTOMER_TEXT = f"select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, cast(c_acctbal as varchar) as c_acctbal, {MARKED} as segment from customer"


def customers(spark, sf):
    return pf.as_text(table(spark, sf, "customer").withColumn("segment", F.expr(MARKED)).drop("c_mktsegment"))


@query(
    "profile_columns",
    " union all ".join(
        f"select '{c}' as name, {i} as position, {duck_kind(c)} as data_type, bool_or({MISSING.format(c=c)}) as nullable, count(*) as row_count from ({CUSTOMER_TEXT})"
        for i, c in enumerate(CUSTOMER)
    ),
)
def profile_columns(spark, sf):
    return pf.profile_columns(customers(spark, sf))


EVENTS = {
    "event_id": "cast(event_id as varchar)", "ts": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "value": "cast(value as varchar)", "event_type": "event_type",
    "flag": "case when value > 10 then 'True' else 'false' end", "day": "strftime(ts, '%Y-%m-%d')", "mixed": "case when event_id % 50 = 0 then 'x' else cast(event_id as varchar) end",
    "number": "case when event_id % 9 = 0 then '' when event_id % 2 = 0 then cast(event_id as varchar) else cast(value as varchar) end",
}


@query("infer_types", " union all ".join(f"select '{c}' as name, {duck_kind('t')} as data_type from (select {e} as t from events)" for c, e in EVENTS.items()))
def infer_types(spark, sf):
    def spark_sql(e: str) -> str:
        e = e.replace("varchar", "string")
        for duck, own in (("strftime(ts, '%Y-%m-%d %H:%M:%S')", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"), ("strftime(ts, '%Y-%m-%d')", "date_format(ts, 'yyyy-MM-dd')")):
            e = e.replace(duck, own)
        return e

    return pf.infer_types(table(spark, sf, "events").select(*[F.expr(spark_sql(e)).alias(c) for c, e in EVENTS.items()]))


PART = ("p_name", "p_brand", "p_type")


@query(
    "sample_values",
    " union all ".join(f"""select '{c}' as name, array_to_string(list_filter([lo, case when mid <> lo then mid end, case when hi <> lo and hi <> mid then hi end], lambda x: x is not null), ';') as samples
from (select min({c}) as lo, arg_min({c}, md5({c})) as mid, max({c}) as hi from part)""" for c in PART),
)
def sample_values(spark, sf):
    return pf.sample_values(table(spark, sf, "part").select(*PART)).select("name", F.array_join("samples", ";").alias("samples"))


@query(
    "null_profile",
    " union all ".join(
        f"select '{c}' as name, count(*) as row_count, count(*) - count({c}) as nulls, '{m}' as representation, count(*) filter (where upper(trim({c})) = '{m}') as found from ({CUSTOMER_TEXT})"
        for c in CUSTOMER for m in ("", "NULL", "N/A")
    ),
)
def null_profile(spark, sf):
    return pf.null_profile(customers(spark, sf))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "odd", "tiny")
# Values that sums in fixed decimals lose or fail on.
ODD = "case when l_orderkey % 97 = 0 then cast('NaN' as double) when l_orderkey % 89 = 0 then cast('1e30' as double) when l_orderkey % 83 = 0 then cast('-Infinity' as double) else l_extendedprice end"
TINY = "l_linenumber * cast('0.00002' as double)"


@query(
    "numeric_ranges",
    " union all ".join(
        f"select '{c}' as name, min(v)::double as low, max(v)::double as high, printf('%.9e', avg(v))::double as mean, count(*) - count(v) as non_finite "
        f"from (select case when isfinite(x) then x end as v from (select {dict(odd=ODD, tiny=TINY).get(c, c)}::double as x from lineitem))" for c in NUMERIC
    ),
)
def numeric_ranges(spark, sf):
    return pf.numeric_ranges(table(spark, sf, "lineitem").withColumns({"odd": F.expr(ODD), "tiny": F.expr(TINY)}), NUMERIC)


SHAPES = {
    "YYYY-MM-DD": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "YYYY-MM-DD HH:MM:SS": "[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:]{8}", "MM/DD/YYYY": "[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "YYYY/MM/DD": "[0-9]{4}/[0-9]{2}/[0-9]{2}", "DD.MM.YYYY": "[0-9]{2}[.][0-9]{2}[.][0-9]{4}", "YYYYMMDD": "[0-9]{8}", "Month D, YYYY": "[A-Z][a-z]+ [0-9]+, [0-9]{4}",
}


@query(
    "date_formats",
    "select * from (" + " union all ".join(
        f"select '{c}' as name, '{k}' as layout, count(*) as n from (select {e} as t from orders) where regexp_full_match(t, '{p}')"
        for c, e in (("order_date", date_text("o_orderdate", duck_format)), ("status", "o_orderstatus")) for k, p in SHAPES.items()
    ) + ") where n > 0",
)
def date_formats(spark, sf):
    rows = table(spark, sf, "orders").select(F.expr(date_text("o_orderdate", spark_format)).alias("order_date"), F.col("o_orderstatus").alias("status"))
    return pf.date_formats(rows)


# Dates of the orders as columns would hold them: days that decide, days that do not, and values that spoil a layout.
LAYOUT_COLUMNS = {
    "us": ("strftime(o_orderdate, '%m/%d/%Y')", "date_format(o_orderdate, 'MM/dd/yyyy')"),
    "european": ("strftime(o_orderdate, ' %d/%m/%Y')", "date_format(o_orderdate, ' dd/MM/yyyy')"),
    "early_days": ("case when day(o_orderdate) <= 12 then strftime(o_orderdate, '%d/%m/%Y') when o_orderkey % 2 = 0 then 'n/a' end",
                   "case when day(o_orderdate) <= 12 then date_format(o_orderdate, 'dd/MM/yyyy') when o_orderkey % 2 = 0 then 'n/a' end"),
    "one_late_day": ("case when o_orderkey = (select max(o_orderkey) from orders) then '31.01.1995' else strftime(o_orderdate, '%m.') || '01.1995' end", "late"),
    "mixed": ("case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d.%m.%Y') else strftime(o_orderdate, '%Y-%m-%d') end",
              "case when o_orderkey % 2 = 0 then date_format(o_orderdate, 'dd.MM.yyyy') else date_format(o_orderdate, 'yyyy-MM-dd') end"),
    "spoilt": ("case when o_orderkey % 5 = 0 then '19950230' else strftime(o_orderdate, '%Y%m%d') end", "case when o_orderkey % 5 = 0 then '19950230' else date_format(o_orderdate, 'yyyyMMdd') end"),
    "short": ("strftime(o_orderdate, '%y/%m/%d')", "date_format(o_orderdate, 'yy/MM/dd')"), "status": ("o_orderstatus", "o_orderstatus"),
}


def possible_sql(t: str) -> str:
    """The layouts under which a text is a date, by the parser of the other side; a list in the order of the layouts."""
    def pattern(name: str) -> str:
        for part, sign in (("YYYY", "%Y"), ("YY", "%y"), ("MM", "%m"), ("DD", "%d")):
            name = name.replace(part, sign)
        return name

    return "[" + ", ".join(f"case when regexp_matches({t}, '{shape}') and try_strptime({t}, '{pattern(name)}') is not null then '{name}' end" for name, shape, _ in pf.COLUMN_LAYOUTS) + "]"


@query(
    "column_layouts",
    " union all ".join(
        f"""select '{c}' as name, array_to_string(list_filter([{', '.join(f"case when bool_and(list_contains(f, '{name}')) then '{name}' end" for name, _, _ in pf.COLUMN_LAYOUTS)}], lambda x: x is not null), ';') as layouts,
  count(f) as n, count(*) filter (where len(list_filter(f, lambda x: x is not null)) = 0) as undated
from (select {possible_sql('t')} as f from (select trim(t) as t from (select {duck} as t from orders)) where t is not null and upper(t) not in ('', 'NULL', 'N/A'))""" for c, (duck, _) in LAYOUT_COLUMNS.items()
    ),
)
def column_layouts(spark, sf):
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    late = F.when(F.col("o_orderkey") == F.col("last"), "31.01.1995").otherwise(F.concat(F.date_format("o_orderdate", "MM."), F.lit("01.1995")))
    rows = orders.join(F.broadcast(last)).select(*[(late if own == "late" else F.expr(own)).alias(c) for c, (_, own) in LAYOUT_COLUMNS.items()])
    return pf.column_layouts(rows).withColumn("layouts", F.array_join("layouts", ";"))


# Files of every kind, each around the whole text of a document, in which marks of the formats are blanks.
FLAT = """translate(text, concat(chr(10), chr(13), chr(9), '|,;"<>{}[]'), '            ')"""
FILE = f"""case doc_id % 12 when 0 then concat('id|source|size', chr(10), doc_id, '|', {FLAT}, '|', n_chars) when 1 then concat('id', chr(9), 'lang', chr(10), doc_id, chr(9), {FLAT})
  when 2 then concat('id,source,note', chr(10), doc_id, ',', source, ',"a, ', {FLAT}, '"', chr(10), doc_id, ',', lang, ',c') when 3 then concat('a;b', chr(10), lang, ';', {FLAT})
  when 4 then concat('{{"id": ', doc_id, ', "text": "', replace({FLAT}, chr(92), ' '), '"}}') when 5 then concat('<?xml version="1.0"?><d><id>', {FLAT}, '</id></d>') when 6 then concat('<d><id>', {FLAT}, '</id></d>')
  when 7 then concat('id    ', rpad('lang', cast(length({FLAT}) as int), '.'), chr(10), rpad('x', 6, ' '), {FLAT}) when 8 then concat('<!DOCTYPE html><html><body>', {FLAT}, '</body></html>')
  when 9 then concat(doc_id, ',', n_chars, chr(10), doc_id, ',', {FLAT}) when 10 then concat('<!-- ', {FLAT}, ' -->', chr(10), '<html><body>x</body></html>') else text end"""


def detected_sql(key: str, text: str, rows: str) -> str:
    def same(sep: str) -> str:
        counts = f"list_transform(string_split(b, chr(10)), lambda x: length(x) - length(replace(x, {sep}, '')))"
        return f"contains(t, chr(10)) and contains(split_part(b, chr(10), 1), {sep}) and list_min({counts}) >= 1 and list_min({counts}) = list_max({counts})"

    lengths = "list_transform(string_split(b, chr(10)), lambda x: length(x))"
    return f"""select k, format, delimiter, case when delimiter is not null and contains(t, '"') then '"' end as quote_char,
  case when delimiter is not null then len(list_filter(string_split(split_part(b, chr(10), 1), delimiter), lambda h: regexp_matches(h, '^\\s*([+-]?[0-9.,]+|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*)?\\s*$'))) = 0 end as has_header
from (select *, case format when 'pipe-delimited' then '|' when 'tab-delimited' then chr(9) when 'csv' then ',' when 'semicolon-delimited' then ';' end as delimiter
from (select k, t, b, case when regexp_matches(t, '{pf.HTML_OPENING}') then 'html' when starts_with(t, '<?xml') or regexp_matches(t, '(?s)^<[A-Za-z][^>]*>.*>$') then 'xml'
  when regexp_matches(t, '^[{{\\[]') and json_valid(t) then 'json' when {same("'|'")} then 'pipe-delimited' when {same("chr(9)")} then 'tab-delimited' when {same("','")} then 'csv' when {same("';'")} then 'semicolon-delimited'
  when contains(t, chr(10)) and contains(t, '  ') and list_min({lengths}) = list_max({lengths}) then 'fixed-width' else 'text' end as format
from (select k, t, case when contains(t, '"') then regexp_replace(t, '"[^"]*"', '', 'g') else t end as b from (select {key} as k, trim({text}, {si.WS}) as t from {rows}))))"""


@query("detect_format", f"{detected_sql('doc_id', FILE, 'documents')} union all {detected_sql('-1 - page_id', 'html', 'pages')}")
def detect_format(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.expr(FILE).alias("t"))
    pages = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("k"), F.col("html").alias("t"))
    return pf.detect_format(docs.unionByName(pages), "t").select("k", "format", "delimiter", "quote_char", "has_header")


LATIN = "regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g')"


@query(
    "detect_encoding",
    f"""select doc_id, case when doc_id % 3 = 0 then case when regexp_matches({LATIN}, '[^\\x{{00}}-\\x{{7F}}]') then 'ISO-8859-1' else 'ASCII' end
  when regexp_matches(text, '[^\\x{{00}}-\\x{{7F}}]') then 'UTF-8' else 'ASCII' end as encoding from documents""",
)
def detect_encoding_query(spark, sf):
    latin = F.encode(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", detect_encoding(content).alias("encoding"))


def count_sql(pattern: str) -> str:
    return f"cast(len(regexp_extract_all(h, '{pattern}')) as bigint)"


@query(
    "text_structure",
    f"""select page_id, {duck_tag('title')} as title, {count_sql('(?i)<h[1-6][ >]')} as headings, {count_sql('(?i)<(?:section|article)[ >]')} as sections, {count_sql('(?i)<p[ >]')} as paragraphs,
  {count_sql('(?i)<li[ >]')} as list_items from (select page_id, {NO_SCRIPT} as h from pages)""",
)
def text_structure(spark, sf):
    return pf.text_structure(table(spark, sf, "pages"), "html", ["page_id"])


@query(
    "profile_valid",
    """select c_custkey, r is null as ok, r as reason from (select c_custkey, case when c_custkey % 5 = 0 then 'No format given' when c_custkey % 7 = 0 then 'No list of columns'
  when c_custkey % 11 = 0 then 'The list of columns is empty' when c_custkey % 13 = 0 then 'A column has no name' when c_custkey % 17 = 0 then 'A column has no data_type' end as r from customer)""",
)
def profile_valid(spark, sf):
    k = F.col("c_custkey")
    second = F.struct(F.when(k % 13 != 0, F.col("c_name")).alias("name"), F.when(k % 17 != 0, F.lit("string")).alias("data_type"))
    columns = F.array(F.struct(F.lit("id").alias("name"), F.lit("integer").alias("data_type")), second)
    none = F.slice(columns, 1, F.when(k % 11 == 0, F.lit(0)).otherwise(F.lit(2)))
    profile = F.struct(F.when(k % 5 != 0, F.lit("csv")).alias("format"), F.when(k % 7 != 0, none).alias("columns"))
    return table(spark, sf, "customer").select("c_custkey", pf.profile_valid(profile).alias("c")).select("c_custkey", "c.ok", "c.reason")


@query(
    "profile_enriched",
    f"""select doc_id, cast(len(string_split(trim({PADDED}, {si.WS}), chr(10))) as bigint) as sample_line_count, cast(strlen({PADDED}) as bigint) as sample_byte_size, cast(doc_id % 4 as bigint) as column_count,
  case when regexp_matches(f, 'pipe|delimited|csv|tsv') then 'delimited' when contains(f, 'json') then 'json' when contains(f, 'xml') then 'xml'
  when contains(f, 'fixed') then 'fixed_width' when regexp_matches(f, 'text|article|document|narrative|unstructured') then 'text' else 'other' end as format_category
from (select *, lower(coalesce({FORMATS}, '')) as f from documents)""",
)
def profile_enriched(spark, sf):
    columns = F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int")))
    docs = table(spark, sf, "documents").select("doc_id", F.expr(PADDED).alias("sample"), F.expr(FORMATS).alias("format"), columns.alias("cols"))
    return pf.enrich_profile(docs, "sample", "format", "cols").select("doc_id", "sample_line_count", "sample_byte_size", "column_count", "format_category")


@query(
    "spec_from_profile",
    f"""select target_position, target, source, case source {" ".join(f"when '{c}' then (select {duck_kind(c)} from ({CUSTOMER_TEXT}))" for c in CUSTOMER)} end as data_type,
  case source {" ".join(f"when '{c}' then (select bool_or({MISSING.format(c=c)}) from ({CUSTOMER_TEXT}))" for c in CUSTOMER)} end as nullable, rule
from (values (0, 'CustomerID', 'c_custkey', 'as is'), (1, 'C Name', 'c_name', 'upper case'), (2, 'Balance', 'c_acctbal', 'two decimals'), (3, 'Segment', 'segment', 'upper case'), (4, 'Phone', null, 'leave empty')) t(target_position, target, source, rule)""",
)
def spec_from_profile(spark, sf):
    profile = pf.profile_columns(customers(spark, sf))
    target = ["CustomerID", "C Name", "Balance", "Segment", "Phone"]
    return pf.spec_from_profile(profile, target, {"c_custkey": "CustomerID", "c_acctbal": "Balance"}, {"string": "upper case"})


# Properties of the events with other shapes planted between them: other types, nested fields, lists, nulls, and no JSON at all.
MIXED = """case event_id % 6 when 0 then props when 1 then concat('{"k": "', event_type, '", "n": {"a": ', event_id, '}}') when 2 then concat('{"k": 1.5, "n": {"b": [', event_id, ', null]}}')
  when 3 then '{"n": {"b": ["x", 2]}, "t": true}' when 4 then concat('{"only": {"c": ', event_id, '}, "z": null}') else 'no json' end"""
MIXED_PATHS = {"k": "$.k", "n.a": "$.n.a", "n.b[]": "$.n.b[*]", "only.c": "$.only.c", "t": "$.t", "z": "$.z"}


def kind_of_path(path: str, where: str) -> str:
    found = f"unnest(json_extract(j, '{where}'))" if "[*]" in where else f"json_extract(j, '{where}')"
    return f"""select '{path}' as path, case when count(distinct kind) = 1 then max(kind) else 'string' end as type from (select case json_type(x) when 'UBIGINT' then 'bigint' when 'BIGINT' then 'bigint'
  when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'decimal(2,1)' end as kind from (select {found} as x from mixed) where json_type(x) <> 'NULL')"""


@query(
    "infer_json",
    f"with mixed as (select cast(m as json) as j from (select {MIXED} as m from events) where json_valid(m)) " + " union all ".join(kind_of_path(p, w) for p, w in MIXED_PATHS.items()),
)
def infer_json(spark, sf):
    kind = mj.infer_json(table(spark, sf, "events").select(F.expr(MIXED).alias("m")), "m")
    return spark.createDataFrame(list(mj.type_paths(kind)), "path string, type string")


@query(
    "mixed_json",
    f"""select event_id, case when json_type(j, '$.k') = 'VARCHAR' then j ->> '$.k' else cast(json_extract(j, '$.k') as varchar) end as k, cast(json_extract(j, '$.n.a') as bigint) as a,
  case when json_extract(j, '$.n.b') is not null then array_to_string(list_transform(j ->> '$.n.b[*]', lambda x: coalesce(x, '-')), ';') end as b,
  cast(json_extract(j, '$.t') as boolean) as t, cast(json_extract(j, '$.only.c') as bigint) as c
from (select event_id, case when json_valid(m) then cast(m as json) end as j from (select event_id, {MIXED} as m from events))""",
)
def mixed_json(spark, sf):
    """The columns that the merged type gives, mixed places as text."""
    parsed = mj.with_parsed(table(spark, sf, "events").select("event_id", F.expr(MIXED).alias("m")), "m")
    b = F.array_join(F.transform("parsed.n.b", lambda x: F.coalesce(x, F.lit("-"))), ";")
    return parsed.select("event_id", F.col("parsed.k").alias("k"), F.col("parsed.n.a").alias("a"), b.alias("b"), F.col("parsed.t").alias("t"), F.col("parsed.only.c").alias("c"))
