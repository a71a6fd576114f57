"""Queries for the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import profile as pf
from veriform.plans import stand_ins as si
from veriform.plans.mapping import TARGET_SQL, invoices
from veriform.plans.registry import query, table
from veriform.sinks import json_text as js
from veriform.sinks import lines as ln
from veriform.sinks import runs
from veriform.sinks import views as vw


def escaped(c: str) -> str:
    return f"replace(replace({c}, chr(92), chr(92) || chr(92)), '|', chr(92) || '|')"


INVOICE_LINE = "concat_ws('|', " + ", ".join(escaped(f'coalesce(trim(cast("{t}" as varchar)), \'\')') for t in si.TARGET) + ")"


@query("pipe_lines", f"select '{'|'.join(si.TARGET)}' as line union all select {INVOICE_LINE} from ({TARGET_SQL} from ({si.STAGED_SQL}))")
def pipe_lines(spark, sf):
    return ln.to_pipe_lines(invoices(spark, sf))


NAME = """case c_custkey % 5 when 0 then concat(c_name, ', Inc') when 1 then concat('"', c_name, '"') when 2 then concat(c_name, chr(10), 'c/o') when 3 then null else concat(' ', c_name, ' ') end"""
# Numbers and moments that are easily cut short, and how they are written.
RATIO = "case {k} % 6 when 0 then cast('0.123456789012345' as double) when 1 then cast('1e-12' as double) when 2 then cast('-2.5' as double) when 3 then cast('1e30' as double) when 4 then cast('123456789012345678' as double) end"
RATIO_TEXT = "case {k} % 6 when 0 then '0.123456789012345' when 1 then '0.000000000001' when 2 then '-2.5' when 3 then '1.0E30' when 4 then '123456789012345680' else '' end"
MOMENT = "case {k} % 4 when 0 then timestamp '2024-05-06 07:08:09.000012' when 1 then timestamp '2024-05-06 07:08:09.5' when 2 then timestamp '2024-05-06 07:08:10' else timestamp '2024-05-06 00:00:00' end"
MOMENT_TEXT = "case {k} % 4 when 0 then '2024-05-06T07:08:09.000012' when 1 then '2024-05-06T07:08:09.5' when 2 then '2024-05-06T07:08:10' else '2024-05-06' end"


def quoted(c: str) -> str:
    return f"case when regexp_matches({c}, '[,\"\\r\\n]') then '\"' || replace({c}, '\"', '\"\"') || '\"' else {c} end"


@query(
    "csv_lines",
    f"""select 'c_custkey,name,c_acctbal,vip,ratio,moment' as line union all
select concat_ws(',', cast(c_custkey as varchar), {quoted('n')}, cast(b as varchar), cast(vip as varchar), {RATIO_TEXT.format(k='c_custkey')}, {MOMENT_TEXT.format(k='c_custkey')})
from (select c_custkey, coalesce({NAME}, '') as n, cast(c_acctbal as decimal(18,2)) as b, c_acctbal > 5000 as vip from customer)""",
)
def csv_lines(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.expr(NAME.replace("chr(10)", "char(10)")).alias("name"), F.col("c_acctbal").cast("decimal(18,2)"), (F.col("c_acctbal") > 5000).alias("vip"),
        F.expr(RATIO.format(k="c_custkey")).alias("ratio"), F.expr(MOMENT.format(k="c_custkey")).alias("moment"),
    )
    return ln.to_csv_lines(rows)


@query(
    "tab_lines",
    "select concat_ws(chr(9), 's_suppkey', 's_name', 's_nationkey', 's_acctbal', 'ratio', 'moment') as line union all "
    f"select concat_ws(chr(9), s_suppkey, s_name, s_nationkey, cast(s_acctbal as decimal(18,2)), {RATIO_TEXT.format(k='s_suppkey')}, {MOMENT_TEXT.format(k='s_suppkey')}) from supplier",
)
def tab_lines(spark, sf):
    rows = table(spark, sf, "supplier").withColumns({
        "s_acctbal": F.col("s_acctbal").cast("decimal(18,2)"), "ratio": F.expr(RATIO.format(k="s_suppkey")), "moment": F.expr(MOMENT.format(k="s_suppkey"))})
    return ln.to_delimited_lines(rows, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "ratio", "moment"], "\t")


@query(
    "pipe_values",
    f"select 'id|ratio|moment' as line union all select concat_ws('|', o_orderkey, {RATIO_TEXT.format(k='o_orderkey')}, {MOMENT_TEXT.format(k='o_orderkey')}) from orders",
)
def pipe_values(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(RATIO.format(k="o_orderkey")).alias("ratio"), F.expr(MOMENT.format(k="o_orderkey")).alias("moment"))
    return ln.to_pipe_lines(rows)


RECORD = "case when c_custkey % 4 = 0 then null else c_mktsegment end"


@query(
    "json_records",
    f"select cast(to_json(struct_pack(id := c_custkey, name := c_name, segment := {RECORD}, balance := c_acctbal, rich := c_acctbal > 5000)) as varchar) as record from customer",
)
def json_records(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr(RECORD).alias("segment"), F.col("c_acctbal").alias("balance"),
        (F.col("c_acctbal") > 5000).alias("rich"),
    )
    return js.to_json_records(rows)


def array_sql(page_rows: int | None) -> str:
    page = f"cast(floor((row_number() over (partition by c_nationkey order by c_custkey) - 1) / {page_rows}) as bigint)" if page_rows else "cast(0 as bigint)"
    return f"""select c_nationkey, page, count(*) as n, cast(to_json(list(struct_pack(c_custkey := c_custkey, c_name := c_name, segment := {RECORD}) order by c_custkey)) as varchar) as records
from (select *, {page} as page from customer) group by c_nationkey, page"""


def arrays(spark, sf, page_rows):
    rows = table(spark, sf, "customer").withColumn("segment", F.expr(RECORD))
    return js.to_json_array(rows, ["c_nationkey"], ["c_custkey", "c_name", "segment"], ["c_custkey"], page_rows)


@query("json_array", array_sql(js.PAGE_ROWS))
def json_array(spark, sf):
    return arrays(spark, sf, js.PAGE_ROWS)


@query("json_array_pages", array_sql(4))
def json_array_pages(spark, sf):
    return arrays(spark, sf, 4)


def nested_sql(page_rows: int | None) -> str:
    order = "l_linenumber, l_partkey, l_quantity, l_shipdate"
    page = f"cast(floor((row_number() over (partition by l_orderkey order by {order}) - 1) / {page_rows}) as bigint)" if page_rows else "cast(0 as bigint)"
    return f"""select o_orderkey, coalesce(page, 0) as page, cast(to_json(struct_pack("order" := struct_pack(id := o_orderkey, status := o_orderstatus, price := o_totalprice),
  items := coalesce(ls, []), shipping := struct_pack(n := coalesce(n, 0), last := l))) as varchar) as document
from orders left join (select l_orderkey, page, list(struct_pack(line := l_linenumber, part := l_partkey, quantity := l_quantity) order by {order}) as ls
  from (select *, {page} as page from lineitem) group by l_orderkey, page) on o_orderkey = l_orderkey
left join (select l_orderkey as k, count(*) as n, strftime(max(l_shipdate), '%Y-%m-%d') as l from lineitem group by 1) on o_orderkey = k"""


def nested(spark, sf, page_rows):
    orders = table(spark, sf, "orders")
    items = js.collect_children(
        table(spark, sf, "lineitem"), ["l_orderkey"], {"line": "l_linenumber", "part": "l_partkey", "quantity": "l_quantity", "shipped": "l_shipdate"},
        {"last": F.max("l_shipdate")}, page_rows,
    )
    layout = {
        "order": {"id": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "price": F.col("o_totalprice")},
        "items": F.transform(
            F.coalesce("items", F.array().cast(items.schema["items"].dataType)),
            lambda x: F.struct(x["line"].alias("line"), x["part"].alias("part"), x["quantity"].alias("quantity")),
        ),
        "shipping": {"n": F.coalesce("n", F.lit(0)), "last": F.date_format("last", "yyyy-MM-dd")},
    }
    joined = orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left")
    return joined.select("o_orderkey", F.coalesce("page", F.lit(0)).cast("bigint").alias("page"), js.to_nested_json(layout).alias("document"))


@query("nested_json", nested_sql(None))
def nested_json(spark, sf):
    return nested(spark, sf, None)


@query("nested_json_pages", nested_sql(3))
def nested_json_pages(spark, sf):
    return nested(spark, sf, 3)


@query(
    "typed_view",
    """select l_orderkey as "OrderNumber", try_cast(l_quantity as integer) as "Quantity", cast(l_extendedprice as decimal(18,2)) as "Price",
  cast(l_shipdate as date) as "ShipDate", try_cast(l_returnflag as integer) as "Flag" from lineitem""",
)
def typed_view(spark, sf):
    return vw.create_view(table(spark, sf, "lineitem"), "veriform_lineitem", [
        ("l_orderkey", "OrderNumber", "bigint"), ("l_quantity", "Quantity", "int"), ("l_extendedprice", "Price", "decimal(18,2)"),
        ("l_shipdate", "ShipDate", "date"), ("l_returnflag", "Flag", "int"),
    ])


LINEITEM_TYPES = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float",
    "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
}


def duck_kind(c: str) -> str:
    """Narrowest type all values of a text column fit, in SQL."""
    v = f"trim({c})"
    tests = [
        ("boolean", f"lower({v}) in ('true', 'false')"), ("integer", f"regexp_full_match({v}, '[+-]?[0-9]+') and try_cast({v} as bigint) is not null"),
        ("float", f"regexp_full_match({v}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"),
        ("date", f"regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast({v} as date) is not null"),
        ("datetime", f"regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}') and try_cast({v} as timestamp) is not null"),
    ]
    present = f"upper({v}) not in ('', 'NULL', 'N/A')"
    body = " ".join(f"when count(*) filter (where {present}) > 0 and coalesce(bool_and({t}) filter (where {present}), false) then '{k}'" for k, t in tests)
    return f"case {body} else 'string' end"


SQL_OF = "case k when 'integer' then 'INTEGER' when 'float' then 'FLOAT' when 'datetime' then 'TIMESTAMP' when 'date' then 'DATE' when 'boolean' then 'BOOLEAN' else 'VARCHAR' end"


@query(
    "view_ddl",
    "select 'CREATE VIEW invoice_lines AS' || chr(10) || 'SELECT' || chr(10) || concat_ws(',' || chr(10), "
    + ", ".join(
        f"(select '  CAST(\"{c}\" AS ' || {SQL_OF} || ') AS {c}' from (select {duck_kind(f'cast({c} as varchar)')} as k from lineitem))"
        for c in LINEITEM_TYPES
    )
    + ") || chr(10) || 'FROM lineitem_text' as ddl",
)
def view_ddl(spark, sf):
    return vw.view_ddl(pf.profile_columns(table(spark, sf, "lineitem")), "invoice_lines", "lineitem_text")


@query("output_names", """select page_id, regexp_replace(b, '^(.*[^.].*)[.][^.]*$', '\\1') || '-20250201-101500-' || left(md5(u), 8) || '.txt' as output_name
from (select page_id, u, regexp_extract(u, '[^/]*$', 0) as b from (select page_id, case when page_id % 2 = 0 then url || '.html' else url end as u from pages))""")
def output_names(spark, sf):
    pages = table(spark, sf, "pages").withColumn("u", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".html"))).otherwise(F.col("url")))
    return pages.select("page_id", runs.output_name(F.col("u"), "20250201-101500", "txt", F.col("u")).alias("output_name"))
