"""Queries for the sources."""

from __future__ import annotations

import os
from html.entities import html5

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from veriform.plans.registry import query, table
from veriform.plans.workbooks import build_workbook
from veriform.session import scratch
from veriform.sinks import lines as ln
from veriform.sources import documents as dc
from veriform.sources import fixed_width as fw
from veriform.sources import folder as fl
from veriform.sources import labels as lb
from veriform.sources import records as rc
from veriform.sources import workbook as wb

# Documents per written file: files stay small, and so does the one row each becomes when read whole.
PER_FILE = 64


def write_documents(spark, sf, folder: str) -> None:
    """Documents as text files of a few documents each."""
    table(spark, sf, "documents").select("text").write.option("maxRecordsPerFile", PER_FILE).text(folder)


LINES_SQL = "select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by line"


def counted_lines(docs):
    # Each file ends with a line end, which is not a line of its own.
    lines = docs.select(F.explode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("scan_documents", LINES_SQL)
def scan_documents(spark, sf):
    folder = scratch(spark, "documents")
    write_documents(spark, sf, folder)
    return counted_lines(dc.read_documents(spark, folder, "*.txt"))


@query("scan_folder", f"select line, n, cast(null as varchar) as error from ({LINES_SQL}) union all select null, 2, 'Could not load file'")
def scan_folder(spark, sf):
    """Every line of the files, and rows for a file that cannot be read and for one that was asked for and is not there."""
    folder = scratch(spark, "folder")
    write_documents(spark, sf, folder)
    spark.range(1).select(F.lit("not for the pattern").alias("value")).write.mode("append").option("compression", "gzip").text(folder)
    system, at = fl.file_system(folder)
    asked = ["part-gone.txt"]
    if isinstance(system, fs.LocalFileSystem):
        os.symlink(f"{at}/nowhere", f"{at}/part-broken.txt")
    else:
        asked.append("part-broken.txt")
    every = dc.read_documents(spark, folder, "part-*.txt", asked)
    bad = every.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("line"), "n", "error")
    return counted_lines(every.filter("error is null")).withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@query("file_provenance", "select cast(count(*) as bigint) as lines, cast(sum(strlen(text) + 1) as bigint) as bytes, true as named from (select unnest(string_split(text, chr(10))) as text from documents)")
def file_provenance(spark, sf):
    folder = scratch(spark, "provenance")
    write_documents(spark, sf, folder)
    # Stripping a file would drop its blank last lines from the count, so the fixture counts line ends.
    files = dc.with_provenance(dc.read_documents(spark, folder, "*.txt"))
    ends = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))
    return files.agg(
        F.sum(ends).cast("bigint").alias("lines"), F.sum("byte_size").alias("bytes"),
        F.bool_and(F.col("file_name").startswith("part-") & F.col("file_path").endswith(F.col("file_name"))).alias("named"),
    )


ORDER_SCHEMA = "o_orderkey bigint, note string, o_totalprice decimal(18,2), o_orderdate date"
ORDER_NOTE = """case o_orderkey % 4 when 0 then concat('a, "b" ', o_orderpriority) when 1 then concat('two', chr(10), 'lines') when 2 then null else o_orderpriority end"""


@query("scan_delimited", f"select o_orderkey, {ORDER_NOTE} as note, cast(o_totalprice as decimal(18,2)) as o_totalprice, cast(o_orderdate as date) as o_orderdate from orders")
def scan_delimited(spark, sf):
    folder = scratch(spark, "orders-csv")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.expr(ORDER_NOTE).alias("note"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate").cast("date")
    )
    ln.write_csv(orders, folder)
    return rc.read_delimited(spark, folder, ",", True, ORDER_SCHEMA)


@query(
    "scan_json",
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type, json_valid(props) as valid from events",
)
def scan_json(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), "event_type", F.try_parse_json("props").isNotNull().alias("valid"))


NO_SCRIPT = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


def duck_unescape(c: str) -> str:
    """The named entities that the tables hold; the ampersand goes last."""
    for name in ("copy", "middot", "lt", "gt", "quot", "nbsp", "larr", "amp"):
        c = f"""replace({c}, '&{name};', '{html5[name + ";"]}')"""
    return c


def duck_inner(c: str) -> str:
    return "trim(regexp_replace(" + duck_unescape(f"regexp_replace({c}, '<[^>]*>', '', 'g')") + ", '[ \\t\\n\\f\\r\\v]+', ' ', 'g'))"


def duck_tag(tag: str) -> str:
    inside = f"regexp_extract(h, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
    return f"nullif({duck_inner(inside)}, '')"


@query(
    "html_fields",
    f"""select page_id, {duck_tag('title')} as title, {duck_tag('h1')} as heading, nullif(regexp_extract(h, '(?is)<html\\b[^>]*\\blang="([^"]*)"', 1), '') as lang,
  {duck_tag('p')} as first_paragraph from (select page_id, {NO_SCRIPT} as h from pages)""",
)
def html_fields(spark, sf):
    fields = {"title": rc.tag_text("title"), "heading": rc.tag_text("h1"), "lang": rc.attribute("html", "lang"), "first_paragraph": rc.tag_text("p")}
    return rc.extract_html(table(spark, sf, "pages"), "html", fields, ["page_id"])


# Mark-up around a document's text, and what must be read from it, written out by hand.
PLANTED_HTML = """concat('<html lang=en><body><a data-href="no" href=''/a?x=1&amp;y=2''>one</a><a class=big href=/b>two</a><A HREF="/c&#47;d">three</A><h1 class=''top main''>Caf&eacute; &#8217;x&#x2014;y&#38;lt; &mdash;</h1>',
  '<h1 class="topmost">no</h1><p>Price (net): </p><b>12</b><p>', replace(replace(replace(text, '&', '+'), '<', '('), '>', ')'), '</p></body></html>')"""


@query(
    "html_planted",
    "select doc_id, 'en' as lang, '/a?x=1&y=2 /b /c/d' as links, 'Café ’x—y&lt; —' as heading, '12' as price, "
    "cast(length(trim(regexp_replace(replace(replace(replace(text, '&', '+'), '<', '('), '>', ')'), '[ \t\n\f\r\v]+', ' ', 'g'))) as bigint) as body from documents",
)
def html_planted(spark, sf):
    fields = {"lang": rc.attribute("html", "lang"), "links": rc.attribute_list("a", "href"), "heading": rc.tag_text("h1", "main"), "price": rc.labelled("Price (net)"), "bodies": rc.tag_list("p")}
    found = rc.extract_html(table(spark, sf, "documents").withColumn("page", F.expr(PLANTED_HTML)), "page", fields, ["doc_id"])
    return found.select("doc_id", "lang", F.array_join("links", " ").alias("links"), "heading", "price", F.length(F.element_at("bodies", -1)).cast("bigint").alias("body"))


# The same four facts of a document in tables, lists, nested elements and lines; half of them are left open by their end tags.
FACTS_HTML = """case doc_id % 6
  when 0 then concat('<table><tr><th>Source</th><td>', source, '</td></tr><tr><th>Language:</th><td><span>', lang, '</span></td></tr><tr><th>Net size</th><td>', n_chars, '</td></tr><tr><th>Ref</th><td>', doc_id, '</td></tr></table>')
  when 1 then concat('<table><thead><tr><th>Ref<th>Source<th>Net size<th>Language</thead><tr><td>', doc_id, '<td>', source, '<td>', n_chars, '<td><b>', lang, '</b></table>')
  when 2 then concat('<dl><dt>Source<dd>', source, '<dt>Language<dd>', lang, '<dt>Net size<dd><p>', n_chars, '</p><dt>Ref<dd>', doc_id, '</dl>')
  when 3 then concat('<div><div><span><i>Source</i></span><div><span>', source, '</span></div></div><div><span>Language</span>: <span><em>', lang, '</em></span></div><div><label>Net size</label><div><div>', n_chars, '</div></div></div><p>Ref: ', doc_id, '</p></div>')
  when 4 then concat('<ul><li>Source: ', source, '<li><b>Language</b>: ', lang, '<li>NET SIZE : <u>', n_chars, '</u><li>Ref:<br>', doc_id, '</ul>')
  else concat('<table><tr><td>Source</td><td>Language</td></tr><tr><td>', source, '</td><td>', lang, '</td></tr></table><section><h3>Net size</h3><p>', n_chars, '</p></section><p title="Ref: no">Ref</p><!-- Ref: 0 --><script>Ref: 1</script><p>', doc_id) end"""
FACTS_PAGE = f"""concat('<html><body><p>', replace(replace(replace(text, '&', '+'), '<', '('), '>', ')'), '</p>', {FACTS_HTML}, '<p>', replace(replace(replace(text, '&', '+'), '<', '('), '>', ')'), '</p></body></html>')"""


@query("html_labels", "select doc_id, source, lang, cast(n_chars as varchar) as size, cast(doc_id as varchar) as ref from documents")
def html_labels(spark, sf):
    pages = table(spark, sf, "documents").withColumn("page", F.expr(FACTS_PAGE)).select("doc_id", "page")
    return lb.labelled_values(pages, "page", {"source": "Source", "lang": "Language", "size": "Net size", "ref": "Ref"}, ["doc_id"])


@query(
    "html_links",
    f"""select page_id, cast(len(l) as bigint) as n, array_to_string(list_transform(l, lambda x: {duck_unescape('x')}), ' ') as links
from (select page_id, regexp_extract_all(h, '(?is)<a\\b[^>]*\\bhref="([^"]*)"', 1) as l from (select page_id, {NO_SCRIPT} as h from pages))""",
)
def html_links(spark, sf):
    found = rc.extract_html(table(spark, sf, "pages"), "html", {"links": rc.attribute_list("a", "href")}, ["page_id"])
    return found.select("page_id", F.size("links").cast("bigint").alias("n"), F.array_join("links", " ").alias("links"))


BOOK_ROWS = 500
BOOK_SQL = f"""with r as (select c_custkey // {BOOK_ROWS} as b, c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then null else c_mktsegment end as s,
  cast(row_number() over (partition by c_custkey // {BOOK_ROWS} order by c_custkey) as integer) as row from customer),
h as (select distinct b from r)
select 'book-' || b as file, 0 as row, c as col, v as value from h cross join (values (0, 'id'), (1, 'name'), (2, 'nation'), (3, 'segment')) t(c, v)
union all select 'book-' || b, row, 0, cast(c_custkey as varchar) from r union all select 'book-' || b, row, 1, c_name from r
union all select 'book-' || b, row, 2, cast(c_nationkey as varchar) from r union all select 'book-' || b, row, 3, s from r where s is not null"""


@query("scan_workbook", BOOK_SQL)
def scan_workbook(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.concat(F.lit("book-"), F.floor(F.col("c_custkey") / BOOK_ROWS).cast("string")).alias("file_path"), "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_custkey")
        rows = [(int(r.c_custkey), r.c_name, int(r.c_nationkey), r.segment) for r in pdf.itertuples()]
        return pd.DataFrame({"file_path": [pdf["file_path"].iloc[0]], "content": [build_workbook(["id", "name", "nation", "segment"], rows)]})

    # Customer keys are unique, so a group has at most BOOK_ROWS rows.
    books = customers.groupBy("file_path").applyInPandas(build, "file_path string, content binary")
    cells = wb.workbook_cells(wb.parse_workbooks(books))
    return cells.select(F.col("file_path").alias("file"), "row", "col", "value")


FIXED = "concat(lpad(cast(s_suppkey as {s}), 12, ' '), rpad(s_name, 25, ' '), lpad(cast(s_nationkey as {s}), 4, ' '), lpad(case when s_suppkey % 9 = 0 then 'n/a' else cast(cast(s_acctbal as decimal(18,2)) as {s}) end, 14, ' '))"


@query(
    "scan_fixed_width",
    "select s_suppkey, s_name, s_nationkey, case when s_suppkey % 9 <> 0 then cast(s_acctbal as decimal(18,2)) end as s_acctbal from supplier",
)
def scan_fixed_width(spark, sf):
    lines = table(spark, sf, "supplier").select(F.expr(FIXED.format(s="string")).alias("line"))
    return rc.read_fixed_width(lines, "line", [("s_suppkey", 1, 12, "bigint"), ("s_name", 13, 25, "string"), ("s_nationkey", 38, 4, "int"), ("s_acctbal", 42, 14, "decimal(18,2)")])


WIDE = FIXED.replace("cast(s_suppkey as {s})", "cast(s_suppkey * 997 as {s})")


@query(
    "fixed_width_inferred",
    "select s_suppkey * 997 as id, s_name, s_nationkey, case when s_suppkey % 9 <> 0 then cast(s_acctbal as decimal(18,2)) end as s_acctbal from supplier",
)
def fixed_width_inferred(spark, sf):
    """Records of the suppliers, the places of their fields found from the lines."""
    lines = table(spark, sf, "supplier").select(F.expr(WIDE.format(s="string")).alias("line"))
    types = {"id": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "decimal(18,2)"}
    spec = fw.infer_fields(lines, "line", list(types))
    return rc.read_fixed_width(lines, "line", [(name, start, length, types[name]) for name, start, length, _ in spec])


LATIN = "regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?'{g})"


@query("decode_fallback", "select doc_id, case when doc_id % 3 = 0 then " + LATIN.replace("{g}", ", 'g'") + " else text end as value from documents")
def decode_fallback(spark, sf):
    latin = F.encode(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", dc.decode_text(content).alias("value"))


@query("sample_lines", "select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) as sample from documents")
def sample_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", dc.sample_lines(F.col("text"), 3).alias("sample"))
