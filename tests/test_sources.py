"""Layouts of the sample conversions, with short inputs written for the tests."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veriform.functions import values as vl
from veriform.operators import checks as ck
from veriform.operators import mapping as mp
from veriform.plans.stand_ins import TARGET
from veriform.plans.workbooks import build_workbook
from veriform.sinks import json_text as js
from veriform.sinks import lines as ln
from veriform.sources import documents as dc
from veriform.sources import records as rc
from veriform.sources import workbook as wb

INVOICES = '''InvoiceID,CustomerName,CustomerID,InvoiceDate,DueDate,SubTotal,TotalAmount,PaymentStatus,PaymentDate,BillingAddress,Notes
R-77,Harbour Bakery,K9,2023-11-02,2023-12-02,80.00,95.20,Paid,2023-11-20,"4 Mill Lane, Floor 2",ok
R-78,Oak & Sons,K4,2023-11-05,2023-12-05,12.00,14.28,Pending,,"""The Yard, Gate C""","two
lines"
'''
GOLDEN = [
    "InvoiceID|CustomerID|CustomerName|InvoiceDate|DueDate|TotalAmount|PaymentStatus",
    "R-77|K9|Harbour Bakery|2023-11-02|2023-12-02|95.20|Paid",
    "R-78|K4|Oak & Sons|2023-11-05|2023-12-05|14.28|Pending",
]


def lines_of(df):
    return [r["line"] for r in df.collect()]


def test_invoice_csv_to_pipe(spark, tmp_path):
    (tmp_path / "invoices.csv").write_text(INVOICES)
    df = rc.read_delimited(spark, str(tmp_path / "*.csv"), multi_line=True)
    assert df.filter("InvoiceID = 'R-78'").first()["BillingAddress"] == '"The Yard, Gate C"'
    out = mp.project_to_target(df, mp.mapping_for(df, TARGET), TARGET)
    assert lines_of(ln.to_pipe_lines(out)) == GOLDEN
    assert lines_of(ln.to_pipe_lines(out.limit(0))) == GOLDEN[:1]


def test_missing_and_extra_columns(spark):
    df = spark.createDataFrame([("1", "x", "p")], "`Order #` string, Extra string, `Cust. ID` string")
    mapping = mp.mapping_for(df, ["OrderNumber", "CustomerID", "Quantity"], {"Order #": "OrderNumber", "Cust ID": "CustomerID"})
    assert mapping == {"OrderNumber": "Order #", "CustomerID": "Cust. ID"}
    out = mp.project_to_target(df, mapping, ["OrderNumber", "CustomerID", "Quantity"])
    assert lines_of(ln.to_pipe_lines(out)) == ["OrderNumber|CustomerID|Quantity", "1|p|"]


def test_inventory_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        '<?xml version="1.0"?><Stock xmlns="urn:test:stock"><Place><Code>N</Code></Place><Items>'
        '<Item Code="LAMP-1"><Label>Desk lamp</Label><Maker>Lumo</Maker><State>For sale</State><Count><Here>12</Here></Count><Money><Price unit="EUR">39.50</Price></Money></Item>'
        '<Item Code="RUG-9"><Label>Rug</Label><Maker>Weft</Maker><State>Few left</State><Count><Here>2</Here></Count><Money><Price unit="EUR">210.00</Price></Money></Item></Items></Stock>'
    )
    df = rc.read_xml(spark, str(tmp_path / "p.xml"), "Item")
    flat = mp.flatten(df, {"SKU": "_Code", "ProductName": "Label", "Brand": "Maker", "QuantityOnHand": "Count.Here", "Status": "State", "RetailPrice": "Money.Price._VALUE"})
    assert lines_of(ln.to_pipe_lines(flat)) == [
        "SKU|ProductName|Brand|QuantityOnHand|Status|RetailPrice", "LAMP-1|Desk lamp|Lumo|12|For sale|39.5", "RUG-9|Rug|Weft|2|Few left|210",
    ]


VACANCY = '''<html><head><script>var x = "<h1>no</h1>";</script></head><body><h1 class='vacancy head'>Tram driver</h1><div>
<span class=unit>Night lines</span><span class="town">Graz, Austria (On site)</span><span>Ref: TD-31</span>
<span>Since: March 3, 2024</span></div><li>2 years or more</li><h2>About us</h2>
<i class="asset">Patience</i><i class="asset">A/B tests</i><i class="asset">Salt &amp; sand</i><i class="assets">no</i></body></html>'''


def test_job_html_to_csv(spark):
    df = spark.createDataFrame([(VACANCY,)], "html string")
    fields = {
        "JobID": rc.labelled("Ref"), "Title": rc.tag_text("h1", "vacancy"), "Department": rc.tag_text("span", "unit"), "place": rc.tag_text("span", "town"),
        "posted": rc.labelled("Since"), "skills": rc.tag_list("i", "asset"),
    }
    found = rc.extract_html(df, "html", fields)
    out = found.select(
        "JobID", "Title", "Department", F.regexp_extract("place", r"^(.*) \(", 1).alias("Location"), F.regexp_extract("place", r"\((.*)\)", 1).alias("WorkArrangement"),
        vl.iso_date(F.col("posted")).alias("PostedDate"), vl.join_list(F.col("skills")).alias("Skills"),
    )
    assert lines_of(ln.to_csv_lines(out)) == [
        "JobID,Title,Department,Location,WorkArrangement,PostedDate,Skills", 'TD-31,Tram driver,Night lines,"Graz, Austria",On site,2024-03-03,Patience;A/B tests;Salt & sand',
    ]


FLAT = '''<html><body><h1>Canal house</h1><b class="ask">€415,000</b><img alt="x" src='/front.png'><img src=/back.png>
<ul><li><em>Baths:</em> 1 full, 1 half</li><li><em>Floor area:</em> 1,120 sq ft</li></ul>
<h2>Inside (all)</h2><ul class="f"><li>Tiled stove</li><li>Cellar</li></ul><table><tr><th>Dues</th> <td>$95/quarter</td></tr></table>
<p>Call: 555.222.1199</p></body></html>'''


def test_listing_html_to_nested_json(spark):
    df = spark.createDataFrame([(FLAT,)], "html string")
    f = rc.extract_html(df, "html", {
        "title": rc.tag_text("h1"), "price": rc.tag_text("b", "ask"), "baths": rc.labelled("Baths"), "area": rc.labelled("Floor area"), "dues": rc.labelled("Dues"),
        "inside": rc.section_list("Inside (all)"), "images": rc.attribute_list("img", "src"), "license": rc.labelled("License"), "phone": rc.labelled("Call"),
    })
    layout = {
        "property": {
            "title": F.col("title"), "price": vl.clean_number(F.col("price"), "double"),
            "bathrooms": {"full": F.regexp_extract("baths", r"(\d+) full", 1).try_cast("int"), "half": F.regexp_extract("baths", r"(\d+) half", 1).try_cast("int")},
            "squareFootage": vl.clean_number(F.col("area"), "int"), "hoa": {"amount": vl.clean_number(F.col("dues"), "int"), "unit": vl.trailing_unit(F.col("dues"))},
            "features": {"interior": F.col("inside")},
        },
        "agent": {"phone": vl.phone(F.col("phone"))}, "media": {"images": F.col("images")}, "company": {"license": F.col("license")},
    }
    assert json.loads(f.select(js.to_nested_json(layout).alias("j")).first()["j"]) == {
        "property": {
            "title": "Canal house", "price": 415000.0, "bathrooms": {"full": 1, "half": 1}, "squareFootage": 1120, "hoa": {"amount": 95, "unit": "quarter"},
            "features": {"interior": ["Tiled stove", "Cellar"]},
        },
        "agent": {"phone": "(555) 222-1199"}, "media": {"images": ["/front.png", "/back.png"]}, "company": {"license": None},
    }
    row = f.select(ck.mandatory({"title": F.col("title"), "license": F.col("license")}).alias("m"), ck.any_of({"phone": F.col("phone"), "license": F.col("license")}).alias("a")).first()
    assert row["m"] == (False, "Missing: license") and row["a"]["ok"]


@pytest.mark.parametrize(("page", "ok"), [
    ("<html><body><p>a<p>b<br></body></html>", True), ("</html><html >", False), ("<div><b></div>", False), ("<div><b></div></b>", False), ("<DIV></div>", True), ("<x/><y></y>", True),
    ("<script>if (a<b) {'</div>'}</script><!-- <i> -->", True), ("plain", True), ("<ul><li>a<li>b</ul>", True), ("<i></i></i>", False),
])
def test_tags_balance(spark, page, ok):
    assert spark.createDataFrame([(page,)], "t string").select(ck.tags_balance(F.col("t")).alias("c")).first()["c"]["ok"] is ok


@pytest.mark.parametrize(("header", "target"), [("Tax", None), ("No", None), ("Fax", "Fax"), ("Custmer", "Customer"), ("Cstomre", None), ("Amount", "Amount"), ("Amont", "Amount"), ("Amnt", None)])
def test_header_distance_depends_on_length(spark, header, target):
    df = spark.createDataFrame([("1",)], f"`{header}` string")
    assert mp.mapping_for(df, ["ID", "Fax", "Customer", "Amount"]) == ({target: header} if target else {})


def test_numbered_entities(spark):
    df = spark.createDataFrame([("&#65;&#x42;&#128512; &amp;lt; &#38;amp; &#0; &#xD800; &#99999999; &unknown; R&D",)], "t string")
    assert df.select(rc.unescape(F.col("t"))).first()[0] == "AB😀 &lt; &amp; &#0; &#xD800; &#99999999; &unknown; R&D"


def test_json_and_delimited_columns(spark, tmp_path):
    js.write_json_records(spark.sql("select 1 as a, timestamp'2025-01-02 03:04:05.5' as t, cast(null as string) as n"), str(tmp_path / "j"))
    row = rc.read_json(spark, str(tmp_path / "j"), "a int, t string, n string").first()
    assert tuple(row) == (1, "2025-01-02T03:04:05Z", None)
    got = spark.createDataFrame([('1,"a ""b"", c"',)], "l string").select(rc.from_delimited(F.col("l"), "a int, b string").alias("s")).first()["s"]
    assert tuple(got) == (1, 'a "b", c')
    assert spark.sql("select 'abc' as t").select(vl.two_decimals(F.col("t"))).first()[0] is None


def test_unreadable_files_have_a_row(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([("fine",), ("spoilt",)], "value string").repartition(2).write.text(str(folder))
    spoilt = next(p for p in folder.glob("part-*") if p.read_text() == "spoilt\n")
    spoilt.write_text("changed behind its checksum")
    rows = {r["value"]: (r["error"], r["file_path"].endswith(spoilt.name)) for r in dc.read_documents(spark, str(folder), "part-*.txt").collect() if r["value"] != ""}
    assert rows == {"fine\n": (None, False), None: (dc.UNREADABLE, True)}
    listed = dc.read_folder(spark, str(folder), "part-*.txt")
    spoilt.unlink()
    gone = [r["content"] for r in listed.collect()]
    assert all(gone)
    asked = spark.createDataFrame([(str(spoilt),)], "file_path string")
    assert dc.with_missing(asked, dc.read_documents(spark, str(folder), "part-*.txt")).first()["error"] == dc.UNREADABLE


def test_csv_files_round_trip(spark, tmp_path):
    rows = [(1, 'a "q", b', Decimal("1.50")), (2, "two\nlines", None), (3, None, Decimal("-3.00"))]
    df = spark.createDataFrame(rows, "id int, note string, amount decimal(18,2)").repartition(3)
    ln.write_csv(df, str(tmp_path / "out"))
    back = rc.read_delimited(spark, str(tmp_path / "out"), schema="id int, note string, amount decimal(18,2)", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == rows
    texts = [p.read_bytes() for p in (tmp_path / "out").glob("part-*")]
    assert all(t == b"" or t.startswith(b"id,note,amount\r\n") for t in texts)


def test_typed_values_as_text(spark):
    df = spark.sql("select ' a ' as s, 2.5D as d, 1e10D as big, true as t, timestamp'2025-01-02 03:04:05' as ts, cast(null as int) as n, date'2025-01-02' as day")
    assert lines_of(ln.to_pipe_lines(df))[1] == "a|2.5|10000000000|True|2025-01-02T03:04:05||2025-01-02"
    assert lines_of(ln.to_csv_lines(df))[1] == " a ,2.5,10000000000,true,2025-01-02T03:04:05,,2025-01-02"
    assert js.to_json_records(df.select("ts", "n", "t", "day")).first()[0] == '{"ts":"2025-01-02T03:04:05Z","n":null,"t":true,"day":"2025-01-02"}'


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café �".encode() + b"\xff!")
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.log").write_text("no")
    got = {r["file_path"].rsplit("/", 1)[-1]: r["value"] for r in dc.read_documents(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"a.txt": "café �!", "b.txt": "caf"}
    decoded = dc.read_folder(spark, str(tmp_path), "b.txt").select(dc.decode_text(F.col("content")).alias("v"), dc.detect_encoding(F.col("content")).alias("e")).first()
    assert (decoded["v"], decoded["e"]) == ("café", "ISO-8859-1")
    asked = spark.createDataFrame([("x/none.txt",)], "file_path string")
    assert dc.with_missing(asked, dc.read_documents(spark, str(tmp_path), "*.txt")).first()["error"] == "Could not load file"


def test_workbooks(spark, tmp_path):
    book = build_workbook(["Order #", "Day", "Paid"], [("A1", 45672, True), (None, 45672.5, None), ("C & D", 1.5, False)], dates={1})
    (tmp_path / "orders.xlsx").write_bytes(book)
    (tmp_path / "broken.xlsx").write_bytes(b"not a workbook")
    rows = wb.read_workbook(spark, str(tmp_path)).collect()
    bad = [r for r in rows if r["error"]]
    assert len(bad) == 1 and bad[0]["file_path"].endswith("broken.xlsx")
    values = [r["values"] for r in sorted((r for r in rows if not r["error"]), key=lambda r: r["row"])]
    assert values == [["Order #", "Day", "Paid"], ["A1", "2025-01-15", "True"], [None, "2025-01-15 12:00:00"], ["C & D", "1899-12-31 12:00:00", "False"]]


@pytest.mark.parametrize("text,ok", [("-12.5", True), ("=SUM(A1)", False), ("a,=cmd", False), ("x\n+cmd|", False), ("mail me @ home", True), ("- item", True)])
def test_formulas(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(ck.no_injection(F.col("t")).alias("c")).first()["c"]["ok"] is ok
