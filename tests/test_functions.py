import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriform.functions import text as tx
from veriform.functions import values as vl


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


def many(spark, values, fn, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", fn(F.col("c")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_tags(spark):
    texts = ["<output>a</output> x <output>b</output>", "</output><output>", "<output></output>", "none", "<OutPut> a\n b\t</OUTPUT>", None]
    assert many(spark, texts, tx.parse_output) == ["a</output> x <output>b", None, "", None, "a\n b", None]
    assert many(spark, texts, lambda c: tx.between_tags(c, *tx.OUTPUT_TAGS)) == ["a", None, "", None, "a\n b", None]


def test_verdicts(spark):
    texts = [
        "<isvalid>True</isvalid>", "<ISVALID> true </IsValid>", "<isvalid>yes</isvalid>", "<isvalid></isvalid>", "no tag",
        "<isvalid>false</isvalid><isvalid>true</isvalid><invalid_msg>a\nb</invalid_msg>",
    ]
    got = [(r["isvalid"], r["invalid_msg"]) for r in many(spark, texts, tx.parse_verdict)]
    assert got == [(True, None), (True, None), (False, None), (None, None), (None, None), (False, "a\nb")]


def test_render_order_and_safe(spark):
    values = {tx.DATA: F.lit("x {<!--RunIndex-->}"), tx.RUN_INDEX: F.lit(2)}
    row = spark.range(1).select(
        tx.render_template("d={<!--Data-->} i={<!--RunIndex-->}", values).alias("a"),
        tx.render_template("d={<!--Data-->} i={<!--RunIndex-->}", values, safe=True).alias("b"),
    ).first()
    assert row["a"] == "d=x 2 i=2"
    assert row["b"] == "d=x {<!--RunIndex-->} i=2"


def test_placeholders(spark):
    assert many(spark, ["a {<!--Output-->}", "a {Output}"], tx.has_placeholders) == [True, False]


def test_block_and_sections(spark):
    start, end = tx.BLOCK_MARKERS
    texts = [f"x {start} k: v {end} y", "Sure\nkey: |\n  a", f"{end} {start}", "nothing here"]
    assert many(spark, texts, tx.extract_block) == ["k: v", "key: |\n  a", None, None]
    spec = "data_conversion_request_msg: |\n  no marker\ndata_validation_request_msg: |\n  {<!--Output-->}\nother: {<!--Data-->}"
    assert one(spark, spec, tx.placeholder_issues) == ["no {<!--Data-->} in data_conversion_request_msg"]


def test_json(spark):
    texts = ['<output> {"a": {"b": 1}} </output>', 'x {"a": 1} y', '<output>{"a": 1,}</output>', "none", '{"a": 1} {"b": 2}']
    assert many(spark, texts, tx.extract_json) == ['{"a": {"b": 1}}', '{"a": 1}', None, None, None]
    assert many(spark, ['{"a":1}} junk {', '{"a":1}] junk [', '1,"y":2', "[1, 2]", "{'a': 1}", None], tx.is_json) == [False, False, False, True, False, False]


def test_strip_like_python(spark):
    texts = ["\t a \n", chr(0xA0) + "b" + chr(0x3000), "", " \x1c", "é "]
    assert many(spark, texts, tx.strip) == [t.strip() for t in texts]


def test_dates(spark):
    texts = ["2025-01-28", "01/28/2025", "January 28, 2025", "28.01.2025", "20250128", "2025/01/28", "2025-01-28 10:00:00", "2025-02-30", "soon", None]
    assert many(spark, texts, vl.iso_date) == ["2025-01-28"] * 7 + [None] * 3


def test_numbers_and_units(spark):
    texts = ["$3,850,000", "$750/month", "6,450 sq ft", "1.8 acres", "call", "-12.50 USD"]
    assert [None if v is None else str(v) for v in many(spark, texts, vl.clean_number)] == ["3850000.00", "750.00", "6450.00", "1.80", None, "-12.50"]
    assert many(spark, texts[:4], vl.trailing_unit) == [None, "month", "sq ft", "acres"]


def test_small_ones(spark):
    assert many(spark, ["Yes", " no", "TRUE", "0", "maybe"], vl.to_boolean) == [True, False, True, False, None]
    assert many(spark, ["555-123-4567", "12", "(555) 123 4567"], vl.phone) == ["(555) 123-4567", "12", "(555) 123-4567"]
    assert many(spark, ["abcd12345", "abcd1234"], vl.mask) == ["abcd...2345", "***"]
    assert many(spark, ["", " null ", "N/A", "x"], vl.null_if_marker) == [None, None, None, "x"]
    assert many(spark, ["Pipe-delimited", "json", "application/xml", "fixed width", "article", "csv json", None], vl.format_category) == [
        "delimited", "json", "xml", "fixed_width", "text", "delimited", "other",
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet="ab|\\\n\r\t\x01\x02\"' é12nr", max_size=12), min_size=3, max_size=3), min_size=1, max_size=20))
@pytest.mark.parametrize("sep", ["|", "\t"])
def test_escaped_lines_come_back(spark, sep, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f array<string>")
    line = F.concat_ws(sep, *[vl.escape_field(F.get("f", j), sep) for j in range(3)])
    got = df.select("i", line.alias("line")).select("i", "line", vl.split_escaped(F.col("line"), sep).alias("f"), vl.field_count(F.col("line"), sep).alias("n")).collect()
    for r in got:
        assert r["f"] == rows[r["i"]]
        assert r["n"] == 3 and "\n" not in r["line"]
