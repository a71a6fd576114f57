"""Labels and their values in any structure, and the references of the markup language."""

import html
import time

import pytest
from pyspark.sql import functions as F

from veriform.sources import labels as lb
from veriform.sources import records as rc


@pytest.mark.parametrize("page,label,value", [
    ("<table><tr><th>Price<td>3 &euro;</table>", "Price", "3 €"),
    ("<table><tr><th>Price<th>Size<tr><td>3<td>4</table>", "Size", "4"),
    ("<table><tr><td>Price</td><td><table><tr><td>3</td></tr></table></td></tr><tr><td>4</td></tr></table>", "Price", "3"),
    ("<dl><dt>Price</dt><dt>also</dt><dd>3</dd></dl>", "Price", "3"),
    ("<dl><dt>Price<dd><p>3</p><dt>Size<dd>4</dl>", "Price", "3"),
    ("<div><span><b>Price</b></span><span><span><i>3</i> per <em>unit</em></span></span></div><p>4", "price", "3 per unit"),
    ("<p><strong>Price:</strong> 3</p><p>4</p>", "Price", "3"),
    ("<p>Price : a:b</p>", "Price", "a:b"),
    ("<p>Prices: 9</p><p>Price</p><p>3</p>", "Price", "3"),
    ("<p>3</p><p>Price</p>", "Price", None),
    ("Price: 3", "Price", "3"),
    ("<p>Price</p><script>1</script><style>2</style><!-- 4 --><textarea>5</textarea><p>3", "Price", "3"),
    ("<p>1 < 2</p><p>Price (net)<br/>3 > 2</p>", "Price (net)", "3 > 2"),
    ("", "Price", None),
    ("<", "Price", None),
])
def test_values_beside_labels(page, label, value):
    assert lb.values_of(page, [label]) == [value]


def test_other_labels_are_no_values():
    assert lb.values_of("<tr><td>Price<td>Size<tr><td>3<td>4", ["Price", "Size", "None"]) == ["3", "4", None]


@pytest.mark.parametrize("part,n", [("<div class=x ", 80_000), ('<a "', 250_000), ("<", 1_000_000), ("<td>", 40_000), ("<!--", 250_000), ("</p>", 250_000), ("<script>", 100_000), ("<table><tr><td>", 3_000)])
def test_long_broken_pages_take_little_time(part, n):
    start = time.monotonic()
    lb.values_of("<p>Price</p>" + part * n, ["Price"])
    assert time.monotonic() - start < 5


def test_columns_and_null_pages(spark):
    df = spark.createDataFrame([(1, "<p>Price: 3", "a"), (2, None, "b")], "`the id` int, page string, _values string")
    got = lb.labelled_values(df, "page", {"p.x": "Price", "s": "Size"}, ["the id", "_values"]).collect()
    assert sorted((r["the id"], r["_values"], r["p.x"], r["s"]) for r in got) == [(1, "a", "3", None), (2, "b", None, None)]


def test_all_named_references(spark):
    texts = ["&Eacute;&iquest;&icirc;&oelig;", "a &amp;eacute; &notin; &NotEqualTilde; &fjlig;", "&nosuch; &amp;amp;&lt;b&gt; R&D &copy &#8364;&euro;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rc.unescape(F.col("t"))).collect()]
    assert got[:2] == [html.unescape(t) for t in texts[:2]]
    assert got[2] == "&nosuch; &amp;<b> R&D &copy €€"
