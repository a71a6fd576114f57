"""Records with line breaks in quotes, read in ranges."""

import csv
import io
import random

import pytest

from veriform.sources import quoted as qt
from veriform.sources import records as rc


@pytest.fixture
def small_ranges(spark):
    """Ranges of about 300 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def rows_of(rng, n):
    def field():
        kind = rng.randint(0, 6)
        if kind == 0:
            return "\n".join(rng.choice(["", "a,b", 'he said "no"', "x" * rng.randint(0, 90)]) for _ in range(rng.randint(1, 9)))
        return ["plain", 'a "b" c', "1,2", "é\U0001f600", "", "tail \r\n next"][kind - 1]

    return [(str(i), field(), field()) for i in range(n)]


def written(rows, head=("id", "first name", "b.c")):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(head)
    w.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("max_sent", [qt.SENT, 0])
def test_ranges_give_the_records_of_whole_files(spark, tmp_path, small_ranges, max_sent, monkeypatch):
    rng, want = random.Random(4), []
    for f in range(4):
        rows = rows_of(rng, 60)
        (tmp_path / f"{f}.csv").write_text(written(rows), newline="")
        want += rows
    monkeypatch.setattr(qt.read_records, "__defaults__", (max_sent,))
    lines = qt._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    df = rc.read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "first name", "b.c"]
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(((a, b or None, c or None) for a, b, c in want), key=str)


def test_a_record_over_many_ranges_and_a_header_over_two(spark, tmp_path, small_ranges):
    long_ = "\n".join("line %d of it" % i for i in range(200))
    (tmp_path / "a.csv").write_text(written([("1", long_, "x"), ("2", "y", long_)], ("id", "\n".join(["h" * 50] * 10), "z")), newline="")
    (tmp_path / "b.csv").write_text("\r\n \r\n" + written([("3", "", "q")], ("id", "\n".join(["h" * 50] * 10), "z")) + "\n\n", newline="")
    df = rc.read_delimited(spark, str(tmp_path), schema="id int, a string, b string")
    assert sorted(map(tuple, df.collect())) == [(1, long_, "x"), (2, "y", long_), (3, None, "q")]


def test_without_header_and_other_separators(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\t"x\ty"\n2\t"two\nlines"\n')
    df = rc.read_delimited(spark, str(tmp_path / "a.tsv"), "\t", False)
    assert df.columns == ["_c0", "_c1"] and sorted(map(tuple, df.collect())) == [("1", "x\ty"), ("2", "two\nlines")]


def test_an_open_quote_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,a\n2,"never closed\n3,b\n')
    got = qt.read_records(spark, str(tmp_path / "a.csv")).where("not first").collect()
    assert sorted(r["value"] for r in got) == ["1,a", '2,"never closed\n3,b']
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    assert rc.read_delimited(spark, str(tmp_path / "empty"), schema="a int").count() == 0


def test_no_line_is_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text(written(rows_of(random.Random(1), 50)), newline="")
    plan = qt.read_records(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().executedPlan().toString()
    whole = plan.split("Union")[1].split("Exchange hashpartitioning")[0]
    assert "MapInArrow" in whole and "SortMergeJoin" not in whole
