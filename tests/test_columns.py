"""Numbers with signs, layouts that a column decides, JSON of several shapes, rows whose key changed, headers that are escaped."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.functions import values as vl
from veriform.operators import pairing
from veriform.operators import profile as pf
from veriform.plans import reconcile as pr
from veriform.sinks import lines as ln
from veriform.sources import mixed_json as mj


@pytest.mark.parametrize("text,number", [
    ("-$1,250.00", "-1250.00"), ("($5.00)", "-5.00"), (" (1,000) ", "-1000.00"), ("12.50-", "-12.50"), ("€-3", "-3.00"), ("-€ 3", "-3.00"), ("−7", "-7.00"), ("-EUR 3", "-3.00"),
    ("USD 4", "4.00"), ("$5-$9", "5.00"), ("(555) 123", "555.00"), ("net - 8", "8.00"), ("2020-05-06", "2020.00"), ("A-12", "-12.00"), ("3 (-4)", "3.00"), ("none", None), ("", None), (None, None),
])
def test_signs_of_numbers(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(vl.clean_number(F.col("t")).cast("string")).first()[0]
    assert got == number


def layouts(spark, values):
    row = pf.column_layouts(spark.createDataFrame([(v,) for v in values], "`my day` string")).first()
    return row["layouts"], row["n"], row["undated"]


def test_a_column_decides_its_layout(spark):
    assert layouts(spark, ["03/04/2024", "05/06/2024", None, "n/a"]) == (["MM/DD/YYYY", "DD/MM/YYYY"], 2, 0)
    assert layouts(spark, ["03/04/2024", " 13/06/2024 "]) == (["DD/MM/YYYY"], 2, 0)
    assert layouts(spark, ["13/04/2024", "04/13/2024"]) == ([], 2, 0)
    assert layouts(spark, ["2024-02-30"]) == ([], 1, 1)
    assert layouts(spark, ["29/02/23", "01/02/03"]) == (["YY/MM/DD"], 2, 0)
    assert layouts(spark, [None, ""]) == ([], 0, 0)


def brute_json(values):
    out = {}

    def walk(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for x in v:
                walk(x, path + "[]")
        elif v is not None:
            out.setdefault(path, set()).add("boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string")

    for v in values:
        walk(v, "")
    return {p: k.pop() if len(k) == 1 else "string" for p, k in out.items()}


def test_types_of_random_json(spark):
    rng = random.Random(5)
    names = ["a", "b c", "d`e", "f.g", "h:i,j<k>", "é"]

    def value(depth):
        kind = rng.randint(0, 5 if depth < 3 else 3)
        if kind == 4:
            return [rng.choice([1, 2, None]) for _ in range(rng.randint(1, 3))]
        if kind == 5:
            return {n: value(depth + 1) for n in rng.sample(names, rng.randint(1, 3))}
        return [1, "x", True, 7][kind]

    # One shape per name, so that only plain values conflict.
    shapes = {n: value(1) for n in names}
    values = []
    for _ in range(40):
        values.append({n: (rng.choice([1, "t", False]) if not isinstance(shapes[n], dict | list) and n == "a" else shapes[n]) for n in rng.sample(names, 3)})
    kind = mj.infer_json(spark.createDataFrame([(json.dumps(v),) for v in values] + [("{broken",), (None,)], "j string"), "j")
    assert dict(mj.type_paths(kind)) == brute_json(values)


def test_mixed_places_are_text(spark):
    rows = ['{"a": 1, "n": {"x": [1]}}', '{"a": "one", "n": {"x": ["b", {"c": 2}]}}', '{"a": {"b": 2}}', "nothing", None, "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "`the j` string")
    kind = mj.infer_json(df, "the j")
    assert kind == T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.StructType([T.StructField("x", T.ArrayType(T.StringType()))]))])
    got = [r["parsed"] and (r["parsed"]["a"], r["parsed"]["n"] and r["parsed"]["n"]["x"]) for r in mj.with_parsed(df, "the j").collect()]
    assert got[:3] == [("1", ["1"]), ("one", ["b", '{"c":2}']), ('{"b":2}', None)]
    assert mj.infer_json(df.limit(0), "the j") == T.StringType()
    numbers = spark.createDataFrame([("1",), ("2",)], "j string")
    assert [r["parsed"] for r in mj.with_parsed(numbers, "j").collect()] == [1, 2]


def test_every_changed_key_is_paired(spark):
    sf = "/root/testdata/sf0.01"
    pairs = pairing.paired_rows(pr.source(spark, sf), pr.damaged(spark, sf), ["o_orderkey"], pr.FIELDS).collect()
    moved = {r[0] for r in pr.source(spark, sf).where("o_orderkey % 211 = 0 and o_orderkey % 101 <> 0").select("o_orderkey").collect()}
    added = [r["added_o_orderkey"] for r in pairs]
    assert {-a - 1 for a in added} == moved and len(moved) > 40
    right = [r for r in pairs if r["lost_o_orderkey"] == -r["added_o_orderkey"] - 1]
    assert len(right) >= 0.95 * len(moved)
    assert len({r["lost_o_orderkey"] for r in pairs}) == len(pairs)


def test_copies_give_no_combinations(spark):
    lost = spark.createDataFrame([(i, "a", None, 1) for i in range(50)] + [(100, "b", "x", 2), (101, "c", "x", 3), (1000, "z", "z", 9)], "k int, `p q` string, r string, s int")
    added = spark.createDataFrame([(i + 5000, "a", None, 1) for i in range(30)] + [(6000, "b", "y", 2), (6001, "c", "x", 4), (1000, "z", "z", 9)], "k int, `p q` string, r string, s int")
    got = [(r["lost_k"], r["added_k"], r["changed"]) for r in pairing.paired_rows(lost, added, ["k"], ["p q", "r", "s"]).collect()]
    assert sorted(got) == [(i, i + 5000, None) for i in range(30)] + [(100, 6000, "r"), (101, 6001, "s")]
    plan = pairing.paired_rows(lost, added, ["k"], ["p q", "r", "s"])
    assert Counter(r["changed"] for r in plan.collect())[None] == 30


def test_header_names_are_escaped(spark):
    df = spark.createDataFrame([("x|y",)], "`a|b\\c` string")
    got = [r["line"] for r in ln.to_pipe_lines(df).collect()]
    assert got == ["a\\|b\\\\c", "x\\|y"]


def test_fields_of_fixed_width_lines(spark):
    from veriform.sources import fixed_width as fw

    rng = random.Random(3)
    rows = [(rng.randint(1, 99999), rng.choice(["bolt", "washer", "nut m8"]), "AB" + rng.choice("xyz"), rng.choice(["9.50", "-120.25", "n/a"])) for _ in range(200)] + [(7, "a", "ABx", "1.00")]
    lines = [f"{n:>6}{code}{name:<10}{amount:>75}  {'E':<3}" for n, name, code, amount in rows] + ["", None, "   "]
    df = spark.createDataFrame([(x.rstrip() if x else x,) for x in lines], "`the line` string").repartition(3)
    spec = fw.infer_fields(df, "the line", ["n", "code_name", "amount", "flag"])
    assert [(name, start) for name, start, *_ in spec] == [("n", 1), ("code_name", 7), ("amount", 16), ("flag", 97)]
    facts = fw.column_facts(df, "the line")
    shown = [x for x in lines if x and x.strip()]
    for p in range(len(facts["ever"])):
        column = [(x + " " * 200)[p] for x in shown]
        assert facts["ever"][p] == str(int(any(c != " " for c in column)))
        assert facts["always"][p] == str(int(all(c != " " for c in column)))
        assert facts["begins"][p] == str(int(any(c != " " and (p == 0 or x[p - 1] == " ") for x, c in zip(shown, column, strict=True))))
        assert facts["ends"][p] == str(int(any(c != " " and (x + " " * 200)[p + 1] == " " for x, c in zip(shown, column, strict=True))))
    assert fw.infer_fields(df.limit(0), "the line") == []
