import re

import pytest
from pyspark.sql import functions as F

from conftest_llm import odd_rows, with_clashes, words
from veriform.llm import decontaminate as dc
from veriform.llm import source_mix as sm

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, size=10):
    wins = {}
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item) if item is not None else "")
    out = []
    for i, text in rows:
        w, hit, found = fold(text), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[tuple(w[a : a + n])]
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_matches_brute_force(spark, make_docs, rng, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    few = words(rng, 12)
    items = [(i, " ".join(words(rng, 30))) for i in range(5)] + [(10, "Short ITEM!"), (11, None), (12, ""), (None, "Élan vital Ünder"), (13, " ".join(few)), (13, " ".join(few)), (14, "the the the the the the the the the the the")]
    rows = list(odd_rows(rng))
    for i in range(30):
        w = words(rng, 60)
        if i % 3 == 0:
            p = items[i % 5][1].split()
            w[20:20] = p[i % 7 : 25]
        if i % 5 == 0:
            w[50:50] = ["short-item", "élan", "vital", "ünder", "Élan", "vital", "ünder"]
        if i % 4 == 0:
            w += few[:9] + ["gap"] + few[9:] + ["the"] * 14
        rows.append((100 + i, ", ".join(w)))
    docs = with_clashes(make_docs(rows))
    got = dc.contamination(docs, bench(spark, items))
    assert sorted((str(r["id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()) == brute(rows, items)
    left = dc.clean_rows(docs, bench(spark, items))
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(i for i, _, hit, _ in brute(rows, items) if not hit)


@pytest.mark.parametrize("size", [10, 70])
def test_rows_that_repeat_in_full_keep_their_hits(spark, make_docs, rng, size):
    w = words(rng, 200)
    items = [(1, " ".join(w[50:130])), (2, w[3] + " " + w[4])]
    hit, clean = " ".join(w), " ".join(words(rng, 80))
    rows = [(1, hit), (1, hit), (2, clean), (2, clean), (3, hit), (None, hit), (None, hit), (None, hit), (None, clean)]
    docs = make_docs(rows)
    got = dc.contamination(docs, bench(spark, items), size=size)
    assert sorted((str(r["id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()) == brute(rows, items, size)
    left = dc.clean_rows(docs, bench(spark, items), size=size)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted((str(i), t) for i, t in rows if t == clean)


def test_near_matches(spark, make_docs, rng):
    item = words(rng, 10)
    other = words(rng, 40)
    spread = other[:10] + item[:5] + ["between"] + item[5:] + other[10:]
    turned = other[:7] + item[::-1] + other[7:]
    docs = make_docs([(1, " ".join(spread)), (2, " ".join(turned)), (3, " ".join(item)), (4, " ".join(item[:5] + other + item[5:])), (5, " ".join(other))])
    found = dc.matches(docs, bench(spark, [(1, " ".join(item))]), slop=2)
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"))
    assert {(r["doc_id"], r["kind"]) for r in found.join(ids, "uid").collect()} == {(1, "near"), (2, "near"), (3, "phrase")}


def test_empty_tables(spark, make_docs, rng):
    assert dc.contamination(make_docs([]), bench(spark, [(1, "a b")])).count() == 0
    for items in ([], [(1, None), (2, "!?")]):
        got = dc.contamination(make_docs([(1, "a b"), (2, None)]), bench(spark, items)).collect()
        assert sorted((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got) == [(1, 2, 0, []), (2, 0, 0, [])]


def test_words_are_split_without_a_pattern(spark, make_docs):
    every = [chr(c) for c in [*range(0x180), 0x130, 0x212A, 0x2028, 0x3000, 0xFEFF, 0xFFFD, 0x1F600]]
    rows = [(i, f"A{c}b{c}{c} {c}Z") for i, c in enumerate(every)] + [(-1, None), (-2, ""), (-3, "".join(every)), (-4, " .x. ")]
    docs = make_docs(rows)
    got = docs.select("doc_id", dc._words(F.col("text")).alias("w"))
    assert {r["doc_id"]: r["w"] for r in got.collect()} == {i: fold(t) for i, t in rows}
    lists = dc.postings(docs.select(F.col("doc_id").alias("uid"), "text"), spark.createDataFrame([("z",), ("b",)], "term string"), 2)
    want = {(i, k, w[k], tuple(w[max(0, k - 2) : k + 3])) for i, t in rows for w in [fold(t)] for k in range(len(w)) if w[k] in "zb"}
    assert {(r["uid"], r["pos"], r["term"], tuple(r["near"])) for r in lists.collect()} == want
    counts = dc.contamination(docs, bench(spark, [(1, "a b")]))
    for frame in (got, lists, counts):  # matching words took 9 of 10 seconds of each pass
        assert "regexp" not in frame._jdf.queryExecution().optimizedPlan().toString().lower()


def water(sizes, epochs=3):
    """Targets by giving out what is over again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= epochs * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, None: 7, "c": 900, "d": 1}, {"x": 10}, {None: 5, "": 3}, {"a": 0, "b": 10, "c": 0}, {f"s{i}": 1 + 37 * i % 101 for i in range(30)}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in sm.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water(sizes)
    assert set(got) == set(want)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_fills_targets_and_reruns_agree(make_docs, rng, monkeypatch):
    monkeypatch.setattr(sm, "RANGE_ROWS", 50)
    rows = [(i, " ".join(words(rng, rng.randint(5, 60))), "big" if i % 3 else ("mid" if i % 2 else "tiny")) for i in range(900)]
    rows += [(i, "repeated row", "mid") for i in (5000, 5000, 5000, 5001)]
    docs = make_docs(rows)
    m = sm.mix(docs).collect()
    assert len(m) == len(rows) and all(0 <= r["copies"] <= 3 for r in m)
    per = {}
    for r in m:
        x = per.setdefault(r["source"], [r["target"], 0, r["source_size"], 0])
        x[1] += r["size"] * r["copies"]
        x[3] += r["size"]
    for target, taken, size, total in per.values():
        assert size == total and abs(taken - target) <= 30  # half of the longest document
    again = sorted((r["id"], r["copies"]) for r in sm.mix(docs.repartition(7)).collect())
    assert again == sorted((r["id"], r["copies"]) for r in m)


def test_keys_prefer_heavy_rows(make_docs):
    docs = make_docs([(i, "word " * 10, "only") for i in range(2000)] + [(5000 + i, "word " * 10, "z") for i in range(2000)])
    heavy = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    m = sm.mix(docs, weight=heavy, weights=(1.0, 3.0)).where("source = 'only'").collect()
    taken = [sum(r["copies"] for r in m if r["id"] % 2 == k) for k in (0, 1)]
    assert taken[0] > 2 * taken[1] > 0


def test_odd_rows_and_mixed_rows(make_docs, rng):
    rows = [(*r, s) for r in odd_rows(rng) for s in ("a", None)]
    docs = with_clashes(make_docs(rows))
    m = sm.mix(docs)
    assert m.count() == len(rows)
    assert all((r["copies"] == 0 or r["size"] > 0) and r["copies"] <= 3 for r in m.collect())
    mixed = sm.mixed_rows(docs)
    assert mixed.columns == [*docs.columns, "copies"] and mixed.count() == len(rows)
    assert sorted((r["id"] is None, r["id"] or 0, r["copies"]) for r in m.collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["copies"]) for r in mixed.collect())
    assert sm.mix(make_docs([])).count() == 0 and sm.mixed_rows(make_docs([])).count() == 0
