import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import odd_rows, prose, with_clashes, words
from veriform.llm import line_rules, quality_model, toxicity

WORD = "[^\x20\x09-\x0d]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(make_docs, rng):
    rows = [*odd_rows(rng), (30, "a b c a b c\na b\n\na b\n \n"), (31, "ééé ñ# a\x85b c\xa0d " * 40), (32, "\n".join(["same line here"] * 4))]
    docs = with_clashes(make_docs(rows))
    got = line_rules.clean_lines(docs).collect()
    want = sorted((r[0] is None, r[0] or 0, *counts(r[1])) for r in rows)
    assert sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


@pytest.mark.parametrize(("line", "fault"), [
    ("This is a plain sentence, with a comma and a stop.", None), ("Home | About | Contact us | News", "navigation"),
    ("WIN!! BIG!! MONEY!! NOW!!", "punctuation"), ("THIS LINE SHOUTS AT EVERY READER", "punctuation"), ("some### words*** with$$$ marks", "punctuation"),
    ("spam " * 20, "repetition"), ("Licensed under the Apache License, Version 2.0.", "boilerplate"), ("We use cookies: see our privacy policy.", "boilerplate"),
    ("Menu", "punctuation"), ("Yes.", None), ("", None), ("He said (twice) that 5 < 6 and left.", None),
])
def test_line_rules(line, fault):
    assert line_rules.line_fault(line, line_rules.Rules()) == fault


@pytest.mark.parametrize("line", ["The design in the catalog is new.", "He put the catalog in the box.", "A blog in English, a dialog in French.", "Please spread more butter on it."])
def test_phrases_are_whole_words(line):
    assert line_rules.line_fault(line, line_rules.Rules()) is None
    assert line_rules.line_fault("Please log in, or read more.", line_rules.Rules()) == "boilerplate"


def test_failing_lines_go_and_texts_that_lose_too_much(make_docs, rng):
    good = "\n".join(prose(rng, 30) for _ in range(4))
    menu = "Home | About | News | Contact"
    rows = [(1, good), (2, menu + "\n" + good), (3, "\n".join([menu, "Shop | Cart | Help"] + [prose(rng, 5)])), (4, good + "\n" + good)]
    got = {r["id"]: r for r in line_rules.clean_lines(make_docs(rows)).collect()}
    assert got[1]["passes"] and got[1]["clean_text"] == good
    assert got[2]["passes"] and got[2]["clean_text"] == good and got[2]["lines_lost"] == 1
    assert not got[3]["passes"]
    assert not got[4]["passes"] and got[4]["clean_text"] == good


def junk(rng, n):
    return " ".join(w + rng.choice(("###", "***", "$$$")) for w in words(rng, n))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, make_docs):
    rng = random.Random(8)
    bad = [i % 6 == 0 for i in range(600)]
    docs = make_docs([(i, junk(rng, 80) if b else "\n".join(prose(rng, 25) for _ in range(4))) for i, b in enumerate(bad)])
    labels = labelled(spark, [(i, 1 - b, 0) for i, b in enumerate(bad)])
    got = quality_model.quality_scores(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and 60 < len(held) < 200
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum((r["score"] >= 0.3) != bad[r["id"]] for r in held) >= 0.98 * len(held)
    # held-out labels are not learned
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["id"]: r["score"] for r in quality_model.quality_scores(docs, turned).collect()}
    assert all(abs(again[r["id"]] - r["score"]) < 1e-6 for r in got)
    kept = quality_model.good_rows(docs, labels)
    assert kept.columns == docs.columns
    assert sum(bad[r["doc_id"]] for r in kept.collect()) <= 2 and kept.count() >= 490


def test_isotonic_is_the_closest_rising_fit():
    x, y, w = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1.0, 1, 2, 1, 1, 3])
    fit = quality_model.isotonic(x, w, y)
    assert (np.diff(fit) >= 0).all()
    assert np.allclose(fit, [0.1, 0.325, 0.325, 0.325, 0.825, 0.825])


def test_scores_of_odd_rows_and_labels(spark, make_docs, rng):
    docs = with_clashes(make_docs(odd_rows(rng)))
    odd = [(6, 1, 1), (6, 0, None), (7, None, 0), (8, 1, 0), (None, 1, 1), (99, 0, 1), (5, 0, 0), (4, 0, 1), (9, 0, 0)]
    for rows in (odd, [], [(i, 1, 0) for i in range(12)], [(i, None, None) for i in range(12)]):
        for got in (quality_model.quality_scores(docs, labelled(spark, rows)), toxicity.toxicity_scores(docs, labelled(spark, rows))):
            scores = got.collect()
            assert len(scores) == len(odd_rows(rng))
            assert all(0 <= r["score"] <= 1 for r in scores)
    for docs in (make_docs([]),):
        assert quality_model.quality_scores(docs, labelled(spark, odd)).count() == 0
        assert toxicity.toxicity_scores(docs, labelled(spark, odd)).count() == 0


def test_toxicity_learns_a_pair_that_sums_miss(spark, make_docs):
    """Toxic only if an insult and a group are both there."""
    rng = random.Random(4)
    rows, toxic = [], []
    for i in range(1600):
        w = words(rng, 40)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            w[5] = rng.choice(("grumbler", "dullard"))
        if group:
            w[20] = rng.choice(("northerners", "southerners"))
        toxic.append(int(insult and group))
        rows.append((i, " ".join(w)))
    got = toxicity.toxicity_scores(make_docs(rows), labelled(spark, [(i, 1, t) for i, t in enumerate(toxic)]), settings=toxicity.Settings(terms=64, epochs=40)).collect()
    held = [r for r in got if r["held_out"]]
    assert sum((r["score"] >= 0.5) == toxic[r["id"]] for r in held) >= 0.95 * len(held)


def test_terms_are_folded_and_cut_at_marks():
    import pyarrow as pa

    s = toxicity.Settings()
    row, term = toxicity.term_ids(pa.array(["Idiot, you", "idiot you!", None, "", "IDIOT-you"]), s)
    sets = [set(term[row == i].tolist()) for i in range(5)]
    assert sets[0] == sets[1] == sets[4] != set() and not sets[2] and not sets[3]
