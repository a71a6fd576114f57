import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SCHEMA, odd_rows, with_clashes

from veriform.llm import collocations as co


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(rows, least, longest, most):
    """Every phrase by counting windows of words; rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    wanted = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in wanted.items():
        if any(q[0] == lang and len(q[1]) > len(p) and c >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, c in wanted.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:most], 1)]
    return sorted(ranked)


def result(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def texts(rng, n):
    """Texts of a small vocabulary with set phrases, in four languages and none."""
    vocab = ["The", "a", "of", "é", "to", "Ünder", "x y", "\U0001f600", "in", "be", "o", "it"]
    fixed = ["New York City hall is", "as well as", "in be a of to the", "x it"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab))
            if rng.random() < 0.2:
                words[-1] += rng.choice([".", ",", "!", "\n", ";", "?", ":", "\x0b", " . "])
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "de", None, "", "fr"]), "s", 0))
    return rows


@pytest.mark.parametrize("size", [50, 1 << 21])
def test_matches_brute_force_over_many_shards(spark, size):
    rows = texts(random.Random(2), 300)
    rows += rows[:40] + [(None, None, "en", "s", 0), (None, "", None, None, None), (1, "same same same same same same same", "en", None, 1)] * 3
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = result(co.collocations(docs, least=9, longest=5, most=30, size=size))
    assert got == brute([(r[2], r[1]) for r in rows], 9, 5, 30)
    assert len(got) > 50


def test_odd_rows_and_no_rows(spark, make_docs, rng):
    rows = odd_rows(rng)
    got = result(co.collocations(make_docs(rows), least=2, longest=3, most=10))
    assert got == brute([("en", r[1]) for r in rows], 2, 3, 10)
    assert co.collocations(make_docs([]), least=2).count() == 0


def test_scores_beyond_64_bits(spark):
    a = spark.createDataFrame([(10**12, 3 * 10**13, [10**12 + 1, 10**12], [10**12 + 7, 10**12])], "a long, n long, heads array<long>, tails array<long>")
    got = a.select(co.cuts(2).alias("c")).first()["c"]
    assert got["score"] == 1000 * 10**12 * 3 * 10**13 // ((10**12 + 1) * (10**12 + 7))


def test_index_extends_to_both_sides():
    rng = np.random.default_rng(4)
    seq = np.append(rng.integers(0, 4, 400), 0).astype(np.int32)
    index = co.Index(seq, 4)
    windows = {k: Counter(tuple(int(x) for x in seq[i : i + k]) for i in range(len(seq) - k + 1) if (seq[i : i + k] > 0).all()) for k in range(1, 5)}

    def counts(p):
        return [(w, int(n)) for w, n in zip(zip(*(map(int, c) for c in p.words), strict=True), p.size, strict=True)]

    p = index.right(index.whole)
    for k in range(1, 4):
        assert dict(counts(p)) == windows[k] and len(p) == len(windows[k])
        assert [w for w, _ in counts(index.phrases(k))] == sorted(windows[k])
        right, left = index.right(p), index.left(p)
        assert dict(counts(right)) == dict(counts(left)) == windows[k + 1]
        # Either way leads to the same rows of both transforms.
        assert {w: (int(a), int(b)) for (w, _), a, b in zip(counts(right), right.at, right.back, strict=True)} == {w: (int(a), int(b)) for (w, _), a, b in zip(counts(left), left.at, left.back, strict=True)}
        p = right if k % 2 else left


def test_runs_of_kept_phrases():
    seq = np.array([1, 2, 3, 0, 1, 2, 0, 3, 1, 2, 3, 0], np.int32)
    slots = co.slots_of(seq, 2)
    assert [tuple(seq[i : i + 2]) for i in np.flatnonzero(slots >= 0)] == [(1, 2), (2, 3), (1, 2), (3, 1), (1, 2), (2, 3)]
    assert slots[slots >= 0].tolist() == [0, 1, 0, 2, 0, 1]
    kept = np.isin(slots, [0, 1])
    assert co.keep_runs(seq, kept, 2).tolist() == [1, 2, 3, 0, 1, 2, 3, 0]
    assert co.keep_runs(seq, np.zeros(len(seq), bool), 2).tolist() == []
