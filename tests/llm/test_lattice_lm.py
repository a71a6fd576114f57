import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import odd_rows, prose, with_clashes
from pyspark.sql import functions as F

from veriform.llm import lattice_lm as lm

# An invented vocabulary: later pieces are rarer.
SCORES = {p: -float(i) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "c", "aba", "▁▁", "A", "é"] + [x + y for x in "bcdfghklmnprstvz" for y in "aeiou"] + list("defghiklmnoprstuvz."))}


def segmentations(text, vocabulary):
    if not text:
        yield []
        return
    for i in range(1, len(text) + 1):
        if text[:i] in vocabulary.place:
            for rest in segmentations(text[i:], vocabulary):
                yield [vocabulary.place[text[:i]], *rest]
    if text[0] not in vocabulary.place:
        for rest in segmentations(text[1:], vocabulary):
            yield [*(vocabulary.bytes_at + b for b in text[0].encode()), *rest]


@pytest.mark.parametrize("word", ["a", "ab", "ababa", "cabab", "é", "aéxb", "xx\U0001f600", "abab.cab"])
def test_forward_adds_all_segmentations(word):
    vocabulary = lm.Vocabulary(SCORES)
    rng = np.random.default_rng(1)
    p = rng.random(vocabulary.size)
    p /= p.sum()
    all_ = list(segmentations("▁" + word, vocabulary))
    each = np.array([np.prod(p[s]) for s in all_])
    lattice = lm.Lattice(vocabulary, p)
    assert lattice.log_probability(word.encode()) == pytest.approx(math.log(each.sum()))
    uses = np.zeros(vocabulary.size)
    lattice.expect(word.encode(), 3, uses)
    want = np.zeros(vocabulary.size)
    for s, w in zip(all_, each / each.sum(), strict=True):
        np.add.at(want, s, 3 * w)
    assert np.allclose(uses, want)


def test_vocabulary_is_a_distribution_without_other_marks():
    v = lm.Vocabulary(SCORES)
    assert v.guess.sum() == pytest.approx(1) and (v.guess > 0).all()
    assert not {"▁▁", "A"} & v.place.keys()


def words_of(text):
    return ("".join(c.lower() if c.isascii() else c for c in text or "")).encode().split()


def brute(rows, turns, prior, start):
    v = lm.Vocabulary(SCORES)
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            c.update([*words_of(t), lm.END])
    n, size, p = sum(c.values()), sum(c.values()) + len(c) + 1, v.guess
    for _ in range(turns):
        uses, lattice = np.zeros(v.size), lm.Lattice(v, p)
        for w in c:
            if w != lm.END:
                lattice.expect(w, 1, uses)
        p = (uses + prior * v.guess) / (uses.sum() + prior)
    once, twice = (sum(k == x for k in c.values()) for x in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    lattice, out = lm.Lattice(v, p), []
    for (i, t), h in zip(rows, held, strict=True):
        w = [*words_of(t), lm.END]
        base = sum(math.log10((c[x] + 1) / size) for x in w)
        logs = {x: math.log(p[-1]) if x == lm.END else lattice.log_probability(x) for x in set(w)}
        before, score = Counter(), 0.0
        for k, x in enumerate(w):  # word by word, as the urn fills
            if c[x] or before[x] or logs[x] > -600:
                new = max(c[x] - d, 0) / n + d * len(c) / n * math.exp(logs[x])
                score += math.log10((before[x] + start * new) / (k + start))
            else:
                score += (math.log(d * len(c) / n * start / (k + start)) + logs[x]) / math.log(10)
            before[x] += 1
        out.append((str(i), h, len(w), sum(c[x] > 0 for x in w), n, pytest.approx(base), pytest.approx(score), pytest.approx(sum(logs[x] for x in w) / math.log(10))))
    return out


@pytest.mark.parametrize("frequent", [20, lm.FREQUENT])
def test_matches_brute_force(make_docs, rng, frequent):
    rows = odd_rows(rng) + [(100 + i, prose(rng, rng.randint(1, 60))) for i in range(60)]
    rows += [(200, "long " * 3 + "y" * 100), (201, "y" * 100 + " Y" + "Y" * 99), (202, "y" * 101)]
    got = lm.lattice_scores(with_clashes(make_docs(rows)), SCORES, frequent=frequent).collect()
    keys = ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "pieces_score")
    got = sorted(((str(r["id"]), *(r[k] for k in keys[1:])) for r in got), key=lambda r: (r[0], r[2], r[5]))
    want = sorted(brute(rows, 2, 1000.0, 3000.0), key=lambda r: (r[0], r[2], r[5].expected))
    assert got == want


def test_slices_of_a_text(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 10)
    text = "Some words and averyveryverylongone\nmore\x0bhere é  ".encode()
    assert [w for part in lm.word_lists(text) for w in part] == text.lower().split()


def test_nothing_to_learn_from(make_docs):
    assert lm.lattice_scores(make_docs([]), SCORES).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.lattice_scores(make_docs([(held, "ab ab"), (held, None)]), SCORES).orderBy("n_tokens").collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert got[1]["score"] < got[0]["score"] < 0


def test_urn_is_a_product_of_draws():
    words = lm.Words(100, 10, 0.5, 30.0)
    for p in (0.3, 1e-9):
        for times in (1, 2, 7, 8, 9, 30, 1000):
            want = sum(math.log(k + 30 * p) for k in range(times))
            assert words.drawn(np.array([math.log(p)]), np.array([times]))[0] == pytest.approx(want, rel=1e-10)
    assert words.drawn(np.array([-5000.0]), np.array([3]))[0] == pytest.approx(math.log(30) - 5000 + math.log(2))


def test_words_and_new_words_share_one(spark):
    words = lm.Words(1000, 4, 0.5, 30.0)
    counts = np.array([500, 300, 199, 1])
    none = np.log(np.full(4, 1e-300))
    assert np.exp(words.log_probability(counts, none)).sum() == pytest.approx(1 - 0.5 * 4 / 1000)


def test_texts_are_likelier_than_by_pieces_alone(spark):
    from veriform.llm import queries

    s = queries.op13_lattice_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("pieces_score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print(tuple(s))
    assert s[0] > s[1] and s[0] > 1.2 * s[2]


def test_many_words_at_once_are_like_one_by_one():
    rng, vocabulary = random.Random(9), lm.Vocabulary(SCORES)
    p = np.random.default_rng(2).random(vocabulary.size)
    p /= p.sum()
    words = [bytes(rng.choice([97, 97, 98, 99, 195, 169, 255, 0, 46]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    words += ["ab😀é".encode() * 3, b"ab" * 40, b"x" * 200, b"z" * 63, b"z" * 64] + [b"ababcab"] * 20
    one, many = lm.Lattice(vocabulary, p), lm.Lattices(vocabulary, p)
    assert np.allclose(many.log_probabilities(words), [one.log_probability(w) for w in words])
    a, b = np.zeros(vocabulary.size), np.zeros(vocabulary.size)
    many.expect(words, a)
    for w in words:
        one.expect(w, 1.0, b)
    assert np.allclose(a, b)


def test_random_words_have_a_probability():
    rng, vocabulary = random.Random(3), lm.Vocabulary(SCORES)
    lattice = lm.Lattice(vocabulary, vocabulary.guess)
    for _ in range(200):
        word = bytes(rng.choice([97, 98, 99, 195, 169, 255, 0, 46]) for _ in range(rng.randint(1, 12)))
        assert -math.inf < lattice.log_probability(word) < 0
