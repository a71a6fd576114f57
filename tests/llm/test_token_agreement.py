import random

import public_tokenizers
import pytest

from veriform.llm import token_count as tc


@pytest.fixture(scope="module")
def scores():
    return tc.load_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))


def test_tokens_agree_if_their_text_is_encoded_as_both(scores):
    rng, machine = random.Random(6), tc.Transducer(scores)
    pieces = sorted(p for p in machine.joined if tc.MARK not in p[1:])
    short = [p for p in pieces if len(p) < 4]
    seen = set()
    for _ in range(30_000):
        a, b = rng.choice(pieces if rng.random() < 0.5 else short), rng.choice([p for p in (rng.choice(pieces), rng.choice(short)) if p[0] != tc.MARK] or ["a"])
        want = tc.merged(a + b, scores)[0] == [a, b]
        assert machine.agree(a, b) == want, (a, b)
        seen.add(want)
    assert seen == {True, False}


def test_equal_letters_are_merged_from_the_left(scores):
    machine = tc.Transducer(scores)
    for n in range(1, 40):
        for char in "aeo.=-▁":
            text = char * n
            assert machine.run(text) == len(tc.merged(text, scores)[0])
            for k in range(1, n):
                if machine.joined.get(text[:k]) is not None and machine.joined.get(text[k:]) is not None:
                    assert machine.agree(text[:k], text[k:]) == (tc.merged(text, scores)[0] == [text[:k], text[k:]])


def test_joints_need_parts_before_the_whole():
    with pytest.raises(ValueError):
        tc.joints({"a": -9.0, "b": -9.0, "c": -9.0, "ab": -5.0, "abc": -1.0})


def test_units_end_where_no_piece_reaches_across(scores):
    words, ends = ["stone", "water", "Élan", "мир", "x7"], ["", ",", ".", "!", ".\n", "\n", ":\n\n"]
    text = tc.MARK + tc.MARK.join(w + e + v for w in words for e in ends for v in words) + tc.MARK * 3
    machine = tc.Transducer(scores)
    assert machine.count(text) == len(tc.merged(text, scores)[0])
    # Words and marks are counted apart: 10 words, with and without a word mark, and what is between them; not 245 pairs.
    assert len(machine.units) < 70


def test_transitions_outlast_the_units(scores, monkeypatch):
    monkeypatch.setattr(tc, "KEEP", 40)
    machine, calls = tc.Transducer(scores), []
    known = machine.compile
    monkeypatch.setattr(machine, "compile", lambda *step: calls.append(step) or known(*step))
    texts = [tc.MARK + tc.MARK.join(a + b for b in "abcdefg") for a in "uvwxyz"]
    for _ in range(20):
        for t in texts:
            assert machine.count(t) == len(tc.merged(t, scores)[0])
    assert len(calls) < 60  # 6 first letters, 7 second ones behind each; made again for every round before
