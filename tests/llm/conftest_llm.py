"""Rows that the tests of these operators share."""

import random

VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvz"


def words(rng: random.Random, n: int, syllables: tuple[int, int] = (2, 4)) -> list[str]:
    return ["".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(*syllables))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, n)).capitalize() + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(rng: random.Random) -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, the same id twice, and a long text."""
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, prose(rng, 80)), (6, prose(rng, 80)), (7, "same row"), (7, "same row"),
        (None, "no id"), (None, None), (8, " ".join(words(rng, 30_000))), (9, "x" * 200_000), (10, "zß é  \U0001f600 \x00 end"), (11, "a\n" * 500),
    ]


def with_clashes(docs):
    """Extra columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("id", "uid", "h", "row", "fp", "key", "size", "copies_", "cut", "s", "e", "text_", "score", "y", "words", "window", "id_", "h_", "n")})
