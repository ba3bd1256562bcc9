from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, `start` int, node int, position int, "
    "shard int, score double, block int, slot int, stats string, fold int, root int, length int, hash int, part int, n_links int, signature string, "
    "__id string, __key string, __position int, __rank int, __source string, id int, of string, chars int, bucket int, band int, label int"
)


def rows_of(pairs):
    """Documents (doc_id, text, source) with columns whose names operators use inside."""
    return [(i, t, "en", s, None, "k", 1, 2, 3, 4, 5, 0.5, 6, 7, "s", 8, 9, 10, 11, 12, 13, "x", "i", "k", 1, 2, "s", 3, "o", 4, 5, 6, 7) for i, t, s in pairs]


@pytest.fixture(scope="session")
def documents(spark):
    def make(pairs):
        return spark.createDataFrame(rows_of(pairs), SCHEMA)

    return make


def sentence(seed: int, words: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randint(0, 60)}" for _ in range(words))


LONG = " ".join(sentence(i, 1000) for i in range(60))
HARD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "One two,three. É ß Σ <|endoftext|> x", "b"),
    (6, LONG, "a"), (7, sentence(7, 80), "a"), (7, sentence(7, 80), "a"), (7, sentence(8, 80), "a"), (None, sentence(9, 80), None),
    (None, sentence(9, 80), None), (8, sentence(9, 80), "c"), (9, sentence(9, 79) + " other", "a"), (10, sentence(9, 80).replace(" ", "\n"), "a"),
    (11, "\x1c\x0b\x0c .,,. 'S ''ll ½ 日本語\u0301 \u200b", "a"), (1 << 60, sentence(11, 3), "a"), (-5, "x" * 70_000, "d"),
]


@pytest.fixture(scope="session")
def hard(documents):
    return documents(HARD).repartition(3)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
