"""The edit distance against the plain table."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import distance as D
from vellum.functions import text as T


def plain(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


@pytest.mark.parametrize("first", [1, 3, 64])
def test_random_pairs(first, monkeypatch):
    monkeypatch.setattr(D, "FIRST", first)
    monkeypatch.setattr(D, "WIDE", 0 if first == 3 else 8192)
    draw = random.Random(first)
    for _ in range(400):
        kinds = draw.choice([2, 3, 10])
        x = [draw.randrange(kinds) for _ in range(draw.randint(0, 40))]
        y = [draw.randrange(kinds) for _ in range(draw.randint(0, 40))] if draw.random() < 0.5 else [c for c in x if draw.random() > 0.1] + [draw.randrange(kinds) for _ in range(draw.randint(0, 4))]
        assert D.edit_distance(np.array(x, np.int64), np.array(y, np.int64)) == plain(x, y)


def test_long_texts_in_seconds(spark):
    draw = np.random.default_rng(3)
    text = "".join(map(chr, draw.integers(0x3042, 0x3090, 200_000)))
    other = "x" + text[:50_000] + "山" + text[50_001:120_000] + text[120_007:] + "é"
    began = time.perf_counter()
    df = spark.createDataFrame([(text, other), (text, None), ("ab", "é")], "a string, b string")
    assert [r.d for r in df.select(D.char_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [10, None, 2]
    assert time.perf_counter() - began < 60


def test_long_lists_of_words(spark):
    words = [f"w{i * i % 9973}" for i in range(30_000)]
    changed = words[:100] + ["new", "words"] + words[101:20_000] + words[20_003:]
    df = spark.createDataFrame([(" ".join(words), " ".join(changed))], "a string, b string")
    assert df.select(T.word_distance(F.col("a"), F.col("b")).alias("d")).first().d == 5
