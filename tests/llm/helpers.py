"""Plain restatements and small tables that the tests of several operators use."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ID string, row_ string, text_ string, t_ bigint"


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    line = "one two three four five six seven eight nine ten eleven"
    long = "\n".join(f"{line} {i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, line), (4, line), (5, long), (6, f"a {line}\nb {line}\nc {line}\nd"), (7, f"a {line}\nb {line}\nc {line}\nd"), (None, line), (8, "\x00\u00a0é ＡＢ 😀"), (9, "x")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", None if k % 5 == 0 else len(t or ""), "id", "r", "t", 5) for k, (i, t) in enumerate(rows)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Groups:
    """Union-find; the root of a set is its least member."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
