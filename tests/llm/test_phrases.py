from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import empty, odd
from vellum.llm import phrases as P
from vellum.llm import queries


def plain(rows, least, longest=5, top=2000):
    """The result by counting every gram of every piece."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda c: c[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    for lang, counts in f.items():
        found, most = [], Counter()
        for p, a in counts.items():
            ws = p.split(" ")
            if len(ws) > 1 and a >= least:
                cuts = [(" ".join(ws[:k]), " ".join(ws[k:])) for k in range(1, len(ws))]
                score, k = min((1000 * a * n[lang] // (counts[x] * counts[y]), k) for k, (x, y) in enumerate(cuts))
                found.append((-score, -a, p.encode(), counts[cuts[k][0]], counts[cuts[k][1]]))
                for size in range(2, len(ws)):
                    for i in range(len(ws) - size + 1):
                        inner = " ".join(ws[i : i + size])
                        most[inner] = max(most[inner], a)
        kept = sorted(x for x in found if 100 * most[x[2].decode()] < 100 * -x[1])
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(kept[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_its_twin(same):
    same(queries.op11_phrase_collocations, P.SQL)


def test_odd_rows(spark):
    docs = odd(spark)
    for least, longest in ((2, 5), (1, 3), (1, 1), (2, 2), (3000, 5)):
        assert rows(P.collocations(docs, least=least, longest=longest)) == plain([(r.lang, r.text) for r in docs.collect()], least, longest)
    assert rows(P.collocations(empty(spark))) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BITS", 6)  # a bitmap with many false positives changes nothing
    monkeypatch.setattr(P, "MOST_BITS", 7)
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cc", "é", "Ünd", " ", "x\x00y", "#"])
    text = lambda: "".join(word() + rng.choice([" ", " ", " ", "\t", "  ", ". ", "!", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    given = [(rng.choice(["en", None, "de"]), text()) for _ in range(150)]
    given += [("en", "the same piece over and over. A b")] * 75  # a third of the rows
    docs = spark.createDataFrame(given, "lang string, text string").repartition(5)
    assert rows(P.collocations(docs, least=4, top=25)) == plain(given, 4, top=25)


def test_large_numbers_stay_exact(spark):
    many = 3_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, many), ("en", "b", 1, many - 1), ("en", "a b", 2, many - 7)], "lang string, phrase string, n int, f bigint")
    totals = spark.createDataFrame([("en", 3 * many)], "lang string, n bigint")
    r = P.scored(counts, totals).first()
    assert r.score == 1000 * (many - 7) * (3 * many) // (many * (many - 1)) and (r.a, r.l, r.r) == (many - 7, many, many - 1)


def test_a_bitmap_never_says_no_to_a_member(spark):
    given = [("en", f"w{i} v{i % 7}") for i in range(5000)]
    found = P.bitmap(spark.createDataFrame(given, "lang string, phrase string"), 2)
    lang = spark.sql("select xxhash64('en') as h").first().h
    hashes, _ = P.word_hashes(pa.array([p.encode() for _, p in given]), P._WORD)
    codes = P.codes(hashes, np.full(len(hashes), lang).view(np.uint64), 2)[::2]
    assert found.has(codes).all() and not found.has(P.mix(codes)).all()


def test_counts_spill_in_small_memory(spark, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", "24MB")
    docs = spark.range(60_000).selectExpr("concat('w', id, ' x', id % 50, ' y', id % 3) as text", "'en' as lang").coalesce(1)
    found = P.frequent(P.pieces(docs, P.F.col("text"), P.F.col("lang")).repartition(1), 1, 2)
    assert {r.n: r["count"] for r in found.groupBy("n").count().collect()} == {1: 60_053, 2: 60_150}
