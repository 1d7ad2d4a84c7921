from __future__ import annotations

import re
from collections import Counter

import numpy as np

from vellum.llm import quality as Q
from tests.llm.helpers import empty, odd, odd_rows, words


def base(text):
    """The contract's counts, restated."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def check(docs):
    text = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = Q.judge(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=key) == sorted(((i, *base(t)) for i, t in text), key=key)
    assert not any(r.kept for r in found if r.base_failed)
    return found


def test_counts(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect()}
    passed = [r for r in check(docs) if not r.base_failed and r.doc_id in good]
    clean, poor = [r.kept for r in passed if good[r.doc_id] == 1], [r.kept for r in passed if good[r.doc_id] == 0]
    assert sum(clean) >= 0.99 * len(clean) and not any(poor)  # labels that the estimates never saw


def test_odd_rows(spark):
    check(odd(spark))
    kept = Q.keep_documents(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sum(r[0] == 4 for r in kept.collect()) == sum(r[0] == 4 for r in odd_rows())
    assert Q.judge(empty(spark)).count() == 0 and Q.keep_documents(empty(spark)).count() == 0


def test_outliers_go_even_when_they_are_many(spark):
    draw = np.random.default_rng(1)
    vocabulary = ["word", "table", "river", "stone", "green", "light", "house", "north", "apple", "chair", "cloud", "music"]
    rows = [(i, " ".join(draw.choice(vocabulary, 60)) + " " + " ".join(f"{x}{i}" for x in draw.choice(vocabulary, 60)), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(f"<|{x}|>#{j}{i}" for j, x in enumerate(draw.choice(vocabulary, 80))), "en", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in Q.judge(docs).collect()}
    assert not any(kept for i, (_, kept) in verdict.items() if i >= 1000)
    fine = [kept for i, (failed, kept) in verdict.items() if i < 1000 and not failed]
    assert fine and sum(fine) >= 0.98 * len(fine)
    assert {r.doc_id for r in Q.keep_documents(docs).collect()} == {i for i, (_, kept) in verdict.items() if kept}


def numpy_mcd(x, floors, starts=200):
    """Plain FAST-MCD: random starts, concentration steps until the determinant settles, the smallest one wins."""
    draw, h, best = np.random.default_rng(0), int(np.ceil(Q.SUBSET * len(x))), None
    for _ in range(starts):
        some, last = draw.choice(len(x), 12, replace=False), np.inf
        while True:
            mean, cov = x[some].mean(axis=0), np.cov(x[some].T, bias=True) * Q.CONSISTENCY + np.diag(floors**2)
            found = np.linalg.slogdet(cov)[1]
            if found > last - 1e-9:
                break
            last, off = found, x - mean
            some = np.argsort(np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off), kind="stable")[:h]
        if best is None or found < best[0]:
            best = found, mean
    return best


def seeded(groups=3, rows=160):
    """Vectors of groups with different centres and scatter, an eighth of them far off along the correlation's short axis; one
    statistic does not vary at all."""
    draw, out = np.random.default_rng(5), {}
    for g in range(groups):
        mix = draw.normal(size=(5, 5)) * (0.2, 0.2 + g, 0.1, 0.1, 0.1) + np.eye(5)
        x = draw.normal(size=(rows, 5)) @ mix + 3 * g
        x[: rows // 8, 0] += 9
        x[: rows // 8, 1] -= 9
        x[:, 3] = 0.25
        out[f"g{g}"] = x
    return out


def test_estimates_equal_a_plain_mcd(spark):
    floors, groups = np.array([0.01, 0.01, 0.02, 0.03, 0.01]), seeded()
    rows = [(g, *map(float, r), *map(float, floors)) for g, x in groups.items() for r in x]
    stats = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} double" for c in Q.MEASURED))
    found = {r.grp: r for r in Q.fit(stats).collect()}
    assert found.keys() == groups.keys()
    for g, x in groups.items():
        log_det, mean = numpy_mcd(x, floors)
        assert -1e-6 < found[g].log_det - log_det < 0.01  # of 200 starts the best is no better than that
        centre, inverse = np.array([found[g][f"m{i}"] for i in range(5)]), np.zeros((5, 5))
        inverse[np.tril_indices(5)] = [found[g][f"i{i}{j}"] for i in range(5) for j in range(i + 1)]
        inverse = inverse + np.tril(inverse, -1).T
        assert np.allclose(centre, mean, atol=0.15)
        some = np.argsort(np.einsum("ij,ij->i", (x - centre) @ inverse, x - centre), kind="stable")[: int(np.ceil(Q.SUBSET * len(x)))]
        cov = np.cov(x[some].T, bias=True) * Q.CONSISTENCY + np.diag(floors**2)
        assert np.allclose(x[some].mean(axis=0), centre, atol=1e-6)  # a further step changes nothing
        assert np.allclose(np.linalg.inv(cov), inverse, rtol=1e-5, atol=1e-6)


def test_verdicts_that_no_threshold_gives(spark):
    """In one source long words go with few words; documents with both, each usual by itself, are the outliers. What is
    usual in a source of wide scatter is an outlier in a narrow one."""
    draw = np.random.default_rng(7)
    make = lambda n, length: " ".join("".join(draw.choice(list("abcdefghij"), max(1, round(draw.normal(length, 0.4))))) for _ in range(n))
    rows, odd_ones, narrow = [], [], []
    for i in range(400):
        t = draw.normal(0, 0.5)
        rows.append((i, make(int(200 * np.exp(t)), 7 - 3 * t + draw.normal(0, 0.25)), "en", "tied", 0))
    for i in range(400, 420):
        odd_ones.append(i)
        rows.append((i, make(int(200 * np.exp(0.9)), 9.7), "en", "tied", 0))
    for i in range(1000, 1300):
        rows.append((i, make(200, 5 + draw.normal(0, 0.1)), "en", "narrow", 0))
    for i in range(1300, 1310):
        narrow.append(i)
        rows.append((i, make(200, 7), "en", "narrow", 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert not any(kept[i] for i in odd_ones + narrow)
    assert np.mean([kept[i] for i in range(400)]) >= 0.97 and np.mean([kept[i] for i in range(1000, 1300)]) >= 0.97


def test_stays_in_the_jvm(spark, sf):
    plan = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
