from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import dimscan as D
from vellum.llm import queries


def plain(rows, k=10, every=100):
    """{query id: [(rank, id, score)]} by comparing each query with every row."""
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = sorted((float(D.exact(np.array([w]), np.array(v))[0]), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out[i] = [(rank, j, s) for rank, (s, j) in enumerate(near, 1)]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(got, want):
    pairs = [(q, j) for q, near in want.items() for _, j, _ in near]
    assert got.keys() == {q for q, _ in pairs}
    return sum(j in {x[1] for x in got[q]} for q, j in pairs) / len(pairs)


def test_recall_over_the_table(spark, sf):
    big = sf.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()]
    got, want = found(queries.op12_dimension_scan(spark, big)), plain(rows)
    assert recall(got, want) >= 0.95
    scores = {q: {j: s for _, j, s in plain_q} for q, plain_q in want.items()}
    for q, near in got.items():
        assert [x[0] for x in near] == list(range(1, 11)) and [(s, j) for _, j, s in near] == sorted((s, j) for _, j, s in near)
        assert all(s == scores[q].get(j, s) for _, j, s in near)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, ask int, LIST double, label int").repartition(3)


def padded(rows):
    return [(i, v, "x", 1, 2.0, None) for i, v in rows]


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.5, 2.0]), (3, [0.5, 2.0]), (3, [0.5, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (200, [-0.0, 0.0])]
    rows += [(7, [1.0, None]), (8, [nan, 1.0]), (300, [inf, 1.0]), (9, [-inf, 1.0]), (None, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (400, [1.0, 2.0, 4.0]), (500, [7.0]), (11, [float(np.float32(3e38)), float(np.float32(-3e38))]), (-100, [0.25, 0.5])]
    got = found(D.search_embeddings(frame(spark, padded(rows))))
    want = {q: near for q, near in plain(rows).items() if near}
    assert got == want and got[0][0] == (1, 1, 0.0) and got[400] == [(1, 10, 1.0)] and 500 not in got
    assert found(D.search_embeddings(frame(spark, []))) == {}
    assert found(D.search_embeddings(frame(spark, padded([(1, [1.0]), (2, [2.0])])))) == {}


def test_a_third_are_copies_and_ties_go_by_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (np.ones(8) if i % 3 == 0 else rng.integers(-2, 3, 8))]) for i in range(3000)]
    got, want = found(D.search_embeddings(frame(spark, padded(rows)))), plain(rows)
    assert got[0] == want[0] == [(n, 3 * n, 0.0) for n in range(1, 11)]
    assert recall(got, want) >= 0.95
    assert all([s for _, _, s in got[q]] == sorted(s for _, _, s in got[q]) for q in got)


def test_near_copies_fill_one_list(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS", 100)  # a list of many blocks, asked in several groups
    monkeypatch.setattr(D, "QUERIES", 4)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 20)).astype(np.float32)
    x[:900] = x[0] + rng.standard_normal((900, 20)).astype(np.float32) * 1e-3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = found(D.nearest(frame(spark, padded(rows)), F.col("vec_id") % 50 == 0, k=5))
    assert recall(got, plain(rows, 5, 50)) >= 0.95


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in 1e9 + rng.standard_normal(12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert recall(found(D.search_embeddings(df)), plain(rows)) >= 0.95


def test_the_test_abandons_early_and_rarely_errs():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 64)) * 2
    x = centres[np.arange(4000) % 40] + rng.standard_normal((4000, 64))
    columns = [np.ascontiguousarray(x[:, a : a + D.STEP].T) for a in range(0, 64, D.STEP)]
    lost = 0
    for q in centres[:25].repeat(2, 0) + rng.standard_normal((50, 64)):
        scores = D.exact(x, q)
        bound = np.sort(scores)[10]
        near = np.flatnonzero(scores <= bound)
        assert set(near) <= set(D.scan(columns, q, bound, 64, tested=False))
        lost += len(set(near) - set(D.scan(columns, q, bound, 64)))
        assert len(D.scan(columns[:2], q, bound, 64)) < 400  # half of the dimensions settle nearly all other clusters
    assert lost <= 0.02 * 50 * 11


@pytest.mark.parametrize("n", [1, 5, 11])
def test_few_rows_are_all_returned(spark, n):
    rows = [(i * 50, [float(i + 1), 1.0]) for i in range(n)]
    assert found(D.search_embeddings(frame(spark, padded(rows)))) == {q: v for q, v in plain(rows).items() if v}
