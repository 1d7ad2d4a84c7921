from __future__ import annotations

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd, words
from vellum.llm import filteraudit as A
from vellum.llm import queries

LABELS = "doc_id bigint, quality int, toxic int, text string, PART string"


def plain(docs, labels):
    """The rows that the definition gives, one order after the other."""
    docs, known = docs.collect(), defaultdict(list)
    for r in labels.collect():
        known[r.doc_id].append(r)
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    parts = defaultdict(list)
    for r in docs:
        t, w = r.text or "", words(r.text)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and r.doc_id > first[t]}
        rows = known[r.doc_id] if r.doc_id is not None else []
        parts[r.source or ""].append(({k for k, v in bad.items() if v}, any(x.quality == 1 for x in rows), any(x.toxic == 1 for x in rows)))
    out = []
    for part, rows in parts.items():
        shapley, made = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_its_twin(same):
    same(queries.op13_filter_audit, A.SQL)


def test_odd_rows(spark):
    given = [(4, 1, 1, "t", "p"), (4, 0, None, None, None), (None, 1, 1, None, None), (6, None, 1, None, None), (99, 1, 1, None, None), (7, 1, 0, None, None)]
    labels = spark.createDataFrame(given, LABELS)
    docs = odd(spark).withColumn("quality", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("source", F.lit("other")).withColumn("doc_id", F.lit(12).cast("long")))
    assert rows(A.audit_documents(docs, labels)) == plain(docs, labels)
    none = spark.createDataFrame([], LABELS)
    assert rows(A.audit_documents(docs, none)) == plain(docs, none)
    assert A.audit_documents(empty(spark), labels).collect() == []


def test_a_group_of_copies_over_many_parts(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'SAME #' else concat('text ', id) end as text", "concat('s', id % 700) as source")
    labels = spark.range(0, 3000, 2).selectExpr("id as doc_id", "int(id % 5 = 0) as quality", "int(id % 7 = 0) as toxic")
    assert rows(A.audit_documents(docs, labels)) == plain(docs, labels)


def test_own_filters(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "string(id) as text")
    found = A.audit(docs, spark.createDataFrame([], LABELS), {"x": F.col("doc_id") % 2 == 0, "y": F.col("doc_id") % 3 == 0}, F.lit(None)).collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found) == [
        ("", "xy", 1, 50, 50, 0, 33, 83), ("", "xy", 2, 33, 17, 17, 17, 51), ("", "yx", 1, 66, 34, 0, 17, 51), ("", "yx", 2, 33, 33, 17, 33, 83),
    ]
    with pytest.raises(ValueError):
        A.audit(docs, docs, dict.fromkeys("abcdefgh", F.lit(True)), F.lit(""))


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    orders = [o for o, _ in A.walk(np.zeros((3, 1 << n, 1), np.int64), n)][:-1]
    assert sorted(orders) == sorted(permutations(range(n)))
    assert all(sum(x != y for x, y in zip(a, b, strict=True)) == 2 for a, b in zip(orders, orders[1:], strict=False))
