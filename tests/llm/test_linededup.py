from __future__ import annotations

import re

from vellum.llm import linededup as L
from vellum.llm.queries import QUERIES, SQL
from tests.llm.helpers import empty, odd, words


def plain(rows):
    """(id, text) -> remaining texts: later occurrences of three-line windows, in order of id and place."""
    seen, out = set(), []
    for i, text in sorted(rows):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:], strict=False):
            window = lines[a], lines[b], lines[c]
            if window in seen:
                gone.update(range(a, c + 1))
            seen.add(window)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_equals_its_twin(same):
    same(QUERIES["op4_line_windows"], SQL["op4_line_windows"])


def test_equals_a_plain_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(docs).collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    out = L.dedup_lines(odd(spark))
    assert out.columns == [*odd(spark).columns, "n_lines", "n_removed"] and out.count() == odd(spark).count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[1].n_lines == 0 and rows[2].text == "" and rows[2].n_lines == 1
    assert rows[6].n_removed == 0 and rows[7].n_removed == 4 and rows[7].text == ""
    assert L.dedup_documents(odd(spark)).schema == odd(spark).schema
    assert L.dedup_lines(empty(spark)).count() == 0


def test_overlaps_within_one_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n\na\nb\nc\nd\na\nb\nc\nd")], "doc_id bigint, text string")
    (r,) = L.dedup_lines(docs).collect()
    assert r.text == plain([(1, docs.first().text)])[0][1] and r.n_removed > 0


def test_stays_in_the_jvm(spark, sf):
    plan = QUERIES["op4_line_windows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
