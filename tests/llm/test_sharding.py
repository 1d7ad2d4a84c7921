from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest

from vellum.llm import sharding as S
from tests.llm.helpers import empty, odd


def check(docs, shards=40):
    rows = S.shard_documents(docs, shards).collect()
    given_ = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == given_
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return {(r.doc_id, r.text_crc32): r.shard for r in rows}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = check(docs), check(docs.repartition(7), 41)
    assert check(docs.repartition(5)) == before
    moved = sum(after[k] != s for k, s in before.items())
    assert moved <= 0.35 * len(before)  # a new order would move 97 %


def test_odd_rows_and_hot_keys(spark):
    check(odd(spark), 4)
    hot = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "'same' as text")
    check(hot, 40)
    assert S.shard_documents(empty(spark)).count() == 0


def test_names_and_many_copies(spark):
    rows = spark.range(7).selectExpr("id as arc", "id as h", "id as copies", "id as base", "id as `row`", "id as replica", "id as `a.b`")
    out = S.place(rows, 3)
    assert out.columns == [*rows.columns, "shard", "slot"] and sorted(r.arc for r in out.collect()) == list(range(7))
    with pytest.raises(ValueError):
        S.place(rows.withColumnRenamed("h", "Shard"), 3)
    many = spark.range(250_000).selectExpr("1 as k")  # more copies than one array holds
    assert sorted(r["count"] for r in S.place(many, 3).groupBy("shard").count().collect()) == [83333, 83333, 83334]


def test_settle_is_exact():
    placed = S.settle([10, 0, 1, 5], [0, 1, 2, 0], 3)
    load = Counter()
    for _, a, z, shard, _ in placed:
        load[shard] += z - a + 1
    assert load == {0: 6, 1: 5, 2: 5}


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    S.write_shards(docs, f"{tmp_path}/s", 5, 30)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()


def test_written_columns_keep_their_names(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as doc_id", "id as PART_", "cast(null as string) as part__")
    S.write_shards(rows, f"{tmp_path}/s", 3, 5)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.select("doc_id", "PART_", "part__").exceptAll(rows).isEmpty() and back.count() == 50


def test_stays_in_the_jvm(spark, sf):
    plan = S.shard_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
