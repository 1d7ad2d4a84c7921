"""Filter interaction audit: what each of several filters removes in every order in which they could be applied.

A document is reduced to its mask, one bit for each filter that it fails, and documents are counted by part, mask and
label: at most 2 ** n cells a part, whatever the number of documents. All orders are then visited by swaps of two
neighbours (plain changes). A swap at places i and i + 1 leaves every other step as it was, so just two steps are worked
out anew, from the cells; each filter's sum of removed documents over all orders builds up along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, ship, words

#: n filters have n! orders of n steps in the result.
MOST_FILTERS = 7
#: Parts whose orders are written into one batch.
PARTS = 64

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Of a filter that fails repeats of an earlier text; it is worked out over the whole table.
REPEATS = "repeats"


def text_filters(text: Column) -> dict[str, Column | str]:
    """The five filters of the query: short, repetitive, capitals, symbols, repeats."""
    w, capitals = words(text), F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(w) < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
        "E": REPEATS,
    }


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail; bit i of mask is the i-th filter.

    ``filters`` maps a name to a column over ``docs`` that is true where a document fails (null: passes), or to REPEATS. ``docs`` has doc_id
    and text; ``labels`` has doc_id, quality and toxic, and a document is good (toxic) if any row of its id says 1.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask, repeat = F.lit(0), 0
    for i, fails in enumerate(filters.values()):
        if isinstance(fails, str):
            repeat |= 1 << i
        else:
            mask = mask + F.when(fails, 1 << i).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("same"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    # equal rows become one with a count before anything is joined; the texts are read once
    rows = cut(rows.groupBy("id", "same", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    told = rows.where("id is not null").join(known, "id", "left").fillna(False, ["good", "toxic"])
    # of equal texts that agree in the rest: how many rows, the least id, and how many rows have it
    groups = told.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = groups.groupBy("same").agg(F.min("first.id").alias("least"))
    split = groups.join(least, "same").withColumn("kept", F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)))
    passing = split.select("part", "mask", "good", "toxic", F.col("kept").alias("n"))
    repeated = split.select("part", F.col("mask").bitwiseOR(F.lit(repeat)), "good", "toxic", F.col("n") - F.col("kept"))
    nameless = rows.where("id is null").select("part", "mask", F.lit(False), F.lit(False), "n")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return passing.union(repeated).union(nameless).where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places i so that swapping entries i and i + 1, one place after the other, visits all n! orders."""
    if n < 2:
        return
    inner = [*plain_changes(n - 1), None]
    for turn, swap in enumerate(inner):  # the last entry runs through an order of the others, to and fro
        leftward = turn % 2 == 0
        yield from range(n - 2, -1, -1) if leftward else range(n - 1)
        if swap is not None:
            yield swap + leftward


def walk(counts: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(order, figures) of every order of ``n`` filters; figures[step] has MEASURES[:6] by part.

    ``counts`` has documents, good and toxic ones by mask and part: an array (3, 2 ** n, parts). The last yield is followed by
    (None, shapley by filter and part).
    """
    masks = np.arange(1 << n)
    alive = np.stack([counts[:, (masks & gone) == 0].sum(1) for gone in masks])  # left, once the filters in ``gone`` have been applied
    fails = [counts[0, (masks >> f & 1) == 1].sum(0) for f in range(n)]
    alone = [counts[0, 1 << f] for f in range(n)]
    order, figures, shapley = list(range(n)), np.zeros((n, 6, counts.shape[2]), np.int64), np.zeros((n, counts.shape[2]), np.int64)

    def work_out(step: int) -> None:
        f, before = order[step], sum(1 << g for g in order[:step])
        after = before | 1 << f
        removed, good, toxic = alive[before] - alive[after]
        figures[step] = alive[after][0], removed, fails[f] - removed, alone[f], good, toxic

    for step in range(n):
        work_out(step)
    for at in [*plain_changes(n), None]:
        for step, f in enumerate(order):
            shapley[f] += figures[step, 1]
        yield tuple(order), figures
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
            work_out(at)
            work_out(at + 1)
    yield None, shapley


def orders(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of ``audit`` from ``cells``. A part's cells travel together: at most 2 ** n of them."""
    n, names = len(names), list(names)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(m, pa.int64()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                few = batch.slice(at, PARTS)
                counts = np.zeros((3, 1 << n, few.num_rows), np.int64)
                for p, found in enumerate(few.column(1).to_pylist()):
                    for c in found:
                        counts[:, c["mask"], p] = c["n"], c["good"], c["toxic"]
                seen = [(o, f.copy()) for o, f in walk(counts, n)]
                shapley = seen.pop()[1]
                for order, figures in seen:
                    total = np.stack([shapley[f] for f in order])
                    columns = [pa.array(x) for x in (*figures.transpose(1, 0, 2).reshape(6, -1), total.ravel())]
                    rows = n * few.num_rows
                    steps = np.repeat(np.arange(1, n + 1, dtype=np.int32), few.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(few.column(0).to_pylist() * n, pa.string()), pa.array(["".join(names[f] for f in order)] * rows), pa.array(steps), *columns], schema=schema)

    ship(table.sparkSession)
    grouped = table.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return grouped.select("part", "cells").mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], part: Column) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each step of every order.

    Counts are of documents (rows) of the part. A null part counts as the empty string, a null text as the empty text. A null doc_id has no
    label and its text is no repeat; rows that share id and text are no repeats of each other. A text repeats if a row
    with a smaller id, of any part, has the same text (SHA-256). Labels without a document do not matter. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    return orders(cells(docs, labels, filters, part), list(filters))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the query returns: the five text filters, by source."""
    return audit(docs, labels, text_filters(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.col("source"))


#: DuckDB twin of ``audit_documents``.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body),
          'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)} AS bad
  FROM w LEFT JOIN l USING (doc_id)),
k AS (
  SELECT part, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic,
         (CASE WHEN bad.A THEN 'A' ELSE '' END) || (CASE WHEN bad.B THEN 'B' ELSE '' END) || (CASE WHEN bad.C THEN 'C' ELSE '' END) || (CASE WHEN bad.D THEN 'D' ELSE '' END) || (CASE WHEN bad.E THEN 'E' ELSE '' END) AS failed
  FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)),
t AS (
  SELECT part, filter_order, step::INT AS step, letter,
         coalesce(sum(n) FILTER (translate(failed, before || letter, '') = failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (contains(failed, letter) AND translate(failed, before, '') = failed), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (contains(failed, letter) AND translate(failed, before, '') <> failed), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (contains(failed, letter) AND translate(failed, before, '') = failed), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (contains(failed, letter) AND translate(failed, before, '') = failed), 0)::BIGINT AS toxic_lost
  FROM k, s GROUP BY part, filter_order, step, letter)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
"""
