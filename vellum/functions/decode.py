"""Greedy decoding of class scores as higher-order functions over ``array<array<double>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKENS, LOW_PEAK = 2, 0.35


def argmax(row: Column) -> Column:
    """Index of the first greatest value; a row without scores fails the query."""
    row = F.when(F.size(row) == 0, F.raise_error(F.lit("no class scores")).cast("array<double>")).otherwise(row)
    return F.array_position(row, F.array_max(row)).cast("int") - 1


def peak(row: Column) -> Column:
    """The greatest softmax probability of a row."""
    top = F.array_max(row)
    return F.lit(1.0) / F.aggregate(row, F.lit(0.0), lambda a, v: a + F.exp(v - top))


def decode_indices(ids: Column, charset: str) -> Column:
    """Characters of ids that count from 1, up to the first 0; ids outside the charset are skipped."""
    zero = F.struct(F.lit(False).alias("done"), F.lit("").alias("text"))
    letters = F.array(*map(F.lit, charset))

    def step(a: Column, i: Column) -> Column:
        done = a.done | (i == 0)
        return F.struct(done.alias("done"), F.concat(a.text, F.when(~done & (i > 0), F.coalesce(F.get(letters, i.cast("int") - 1), F.lit(""))).otherwise("")).alias("text"))

    return F.aggregate(ids, zero, step, lambda a: a.text)


def decode_logits(logits: Column, charset: str) -> Column:
    return decode_indices(F.transform(logits, argmax), charset)


def decode_with_confidence(logits: Column, charset: str) -> Column:
    """struct(text, mean_confidence): decoding also stops at a weak peak once two characters stand; the mean is over those kept."""
    letters = F.array(*map(F.lit, charset))
    zero = F.struct(F.lit(False).alias("done"), F.lit("").alias("text"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    scored = F.transform(logits, lambda r: F.struct(argmax(r).alias("i"), peak(r).alias("p")))

    def step(a: Column, t: Column) -> Column:
        done = a.done | (t.i == 0) | ((a.n >= MIN_TOKENS) & (t.p < LOW_PEAK))
        ch = F.when(~done, F.get(letters, t.i - 1))
        kept = ch.isNotNull()
        return F.struct(done.alias("done"), F.concat(a.text, F.coalesce(ch, F.lit(""))).alias("text"), (a.sum + F.when(kept, t.p).otherwise(0.0)).alias("sum"), (a.n + kept.cast("int")).alias("n"))

    return F.aggregate(scored, zero, step, lambda a: F.struct(a.text.alias("text"), F.when(a.n > 0, a.sum / a.n).otherwise(0.0).alias("mean_confidence")))
