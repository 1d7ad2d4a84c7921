"""Rules over the ordered lines of a page: (page_id, line_idx, text) -> the same columns, fewer rows.

Sequential rules are written as islands: a run of lines that join, or the parity of a line within a run of mergeable pairs,
follows from neighbours alone. All windows share the page partitioning, so a page is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

def _page():
    return Window.partitionBy("page_id").orderBy("line_idx")


def _so_far():
    return _page().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def drop_decoration(lines: DataFrame) -> DataFrame:
    return lines.where(~T.is_decoration(F.col("text")))


def clean_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", T.clean_line(F.col("text")))


def trim_context(lines: DataFrame) -> DataFrame:
    """Before a section boundary, a dangling ``(1`` and then a dangling ``第`` go."""
    dangling = F.regexp_replace(F.regexp_replace("text", r"\(1$", ""), "第$", "")
    after = F.lead("text").over(_page())
    return lines.withColumn("text", T.trim(F.when(T.is_boundary(after), dangling).otherwise(F.col("text"))))


def merge_pairs(lines: DataFrame, mergeable: Column, merged: Column) -> DataFrame:
    """Greedy pairwise merging from the top: in a run of lines that could each merge with the next, every other one does.

    ``mergeable`` and ``merged`` may use text and next_text.
    """
    df = lines.withColumn("next_text", F.lead("text").over(_page()))
    df = df.withColumns({"m_": F.coalesce(mergeable & F.col("next_text").isNotNull(), F.lit(False)), "new_": merged})
    last_break = F.last(F.when(~F.col("m_"), F.col("n_")), ignorenulls=True).over(_so_far())
    df = df.withColumn("n_", F.row_number().over(_page())).withColumn("b_", F.coalesce(last_break, F.lit(0)))
    df = df.withColumn("head_", F.col("m_") & ((F.col("n_") - F.col("b_")) % 2 == 1))
    df = df.withColumn("gone_", F.coalesce(F.lag("head_").over(_page()), F.lit(False)))
    return df.where(~F.col("gone_")).select("page_id", "line_idx", F.when(F.col("head_"), F.col("new_")).otherwise(F.col("text")).alias("text"))


def merge_split_digits(lines: DataFrame) -> DataFrame:
    """An ideograph and a stray digit before a line that goes on with an ideograph: the digit goes, the lines join."""
    left, right = T.trim_end(F.col("text")), T.trim_start(F.col("next_text"))
    pair = F.col("text").rlike("[0-9]") & left.rlike(f"[{T.CJK}][0-9]$") & right.rlike(f"^[{T.CJK}]") & ~T.is_boundary(right)
    return merge_pairs(lines, pair, F.concat(F.substring(left, F.lit(1), F.length(left) - 1), right))


def _joined(lines: DataFrame, joins: Column, piece: Column) -> DataFrame:
    """Concatenates each island of lines that join to the one before; ``piece`` is what a line contributes."""
    df = lines.withColumn("j_", F.coalesce(joins, F.lit(False)))
    df = df.withColumn("follows_", F.coalesce(F.lead("j_").over(_page()), F.lit(False)))
    df = df.withColumn("island_", F.sum((~F.col("j_")).cast("int")).over(_so_far())).withColumn("piece_", piece)
    parts = F.sort_array(F.collect_list(F.struct("line_idx", "piece_")))
    return df.groupBy("page_id", "island_").agg(F.min("line_idx").alias("line_idx"), parts.alias("parts_")).select("page_id", "line_idx", F.array_join(F.transform("parts_", lambda p: p.piece_), "").alias("text"))


def join_hyphenated(lines: DataFrame) -> DataFrame:
    """A word broken by a hyphen at the line end is joined with the next line; joins may follow one another."""
    before = T.trim_end(F.lag("text").over(_page()))
    here = T.trim_start(F.col("text"))
    joins = before.rlike("[A-Za-z]-$") & here.rlike("^[A-Za-z]") & ~T.is_boundary(here)
    head = F.when(F.col("j_"), T.trim_start(F.col("text"))).otherwise(F.col("text"))
    cut = T.trim_end(head)
    return _joined(lines, joins, F.when(F.col("follows_"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(head))


def drop_repeats(lines: DataFrame) -> DataFrame:
    """A line equal to the one before goes."""
    return lines.withColumn("before_", F.lag("text").over(_page())).where(~F.coalesce(F.col("before_") == F.col("text"), F.lit(False))).drop("before_")


def structural_rules(lines: DataFrame) -> DataFrame:
    return drop_repeats(join_hyphenated(merge_split_digits(trim_context(clean_lines(drop_decoration(lines))))))


def page_text(lines: DataFrame) -> DataFrame:
    """(page_id, text): the lines in order, joined by newlines."""
    ordered = F.sort_array(F.collect_list(F.struct("line_idx", "text")))
    return lines.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("text"))
