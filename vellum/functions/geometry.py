"""Boxes, buckets and orientation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The detector's classes; label 1 is the first.
CLASSES = (
    "text_block", "line_main", "line_caption", "line_ad", "line_note", "line_note_tochu", "block_fig", "block_ad", "block_pillar",
    "block_folio", "block_rubi", "block_chart", "block_eqn", "block_cfm", "block_eng", "block_table", "line_title",
)
BOX = ("x0", "y0", "x1", "y1")


def clamp(c: Column, high: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), high)


def is_vertical(df_width: Column, df_height: Column) -> Column:
    return df_height > df_width


def half_up(c: Column) -> Column:
    """Rounds a non-negative number half away from zero."""
    return F.floor(c + 0.5)


def char_count(width: Column, height: Column) -> Column:
    """Characters that a line of this shape may hold, 1 at least."""
    return F.greatest(F.lit(1), half_up(width / F.greatest(height, F.lit(1)) * 2.5)).cast("int")


def char_bucket(width: Column, height: Column, first: int | Column = 25, second: int | Column = 45) -> Column:
    n = char_count(width, height)
    return F.when(n <= first, 3.0).when(n <= second, 2.0).otherwise(100.0)


def near_bucket(c: Column) -> Column:
    """3 or 2 if within 0.2 of it, else 100; null is 100."""
    return F.when(F.abs(c - 3.0) < 0.2, 3.0).when(F.abs(c - 2.0) < 0.2, 2.0).otherwise(100.0)


def pad_box(df: DataFrame, pad: int | Column, width: Column, height: Column) -> DataFrame:
    """Boxes grown by ``pad`` within the page; a box that would be empty keeps its size."""
    grown = {"x0": F.greatest(F.col("x0") - pad, F.lit(0)), "y0": F.greatest(F.col("y0") - pad, F.lit(0)), "x1": F.least(F.col("x1") + pad, width), "y1": F.least(F.col("y1") + pad, height)}
    fine = ((pad if isinstance(pad, Column) else F.lit(pad)) > 0) & (grown["x1"] > grown["x0"]) & (grown["y1"] > grown["y0"])
    return df.withColumns({k: F.when(fine, v).otherwise(F.col(k)).cast("int") for k, v in grown.items()})


def corners() -> Column:
    """Top left, bottom left, top right, bottom right."""
    return F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y0"), ("x1", "y1"))])


def normalized_count(count: Column, height: Column) -> Column:
    return F.least(F.greatest(count, F.lit(1)), F.greatest(height, F.lit(1)))


def normalized_confidence(c: Column) -> Column:
    return clamp(c, F.lit(1.0))
