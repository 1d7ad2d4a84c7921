"""Detections and lines of a page: filters, reading order, mock layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G


def build_detections(raw: DataFrame, threshold: float, scale_x: Column, scale_y: Column) -> DataFrame:
    """Raw detector rows (label, score, x0..y1, char_count) -> class and box in image space.

    Scores must exceed the threshold; labels count classes from 1; boxes are truncated toward zero; a missing character
    count is 100. The class list is a constant of 17 rows.
    """
    spark = raw.sparkSession
    classes = spark.createDataFrame(list(enumerate(G.CLASSES, 1)), "label int, class_name string")
    kept = raw.where(F.col("score") > threshold).withColumn("label", F.col("label").cast("int"))
    boxes = {c: (F.col(c) * (scale_x if c[0] == "x" else scale_y)).cast("int") for c in G.BOX}
    return kept.join(F.broadcast(classes), "label").withColumns(boxes | {"char_count": F.coalesce("char_count", F.lit(100.0))})


def explode_raw(raw: DataFrame) -> DataFrame:
    """(page_id, class_ids, boxes, scores, char_counts?) arrays -> rows, as many as the shortest of ids, boxes and scores."""
    n = F.least(F.size("class_ids"), F.size("boxes"), F.size("scores"))
    counts = F.col("char_counts") if "char_counts" in raw.columns else F.lit(None).cast("array<double>")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    df = raw.select("page_id", "class_ids", "boxes", "scores", counts.alias("char_counts"), at.alias("det_id"))
    box = F.get("boxes", "det_id")
    return df.select("page_id", "det_id", F.get("class_ids", "det_id").alias("label"), F.get("scores", "det_id").cast("double").alias("score"), *[F.get(box, F.lit(i)).cast("double").alias(c) for i, c in enumerate(G.BOX)], F.get("char_counts", "det_id").cast("double").alias("char_count"))


def clamp_valid(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes clamped to the page; those left without area go."""
    clamped = detections.withColumns({c: G.clamp(F.col(c), width if c[0] == "x" else height) for c in G.BOX})
    return clamped.where("x1 > x0 and y1 > y0")


def lines_only(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("class_name").startswith("line_"))


def crop_boxes(detections: DataFrame, width: Column, height: Column, pad: int | Column = 0) -> DataFrame:
    """Single-page rule: line classes; negative corners become 0; boxes without area or beyond the page go; then padding.

    Orientation is that of the padded box."""
    floored = lines_only(detections).withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in G.BOX})
    valid = floored.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("x1") <= width) & (F.col("y1") <= height))
    return G.pad_box(valid, pad, width, height).withColumn("is_vertical", F.col("y1") - F.col("y0") > F.col("x1") - F.col("x0"))


def crop_boxes_batch(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Page-batch rule: a box with a negative corner goes, it is not clamped."""
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("x1") <= width) & (F.col("y1") <= height)
    return lines_only(detections).where(inside).withColumn("is_vertical", F.col("y1") - F.col("y0") > F.col("x1") - F.col("x0"))


def crop_boxes_strict(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Closure rule: an invalid box fails the query."""
    ok = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("x1") <= width) & (F.col("y1") <= height)
    lines = lines_only(detections)
    return lines.withColumn("x0", F.when(ok, F.col("x0")).otherwise(F.raise_error(F.lit("invalid crop box")).cast("int")))


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds line_idx from 0: vertical lines first, from right to left, then horizontal ones from the top; ties by det_id."""
    v = F.col("is_vertical")
    order = [v.desc(), F.when(v, -F.col("x0")).otherwise(F.col("y0")), F.when(v, F.col("y0")).otherwise(F.col("x0")), F.col("det_id")]
    return lines.withColumn("line_idx", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1)


def restore_order(lines: DataFrame, ordered: DataFrame) -> DataFrame:
    """``lines`` with ``place``: where the first equal box of its page stands in ``ordered`` (page_id, box, line_idx); null if none does.

    Equal boxes share a place; sort by (place, det_id), nulls last, to have the lines in that order again.
    """
    first = ordered.groupBy("page_id", *G.BOX).agg(F.min("line_idx").alias("place"))
    return lines.join(first, ["page_id", *G.BOX], "left")


def page_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("class_name").startswith("line_")).alias("n_lines"))


def mock_detections(pages: DataFrame, count: Column, confidence: Column) -> DataFrame:
    """Evenly spaced line boxes inside a margin of a fiftieth, for pages (page_id, width, height)."""
    df = pages.withColumns({"mx": F.greatest(F.expr("width div 50"), F.lit(1)), "my": F.greatest(F.expr("height div 50"), F.lit(1))})
    roomy = F.col("width") > 2 * F.col("mx")
    df = df.withColumns({
        "x0": F.when(roomy, F.col("mx")).otherwise(0),
        "x1": F.when(roomy, F.col("width") - F.col("mx")).otherwise(F.greatest(F.col("width"), F.lit(1))),
        "top": F.least(F.col("my"), F.greatest(F.col("height") - 1, F.lit(0))),
    })
    df = df.withColumn("inner", F.greatest(F.greatest(F.greatest(F.col("height") - F.col("my"), F.lit(0)), F.col("top") + 1) - F.col("top"), F.lit(1)))
    df = df.withColumn("n", F.least(F.greatest(count, F.lit(1)), F.col("inner")).cast("int"))
    df = df.withColumn("det_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    df = df.withColumns({"y0": F.expr("top + (det_id * inner) div n"), "y1_": F.expr("top + ((det_id + 1) * inner) div n")})
    y1 = F.when(F.col("y1_") <= F.col("y0"), F.least(F.col("y0") + 1, F.greatest(F.col("height"), F.lit(1)))).otherwise(F.col("y1_"))
    return df.select("page_id", "det_id", F.lit("line_main").alias("class_name"), G.normalized_confidence(confidence).alias("confidence"), *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1")], y1.cast("int").alias("y1"), F.lit(100.0).alias("char_count"))


def with_fallback(detections: DataFrame, pages: DataFrame, bands: DataFrame) -> DataFrame:
    """Line detections, and bands for the pages that have none. ``bands`` has the columns of ``detections``."""
    lines = lines_only(detections)
    without = pages.join(lines, "page_id", "left_anti").select("page_id")
    return lines.unionByName(bands.join(without, "page_id", "left_semi"))


def bands_as_detections(bands: DataFrame, *keep: str, first: int | Column = 25, second: int | Column = 45) -> DataFrame:
    """Bands as certain lines, with the bucket of their shape; columns of ``bands`` named in ``keep`` stay."""
    bucket = G.char_bucket(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), first, second)
    return bands.select(*keep, "page_id", F.col("span").alias("det_id"), F.lit("line_main").alias("class_name"), F.lit(1.0).alias("confidence"), "x0", "y0", "x1", "y1", bucket.alias("char_count"))
