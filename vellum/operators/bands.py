"""Bands of ink on pages of packed RGB rows, without a row per pixel.

A page, or a tile of one (whole scan lines), is reduced to segments: runs of scan lines with enough ink, and the few lines beside
them that a band may take in, each with its dark pixels per column. Segments of one page join to bands, across the seams of
tiles as well. A page that is one tile is settled where it lies, without a shuffle; tiles shuffle their segments, never pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import ship

#: Gap of scan lines that a band bridges, least height, margins, and the shares of width, height and columns that count as ink.
GAP, LOW, LEFT, RIGHT, OVER = 2, 6, 2, 3, 1
LEAST_INK, WIDTH_SHARE, HEIGHT_SHARE, COLUMN_SHARE = 8, 80, 8, 0.15
THRESHOLD = 220

Segment = tuple[int, int, bool, np.ndarray]


def dark(rgb: bytes, width: int, threshold: int) -> np.ndarray:
    """Whole scan lines of packed RGB -> where r + g + b < 3 * threshold."""
    if width <= 0 or len(rgb) % (3 * width):
        raise ValueError("the buffer does not hold whole scan lines of this width")
    return np.frombuffer(rgb, np.uint8).reshape(-1, width, 3).sum(axis=2, dtype=np.uint16) < 3 * threshold


def segments(ink: np.ndarray, top: int) -> list[Segment]:
    """(first line, last line, enough ink, dark pixels by column) of a tile whose first scan line is ``top``."""
    height, width = ink.shape
    full = ink.sum(axis=1) >= max(LEAST_INK, width // WIDTH_SHARE)
    near = np.zeros(height, bool)  # lines that may belong to a band though they have little ink
    near[:GAP] = near[max(0, height - GAP) :] = True
    for d in range(1, GAP + 1):
        near[d:] |= full[:-d]
        near[:-d] |= full[d:]
    kind = np.where(full, 1, np.where(near, 2, 0))
    starts = np.flatnonzero((kind != np.roll(kind, 1)) | (kind == 2)) if height else np.empty(0, int)
    starts = np.union1d(starts, [0]) if height else starts
    sums = np.add.reduceat(ink, starts, axis=0, dtype=np.int32) if height else []
    return [(top + int(a), top + int(z) - 1, kind[a] == 1, c) for a, z, c in zip(starts, [*starts[1:], height], sums, strict=True) if kind[a]]


def spans(parts: list[Segment], height: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of the bands of a page, from the segments of all its tiles in order."""
    islands: list[list[int]] = []
    for first, last, full, _ in parts:
        if full and islands and first - islands[-1][1] <= GAP + 1:
            islands[-1][1] = last
        elif full:
            islands.append([first, last])
    found = [(y0, height if height - 1 - last <= GAP else last + 1) for y0, last in islands]
    return [(y0, y1) for y0, y1 in found if y1 > y0 + LOW]


def bands(parts: list[Segment], width: int, height: int) -> list[tuple[int, int, int, int]]:
    """(x0, y0, x1, y1) of the bands of a page: its spans, narrowed to the columns with enough ink, with a margin."""
    out, at = [], 0
    for y0, y1 in spans(parts, height):
        columns = np.zeros(width, np.int64)
        while at < len(parts) and parts[at][0] < y0:
            at += 1
        while at < len(parts) and parts[at][0] < y1:
            columns += parts[at][3]
            at += 1
        good = np.flatnonzero(columns >= max(1, (y1 - y0) // HEIGHT_SHARE, math.ceil(int(columns.max()) * COLUMN_SHARE)))
        x0, x1 = (max(int(good[0]) - LEFT, 0), min(int(good[-1]) + RIGHT, width)) if len(good) else (0, width)
        out.append((x0, max(y0 - OVER, 0), max(x1, x0 + 1), min(y1 + OVER, height)))
    return out


_BANDS = "page_id bigint, span int, x0 int, y0 int, x1 int, y1 int"


def _batch(page_ids: list, found: list[list[tuple]], names: tuple[str, ...] = ("x0", "y0", "x1", "y1")) -> pa.RecordBatch:
    rows = [(p, i, *b) for p, bs in zip(page_ids, found, strict=True) for i, b in enumerate(bs)]
    columns = list(zip(*rows, strict=True)) or [()] * (2 + len(names))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.int32()) for i, c in enumerate(columns)], names=["page_id", "span", *names])


def _whole(page: list[pa.Scalar]) -> np.ndarray:
    _, w, h, rgb, t = page
    ink = dark(rgb.as_buffer(), w.as_py(), t.as_py())
    if len(ink) != h.as_py():
        raise ValueError("the buffer does not fit the size")
    return ink


def _drawn(pages: DataFrame, threshold: int | Column) -> DataFrame:
    """(page_id, width, height, rgb, t) of pages with pixels and area."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    drawn = pages.where("rgb is not null and width > 0 and height > 0")
    return drawn.select(F.col("page_id").cast("long").alias("page_id"), F.col("width").cast("int"), F.col("height").cast("int"), "rgb", limit.cast("int").alias("t"))


def page_bands(pages: DataFrame, threshold: int | Column = THRESHOLD) -> DataFrame:
    """(page_id, span, x0, y0, x1, y1) of pages (page_id, width, height, rgb). A page without pixels or area has none; a buffer that
    does not fit the size is an error. No shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inks = (_whole([b.column(c)[r] for c in range(5)]) for r in range(b.num_rows))
            yield _batch(b.column(0).to_pylist(), [bands(segments(ink, 0), ink.shape[1], len(ink)) for ink in inks])

    return _drawn(pages, threshold).mapInArrow(run, _BANDS)


def page_spans(pages: DataFrame, threshold: int | Column = THRESHOLD) -> DataFrame:
    """(page_id, span, y0, y1): the scan lines of each band, without margin. No shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inks = (_whole([b.column(c)[r] for c in range(5)]) for r in range(b.num_rows))
            yield _batch(b.column(0).to_pylist(), [spans(segments(ink, 0), len(ink)) for ink in inks], ("y0", "y1"))

    return _drawn(pages, threshold).mapInArrow(run, "page_id bigint, span int, y0 int, y1 int")


def page_ink(pages: DataFrame, threshold: int | Column = THRESHOLD) -> DataFrame:
    """(page_id, y, ink): dark pixels of every scan line. No shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ink = _whole([b.column(c)[r] for c in range(5)]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ink), b.column(0)[r].as_py())), pa.array(np.arange(len(ink), dtype=np.int32)), pa.array(ink.astype(np.int64))], names=["page_id", "y", "ink"])

    return _drawn(pages, threshold).mapInArrow(run, "page_id bigint, y int, ink bigint")


def tile_bands(tiles: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``page_bands`` of pages that come as tiles (page_id, width, height, top, rgb) of whole scan lines, in any order.

    A tile's segments travel to its page's task: per band the width in counts, so a page's task holds its bands and not its pixels.
    Tiles that do not cover their page from its first line to its last, once each, are an error.
    """
    ship(tiles.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                page, w, h, top, rgb = (b.column(c)[r] for c in range(5))
                ink = dark(rgb.as_buffer(), w.as_py(), threshold)
                found = [(top.as_py(), top.as_py() + len(ink) - 1, None, b""), *[(a, z, f, c.tobytes()) for a, z, f, c in segments(ink, top.as_py())]]
                first, last, full, columns = zip(*found, strict=True)
                same = lambda x, kind: pa.array([x.as_py()] * len(found), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(page, pa.int64()), same(w, pa.int32()), same(h, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(full, pa.bool_()), pa.array(columns, pa.binary())], names=["page_id", "width", "height", "first", "last", "full", "columns"])

    def join(page: pa.Table) -> pa.Table:
        rows = sorted(page.to_pylist(), key=lambda r: (r["full"] is not None, r["first"]))
        width, height, covered = rows[0]["width"], rows[0]["height"], 0
        for r in rows:
            if r["full"] is None:
                if r["first"] != covered:
                    raise ValueError(f"tiles of page {r['page_id']} leave or repeat scan lines at {min(covered, r['first'])}")
                covered = r["last"] + 1
        if covered != height:
            raise ValueError(f"tiles of page {rows[0]['page_id']} end at scan line {covered} of {height}")
        parts = [(r["first"], r["last"], r["full"], np.frombuffer(r["columns"], np.int32)) for r in rows if r["full"] is not None]
        return pa.Table.from_batches([_batch([rows[0]["page_id"]], [bands(parts, width, height)])])

    kept = tiles.select(F.col("page_id").cast("long").alias("page_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("top").cast("int").alias("top"), "rgb")
    found = kept.where("rgb is not null and width > 0").mapInArrow(cut, "page_id bigint, width int, height int, first int, last int, full boolean, columns binary")
    return found.groupBy("page_id").applyInArrow(join, _BANDS)
