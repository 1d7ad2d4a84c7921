"""Detectors and recognisers as Arrow table functions, with one open session per Python worker.

A model says how to open a session and what it makes of a batch. Spark's tasks are the pool: a worker opens a model when the first batch
asks for it, keeps it for later tasks, and closes the one that it used longest ago when more than KEEP are open.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import bands as B
from vellum.session import ship

#: Sessions that one worker keeps open, and bytes of rows that a model is given at a time (a larger row comes alone).
KEEP, BATCH_BYTES = 3, 32 << 20


class Model(Protocol):
    """``key`` names the session: models with equal keys share one. ``run`` gives a list of results for each row of the table."""

    key: str

    def open(self) -> Any: ...

    def run(self, session: Any, rows: pa.Table) -> list: ...

    def close(self, session: Any) -> None: ...


_sessions: OrderedDict[str, tuple[Model, Any]] = OrderedDict()


def session_of(model: Model, keep: int = KEEP) -> Any:
    """The worker's session of ``model``, opened at most once while it stays among the ``keep`` last used."""
    if model.key in _sessions:
        _sessions.move_to_end(model.key)
    else:
        while len(_sessions) >= keep:
            _, (old, opened) = _sessions.popitem(last=False)
            old.close(opened)
        _sessions[model.key] = model, model.open()
    return _sessions[model.key][1]


def by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of about ``most`` bytes, a larger row alone."""
    for b in batches:
        at, size = 0, max(1, b.nbytes // max(1, b.num_rows))
        while at < b.num_rows:
            take = max(1, most // size)
            while take > 1 and b.slice(at, take).nbytes > most:
                take //= 2
            yield pa.Table.from_batches([b.slice(at, take)])
            at += take


def _checked(model: Model, rows: pa.Table) -> list:
    found = model.run(session_of(model), rows)
    if len(found) != rows.num_rows:
        raise ValueError(f"{model.key} gave {len(found)} results for {rows.num_rows} rows")
    return found


RAW = "page_id bigint, det_id int, label int, score double, x0 double, y0 double, x1 double, y1 double, char_count double"


def detect(pages: DataFrame, model: Model, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """RAW rows of the pages (page_id, width, height, rgb): none, one or many for each.

    The model gives, for each page, a tuple of arrays (class ids, boxes, scores, character counts or None), of as many boxes of
    four as there are ids and scores; shapes that do not fit are an error. Pages without pixels are not shown to it.
    """
    ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("det_id", pa.int32()), ("label", pa.int32()), *[(c, pa.float64()) for c in ("score", *G.BOX, "char_count")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, batch_bytes):
            for page, (ids, boxes, scores, counts) in zip(rows["page_id"].to_pylist(), _checked(model, rows), strict=True):
                ids, scores, boxes = np.asarray(ids, np.int32), np.asarray(scores, np.float64), np.asarray(boxes, np.float64).reshape(-1, 4) if np.size(boxes) % 4 == 0 else None
                n = len(ids)
                if boxes is None or not (len(boxes) == len(scores) == n) or counts is not None and len(counts) != n:
                    raise ValueError(f"{model.key}: ids, boxes, scores and counts of page {page} differ in number")
                counts = pa.nulls(n, pa.float64()) if counts is None else pa.array(np.asarray(counts, np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, page, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids), pa.array(scores), *map(pa.array, boxes.T.copy()), counts], schema=schema)

    return pages.where("rgb is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("width").cast("int"), F.col("height").cast("int"), "rgb").mapInArrow(run, RAW)


def recognizer(model: Model, columns: tuple[str, ...], batch_bytes: int = BATCH_BYTES):
    """A recogniser for ``vellum.operators.cascade``: line rows -> the same rows with text and mean_confidence.

    The model is given ``columns`` and returns (text, confidence) for each row; a text of None is an error. Other columns pass by as they are.
    """

    def run(lines: DataFrame) -> DataFrame:
        ship(lines.sparkSession)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in by_bytes(batches, batch_bytes):
                found = _checked(model, rows.select(list(columns)))
                if any(t is None for t, _ in found):
                    raise ValueError(f"{model.key} gave no text for a line")
                made = rows.append_column("text", pa.array([t for t, _ in found], pa.string())).append_column("mean_confidence", pa.array([float(c) for _, c in found], pa.float64()))
                yield from made.to_batches()

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
        return lines.mapInArrow(read, fields + ", text string, mean_confidence double")

    return run


class BandDetector:
    """The detector without a model: bands of ink as lines, with score 1."""

    def __init__(self, threshold: int = B.THRESHOLD):
        self.key, self.threshold = f"bands-{threshold}", threshold

    def open(self) -> int:
        return G.CLASSES.index("line_main") + 1

    def run(self, session: int, rows: pa.Table) -> list:
        out = []
        for w, h, rgb in zip(rows["width"].to_pylist(), rows["height"].to_pylist(), rows["rgb"].to_pylist(), strict=True):
            boxes = B.bands(B.segments(B.dark(rgb, w, self.threshold), 0), w, h)
            out.append(([session] * len(boxes), boxes, [1.0] * len(boxes), None))
        return out

    def close(self, session: int) -> None:
        pass
