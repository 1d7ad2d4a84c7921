"""Crops and model inputs from packed RGB rows, as Arrow-batched numpy functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Channel means and deviations of the detector's input.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def crop(rgb: bytes, width: int, height: int, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    if len(rgb) != width * height * 3:
        raise ValueError("the buffer does not fit the size")
    if not (0 <= x0 < x1 <= width and 0 <= y0 < y1 <= height):
        raise ValueError("invalid crop box")
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)[y0:y1, x0:x1]


def recognizer_input(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Planar BGR in [-1, 1]: upright lines are turned left first, then the image is stretched bilinearly about pixel centres."""
    if image.shape[0] > image.shape[1]:
        image = np.rot90(image)
    image = image.astype(np.float32)

    def places(n: int, size: int):
        at = np.clip((np.arange(n, dtype=np.float32) + np.float32(0.5)) * np.float32(size / n) - np.float32(0.5), 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    ya, yb, wy = places(height, image.shape[0])
    xa, xb, wx = places(width, image.shape[1])
    wx, wy = wx[None, :, None], wy[:, None, None]
    top = image[ya][:, xa] * (1 - wx) + image[ya][:, xb] * wx
    low = image[yb][:, xa] * (1 - wx) + image[yb][:, xb] * wx
    out = (top * (1 - wy) + low * wy) / np.float32(127.5) - np.float32(1)
    return out[:, :, ::-1].transpose(2, 0, 1).astype(np.float32)


def detector_input(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Planar RGB, normalised: padded to a square at the right and bottom, then nearest pixels by integer division."""
    side = max(image.shape[:2])
    ys, xs = np.arange(height) * side // height, np.arange(width) * side // width
    out = np.zeros((height, width, 3), np.float32)
    iny, inx = ys < image.shape[0], xs < image.shape[1]
    out[np.ix_(iny, inx)] = image[ys[iny]][:, xs[inx]]
    return ((out / np.float32(255) - np.float32(MEAN)) / np.float32(STD)).transpose(2, 0, 1).astype(np.float32)


def crop_udf():
    """(rgb, image width, image height, x0, y0, x1, y1) -> the packed RGB rows of the box; a box beyond the image fails the query."""

    @F.pandas_udf("binary")
    def run(rgb: pd.Series, w: pd.Series, h: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([crop(*row).tobytes() for row in zip(rgb, w, h, x0, y0, x1, y1, strict=True)])

    return run


def tensor_udf(kind: str, width: int, height: int):
    """(rgb, image width, image height, x0, y0, x1, y1) -> array<float> of the named input."""
    make = {"recognizer": recognizer_input, "detector": detector_input}[kind]

    @F.pandas_udf("array<float>")
    def run(rgb: pd.Series, w: pd.Series, h: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([make(crop(*row), width, height).ravel() for row in zip(rgb, w, h, x0, y0, x1, y1, strict=True)])

    return run
