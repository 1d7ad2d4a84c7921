"""A data source of page images: ``spark.read.format("page_images")`` gives tiles of packed RGB rows.

Partitions are planned by bytes of the files, so a folder of a million small pages is not a million tasks and a giant one does not wait
behind others. A file is inflated as it is read, and leaves the reader tile by tile: a page never has to fit in memory whole.
Readable are PNG (8 bits a channel, not interlaced) and binary PPM and PGM; ``readers.decode_images`` has Spark's own decoder for the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellum.session import ship

READABLE = ("png", "ppm", "pgm")
#: Bytes of files in one partition, and of pixels in one tile.
PARTITION_BYTES, TILE_BYTES = 32 << 20, 8 << 20
_CHUNK = 1 << 20
#: The signature, channels by colour type, and the filters of the format.
PNG, CHANNELS, NONE, SUB, UP, AVERAGE, PAETH = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}, 0, 1, 2, 3, 4

Rows = tuple[int, int, Iterator[np.ndarray]]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A scan line (a copy of bytes) without its filter; ``step`` bytes make a pixel."""
    if kind == NONE:
        return line
    if kind == UP:
        return line + above
    if kind == SUB:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (AVERAGE, PAETH):
        raise ValueError(f"unknown filter {kind}")
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(step):  # nothing stands to the left
        out[i] = (out[i] + (up[i] // 2 if kind == AVERAGE else up[i])) & 255
    for i in range(step, len(out)):  # each byte needs the one that was made before it
        a, b = out[i - step], up[i]
        if kind == AVERAGE:
            guess = (a + b) // 2
        else:
            c = up[i - step]
            left, above_ = abs(b - c), abs(a - c)
            corner = abs(a + b - 2 * c)
            guess = a if left <= above_ and left <= corner else b if above_ <= corner else c
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _rgb(line: np.ndarray, channels: int) -> np.ndarray:
    pixels = line.reshape(-1, channels)
    return (pixels[:, :3] if channels > 2 else np.repeat(pixels[:, :1], 3, axis=1)).ravel()


def _png(f) -> Rows:
    def chunks() -> Iterator[tuple[bytes, bytes]]:
        while head := f.read(8):
            size, name = struct.unpack(">I4s", head)
            yield name, f.read(size)
            f.read(4)

    parts = chunks()
    name, head = next(parts)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if name != b"IHDR" or depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("only PNG of 8 bits a channel, without palette and interlacing, is read")

    def lines() -> Iterator[np.ndarray]:
        step = CHANNELS[colour]
        size, held, inflate, above = 1 + width * step, b"", zlib.decompressobj(), np.zeros(width * step, np.uint8)
        for name, data in parts:
            while name == b"IDAT" and data:
                held += inflate.decompress(data, _CHUNK)
                data = inflate.unconsumed_tail
                whole = len(held) // size * size
                for at in range(0, whole, size):
                    above = _unfiltered(held[at], np.frombuffer(held, np.uint8, size - 1, at + 1), above, step)
                    yield _rgb(above, step)
                held = held[whole:]

    return width, height, lines()


def _pnm(f, kind: bytes) -> Rows:
    fields: list[int] = []
    while len(fields) < 3:
        word = b""
        while (c := f.read(1)) and not c.isspace():
            if c == b"#":
                while f.read(1) not in (b"\n", b""):
                    pass
                break
            word += c
        if word:
            fields.append(int(word))
        elif not c:
            raise ValueError("the header ends early")
    width, height, most = fields
    if most != 255:
        raise ValueError("only 8 bits a channel are read")
    channels = 3 if kind == b"P6" else 1
    return width, height, (_rgb(np.frombuffer(f.read(width * channels), np.uint8), channels) for _ in range(height))


def tiles(f, tile_bytes: int = TILE_BYTES) -> Iterator[tuple[int, int, int, bytes]]:
    """(width, height, top, rgb) of an open file: stretches of whole scan lines, from the top."""
    head = f.read(2)
    if head == PNG[:2] and f.read(6) == PNG[2:]:
        width, height, lines = _png(f)
    elif head in (b"P5", b"P6"):
        f.read(1)
        width, height, lines = _pnm(f, head)
    else:
        raise ValueError("not a PNG, PPM or PGM image")
    some, held, top = max(1, tile_bytes // max(1, 3 * width)), [], 0
    for line in lines:
        held.append(line.tobytes())
        if len(held) == some:
            yield width, height, top, b"".join(held)
            held, top = [], top + some
    if held:
        yield width, height, top, b"".join(held)
        top += len(held)
    if top != height:
        raise ValueError(f"{top} of {height} scan lines")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class PageImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("name a path")
        self.partition_bytes, self.tile_bytes = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("tileBytes", TILE_BYTES))

    def _open(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        fs, base = self._open()
        info = fs.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base))
        files = sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and i.extension.lower() in READABLE)
        if not files:
            raise ValueError(f"no readable image in {self.path}")
        parts, size = [_Files([])], 0
        for path, n in files:
            if parts[-1].files and size + n > self.partition_bytes:
                parts.append(_Files([]))
                size = 0
            parts[-1].files.append(path)
            size += n
        return parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        for path in partition.files:
            with fs.open_input_stream(path) as f:
                for width, height, top, rgb in tiles(f, self.tile_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([top], pa.int32()), pa.array([rgb], pa.binary())], names=["path", "width", "height", "top", "rgb"])


class PageImages(DataSource):
    """Options: path (a file or a folder, not folders in it), partitionBytes, tileBytes."""

    @classmethod
    def name(cls) -> str:
        return "page_images"

    def schema(self) -> str:
        return "path string, width int, height int, top int, rgb binary"

    def reader(self, schema) -> DataSourceReader:
        return PageImageReader(self.options)


def page_tiles(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(path, width, height, top, rgb): a row for each tile of each image below ``path``. A file that is no image is an error."""
    ship(spark)
    spark.dataSource.register(PageImages)
    return spark.read.format("page_images").options(path=path, **options).load()


def whole_pages(tiles_: DataFrame) -> DataFrame:
    """(page_id, path, width, height, rgb): the pages of ``page_tiles`` in one row each, for stages that look at a page as a whole. page_id is a hash of the path."""
    ordered = F.sort_array(F.collect_list(F.struct("top", "rgb")))
    grouped = tiles_.groupBy("path", "width", "height").agg(ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.rgb))
    return grouped.select(F.xxhash64("path").alias("page_id"), "path", "width", "height", joined.alias("rgb"))


def png(width: int, height: int, rgb: bytes, kind: int = SUB) -> bytes:
    """A PNG of packed RGB rows, all lines filtered by ``kind`` (NONE, SUB or UP)."""
    lines = np.frombuffer(rgb, np.uint8).reshape(height, width * 3)
    if kind == UP:
        lines = np.diff(lines, axis=0, prepend=np.zeros((1, width * 3), np.uint8))
    elif kind == SUB:
        lines = np.diff(lines.reshape(height, width, 3), axis=1, prepend=np.zeros((height, 1, 3), np.uint8)).reshape(height, -1)
    body = np.concatenate([np.full((height, 1), kind, np.uint8), lines], axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
