"""64-bit hashes of the words of whole texts, for a batch of texts at a time.

A word's hash is a polynomial in its bytes (A-Z count as a-z) modulo 2 ** 64, taken from running sums over the batch's
bytes and then mixed; so no word is ever a Python object. Words are runs of bytes other than the separators.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at in one go; a chunk ends where a text or a word ends.
CHUNK = 1 << 16
BASE = 0x9E3779B97F4A7C15 | 1

_SPACE = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _letters(separators: bytes) -> bytes:
    """A table for bytes.translate: separators become 0, A-Z become a-z."""
    table = bytearray(range(256)).lower()
    table[0] = 1
    for b in separators:
        table[b] = 0
    return bytes(table)


#: Words are runs of all bytes but the six white-space characters; or but those, ASCII punctuation and controls.
SPACED = _letters(_SPACE)
BARE = _letters(bytes(range(33)) + b"\x7f" + string.punctuation.encode())

_powers: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    """BASE ** i and its inverse, for i up to n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK)
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (np.uint64(BASE), inverse)]
    return _powers


def _chunks(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(data):
        z = min(len(data), a + CHUNK)
        if z < len(data):
            text = int(starts[np.searchsorted(starts, z, "right") - 1])
            if text > a:
                z = text
            else:  # within a long text: before its last word here; a longer word is taken whole
                while z < len(data) and data[z]:
                    z += 1
        yield a, z
        a = z


def word_hashes(texts: pa.Array, letters: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, end to end; for each text the number of words up to its end). ``texts`` is binary; a null has none."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(memoryview(values or b"")[offsets[0] : offsets[-1]].tobytes().translate(letters), np.uint8)
    offsets = offsets - offsets[0]
    starts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    hashes, places = [], []
    for a, z in _chunks(data, starts):
        part = data[a:z]
        inside = part > 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = starts[np.searchsorted(starts, a, "right") : np.searchsorted(starts, z)] - a  # texts that start within
        opens[cuts] |= inside[cuts]
        closes[cuts - 1] |= inside[cuts - 1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        power, inverse = power_tables(max(len(part), CHUNK))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        places.append(first + a)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets[1:])


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_codes(texts: pa.Array, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(one 64-bit code for each run of ``size`` words within a text, end to end; number of codes of each text).

    With ``short``, a text of fewer words, one at least, has one code of all its words.
    """
    h, ends = word_hashes(texts, SPACED)
    counts = np.diff(ends, prepend=0)
    sizes = np.maximum(counts - (size - 1), 0)
    padded, code = np.concatenate([h, np.zeros(size, np.uint64)]), np.zeros(len(h), np.uint64)
    for k in range(size):
        word = padded[k : k + len(h)]
        if short:  # words past the end of a text count as none
            word = np.where(np.arange(len(h)) + k < np.repeat(ends, counts), word, np.uint64(0))
        code = (code ^ word) * _ODD[k % len(_ODD)]
        code ^= code >> np.uint64(31)
    if short:
        sizes = np.where((counts > 0) & (sizes == 0), 1, sizes)
    at = np.arange(len(h)) - np.repeat(ends - counts, counts)  # place within the text
    return mix(code[at < np.repeat(sizes, counts)]), sizes


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes of the binary ``column``, a longer text alone."""
    sizes = np.cumsum(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
