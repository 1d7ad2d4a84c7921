"""BPE encoding and decoding by a table of distinct words.

Texts are dealt into blocks of bounded size. Each block's distinct words go to the task that their hash names; there
each distinct word of the corpus is encoded once, and its ids go back to the blocks that asked. A block then joins them to
the word positions of its texts, and the ids to the id-to-piece table. Words travel as one compressed chunk per block and
hash range, texts once and compressed, so nothing the size of the token stream is ever shuffled.

Rows that agree in id and text are one row with a count, from the first task that sees two of them on, so a block stays
bounded whatever repeats.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import repeated, ship
from vellum.llm.wordtokens import WordIds

#: Bytes of text in a block; what a task holds is about the size of one block and its distinct words.
BLOCK_BYTES = 24_000_000
#: Partitions that the blocks are dealt into at most; a task takes its blocks one after the other.
MAX_PARTITIONS = 50_000
#: Hash ranges of words; a task holds the distinct words of one range at a time.
MAX_PARTS = 16_384
#: Ids that are turned into text in one go.
STRETCH = 1 << 18


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, id, body, copies): body is the compressed text, dealt into blocks by id and text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.select(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)).cast("int").alias("block"), "id", "body")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            first: dict[tuple, int] = {}
            counts: list[int] = []
            kept: list[int] = []
            for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                k = first.setdefault(key, len(counts))
                if k == len(counts):
                    counts.append(0)
                    kept.append(i)
                counts[k] += 1
            bodies = pa.array([squeeze.compress(b or b"") for _, b in first], pa.binary())
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), bodies, pa.array(counts, pa.int64())], ["block", "id", "body", "copies"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"block int, id {kind}, body binary, copies bigint").repartition(min(blocks, MAX_PARTITIONS), "block"), blocks


def _asks(blocked: DataFrame, parts: int) -> DataFrame:
    """(part, block, words): the sorted distinct words of each block, one chunk per hash range."""

    def chunks(block: int, found: set[bytes]) -> Iterator[pa.RecordBatch]:
        dealt: list[list[bytes]] = [[] for _ in range(parts)]
        for w in sorted(found):
            dealt[zlib.crc32(w) % parts].append(w)
        squeeze = zstandard.ZstdCompressor(level=6)
        for part, chunk in enumerate(dealt):
            if chunk:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([squeeze.compress(b"\n".join(chunk))], pa.binary())], ["part", "block", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, squeeze = None, set(), zstandard.ZstdDecompressor()
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if block != held and found:
                    yield from chunks(held, found)
                    found = set()
                held = block
                found.update(squeeze.decompress(body.as_py()).split())
        if found:
            yield from chunks(held, found)

    return blocked.sortWithinPartitions("block").mapInArrow(run, "part int, block int, words binary")


def _answers(asks: DataFrame, parts: int, tokenizer_json: str, width: int) -> DataFrame:
    """(block, words, ids, sizes): the chunks with each word's ids. All chunks of a hash range meet in one task, one range after
    the other, so that a word is encoded once."""
    code = asks.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary file, a few MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = WordIds(code.value, width, limit=None), None
        unzip, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, block, words in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if part != held:
                    ids.clear()
                    held = part
                got = [ids[w] for w in unzip.decompress(words).split(b"\n")]
                sizes = np.fromiter(map(len, got), "<u4", len(got))
                cells = [pa.array([block], pa.int32()), *[pa.array([b], pa.binary()) for b in (words, squeeze.compress(b"".join(got)), squeeze.compress(sizes.tobytes()))]]
                yield pa.RecordBatch.from_arrays(cells, ["block", "words", "ids", "sizes"])

    return asks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "block int, words binary, ids binary, sizes binary")


def _table(answers: pa.Table) -> dict[bytes, bytes]:
    """Packed ids of every distinct word of a block."""
    unzip, table = zstandard.ZstdDecompressor(), {}
    for cells in zip(*[answers.column(c) for c in ("words", "ids", "sizes")], strict=True):
        words, ids, sizes = (unzip.decompress(c.as_py()) for c in cells)
        ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
        table.update(zip(words.split(b"\n"), map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
    return table


def _joined(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, block_bytes: int, finish, schema: str) -> DataFrame:
    """Blocks of texts cogrouped with their words' ids; ``finish(ids of each text, pieces)`` makes the columns beside id.

    ``finish`` is given an iterator of the integer arrays of ids and the id-to-piece table, and returns a list of columns.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    names = pieces(tokenizer_json)
    width = 2 if len(names) <= 1 << 16 else 4
    blocked, blocks = _blocks(docs, id_col, text_col, block_bytes)
    parts = max(8, min(2 * blocks, MAX_PARTS))
    answers = _answers(_asks(blocked, parts), parts, tokenizer_json, width)
    held = spark.sparkContext.broadcast(names)  # the vocabulary
    single = blocked.groupBy("block", "id", "body").agg(F.sum("copies").alias("copies"))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        table, unzip = _table(words), zstandard.ZstdDecompressor()
        texts = texts.combine_chunks()
        found = (np.frombuffer(b"".join(map(table.__getitem__, unzip.decompress(b.as_py()).split())), f"<u{width}") for b in texts.column("body"))
        return pa.table([texts.column("id"), texts.column("copies"), *finish(found, held.value)], names=["id", "copies", *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    made = single.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"id {kind}, copies bigint, {schema}")
    return repeated(made, "copies").withColumnRenamed("id", id_col)


def pieces(tokenizer_json: str) -> list[str]:
    """The id-to-piece table, read from the tokenizer file."""
    data = json.loads(tokenizer_json)
    known = data["model"]["vocab"] | {t["content"]: t["id"] for t in data["added_tokens"]}
    out = [""] * (max(known.values()) + 1)
    for piece, i in known.items():
        out[i] = piece
    return out


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ids array<int>) of every row.

    A null, empty or blank text has no ids; very long texts are taken whole. Rows that repeat stay, each with the same ids;
    null ids stay. Other columns do not matter. An empty table gives an empty result.
    """

    def finish(found, names):
        return [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))]

    return _joined(docs, tokenizer_path, id_col, text_col, block_bytes, finish, "ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids joined to the id-to-piece table; pieces are joined by a space, as the tokenizer file has no decoder.

    Null or empty ids give the empty text; an id outside the table is an error. Repeated rows and null ids stay; an empty
    table gives an empty result.
    """
    ship(encoded.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        table = pieces(f.read())
    held = encoded.sparkSession.sparkContext.broadcast(table)  # the vocabulary
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        for batch in batches:
            texts = [" ".join([names[i] for i in ids.as_py() or ()]) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def _digest(found: np.ndarray, table: list[str]) -> str:
    """SHA-256 of the entries of ``table`` at ``found``, joined by a space."""
    out = hashlib.sha256()
    for at in range(0, len(found), STRETCH):
        out.update(((" " if at else "") + " ".join(map(table.__getitem__, found[at : at + STRETCH].tolist()))).encode())
    return out.hexdigest()


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids in decimal and of the decoded text.

    A null, empty or blank text has no tokens and the digests of the empty string. Very long texts make a larger block,
    never a cut text. Rows that repeat are encoded alike and stay; null ids stay. Other columns do not matter. An empty table
    gives an empty result.
    """

    def finish(found, names):
        digits, counts, first, second = [str(i) for i in range(len(names))], [], [], []
        for x in found:
            counts.append(len(x))
            first.append(_digest(x, digits))
            second.append(_digest(x, names))
        return [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]

    return _joined(docs, tokenizer_path, id_col, text_col, block_bytes, finish, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
