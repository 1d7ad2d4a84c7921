"""Token-id output as Arrow stream files of equal-length sequences.

A shard is one Arrow IPC stream: columns ``tokens`` and ``mask``, both fixed-size lists of SEQUENCE values, in record
batches of BATCH sequences. All batches of a stream but the last are equally long, so sequence k lies at a computable
offset of the memory-mapped file and is read without a copy (``SequenceFile``). Documents follow each other in the token
stream without gaps; only the end of a shard is padded, with mask false. Beside each shard, an index stream holds id and
number of tokens of each document.

Documents are range-partitioned by id, so shards are ascending; a task packs its rows as they come, and renames its files
into place when they are whole, so a repeated task leaves the same files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, shared_dir, ship
from vellum.llm.wordtokens import word_ids

SEQUENCE = 1024
BATCH = 64
SHARD_BYTES = 32_000_000


def _schema(width: int, sequence: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("tokens", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class ShardWriter:
    """Packs token bytes into the batches of one stream."""

    def __init__(self, sink, width: int, sequence: int = SEQUENCE, batch: int = BATCH):
        self.schema, self.width, self.sequence = _schema(width, sequence), width, sequence
        self.out, self.held, self.full, self.written = pa.ipc.new_stream(sink, self.schema), bytearray(), sequence * batch * width, 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        while len(self.held) >= self.full:
            self._flush(bytes(self.held[: self.full]))
            del self.held[: self.full]

    def _flush(self, ids: bytes) -> None:
        n = len(ids) // self.width
        rows = -(-n // self.sequence)
        self.written += n
        values = np.zeros(rows * self.sequence, f"<u{self.width}")
        values[:n] = np.frombuffer(ids, values.dtype)
        mask = np.arange(len(values)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in (values, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> int:
        if self.held:
            self._flush(bytes(self.held))
        self.out.close()
        return self.written


class SequenceFile:
    """Random access to the sequences of one local shard, without copies: the file is mapped, not read."""

    def __init__(self, path: str):
        self.file = pa.memory_map(path)
        reader = pa.ipc.open_stream(self.file)
        self.schema, self.header = reader.schema, self.file.tell()
        try:
            first = reader.read_next_batch()
        except StopIteration:
            self.batch_rows, self.batch_bytes = 1, 0
            return
        self.batch_rows, self.batch_bytes = first.num_rows, self.file.tell() - self.header

    def __getitem__(self, k: int) -> tuple[pa.Array, pa.Array]:
        """(tokens, mask) of sequence k."""
        at = self.header + k // self.batch_rows * self.batch_bytes
        if k < 0 or not self.batch_bytes or at >= self.file.size():
            raise IndexError(k)
        self.file.seek(at)
        try:
            message = pa.ipc.read_message(self.file)
        except EOFError:  # the mark at the end of the stream
            raise IndexError(k) from None
        if message.type != "record batch":
            raise IndexError(k)
        batch = pa.ipc.read_record_batch(message, self.schema)
        if k % self.batch_rows >= batch.num_rows:
            raise IndexError(k)
        return tuple(c[k % self.batch_rows].values for c in batch.columns)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes ``docs`` to ``folder`` in ascending order of id; returns (shard, n_docs, n_tokens), one row per shard.

    A null text is empty. Null ids come first. Rows that share an id are ordered by their text's hash; rows that repeat are
    written each. Very long texts run over as many sequences as they need. Other columns are not read. An empty table writes no
    file and gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        code = spark.sparkContext.broadcast(f.read())  # the vocabulary file
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.xxhash64(text_col).alias("h"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    ordered = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        context = TaskContext.get()
        shard, size = context.partitionId(), max(Tokenizer.from_str(code.value).get_vocab_size(with_added_tokens=True), end_id + 1)
        width = 2 if size <= 1 << 16 else 4
        ids, end, n_docs, writer, index = word_ids(code.value, width), end_id.to_bytes(width, "little"), 0, None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        names = [f"{base}/part-{shard:06d}.{k}" for k in ("tokens", "index")]
        trial = [f"{n}.{run_id}-{context.taskAttemptId()}" for n in names]
        for rows_ in batches:
            if not rows_.num_rows:
                continue
            if writer is None:
                fs.create_dir(base)
                sinks = [fs.open_output_stream(t) for t in trial]
                schema = pa.schema([("id", rows_.schema.field(0).type), ("n_tokens", pa.int64())])
                writer, index = ShardWriter(sinks[0], width, sequence, batch), pa.ipc.new_stream(sinks[1], schema)
            sizes = []
            for text in rows_.column(1):
                found = ids.text(text.as_py()) + end
                sizes.append(len(found) // width)
                writer.add(found)
            index.write_batch(pa.RecordBatch.from_arrays([rows_.column(0), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += rows_.num_rows
        if writer is None:
            return
        n_tokens = writer.close()
        index.close()
        for sink, name, t in zip(sinks, names, trial, strict=True):
            sink.close()
            fs.move(t, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["shard", "n_docs", "n_tokens"])

    return cut(ordered.mapInArrow(run, "shard int, n_docs bigint, n_tokens bigint"))


def read_documents(spark, folder: str, manifest: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the shard files, read shard by shard as streams."""
    found = sorted((r.shard, r.n_tokens) for r in manifest.collect())  # one row per file
    before, rows = 0, []
    for shard, n in found:
        rows.append((shard, before))
        before += n
    shards = spark.createDataFrame(rows, "shard int, base bigint").repartition(max(1, len(rows)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for rows_ in batches:
            for shard, start in zip(*[c.to_pylist() for c in rows_.columns], strict=True):
                name = f"{base}/part-{shard:06d}"
                with fs.open_input_stream(f"{name}.tokens") as tokens, fs.open_input_stream(f"{name}.index") as index:
                    stream, held = pa.ipc.open_stream(tokens), np.empty(0, np.uint32)
                    for part in pa.ipc.open_stream(index):
                        starts, sums, sizes = [], [], part.column(1).to_pylist()
                        for n in sizes:
                            pieces, have = [held], len(held)
                            while have < n:
                                got = stream.read_next_batch()
                                values = got.column(0).flatten().to_numpy()[np.asarray(got.column(1).flatten())]
                                pieces.append(values.astype(np.uint32))
                                have += len(values)
                            whole = np.concatenate(pieces) if len(pieces) > 1 else held
                            sums.append(zlib.crc32(whole[:n].astype("<u4").tobytes()))
                            held = whole[n:]
                            starts.append(start)
                            start += n
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), part.column(1), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Writes ``docs`` into a new folder of the shared directory and returns what the files say of each document.

    Null and blank texts have the end id only. Very long texts run over as many sequences as they need. An empty table
    writes no file and gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    manifest = write_shards(docs, folder, tokenizer_path, end_id, id_col, text_col, **sizes)
    return read_documents(spark, folder, manifest, docs.schema[id_col].dataType.simpleString(), id_col)
