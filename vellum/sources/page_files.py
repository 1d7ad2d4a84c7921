"""A data source that writes one file per page and kind, and a manifest that says which files count.

A task of the write only stages its files, under names of its own, with a list of them; the driver hears of nothing but that list's
name, and its commit notes the lists of the tasks that count. A failing job is removed by the abort, and a task that was repeated has staged twice and
counts once; the files in place have not been touched yet. Then a second pass moves what counts into place and writes the manifest, by
tasks again: a move that has been made is not made twice. Names are clash-free and follow from the page alone.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vellum.session import ship

#: Between a name and the page's number, where the name alone would not do.
MARK = "~"
_ROW = "page_id bigint, kind string, path string"


def uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def stems(pages: DataFrame, stem: Column) -> DataFrame:
    """(page_id, stem): names that no two pages share. A name that several pages have, or that could be taken for a marked one, carries the page's number."""
    named = pages.select("page_id", stem.alias("stem_"))
    shared = named.groupBy("stem_").agg(F.count(F.lit(1)).alias("n_"))
    alone = (F.col("n_") == 1) & ~F.contains("stem_", F.lit(MARK))
    return named.join(shared, "stem_").select("page_id", F.when(alone, F.col("stem_")).otherwise(F.concat_ws(MARK, "stem_", F.col("page_id").cast("string"))).alias("stem"))


@dataclass
class Staged(WriterCommitMessage):
    name: str


class PageFileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.job = uri(options["path"]), options["job"]

    def _open(self) -> tuple[pafs.FileSystem, str]:
        fs, base = pafs.FileSystem.from_uri(self.target)
        return fs, f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, staging = self._open()
        own = uuid.uuid4().hex
        fs.create_dir(f"{staging}/{own}")
        with fs.open_output_stream(f"{staging}/{own}.json") as listed:
            for i, r in enumerate(iterator):
                with fs.open_output_stream(f"{staging}/{own}/{i}") as f:
                    f.write(r["body"])
                listed.write((json.dumps({"page_id": r["page_id"], "kind": r["kind"], "name": r["name"], "staged": f"{own}/{i}"}) + "\n").encode())
        return Staged(f"{own}.json")

    def commit(self, messages: list[Staged | None]) -> None:
        fs, staging = self._open()
        fs.create_dir(staging)
        with fs.open_output_stream(f"{staging}/lists") as f:
            f.write("\n".join(m.name for m in messages if m is not None).encode())  # a name per task

    def abort(self, messages: list[Staged | None]) -> None:
        fs, staging = self._open()
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class PageFiles(DataSource):
    """Options: path, a folder that driver and executors share; job, a name of its own. Rows: page_id, kind, name (within the folder), body."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "page_id bigint, kind string, name string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageFileWriter(self.options)


def publish(spark: SparkSession, folder: str, job: str) -> None:
    """Moves the files of a committed job into place and writes its part of the manifest. May be called again after a failure."""
    target = uri(folder)
    fs, base = pafs.FileSystem.from_uri(target)
    staging = f"{base}/_staging-{job}"
    with fs.open_input_stream(f"{staging}/lists") as f:
        lists = [f"{target}/_staging-{job}/{name}" for name in f.read().decode().split()]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(target)
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if fs.get_file_info(f"{staging}/{r['staged']}").type == pafs.FileType.File:
                    fs.move(f"{staging}/{r['staged']}", f"{base}/{r['name']}")
                elif fs.get_file_info(f"{base}/{r['name']}").type != pafs.FileType.File:
                    raise FileNotFoundError(r["name"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f"{base}/{r['name']}" for r in rows], pa.string())], names=["page_id", "kind", "path"])

    rows = spark.read.schema("page_id bigint, kind string, name string, staged string")
    found = rows.json(lists).mapInArrow(move, _ROW) if lists else spark.createDataFrame([], _ROW)
    found.write.mode("overwrite").json(f"{target}/_manifest/{job}")
    fs.delete_dir(staging)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, kind, name, body) rows into ``folder`` and returns its manifest."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    ship(spark)
    spark.dataSource.register(PageFiles)
    rows = files.select(F.col("page_id").cast("long").alias("page_id"), "kind", "name", F.col("body").cast("binary").alias("body"))
    rows.write.format("page_files").options(path=folder, job=job).mode("append").save()
    publish(spark, folder, job)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, kind, path) of all files that finished jobs have written into ``folder``; of a file that was written again one row."""
    fs, base = pafs.FileSystem.from_uri(uri(folder))
    jobs = [i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{base}/_manifest", allow_not_found=True))]
    done = [f"{uri(folder)}/_manifest/{j}" for j in jobs if fs.get_file_info(f"{base}/_manifest/{j}/_SUCCESS").type == pafs.FileType.File]
    return spark.read.schema(_ROW).json(done).distinct() if done else spark.createDataFrame([], _ROW)
