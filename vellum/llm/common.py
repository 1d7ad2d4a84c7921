"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import remember
from vellum.session import ship as ship  # noqa: PLC0414

#: Words are maximal runs of characters other than the six ASCII white-space characters.
SPACES = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only when it has been counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000

#: Copies of a row that are made from one array.
STEP = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local session gets a temporary folder of its own; a cluster session is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vellum-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage, so that a lost executor costs a re-read only."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, for wide rows: a Parquet table in the shared folder, of which later passes read the columns they need."""
    path = remember(f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the executors drop the shuffle files of plans that nothing refers to any more; otherwise they stay until the driver's next collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, count: str, number: str) -> DataFrame:
    """Each row as often as its column ``count`` says, with ``number`` from 1. Copies are made STEP at a time, so no array is large."""
    many, left = fresh(df, "many_"), fresh(df, "left_")
    rows = df.withColumn(many, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {STEP}"))))
    rows = rows.withColumn(left, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP).cast("long"), F.col(count) - STEP * F.col(many)))))
    return rows.withColumn(number, STEP * F.col(many) + F.col(left)).drop(many, left)


def repeated(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its column ``count`` says, without that column."""
    number = fresh(df, "number_")
    return numbered(df, count, number).drop(count, number)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark an already materialised, narrow ``df`` for broadcast if it is counted to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(inner) > 0, F.split(inner, f"[{SPACES}]+")).otherwise(F.array().cast("array<string>"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
