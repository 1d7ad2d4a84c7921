"""Accuracy of predictions that arrive as files: each counted once, and one exact total at any time.

The stream's state remembers which (system, file) it has seen, so a file that is delivered again, late or in another batch, changes
nothing. Each batch writes the metrics of its new files under its own number, over what an interrupted run of it has left; the totals are the sums over
all that is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import evaluate


def predictions(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """(system, relpath, text) as Parquet files arrive."""
    reader = spark.readStream.schema("system string, relpath string, text string")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def measured(arriving: DataFrame, truth: DataFrame, target: str, checkpoint: str, level: str = "basic") -> StreamingQuery:
    """Appends the metrics of every new file that has a truth to ``target``. Of several texts of one (system, file) the first to arrive counts."""
    once = arriving.dropDuplicates(["system", "relpath"])

    def write(batch: DataFrame, number: int) -> None:
        evaluate.file_metrics(truth, batch, level).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, target: str) -> DataFrame:
    """``evaluate.system_metrics`` over all files so far."""
    return evaluate.system_metrics(spark.read.parquet(target))
