"""Structured Streaming: a page arrives whole in one file, so each micro-batch runs the page plans and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import page_rules


def texts(spark: SparkSession, folder: str, schema: str = "page_id bigint, text string") -> DataFrame:
    """Page texts as they arrive in Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def structured(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs the structural rules on every new page and appends (page_id, text) to ``target``; batches that repeat overwrite themselves."""

    def write(batch: DataFrame, epoch: int) -> None:
        lines = batch.select("page_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
        page_rules.page_text(page_rules.structural_rules(lines)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
