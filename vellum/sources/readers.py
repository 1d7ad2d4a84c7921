"""Readers for page images, texts, timings and rule files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import ship

#: Extensions of page images, and of evaluation images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "jp2", "bmp")
EVALUATION_EXTENSIONS = ("png", "jpg", "jpeg", "ppm")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_supported_image(path: Column, extensions=IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def collect_images(spark: SparkSession, folder: str | None = None, file: str | None = None) -> DataFrame:
    """The images of a folder (not of folders in it) and a single file, as binaryFile rows. An empty choice is an error."""
    found = [spark.read.format("binaryFile").load(p).where(is_supported_image(F.col("path"))) for p in (folder, file) if p]
    if not found:
        raise ValueError("name a folder or a file")
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if out.select("path").isEmpty():
        raise ValueError("no supported image found")
    return out


def evaluation_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the evaluation images of a folder, not of folders in it, in order; none is an error."""
    out = spark.read.format("binaryFile").load(folder).select("path").where(is_supported_image(F.col("path"), EVALUATION_EXTENSIONS))
    if out.isEmpty():
        raise ValueError(f"no evaluation image in {folder}")
    return out.orderBy("path")


def input_union(listed: DataFrame, single: DataFrame) -> DataFrame:
    """Paths of a listing and of single files, both filtered by extension; duplicates stay."""
    return listed.select("path").unionByName(single.select("path")).where(is_supported_image(F.col("path")))


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb): Spark's image source gives BGR rows, which are reversed per pixel."""
    ship(spark)

    @F.pandas_udf("binary")
    def flip(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        def one(b, c):
            a = np.frombuffer(b, np.uint8).reshape(-1, c)
            return (np.repeat(a, 3, axis=1) if c == 1 else a[:, 2::-1]).tobytes()

        return pd.Series([one(b, c) for b, c in zip(data, channels, strict=True)])

    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return i.select(F.col("origin").alias("path"), "width", "height", flip("data", "nChannels").alias("rgb"))


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(relpath, text) of every .txt file below ``folder``, in order of their paths."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), rf"^\w+:/*\Q{base}\E/", "").alias("relpath"), F.col("value").alias("text")).orderBy("relpath")


def check_settings(line_text: str, output_stem: str | None = None) -> None:
    """Refuses a blank line text, and a blank output stem if one is given."""
    if not line_text.strip():
        raise ValueError("the line text is blank")
    if output_stem is not None and not output_stem.strip():
        raise ValueError("the output stem is blank")


def system_argument(raw: str) -> tuple[str, str]:
    """NAME=DIR, split at the first ``=``; the name must not be blank."""
    name, sep, folder = raw.partition("=")
    if not sep or not name.strip():
        raise ValueError(f"expected NAME=DIR: {raw!r}")
    return name.strip(), folder


def timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="stem string, wall_seconds double")


def charset(data) -> list[str]:
    """Characters from a list of strings, or a mapping model.charset_train of a string or such a list; or from YAML text of that mapping."""
    if isinstance(data, str):
        from vellum.operators.rule_pack import load_yaml

        data = load_yaml(data)
    if isinstance(data, dict):
        data = data.get("model", {}).get("charset_train")
    if isinstance(data, str):
        return list(data)
    if isinstance(data, list) and all(isinstance(x, str) for x in data):
        return [c for x in data for c in x]
    raise ValueError("charset_train must be a string or a list of strings")
