"""Readers and writers: images and fragments from folders, tables as Parquet, JSON or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Image file endings.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def read_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(fragment_id, path, modified, size, content): the id is the last number in the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*IMAGE_ENDINGS))
    number = F.regexp_extract(name, r"(\d{1,18})\D*$", 1)
    return files.select(F.when(number != "", number.cast("long")).alias("fragment_id"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """kind: parquet, orc, json or csv (with a header)."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(path)
