"""Images and frames as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (its path), width, height, n_channels, data (row-major, blue first: bgr is true) of image files."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    i = F.col("image")
    return found.select(i["origin"].alias("image_id"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("n_channels"), F.lit(True).alias("bgr"), i["data"].alias("data"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """image_id, modified, size and content of all files that match."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("image_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def stream_files(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """As read_files, for files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return found.select(F.col("path").alias("image_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, labels: the names in each label file, as functions.labels.parse_list has them."""
    from boxwright.functions.labels import parse_list

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), parse_list(F.col("value")).alias("labels"))
