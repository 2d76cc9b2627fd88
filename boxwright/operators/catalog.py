"""Model descriptors: one row for each model, from its metadata, its shapes and the caller's options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import labels as lb


def describe(models: DataFrame) -> DataFrame:
    """model_id, model_type, model_version, data_type, input_size, labels, decoder, supported.

    models: model_id, metadata and output_shapes (maps), input_shape (array), input_type, and options
    task, version, names (text), null where not given. Options win over metadata, metadata over shapes.
    """
    meta = lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    shapes = F.col("output_shapes")
    described = F.coalesce(meta("description"), F.lit(""))
    version = F.coalesce(F.col("version"), F.when(described != "", lb.version_of(described)).when(lb.has_box_and_class_outputs(shapes), "RFDETR"))
    count = lb.class_count(shapes)
    names = F.when(F.col("names").isNotNull(), lb.parse_list(F.col("names"))).when(F.coalesce(meta("names"), F.lit("")) != "", lb.parse_dict(meta("names"))).when(count.isNotNull(), lb.inferred(count))
    found = models.select(
        "model_id", F.coalesce("task", lb.task_of(meta("task"), shapes)).alias("model_type"), version.alias("model_version"),
        F.when(F.col("input_type") == "float16", "Float16").otherwise("Float").alias("data_type"), lb.input_size(F.col("input_shape")).alias("input_size"), names.alias("labels"),
    )
    return supported(found)


def matrix(spark) -> DataFrame:
    """model_version, model_type, decoder: every supported pair (29 rows)."""
    rows = [(v, t, lb.FAMILY[v]) for v, tasks in lb.SUPPORT.items() for t in tasks]
    return spark.createDataFrame(rows, "model_version string, model_type string, decoder string")


def supported(models: DataFrame) -> DataFrame:
    """models with decoder and supported, by a broadcast of the fixed matrix."""
    table = F.broadcast(matrix(models.sparkSession))
    return models.join(table, ["model_version", "model_type"], "left").withColumn("supported", F.col("decoder").isNotNull()).select(*models.columns, "decoder", "supported")


def unsupported(models: DataFrame) -> DataFrame:
    return models.join(F.broadcast(matrix(models.sparkSession)), ["model_version", "model_type"], "left_anti")


def label_rows(models: DataFrame) -> DataFrame:
    """model_id, index, name: the labels as a dimension table."""
    return models.select("model_id", F.posexplode("labels").alias("index", "name"))


def named(rows: DataFrame, labels: DataFrame, key: str = "label_index", how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """rows with label from labels (model_id, index, name): inner drops unknown numbers, left names them by number.

    The table is broadcast up to most rows, else joined by shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    table = labels.select("model_id", F.col("index").cast("long").alias(key), F.col("name").alias("label"))
    table = F.broadcast(table) if table.limit(most + 1).count() <= most else table
    met = rows.join(table, ["model_id", key], how)
    return met.withColumn("label", F.coalesce("label", F.col(key).cast("string"))) if how == "left" else met
