"""Model files: their bytes and the metadata in them, read from the protobuf without any model library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The field of metadata entries in a model, and of key and value in an entry.
METADATA, KEY, VALUE = 14, 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(raw):
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
    raise ValueError("a number is cut off")


def fields(raw: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(field number, bytes for a length-delimited field, else None) of a protobuf message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        number, kind, value = tag >> 3, tag & 7, None
        if kind == 0:
            _, at = _varint(raw, at)
        elif kind == 1:
            at += 8
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind == 5:
            at += 4
        else:
            raise ValueError(f"unsupported wire type: {kind}")
        yield number, value


def metadata(model: bytes | None) -> dict[str, str]:
    """The custom metadata of a model; of equal keys the last wins, entries without a key are dropped."""
    out = {}
    for number, entry in fields(model or b""):
        if number == METADATA and entry is not None:
            parts = {n: v for n, v in fields(entry) if v is not None}
            if key := parts.get(KEY, b"").decode("utf-8", "replace"):
                out[key] = parts.get(VALUE, b"").decode("utf-8", "replace")
    return out


def with_metadata(models: DataFrame) -> DataFrame:
    """model_id, content and metadata of models (model_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(metadata(raw.as_py()).items()) if raw.is_valid else [] for raw in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("model_id"), batch.column("content"), pa.array(found, pa.map_(pa.string(), pa.string()))], ["model_id", "content", "metadata"])

    return models.select("model_id", "content").mapInArrow(run, f"model_id {models.schema['model_id'].dataType.simpleString()}, content binary, metadata map<string,string>")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """model_id (its path), content, metadata of model files; a missing path raises."""
    return with_metadata(spark.read.format("binaryFile").load(path).select(F.col("path").alias("model_id"), "content"))
