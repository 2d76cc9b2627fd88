"""Masks and contours of detections, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxwright.functions import masks
from boxwright.functions.geometry import mask_crop
from boxwright.operators.infer import views

SIDES = ("left", "top", "right", "bottom")
POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _sides(box: dict | None) -> tuple[float, ...] | None:
    return tuple(box[s] for s in SIDES) if box and all(box[s] is not None for s in SIDES) else None


Finish = Callable[[DataFrame], DataFrame]

#: Rows of a batch that become Python objects at once; bytes of results after which a batch is passed on, and of input batches.
ROWS, BYTES = 256, 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session sends Arrow batches of at most BYTES, unless it has a smaller bound."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BYTES:
        spark.conf.set(name, str(BYTES))
    return df


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _passed_on(results: Iterator[tuple[list, int]], give: Callable[[int, list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """give(first row, results) of results (with their bytes) by row, as soon as they hold BYTES."""
    found, held, first = [], 0, 0
    for result, size in results:
        found.append(result)
        held += size
        if held >= BYTES:
            yield give(first, found)
            found, held, first = [], 0, first + len(found)
    if found:
        yield give(first, found)


def _masked(column: str, mask_of: Callable[[dict, np.ndarray, dict | None], bytes], crop: Callable | None = None, drop: tuple[str, ...] = ()) -> Finish:
    """A step between decoding and exploding: each of objects gets mask = mask_of(object, the row's column, lb)."""

    def finish(df: DataFrame) -> DataFrame:
        if crop is not None:
            df = df.withColumn("objects", F.transform("objects", lambda o: o.withField("__crop", crop(o))))
        old = df.schema["objects"].dataType.elementType
        new = T.StructType([*(f for f in old if f.name not in drop), T.StructField("mask", T.BinaryType())])
        kept = [f for f in df.schema if f.name not in ("objects", column)]
        schema = T.StructType([*kept, T.StructField("objects", T.ArrayType(new))])
        arrow = to_arrow_type(schema["objects"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):

                def masked(part: pa.RecordBatch = part) -> Iterator[tuple[list, int]]:
                    for objects, values, lb in zip(part.column("objects").to_pylist(), views(part.column(column)), part.column("lb").to_pylist(), strict=True):
                        done = [{**{k: v for k, v in o.items() if k not in drop}, "mask": mask_of(o, values, lb)} for o in objects or []]
                        yield done, sum(len(o["mask"]) for o in done)

                def give(first: int, found: list, part: pa.RecordBatch = part) -> pa.RecordBatch:
                    own = part.slice(first, len(found))
                    return pa.RecordBatch.from_arrays([*(own.column(f.name) for f in kept), pa.array(found, arrow)], [*(f.name for f in kept), "objects"])

                yield from _passed_on(masked(), give)

        return bounded(df).mapInArrow(run, schema)

    finish.column = column
    return finish


def in_prototypes(column: str, shape: tuple[int, int, int], model: tuple[int, int], least: float = 0.65) -> Finish:
    """Masks out of prototypes (channels x rows x columns, in a column of the tensors' row) by an object's weights.

    All survivors of an image are masked in its row, before they are exploded.
    """
    channels, rows, cols = shape

    def mask_of(o: dict, proto: np.ndarray, lb: dict | None) -> bytes:
        box, crop = _sides(o["box"]), _sides(o["__crop"])
        if box is None or crop is None or len(proto) < channels * rows * cols:
            return b""
        cells = np.asarray(proto[: channels * rows * cols], np.float32).reshape(channels, rows, cols)
        return masks.from_prototypes(cells, np.asarray(o["weights"], np.float32), crop, int(box[2] - box[0]), int(box[3] - box[1]), least)

    return _masked(column, mask_of, lambda o: mask_crop(o["model_box"], cols, rows, *model), ("__crop", "model_box", "weights"))


def in_logits(column: str, shape: tuple[int, int, int]) -> Finish:
    """Masks out of one map of logits for each prediction (predictions x rows x columns, in a column of the tensors' row)."""
    count, rows, cols = shape

    def mask_of(o: dict, maps: np.ndarray, lb: dict | None) -> bytes:
        box, at = _sides(o["box"]), o["index"] * rows * cols
        if box is None or lb is None or len(maps) < at + rows * cols:
            return b""
        cells = np.asarray(maps[at : at + rows * cols], np.float32).reshape(rows, cols)
        return masks.from_logits(cells, box, (lb["source_w"], lb["source_h"]), (lb["model_w"], lb["model_h"]), lb["resize_mode"])

    return _masked(column, mask_of)


def edge_points(segments: DataFrame, box: str = "box", mask: str = "mask") -> DataFrame:
    """segments with edge_points: the contour pixels of the mask in walking order; empty for an empty mask or box."""
    schema = T.StructType([*segments.schema, T.StructField("edge_points", POINTS)])

    kind = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):

            def walks(part: pa.RecordBatch = part) -> Iterator[tuple[np.ndarray, int]]:
                for b, m in zip(part.column(box).to_pylist(), part.column(mask), strict=True):
                    sides, m = _sides(b), m.as_py()
                    w, h = (int(sides[2] - sides[0]), int(sides[3] - sides[1])) if sides else (0, 0)
                    walk = masks.contour(masks.edge_pixels(masks.unpacked(m, w, h)), w, sides[0], sides[1]) if m and w > 0 and h > 0 else []
                    found = np.asarray(walk, np.float64).reshape(-1, 2)
                    yield found, found.nbytes

            def give(first: int, found: list, part: pa.RecordBatch = part) -> pa.RecordBatch:
                own, every = part.slice(first, len(found)), np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)])
                points = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in (0, 1)], fields=list(kind))
                return pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points)], [*own.schema.names, "edge_points"])

            yield from _passed_on(walks(), give)

    return bounded(segments).mapInArrow(run, schema)
