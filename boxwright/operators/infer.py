"""Images to input tensors, and tensors through a model, in Arrow batches.

Pixels are resampled half-pixel bilinearly. Values are pixel / 255, or (pixel / 255 - mean) / std where both
are given. Outside the image the padded part is black, so it is normalised too, or 0 with pad="zero".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwright.functions.geometry import letterbox, roi_rect

# The usual channel means and deviations.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def resample(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """image (rows, columns, channels) in another size; edges are repeated outwards."""
    rows, cols = image.shape[:2]

    def taps(n: int, size: int):
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    x0, x1, wx = taps(width, cols)
    y0, y1, wy = taps(height, rows)
    pixels = image.astype(np.float64)
    across = pixels[:, x0] + (pixels[:, x1] - pixels[:, x0]) * wx[None, :, None]
    return across[y0] + (across[y1] - across[y0]) * wy[:, None, None]


def tensor(image: np.ndarray, box: dict, model_w: int, model_h: int, mean=None, std=None, pad: str = "black") -> np.ndarray:
    """Planar float32 input of one image (already cut to its region), as the letterbox box places it."""
    w, h = max(1, round(box["draw_w"])), max(1, round(box["draw_h"]))
    left, top = int(np.clip(np.trunc(box["x_pad"]), 0, model_w - 1)), int(np.clip(np.trunc(box["y_pad"]), 0, model_h - 1))
    drawn = np.floor(resample(image[..., :3], w, h) + 0.5)[: model_h - top, : model_w - left]
    m, s = (np.asarray(mean), np.asarray(std)) if mean is not None and std is not None else (np.zeros(3), np.ones(3))
    out = np.zeros((model_h, model_w, 3)) if pad == "zero" else np.broadcast_to(-m / s, (model_h, model_w, 3)).copy()
    out[top : top + drawn.shape[0], left : left + drawn.shape[1]] = (drawn / 255 - m) / s
    return out.transpose(2, 0, 1).astype(np.float32)


def preprocess(images: DataFrame, model_w: int, model_h: int, mode: str = "proportional", mean=None, std=None, pad: str = "black") -> DataFrame:
    """image_id, lb and tensor of images: image_id, width, height, n_channels, data (row-major bytes), roi or not.

    Channels come red first, unless a column bgr says that an image has them blue first.
    """
    roi = F.col("roi") if "roi" in images.columns else None
    rect = roi_rect(F.col("width"), F.col("height"), roi) if roi is not None else F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("width"), F.col("height").alias("height"))
    placed = images.withColumn("__rect", rect).withColumn("lb", letterbox(F.col("__rect.width"), F.col("__rect.height"), model_w, model_h, mode, roi))
    bgr = F.coalesce("bgr", F.lit(False)) if "bgr" in images.columns else F.lit(False)
    placed = placed.select("image_id", "width", "height", "n_channels", "data", bgr.alias("bgr"), "__rect", "lb")
    schema = T.StructType([placed.schema["image_id"], placed.schema["lb"], T.StructField("tensor", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.select(["width", "height", "n_channels", "data", "bgr", "__rect", "lb"]).to_pylist():
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                image = np.repeat(image, 3, 2) if r["n_channels"] == 1 else image[..., 2::-1] if r["bgr"] else image
                c = r["__rect"]
                found.append(tensor(image[c["y"] : c["y"] + c["height"], c["x"] : c["x"] + c["width"]], r["lb"], model_w, model_h, mean, std, pad).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("lb"), pa.array(found, pa.list_(pa.float32()))], ["image_id", "lb", "tensor"])

    return placed.mapInArrow(run, schema)


def views(column: pa.Array) -> list[np.ndarray]:
    """Each list of a column of numbers as an array over Arrow's own memory; a null is empty."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]


def onnx_model(model: bytes, threads: int = 1) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """A function from an input tensor to outputs by name; one session for each Python worker."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = threads
    options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    session = ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    name, outputs = session.get_inputs()[0].name, [o.name for o in session.get_outputs()]
    return lambda x: dict(zip(outputs, session.run(outputs, {name: x}), strict=True))


def predict(tensors: DataFrame, model: bytes, shape: tuple[int, ...], outputs: list[str], load: Callable = onnx_model, column: str = "tensor") -> DataFrame:
    """tensors without column, with one array of floats for each of outputs; shape: of one row, without the batch."""
    held = tensors.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in tensors.schema if f.name != column]
    schema = T.StructType([*kept, *(T.StructField(o, T.ArrayType(T.FloatType())) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = load(held.value)
        for batch in batches:
            rows = [call(np.asarray(x, np.float32).reshape(1, *shape)) for x in views(batch.column(column))]
            found = [pa.array([r[o].astype(np.float32).ravel() for r in rows], pa.list_(pa.float32())) for o in outputs]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *found], [*(f.name for f in kept), *outputs])

    return tensors.mapInArrow(run, schema)
