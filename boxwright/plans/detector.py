"""A model and what its task does to a table of images, end to end: input tensors, inference, rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import catalog, decode, infer, segmentation
from boxwright.sources.models import metadata

DESCRIPTOR = "model_id string, metadata map<string,string>, output_shapes map<string,array<int>>, input_shape array<int>, input_type string, task string, version string, names string"


class Detector:
    """Loads a model once; classify, detect, oriented, segment and pose return rows for tables of images.

    Options win over the model's own metadata. A task that the model is not for raises, as do a version that
    does not support its task and an input of unknown size.
    """

    def __init__(self, spark: SparkSession, model: bytes, labels: str | list[str] | None = None, task: str | None = None, version: str | None = None, resize: str | None = None, mean=None, std=None):
        import onnxruntime as ort

        session = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
        dims = lambda v: [x if isinstance(x, int) else -1 for x in v.shape]
        self.input = dims(session.get_inputs()[0])
        self.outputs = {o.name: dims(o) for o in session.get_outputs()}
        kind = "float16" if "float16" in session.get_inputs()[0].type else "float32"
        names = "\n".join(labels) if isinstance(labels, list) else labels
        row = spark.createDataFrame([("model", metadata(model), self.outputs, self.input, kind, task, version, names)], DESCRIPTOR)
        found = catalog.describe(row).first()
        if found.model_version is None:
            raise ValueError("this model's version is not supported")
        if found.model_type is None:
            raise ValueError("this model's task is not supported")
        self.family = decode.decoder(found.model_version, found.model_type)
        if found.labels is None:
            raise ValueError("class names are missing; pass labels")
        self.task, self.version, self.labels, self.model, self.description = found.model_type, found.model_version, list(found.labels), model, found
        rf = self.family == "rfdetr"
        self.resize = resize or ("stretch" if rf else "proportional")
        self.norm = {"mean": mean or (infer.MEAN if rf else None), "std": std or (infer.STD if rf else None), "pad": "zero" if rf else "black"}

    def raw(self, images: DataFrame) -> DataFrame:
        """image_id, lb and the model's outputs as arrays: kept by callers who decode at several thresholds."""
        _, channels, height, width = self.input
        tensors = infer.preprocess(images, width, height, self.resize, **self.norm)
        return infer.predict(tensors, self.model, (channels, height, width), [*self.outputs])

    def _for(self, task: str) -> None:
        if self.task != task:
            raise ValueError(f"this model does {self.task}, not {task}")

    def _first(self, raw: DataFrame, *more: str) -> tuple[DataFrame, list[int]]:
        name, shape = next(iter(self.outputs.items()))
        if len(shape) < 3:
            raise ValueError(f"unsupported output shape: {shape}")
        return raw.select("image_id", "lb", F.col(name).alias("data"), *more), shape

    def classify(self, images: DataFrame, k: int = 5) -> DataFrame:
        self._for("Classification")
        return decode.classify(self.raw(images).select("image_id", F.col(next(iter(self.outputs))).alias("data")), self.labels, k)

    def detect(self, images: DataFrame, conf: float = 0.2, iou: float = 0.7) -> DataFrame:
        self._for("ObjectDetection")
        return self._boxes(self.raw(images), conf, iou, "detect")

    def oriented(self, images: DataFrame, conf: float = 0.2, iou: float = 0.7) -> DataFrame:
        self._for("ObbDetection")
        return self._boxes(self.raw(images), conf, iou, "obb")

    def pose(self, images: DataFrame, conf: float = 0.2, iou: float = 0.7) -> DataFrame:
        self._for("PoseEstimation")
        return self._boxes(self.raw(images), conf, iou, "pose")

    def _boxes(self, raw: DataFrame, conf: float, iou: float, task: str, channels: int = 0, finish=None) -> DataFrame:
        if self.family == "rfdetr":
            shapes = self.outputs
            return decode.rfdetr(raw.withColumnsRenamed({"dets": "boxes", "labels": "logits"}), self.labels, shapes["dets"][1], shapes["labels"][2], conf, finish)
        df, shape = self._first(raw, *([finish.column] if finish else []))
        if self.family == "v8":
            points = decode.v8_key_points(shape[1], self.input[1], len(self.labels)) if task == "pose" else 0
            return decode.v8(df, self.labels, shape[2], conf, iou, task, points, channels, finish)
        if self.family == "rtdetr":
            return decode.rtdetr(df, self.labels, shape[1], conf)
        return decode.flat(df, self.labels, conf, 6 if task == "detect" else shape[2], task, channels, finish)

    def segment(self, images: DataFrame, conf: float = 0.2, pixel_conf: float = 0.65, iou: float = 0.7, outlines: bool = False) -> DataFrame:
        self._for("Segmentation")
        raw, names = self.raw(images), [*self.outputs]
        if self.family == "rfdetr":
            shape = self.outputs["masks"]
            found = self._boxes(raw, conf, iou, "detect", finish=segmentation.in_logits("masks", tuple(shape[1:4])))
        else:
            if len(names) < 2 or len(self.outputs[names[1]]) < 4:
                raise ValueError(f"unsupported segmentation outputs: {self.outputs}")
            _, channels, rows, cols = self.outputs[names[1]]
            finish = segmentation.in_prototypes(names[1], (channels, rows, cols), (self.input[3], self.input[2]), pixel_conf)
            found = self._boxes(raw, conf, iou, "segment", channels, finish)
        return segmentation.edge_points(found) if outlines else found

    def run(self, images: DataFrame, **options) -> DataFrame:
        """The rows of whatever task the model is for."""
        name = {"Classification": "classify", "ObjectDetection": "detect", "ObbDetection": "oriented", "Segmentation": "segment", "PoseEstimation": "pose"}[self.task]
        return getattr(self, name)(images, **options)


def run_mixed(images: DataFrame, detectors: dict[str, Detector], column: str = "model_id", **options) -> DataFrame:
    """image_id, model_id, task and the fields of any task, for images that each name one of several models.

    Images are split by model, each part goes through its own model, and the parts are put together; fields
    that a task lacks are null. An image of a model that is not there raises.
    """
    known = [*detectors]
    named = F.when(F.col(column).isin(known), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no such model: "), F.coalesce(column, F.lit("null")))))
    out = None
    for name, d in detectors.items():
        taken = {k: v for k, v in options.items() if k in ("conf", "iou") and d.task != "Classification" or k == "k" and d.task == "Classification"}
        part = d.run(images.withColumn(column, named).filter(F.col(column) == name).drop(column), **taken)
        part = part.select(F.lit(name).alias("model_id"), F.lit(d.task).alias("task"), *part.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no models")
    return out
