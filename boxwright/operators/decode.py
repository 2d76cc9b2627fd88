"""Decoders: raw output tensors to detection rows.

A tensor is one row: image_id, data (array of float or double) and lb, the letterbox of its image. Everything
up to and including suppression happens in the array of that row, so no decoder shuffles; survivors alone are
exploded. Detections have image_id, rank, index (of the prediction), label_index, label, confidence and box;
tasks add angle, key_points or weights and model_box.

Reads beyond the data give null; a null or NaN class score never wins. Classes without a label are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions.labels import BACKGROUND, FAMILY, SUPPORT
from boxwright.operators import nms

Read = Callable[[Column, int], Column]


def _names(labels: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in labels)) if labels else F.array().cast("array<string>")


def _value(data: Column, at: Column) -> Column:
    return F.get(data, at).cast("double")


def by_attribute(data: Column, predictions: int) -> Read:
    """Attribute k of prediction i where all predictions of an attribute stand together."""
    return lambda i, k: _value(data, F.lit(k * predictions) + i)


def by_row(data: Column, stride: int) -> Read:
    """Attribute k of prediction i where all attributes of a prediction stand together."""
    return lambda i, k: _value(data, i * stride + k)


def best_class(score: Callable[[Column], Column], classes: int) -> Column:
    """The first of the highest scores over 0: struct of score and label, which is -1 where there is none."""
    none = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("label"))
    if classes < 1:
        return none
    step = lambda a, k: F.when((score(k) > a["score"]) & ~F.isnan(score(k)), F.struct(score(k).alias("score"), k.alias("label"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0), F.lit(classes - 1)), none, step)


def _rows(df: DataFrame, objects: Column, extra: tuple[str, ...] = (), finish: Callable | None = None) -> DataFrame:
    """The objects of each row, exploded. finish: a step of segmentation that gives them masks before that."""
    if finish is not None:
        df = finish(df.select("image_id", "lb", finish.column, objects.alias("objects")))
        objects, extra = F.col("objects"), (*(x for x in extra if x not in ("model_box", "weights")), "mask")
    found = df.select("image_id", F.posexplode(objects).alias("rank", "o"))
    return found.select("image_id", F.col("rank").cast("long").alias("rank"), F.col("o.index").cast("long").alias("index"), F.col("o.label_index").cast("long").alias("label_index"), "o.label", "o.confidence", "o.box", *(f"o.{c}" for c in extra))


def _points(x: Callable[[Column, int], Column], lb: Column, count: int) -> Column:
    """Key points 0..count-1; x(j, k): value k (x, y, confidence) of point j."""
    if count < 1:
        return F.array().cast("array<struct<x:double,y:double,confidence:double>>")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.struct(g.scale_x(x(j, 0), lb).cast("double").alias("x"), g.scale_y(x(j, 1), lb).cast("double").alias("y"), F.coalesce(x(j, 2), F.lit(0.0)).alias("confidence")))


def v8(df: DataFrame, labels: list[str], predictions: int, conf: float = 0.2, iou: float = 0.7, task: str = "detect", key_points: int = 0, channels: int = 0, finish: Callable | None = None) -> DataFrame:
    """Attribute-major heads: centre, size, class scores, then angle, key points or mask weights."""
    data, lb, n = F.col("data"), F.col("lb"), len(labels)
    at, names = by_attribute(data, predictions), _names(labels)

    def scored(i: Column) -> Column:
        return F.struct(i.alias("i"), best_class(lambda k: _value(data, (k + 4) * predictions + i), n).alias("best"))

    def built(s: Column) -> Column:
        i = s["i"]
        x, y, w, h = (at(i, k) for k in range(4))
        sides = (x - w / 2, y - h / 2, x + w / 2, y + h / 2)
        parts = [i.alias("index"), s["best"]["label"].alias("label_index"), F.get(names, s["best"]["label"]).alias("label"), s["best"]["score"].alias("confidence"), g.scale_box(*sides, lb).alias("box")]
        if task == "obb":
            parts.append(F.coalesce(at(i, 4 + n), F.lit(0.0)).alias("angle"))
        if task == "pose":
            parts.append(_points(lambda j, k: _value(data, (F.lit(4 + n + k) + j * 3) * predictions + i), lb, key_points).alias("key_points"))
        if task == "segment":
            parts.append(g.box(*sides).alias("model_box"))
            parts.append(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.coalesce(_value(data, (c + 4 + n) * predictions + i), F.lit(0.0))).alias("weights"))
        return F.struct(*parts)

    candidates = F.filter(F.transform(F.sequence(F.lit(0), F.lit(predictions - 1)), scored), lambda s: (s["best"]["label"] >= 0) & (s["best"]["score"] >= conf))
    extra = {"detect": (), "obb": ("angle",), "pose": ("key_points",), "segment": ("model_box", "weights")}[task]
    return _rows(df, nms.fold(F.transform(candidates, built), iou), extra, finish)


def v8_key_points(attributes: int, input_channels: int, classes: int) -> int:
    """Key points of an attribute-major pose head: right for one class, kept as it is for others."""
    return attributes // input_channels - classes


def flat(df: DataFrame, labels: list[str], conf: float = 0.2, stride: int = 6, task: str = "detect", channels: int = 0, finish: Callable | None = None) -> DataFrame:
    """Row-major heads that have been suppressed already: x1, y1, x2, y2, score, class, and more by task.

    obb has centre and size first and the angle after the class. A partial row at the end counts where it
    still has all the attributes that every row of the task needs.
    """
    data, lb = F.col("data"), F.col("lb")
    at, names = by_row(data, stride), _names(labels)
    need = {"detect": 6, "segment": 6, "obb": 7, "pose": 7}[task]
    count = F.floor((F.size(data) - need) / stride) + 1

    def built(i: Column) -> Column:
        a, b, c, d = (at(i, k) for k in range(4))
        sides = (a - c / 2, b - d / 2, a + c / 2, b + d / 2) if task == "obb" else (a, b, c, d)
        label = g.trunc(at(i, 5)).cast("int")
        parts = [i.alias("index"), label.alias("label_index"), F.when(label >= 0, F.get(names, label)).alias("label"), at(i, 4).alias("confidence"), g.scale_box(*sides, lb).alias("box")]
        if task == "obb":
            parts.append(at(i, 6).alias("angle"))
        if task == "pose":
            parts.append(_points(lambda j, k: _value(data, i * stride + 6 + j * 3 + k), lb, (stride - 6) // 3).alias("key_points"))
        if task == "segment":
            parts.append(g.box(*sides).alias("model_box"))
            parts.append(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.coalesce(_value(data, i * stride + 6 + c), F.lit(0.0))).alias("weights"))
        return F.struct(*parts)

    every = F.when(count < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count.cast("int") - 1))
    passing = F.filter(every, lambda i: ~(at(i, 4) < conf))  # a NaN score passes
    objects = F.filter(F.transform(passing, built), lambda o: o["label"].isNotNull())
    extra = {"detect": (), "obb": ("angle",), "pose": ("key_points",), "segment": ("model_box", "weights")}[task]
    return _rows(df, objects, extra, finish)


def rtdetr(df: DataFrame, labels: list[str], predictions: int, conf: float = 0.2) -> DataFrame:
    """Row-major heads of centre and size in shares of the input, then class scores; no suppression.

    All four sides end at the last pixel of the source.
    """
    data, lb, n = F.col("data"), F.col("lb"), len(labels)
    at, names = by_row(data, 4 + n), _names(labels)

    def scored(i: Column) -> Column:
        return F.struct(i.alias("i"), best_class(lambda k: _value(data, i * (4 + n) + 4 + k), n).alias("best"))

    def built(s: Column) -> Column:
        x, y, w, h = (at(s["i"], k) for k in range(4))
        half_w, half_h = w * lb["model_w"] * 0.5 * lb["gain"], h * lb["model_h"] * 0.5 * lb["gain"]
        cx, cy = (x * lb["model_w"] - lb["x_pad"]) * lb["gain"], (y * lb["model_h"] - lb["y_pad"]) * lb["gain"]
        within_x = lambda v: lb["roi_left"] + g.clamp(g.trunc(v), F.lit(0), lb["source_w"] - 1)
        within_y = lambda v: lb["roi_top"] + g.clamp(g.trunc(v), F.lit(0), lb["source_h"] - 1)
        b = g.box(within_x(cx - half_w), within_y(cy - half_h), within_x(cx + half_w), within_y(cy + half_h))
        return F.struct(s["i"].alias("index"), s["best"]["label"].alias("label_index"), F.get(names, s["best"]["label"]).alias("label"), s["best"]["score"].alias("confidence"), b.alias("box"))

    candidates = F.filter(F.transform(F.sequence(F.lit(0), F.lit(predictions - 1)), scored), lambda s: (s["best"]["label"] >= 0) & (s["best"]["score"] >= conf))
    return _rows(df, F.transform(candidates, built))


def top_pairs(logits: Column, predictions: int, classes: int) -> Column:
    """The best pairs of prediction and class, as many as predictions: array of (score, pair) by falling score.

    Scores are sigmoids kept in single precision; of equal scores the lower pair number comes first.
    """
    scored = F.transform(F.slice(logits, 1, predictions * classes), lambda x, i: F.struct((-g.sigmoid(x)).cast("float").alias("rank"), i.alias("pair")))
    best = F.slice(F.array_sort(scored), 1, predictions)
    return F.transform(best, lambda s: F.struct((-s["rank"]).cast("double").alias("score"), s["pair"].alias("pair")))


def rfdetr(df: DataFrame, labels: list[str], predictions: int, classes: int, conf: float = 0.2, finish: Callable | None = None) -> DataFrame:
    """Boxes and class logits in two tensors (boxes, logits): the best pairs, then threshold, background, labels.

    index is the place of the box and of its mask.
    """
    lb, names = F.col("lb"), _names(labels)
    background = next((i for i, x in enumerate(labels) if x.lower().startswith(BACKGROUND)), -1)

    def built(s: Column) -> Column:
        p = F.floor(s["pair"] / classes).cast("int")
        label = (s["pair"] - p * classes).cast("int")
        cx, cy, w, h = (_value(F.col("boxes"), p * 4 + k) for k in range(4))
        b = g.scale_unit_box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, lb)
        return F.struct(p.alias("index"), label.alias("label_index"), F.get(names, label).alias("label"), s["score"].alias("confidence"), b.alias("box"))

    objects = F.transform(F.filter(top_pairs(F.col("logits"), predictions, classes), lambda s: s["score"] >= conf), built)
    return _rows(df, F.filter(objects, lambda o: (o["label_index"] != background) & o["label"].isNotNull()), finish=finish)


def classify(df: DataFrame, labels: list[str], k: int = 5) -> DataFrame:
    """The k best scores of a row as they are (no softmax): image_id, rank from 1, label (else the number), confidence."""
    names = _names(labels)
    ranked = F.array_sort(F.transform("data", lambda x, i: F.struct((-x).cast("double").alias("rank"), i.alias("i"))))
    found = df.select("image_id", F.posexplode(F.slice(ranked, 1, k)).alias("rank", "o"))
    return found.select("image_id", (F.col("rank") + 1).cast("long").alias("rank"), F.coalesce(F.get(names, F.col("o.i")), F.col("o.i").cast("string")).alias("label"), (-F.col("o.rank")).alias("confidence"))


def decoder(version: str, task: str) -> str:
    """The decoder family of a version; raises where the version does not do the task."""
    if task not in SUPPORT.get(version, ()):
        raise ValueError(f"{version} does not support {task}")
    return FAMILY[version]


def mixed(tensors: DataFrame, column: str, decoders: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Tensors of several layouts: each row goes through the decoder that column names, and the detections are put together.

    Fields that a decoder lacks are null; a row that names no decoder raises.
    """
    names = F.when(F.col(column).isin([*decoders]), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no such decoder: "), F.coalesce(column, F.lit("null")))))
    parts = [run(tensors.filter(names == name)) for name, run in decoders.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
