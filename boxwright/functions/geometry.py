"""Scalar geometry as column expressions: letterboxes, rescaling, overlap and rotated corners.

A letterbox is a struct of source_w, source_h, x_pad, y_pad, gain, resize_mode, model_w, model_h, roi_left and
roi_top; it travels with every tensor, so rescaling is a projection. Boxes are structs of left, top, right and
bottom. Nulls and NaN coordinates give null results instead of a clamped bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    """value within low..high; high wins where the bounds cross."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def trunc(value: Column) -> Column:
    """Towards zero, as a long; null for NaN and what a long cannot hold."""
    return value.try_cast("long")


def half_up(value: Column) -> Column:
    """To the nearest integer, halves upwards."""
    return F.floor(value + 0.5)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value.cast("double")))


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))


def roi_rect(width: Column, height: Column, roi: Column) -> Column:
    """The source rectangle (x, y, width, height) that a region of interest cuts out; the whole without one."""
    left, top = clamp(trunc(roi["left"]), 0, width - 1), clamp(trunc(roi["top"]), 0, height - 1)
    right, bottom = clamp(trunc(roi["right"]), left + 1, width), clamp(trunc(roi["bottom"]), top + 1, height)
    some = roi.isNotNull()
    parts = ((left, F.lit(0), "x"), (top, F.lit(0), "y"), (right - left, width, "width"), (bottom - top, height, "height"))
    return F.struct(*(F.when(some, a).otherwise(b).cast("long").alias(n) for a, b, n in parts))


def letterbox(width: Column, height: Column, model_w: int, model_h: int, mode: str = "proportional", roi: Column | None = None) -> Column:
    """How a source of width x height lies in the model's input. Sources smaller on both sides are not enlarged."""
    if mode not in ("proportional", "stretch"):
        raise ValueError(f"unknown resize mode: {mode}")
    w, h, mw, mh = width.cast("double"), height.cast("double"), F.lit(float(model_w)), F.lit(float(model_h))
    if mode == "stretch":
        x_pad, y_pad, gain, draw_w, draw_h = F.lit(0.0), F.lit(0.0), F.lit(1.0), mw, mh
    else:
        small = (w < mw) & (h < mh)
        ratio = F.when(small, 1.0).otherwise(F.least(mw / w, mh / h))
        draw_w, draw_h = w * ratio, h * ratio
        x_pad, y_pad = (mw - draw_w) * 0.5, (mh - draw_h) * 0.5
        gain = F.when(small, 1.0).otherwise(F.greatest(w / mw, h / mh))
    offset = [F.coalesce(roi[k].cast("double"), F.lit(0.0)) if roi is not None else F.lit(0.0) for k in ("left", "top")]
    return F.struct(
        width.cast("long").alias("source_w"), height.cast("long").alias("source_h"), x_pad.alias("x_pad"), y_pad.alias("y_pad"), gain.alias("gain"), draw_w.alias("draw_w"), draw_h.alias("draw_h"),
        F.lit(mode).alias("resize_mode"), F.lit(model_w).alias("model_w"), F.lit(model_h).alias("model_h"), offset[0].alias("roi_left"), offset[1].alias("roi_top"),
    )


def scale_x(x: Column, lb: Column, edge: int = 1) -> Column:
    """A model abscissa in source pixels, up to source_w - edge; the region's own offset is added after clamping."""
    return lb["roi_left"] + clamp(trunc((x - lb["x_pad"]) * lb["gain"]), F.lit(0), lb["source_w"] - edge)


def scale_y(y: Column, lb: Column, edge: int = 1) -> Column:
    return lb["roi_top"] + clamp(trunc((y - lb["y_pad"]) * lb["gain"]), F.lit(0), lb["source_h"] - edge)


def scale_box(x1: Column, y1: Column, x2: Column, y2: Column, lb: Column, far_edge: int = 0) -> Column:
    """A model box in source pixels. far_edge: how far right and bottom stay from the source's size."""
    return box(scale_x(x1, lb), scale_y(y1, lb), scale_x(x2, lb, far_edge), scale_y(y2, lb, far_edge))


def scale_unit_box(x1: Column, y1: Column, x2: Column, y2: Column, lb: Column) -> Column:
    """A box in shares of the model's input (or, stretched, of the source) in source pixels."""
    w, h = lb["source_w"], lb["source_h"]
    direct = box(
        lb["roi_left"] + clamp(trunc(x1 * w), F.lit(0), w - 1), lb["roi_top"] + clamp(trunc(y1 * h), F.lit(0), h - 1),
        lb["roi_left"] + clamp(trunc(x2 * w), F.lit(0), w), lb["roi_top"] + clamp(trunc(y2 * h), F.lit(0), h),
    )
    return F.when(lb["resize_mode"] == "stretch", direct).otherwise(scale_box(x1 * lb["model_w"], y1 * lb["model_h"], x2 * lb["model_w"], y2 * lb["model_h"], lb))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without a positive overlap."""
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    area = lambda r: (r["right"] - r["left"]) * (r["bottom"] - r["top"])
    return F.when((w > 0) & (h > 0), w * h / (area(a) + area(b) - w * h)).otherwise(0.0)


def drawable(b: Column) -> Column:
    return (b["right"] > b["left"]) & (b["bottom"] > b["top"])


def corners(b: Column, radians: Column) -> Column:
    """The four corners of a box turned about its centre, from the upper left clockwise: array of (x, y)."""
    cx, cy, c, s = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2, F.cos(radians), F.sin(radians)

    def turned(x: str, y: str) -> Column:
        dx, dy = b[x] - cx, b[y] - cy
        return F.struct((cx + dx * c - dy * s).alias("x"), (cy + dx * s + dy * c).alias("y"))

    return F.array(turned("left", "top"), turned("right", "top"), turned("right", "bottom"), turned("left", "bottom"))


def mask_crop(b: Column, mask_w: int, mask_h: int, model_w: int, model_h: int) -> Column:
    """A model box in mask cells: outwards to whole cells, all four sides at most the last cell."""
    x, y = mask_w / model_w, mask_h / model_h
    return box(clamp(F.floor(b["left"] * x), 0, mask_w - 1), clamp(F.floor(b["top"] * y), 0, mask_h - 1), clamp(F.ceil(b["right"] * x), 0, mask_w - 1), clamp(F.ceil(b["bottom"] * y), 0, mask_h - 1))
