"""Greedy non-maximum suppression: in the row of an image, or by group.

Boxes go by falling confidence, equal ones by index; a box stays unless its overlap with one that stayed
exceeds the threshold. Class does not matter. A threshold of 0 or less leaves everything as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import iou


def fold(objects: Column, threshold: float) -> Column:
    """The survivors of an array of structs with confidence, index and box: no shuffle, one pass over the array."""
    if threshold <= 0:
        return objects
    ranked = F.array_sort(F.transform(objects, lambda o: F.struct((-o["confidence"]).alias("rank"), o["index"].alias("index"), o.alias("o"))))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: iou(k["o"]["box"], x["o"]["box"]) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    return F.transform(F.aggregate(ranked, F.slice(ranked, 1, 0), step), lambda x: x["o"])


def suppress(boxes: DataFrame, group: str, threshold: float) -> DataFrame:
    """Rows (group, index, confidence, box, ...) that survive within their group: one shuffle on the group."""
    if threshold <= 0:
        return boxes
    rest = [c for c in boxes.columns if c != group]
    kept = boxes.groupBy(group).agg(F.collect_list(F.struct(*rest)).alias("all")).select(group, F.explode(fold(F.col("all"), threshold)).alias("o"))
    return kept.select(group, *(F.col(f"o.{c}").alias(c) for c in rest)).select(*boxes.columns)


def survivors(confidence: np.ndarray, index: np.ndarray, boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Positions that stay, best first; boxes: left, top, right, bottom."""
    order = np.lexsort((index, -confidence))
    left, top, right, bottom = boxes[order].T
    area = (right - left) * (bottom - top)
    alive, kept = np.ones(len(order), bool), []
    for k in range(len(order)):
        if not alive[k]:
            continue
        kept.append(order[k])
        w = np.minimum(right[k], right[k + 1 :]) - np.maximum(left[k], left[k + 1 :])
        h = np.minimum(bottom[k], bottom[k + 1 :]) - np.maximum(top[k], top[k + 1 :])
        both = np.where((w > 0) & (h > 0), w * h, 0.0)
        union = area[k] + area[k + 1 :] - both
        alive[k + 1 :] &= ~((both > 0) & (both > threshold * union) & (both / np.where(union == 0, 1, union) > threshold))
    return np.array(kept, np.int64)


def suppress_wide(boxes: DataFrame, group: str, threshold: float) -> DataFrame:
    """As suppress, for groups of many thousand boxes: each is vectorised over the boxes that follow."""
    if threshold <= 0:
        return boxes

    def run(table: pa.Table) -> pa.Table:
        box = table.column("box").combine_chunks()
        sides = np.stack([box.field(s).to_numpy(zero_copy_only=False) for s in ("left", "top", "right", "bottom")], 1)
        return table.take(survivors(table.column("confidence").to_numpy(), table.column("index").to_numpy(), sides, threshold))

    return boxes.groupBy(group).applyInArrow(run, boxes.schema)
