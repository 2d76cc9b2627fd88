"""Frame streams: the latest frame of each source, the moving frame rate, debounced requests.

Each has a batch form over a table and, where state is needed, a streaming form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions.geometry import clamp

OLD, NEW = 0.85, 0.15


def latest(frames: DataFrame, source: str, order: list[str]) -> DataFrame:
    """The last frame of each source: one row each, with a partial aggregate before the shuffle."""
    rest = [c for c in frames.columns if c != source]
    return frames.groupBy(source).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("f")).select(source, *(F.col(f"f.{c}").alias(c) for c in rest)).select(*frames.columns)


def camera(frames: DataFrame, source: str, order: list[str], handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """A running query that gives handle the latest frame of each source in every micro-batch; others are dropped."""
    writer = frames.writeStream.foreachBatch(lambda batch, number: handle(latest(batch, source, order), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _millis(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1000.0


def average(millis: Column) -> Column:
    """The moving frame rate after all of an ordered array of times in milliseconds, null without any rate.

    The first time arms it, a time that is not later is ignored as a rate but replaces the last; 0 counts
    as unset, for times and for the average.
    """
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("fps"), F.lit(False).alias("some"))

    def step(a: Column, t: Column) -> Column:
        delta = t - a["last"]
        rate = F.when(delta > 0, F.lit(1000.0) / delta)
        fps = F.when(rate.isNull() | (a["last"] == 0), a["fps"]).when(a["fps"] == 0, rate).otherwise(a["fps"] * OLD + rate * NEW)
        return F.struct(t.alias("last"), fps.alias("fps"), (a["some"] | (rate.isNotNull() & (a["last"] != 0))).alias("some"))

    return F.aggregate(millis, start, step, lambda a: F.when(a["some"], a["fps"]))


def frame_rate(frames: DataFrame, source: str, time: str, tie: str) -> DataFrame:
    """source, fps of a table of frames."""
    millis = _millis(F.col(time)).alias("t")
    return frames.groupBy(source).agg(F.array_sort(F.collect_list(F.struct(millis, F.col(tie).alias("tie")))).alias("all")).select(source, average(F.transform("all", lambda x: x["t"])).alias("fps"))


def frame_rate_stream(frames: DataFrame, source: str, time: str, tie: str) -> DataFrame:
    """source, fps of a stream, a row for each source whenever its frames arrive (update mode).

    State is one time and one average for each source; frames within a micro-batch go by time.
    """
    kind = dict(frames.dtypes)[source]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, fps = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["t", "tie"])
        for t in rows["t"]:
            if last != 0:
                delta = t - last
                if delta > 0:
                    fps = 1000.0 / delta if fps == 0 else fps * OLD + 1000.0 / delta * NEW
            last = t
        state.update((float(last), float(fps)))
        yield pd.DataFrame({source: [key[0]], "fps": [fps if fps != 0 else None]})

    timed = frames.select(source, _millis(F.col(time)).alias("t"), F.col(tie).alias("tie"))
    return timed.groupBy(source).applyInPandasWithState(run, f"{source} {kind}, fps double", "last double, fps double", "update", "NoTimeout")


def debounced(requests: DataFrame, source: str, time: str, tie: str, gap_ms: int = 150) -> DataFrame:
    """The last request of each run: those that no other follows within gap_ms."""
    w = Window.partitionBy(source).orderBy(time, tie)
    follows = _millis(F.lead(time).over(w)) - _millis(F.col(time))
    return requests.withColumn("__next", follows).filter(F.col("__next").isNull() | (F.col("__next") >= gap_ms)).drop("__next")


def newest_result(results: DataFrame, source: str, token: str) -> DataFrame:
    """The result with the highest token of each source; stale ones go."""
    return latest(results, source, [token])


def threshold(text: Column, default: float) -> Column:
    """A number in 0..1 from a text; default where it is no finite number. A blank text is 0."""
    value = F.when(F.trim(text) == "", 0.0).otherwise(F.trim(text).try_cast("double"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, clamp(value, 0.0, 1.0)).otherwise(default)
