"""Edge cases by hand, properties, and small models end to end."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions import labels as lb
from boxwright.operators import decode, infer, nms, render
from boxwright.plans.detector import Detector, run_mixed
from boxwright.sources import images, models
from boxwright.streaming import frames
from tests.onnx_bytes import block, constant_model

NAN = float("nan")


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def boxes(*rows):
    return F.array(*(F.struct(F.lit(i).alias("index"), F.lit(float(c)).alias("confidence"), g.box(*(F.lit(float(v)) for v in b)).alias("box")) for i, c, b in rows))


def plain_lb(w=1000, h=1000, **more):
    return g.letterbox(F.lit(w), F.lit(h), 640, 640, **more)


def test_letterbox_by_hand(spark):
    r = one(spark, small=g.letterbox(F.lit(100), F.lit(50), 640, 640), wide=g.letterbox(F.lit(1280), F.lit(320), 640, 640), flat=g.letterbox(F.lit(1280), F.lit(320), 640, 640, "stretch"))
    assert (r.small.x_pad, r.small.y_pad, r.small.gain) == (270, 295, 1) and (r.wide.x_pad, r.wide.y_pad, r.wide.gain) == (0, 240, 2) and (r.flat.x_pad, r.flat.gain) == (0, 1)
    with pytest.raises(ValueError):
        g.letterbox(F.lit(1), F.lit(1), 2, 2, "crop")


def test_regions_by_hand(spark):
    roi = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"), strict=True)))
    r = one(spark, out=g.roi_rect(F.lit(10), F.lit(10), roi(-5, -5, -1, -1)), part=g.roi_rect(F.lit(100), F.lit(100), roi(10.7, 0, 20.2, 9)), lb=plain_lb(roi=roi(10.7, 0, 1, 1)))
    assert tuple(r.out) == (0, 0, 1, 1) and r.part.x == 10 and r.lb.roi_left == 10.7


def test_clamp_and_truncation(spark):
    r = one(spark, crossed=g.clamp(F.lit(5), 9, 3), none=g.clamp(F.lit(None).cast("int"), 0, 1), down=g.trunc(F.lit(-1.7)), nan=g.trunc(F.lit(NAN)), half=g.half_up(F.lit(-2.5)))
    assert (r.crossed, r.none, r.down, r.nan, r.half) == (3, None, -1, None, -2)


def test_suppression_rules(spark):
    a, b, c = (0, 0, 10, 10), (5, 0, 15, 10), (100, 100, 110, 110)  # overlap of a and b: 1/3
    every = boxes((0, 0.5, b), (1, 0.9, a), (2, 0.5, c))
    at = lambda t: [x["index"] for x in one(spark, k=nms.fold(every, t)).k]
    assert at(0) == [0, 1, 2] and at(0.3) == [1, 2] and at(1 / 3) == [1, 0, 2]
    assert [x["index"] for x in one(spark, k=nms.fold(boxes((0, 0.5, a), (1, 0.5, a)), 0.5)).k] == [0]


@pytest.mark.parametrize("seed", range(3))
def test_suppression_properties(spark, seed):
    rng = np.random.default_rng(seed)
    corner = rng.integers(0, 60, (40, 2))
    rows = [(i, float(rng.integers(0, 5)), (*map(int, corner[i]), *map(int, corner[i] + rng.integers(0, 30, 2)))) for i in range(40)]
    kept = [x["index"] for x in one(spark, k=nms.fold(boxes(*rows), 0.3)).k]
    sides = np.array([r[2] for r in rows], float)

    def iou(i, j):
        w, h = min(sides[i][2], sides[j][2]) - max(sides[i][0], sides[j][0]), min(sides[i][3], sides[j][3]) - max(sides[i][1], sides[j][1])
        area = lambda k: (sides[k][2] - sides[k][0]) * (sides[k][3] - sides[k][1])
        return w * h / (area(i) + area(j) - w * h) if w > 0 and h > 0 else 0.0

    assert kept == list(nms.survivors(np.array([r[1] for r in rows]), np.arange(40), sides, 0.3))
    assert all(iou(i, j) <= 0.3 for i in kept for j in kept if i != j)
    better = lambda i, j: (-rows[i][1], i) < (-rows[j][1], j)
    assert all(any(iou(i, j) > 0.3 and better(i, j) for i in kept) for j in range(40) if j not in kept)


def tensor(spark, *values):
    return spark.createDataFrame([(1, [None if v is None else float(v) for v in values])], "image_id long, data array<double>").withColumn("lb", plain_lb())


def test_scores_by_hand(spark):
    head = lambda *scores: [10, 10, 4, 4, *scores]  # noqa: E731  one prediction
    assert decode.v8(tensor(spark, *head(-1, 0)), ["a", "b"], 1, 0.0).count() == 0
    assert decode.v8(tensor(spark, *head(0.5, 0.5)), ["a", "b"], 1, 0.2).first().label == "a"
    assert decode.v8(tensor(spark, *head(NAN, 0.3)), ["a", "b"], 1, 0.2).first().label == "b"
    assert decode.v8(tensor(spark, *head(0.9)), ["a", "b"], 1, 0.2).count() == 1  # short data: the missing score never wins
    rows = lambda *v: [r.label for r in decode.flat(tensor(spark, *v), ["a", "b"], 0.2).orderBy("index").collect()]
    assert rows(0, 0, 9, 9, NAN, 1.9, 0, 0, 9, 9, 0.9, 2, 0, 0, 9, 9, 0.9, -1, 0, 0, 9, 9, 0.1, 0, 1, 2, 3) == ["b"]
    assert [r.label for r in decode.classify(tensor(spark, 0.1, 0.9, 0.9), ["a"], 2).orderBy("rank").collect()] == ["1", "2"]


def test_background_takes_a_place(spark):
    df = tensor(spark).withColumn("boxes", F.expr("array(0.5D, 0.5D, 0.2D, 0.2D, 0.5D, 0.5D, 0.4D, 0.4D)"))
    got = lambda *logits: [(r["index"], r.label) for r in decode.rfdetr(df.withColumn("logits", F.array(*(F.lit(float(x)) for x in logits))), ["Background_class", "a", "b"], 2, 3, 0.1).collect()]
    assert got(9, 1, 2, 8, 0, 0) == []  # both places go to background
    assert got(-9, 5, 4, -9, 0, 0) == [(0, "a"), (0, "b")]  # one box, two classes


def test_pose_counts():
    assert decode.v8_key_points(56, 3, 1) == 17 and decode.v8_key_points(58, 3, 3) == 16
    with pytest.raises(ValueError):
        decode.decoder("V10", "Segmentation")


def test_label_texts(spark):
    r = one(spark, plain=lb.parse_list(F.lit("a, b\n\nc")), js=lb.parse_list(F.lit(' ["x", " y ", ""] ')), bad=lb.parse_list(F.lit("[x, y")), gaps=lb.parse_dict(F.lit("{0: 'a', 5: \"b\", bad, 5: 'c'}")), none=lb.parse_dict(F.lit(" ")), back=lb.background_index(F.expr("array('a', 'BACKGROUND_CLASS x')")), no=lb.background_index(F.expr("array('a')")), num=lb.numbered(F.expr("array('q')")))
    assert r.plain == ["a", "b", "c"] and r.js == ["x", "y"] and r.bad == ["[x", "y"] and r.gaps == ["a", "c"] and r.none == [] and (r.back, r.no) == (1, -1) and tuple(r.num[0]) == (0, "q")
    for bad in (lb.input_size(F.array(F.lit(-1), F.lit(3))), F.size(lb.inferred(F.lit(None).cast("int")))):
        with pytest.raises(PySparkException):
            one(spark, x=bad)
    assert one(spark, x=lb.input_size(F.array().cast("array<int>"))).x == 0


def test_colours(spark):
    r = one(spark, hexa=render.parsed_colour(F.lit("#0a0B0c")), rgba=render.parsed_colour(F.lit("rgba(1, 2, 3, 0.5)")), rgb=render.parsed_colour(F.lit("rgb(4,5)")), odd=render.parsed_colour(F.lit("red")), a=render.opacity(F.lit(0.5), F.lit(7)), b=render.opacity(F.lit(None).cast("double"), F.lit(7)))
    assert tuple(r.hexa) == (10, 11, 12, 255) and tuple(r.rgba) == (1, 2, 3, 128) and tuple(r.rgb) == (4, 5, 94, 255) and tuple(r.odd) == (34, 197, 94, 128) and (r.a, r.b) == (128, 7)


def test_metadata_bytes():
    held = models.metadata(constant_model((1, 3, 4, 4), {"o": np.zeros((1, 2))}, {"task": "detect", "k": "é"}))
    assert held == {"task": "detect", "k": "é"}
    twice = block(14, block(1, "k") + block(2, "1")) + block(14, block(1, "k") + block(2, "2")) + block(14, block(2, "no key"))
    assert models.metadata(twice) == {"k": "2"} and models.metadata(None) == {}
    for bad in (b"\x80", b"\x0b", b"\x72\x80"):
        with pytest.raises(ValueError):
            models.metadata(bad)


def pictures(spark, w=8, h=6):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, w, h, 3, bytearray(rng.integers(0, 256, w * h * 3).astype(np.uint8).tobytes())) for i in range(3)], "image_id long, width int, height int, n_channels int, data binary")


def test_input_tensors(spark):
    same = infer.preprocess(pictures(spark), 8, 6).orderBy("image_id").collect()
    first = np.frombuffer(bytes(pictures(spark).orderBy("image_id").first().data), np.uint8).reshape(6, 8, 3)
    assert np.allclose(np.array(same[0].tensor).reshape(3, 6, 8), first.transpose(2, 0, 1) / 255)
    wide = np.array(infer.preprocess(pictures(spark), 16, 16, mean=infer.MEAN, std=infer.STD, pad="zero").first().tensor).reshape(3, 16, 16)
    assert wide[:, :5].any() == 0 and wide[:, 5:11, 4:12].any()
    black = np.array(infer.preprocess(pictures(spark), 16, 16, mean=infer.MEAN, std=infer.STD).first().tensor).reshape(3, 16, 16)
    assert np.allclose(black[0, 0, 0], -infer.MEAN[0] / infer.STD[0])


def test_models_end_to_end(spark):
    out = np.zeros((1, 6, 2), np.float32)
    out[0, :, 0], out[0, :, 1] = [4, 3, 4, 4, 0.1, 0.9], [4, 3, 4, 4, 0.6, 0.2]
    meta = {"task": "detect", "description": "Ultralytics YOLO11n", "names": "{0: 'cat', 1: 'dog'}"}
    d = Detector(spark, constant_model((1, 3, 8, 8), {"output0": out}, meta))
    got = d.run(pictures(spark), conf=0.3).collect()
    assert (d.version, d.task, d.labels) == ("V11", "ObjectDetection", ["cat", "dog"]) and len(got) == 3 and all((r.label, round(r.confidence, 4)) == ("dog", 0.9) for r in got)
    assert d.detect(pictures(spark), conf=0.3, iou=0).count() == 6
    with pytest.raises(ValueError):
        d.segment(pictures(spark))
    rf = {"dets": np.full((1, 2, 4), 0.5, np.float32), "labels": np.array([[[-5, 3], [-5, -5]]], np.float32), "masks": np.ones((1, 2, 4, 4), np.float32)}
    s = Detector(spark, constant_model((1, 3, 8, 8), rf, {}))
    rows = s.segment(pictures(spark), outlines=True).collect()
    assert (s.version, s.task, s.resize) == ("RFDETR", "Segmentation", "stretch") and len(rows) == 3
    assert all(r.label == "class_1" and len(r.mask) == 2 and len(r.edge_points) == 10 for r in rows)  # box 2,1..6,4 is all edge but two
    seg = {"output0": np.concatenate([out[:, :6], np.ones((1, 1, 2), np.float32)], 1), "output1": np.full((1, 1, 4, 4), 3, np.float32)}
    v8 = Detector(spark, constant_model((1, 3, 8, 8), seg, meta | {"task": "segment"}))
    assert all(set(np.unpackbits(np.frombuffer(bytes(r.mask), np.uint8))) <= {0, 1} and any(r.mask) for r in v8.segment(pictures(spark), 0.3).collect())
    cls = Detector(spark, constant_model((1, 3, 8, 8), {"o": np.array([[0.1, 0.7, 0.2]], np.float32)}, meta | {"task": "classify"}))
    assert [r.label for r in cls.classify(pictures(spark).limit(1), 3).orderBy("rank").collect()] == ["dog", "2", "cat"]
    with pytest.raises(ValueError):
        Detector(spark, constant_model((1, 3, 8, 8), {"output0": out}, {"task": "obb", "description": "Ultralytics YOLOv10"}))


def test_image_files_give_red_first(spark, tmp_path):
    """A bitmap of two pixels, red and blue."""
    pixels = bytes([0, 0, 255, 255, 0, 0, 0, 0])  # blue, green, red of each, then padding to four bytes
    head = b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, len(pixels), 2835, 2835, 0, 0)
    (tmp_path / "two.bmp").write_bytes(head + pixels)
    r = infer.preprocess(images.read_images(spark, str(tmp_path)), 2, 1).first()
    assert list(r.tensor) == [1, 0, 0, 0, 0, 1]


def test_mixed_models(spark):
    out = np.zeros((1, 6, 2), np.float32)
    out[0, :, 0] = [4, 3, 4, 4, 0.1, 0.9]
    meta = {"task": "detect", "description": "Ultralytics YOLO11n", "names": "{0: 'cat', 1: 'dog'}"}
    boxes = Detector(spark, constant_model((1, 3, 8, 8), {"output0": out}, meta))
    classes = Detector(spark, constant_model((1, 3, 8, 8), {"o": np.array([[0.1, 0.7]], np.float32)}, meta | {"task": "classify"}))
    named = pictures(spark).withColumn("model_id", F.when(F.col("image_id") == 1, "c").otherwise("b"))
    rows = run_mixed(named, {"b": boxes, "c": classes}, conf=0.3, k=1).orderBy("image_id").collect()
    assert [(r.image_id, r.model_id, r.task, r.label, r.box is None) for r in rows] == [(0, "b", "ObjectDetection", "dog", False), (1, "c", "Classification", "dog", True), (2, "b", "ObjectDetection", "dog", False)]
    with pytest.raises(PySparkException):
        run_mixed(named, {"b": boxes}).collect()


def test_label_texts(spark):
    texts = {"{0: 'a', 1: \"b\"}": ["a", "b"], "{'3': x, 1: y , bad, 2 y, : z, 4:, 5: ''}": ["y", "x", "'"], "{1: a:b, 1: 'c d'}": ["c d"], "{}": [], "": [], " {7: ' s '} ": [" s "]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lb.parse_dict(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts
    sizes = {"bold 18px serif": 18.0, "12.5px/1.2 x 3px": 12.5, "px 7px": 7.0, "bold": 14.0, "": 14.0}
    assert {r.t: r.s for r in spark.createDataFrame([(t,) for t in sizes], "t string").select("t", render.font_size(F.col("t")).alias("s")).collect()} == sizes


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x, y\nz")
    assert images.read_labels(spark, str(tmp_path)).first().labels == ["x", "y", "z"]
    assert images.read_files(spark, str(tmp_path)).first()["size"] == 6
    (tmp_path / "m").mkdir()
    (tmp_path / "m/model.onnx").write_bytes(constant_model((1, 3, 4, 4), {"o": np.zeros((1, 2))}, {"task": "pose"}))
    assert models.read_models(spark, str(tmp_path / "m")).first().metadata == {"task": "pose"}
    with pytest.raises(PySparkException):
        models.read_models(spark, str(tmp_path / "none"))


def test_frame_rate_rules(spark):
    fps = lambda *t: one(spark, f=frames.average(F.array(*(F.lit(float(x)) for x in t)))).f
    assert fps(5) is None and fps(5, 5) is None and fps(100, 200) == 10 and fps(100, 200, 150, 250) == pytest.approx(10 * 0.85 + 10 * 0.15)


def test_streams(spark, tmp_path):
    """State carried over micro-batches equals the batch form; the latest frame alone is handled."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "source string, event_id long, ts timestamp"
    rows = [("a", 1, 0), ("b", 2, 10), ("a", 3, 100), ("a", 4, 100), ("b", 5, 60), ("a", 6, 180), ("b", 7, 260), ("a", 8, 400)]
    whole = spark.createDataFrame(rows, "source string, event_id long, ms long").select("source", "event_id", F.timestamp_millis(F.col("ms") + 1000).alias("ts")).cache()
    for k in range(2):
        whole.filter(f"event_id between {k * 4 + 1} and {k * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, kept = {}, []

    def collect(batch, number):
        for r in batch.collect():
            seen[r.source] = r.fps

    q = frames.frame_rate_stream(stream(), "source", "ts", "event_id").writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.source: r.fps for r in frames.frame_rate(whole, "source", "ts", "event_id").collect()}
    assert seen == pytest.approx(want)
    q = frames.camera(stream(), "source", ["ts", "event_id"], lambda df, n: kept.extend((n, r.source, r.event_id) for r in df.collect()), str(tmp_path / "c2"), available_now=True)
    q.awaitTermination()
    assert kept and {(s, e) for _, s, e in kept} >= {("a", 8), ("b", 7)} and len(kept) == len({(n, s) for n, s, _ in kept})
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_thresholds(spark):
    at = lambda x: one(spark, t=frames.threshold(F.lit(x), 0.7)).t
    assert [at(x) for x in ("0.25", "", "x", "7", "-1", "Infinity", "NaN")] == [0.25, 0, 0.7, 1, 0, 0.7, 0.7]
