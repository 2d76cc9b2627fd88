"""Every query that has SQL against DuckDB on the driver's tables; the others against a scalar model in plain Python."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boxwright.functions import masks
from boxwright.functions import labels
from boxwright.operators import render, segmentation
from boxwright.plans import detect, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in result.fetchall()]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


#: Halfway between two decimals of six digits, where the next even one is written, or next to it.
HALVES = [k / 128 + off for k in range(-39, 40) for off in (0, 2**-30, -(2**-30))]


def halves(tmp_path, name):
    """Rows of a query, and of its SQL, over embeddings of such values."""
    rng = np.random.default_rng(8)
    values = pa.array([rng.choice(HALVES, 64).tolist() for _ in range(200)], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(200), pa.int64()), "embedding": values}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    return con.execute(f"SELECT image_id, report FROM ({registry.ORACLE_SQL[name]}) ORDER BY image_id").fetchall()


def test_class_report_of_halves(spark, tmp_path):
    want = halves(tmp_path, "class_report")
    assert [tuple(r) for r in registry.QUERIES["class_report"](spark, str(tmp_path)).select("image_id", "report").orderBy("image_id").collect()] == want


@pytest.mark.parametrize("name", ["oriented_report", "detection_report"])
def test_detection_reports_of_halves(spark, tmp_path, name):
    want = halves(tmp_path, name)
    assert [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select("image_id", "report").orderBy("image_id").collect()] == want


def test_decimals_as_printf_writes_them(spark):
    values = [*HALVES, *(3 * v for v in HALVES), 0.0, -0.0, -1e-9, 5e-324, 0.25, 0.35, 0.9999995, 0.9999994999, 9.95, 99.95, 0.5, 1.5, -2.5, 1e9 + 0.5, 2.0**51 + 0.5, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 6):
        got = [r.t for r in df.select(render.fixed(df.v, digits).alias("t")).collect()]
        assert got == [f"%.{digits}f" % v for v in values]
    assert spark.range(1).select(render.fixed(F.lit(None), 6).alias("t")).first().t == "null"


def golden_mask(proto, weights, crop, width, height, least):
    """One pixel at a time."""
    if width <= 0 or height <= 0:
        return []
    f32 = np.float32
    _, rows, cols = proto.shape
    clip = lambda v, lo, hi: min(max(v, lo), hi)
    left, top = clip(math.trunc(crop[0]), 0, cols - 1), clip(math.trunc(crop[1]), 0, rows - 1)
    right, bottom = clip(math.trunc(crop[2]), left + 1, cols), clip(math.trunc(crop[3]), top + 1, rows)
    if not any(weights):
        return [False] * (width * height)
    cell = [[float(f32(1 / (1 + math.exp(-sum(float(proto[c, top + y, left + x]) * float(w) for c, w in enumerate(weights) if w))))) for x in range(right - left)] for y in range(bottom - top)]
    h, w = bottom - top, right - left
    if (w, h) == (width, height):
        return [v > least for row in cell for v in row]
    out = []
    for ty in range(height):
        sy = (ty + 0.5) * (h / height) - 0.5
        y0 = clip(math.floor(sy), 0, h - 1)
        y1 = min(y0 + 1, h - 1)
        for tx in range(width):
            sx = (tx + 0.5) * (w / width) - 0.5
            x0 = clip(math.floor(sx), 0, w - 1)
            x1 = min(x0 + 1, w - 1)
            wx = float(f32(sx - x0))
            a = cell[y0][x0] + (cell[y0][x1] - cell[y0][x0]) * wx
            b = cell[y1][x0] + (cell[y1][x1] - cell[y1][x0]) * wx
            out.append(a + (b - a) * (sy - y0) > least)
    return out


def test_prototype_masks_equal_the_golden_model():
    rng = np.random.default_rng(3)
    for _ in range(60):
        shape = tuple(int(x) for x in rng.integers(1, 7, 3))
        proto = rng.normal(0, 2, shape).astype(np.float32)
        weights = (rng.normal(0, 2, shape[0]) * rng.integers(0, 2, shape[0])).astype(np.float32)
        crop = tuple(float(x) for x in rng.integers(0, 6, 4))
        w, h = (int(x) for x in rng.integers(0, 14, 2))
        want = golden_mask(proto, weights, crop, w, h, 0.4)
        got = masks.from_prototypes(proto, weights, crop, w, h, 0.4)
        assert got == np.packbits(np.array(want, bool), bitorder="little").tobytes()
    zero = masks.from_prototypes(np.ones((1, 2, 2), np.float32), np.zeros(1, np.float32), (0, 0, 2, 2), 3, 3, 0.4)
    assert zero == bytes(2)  # without weights no pixel is set, though one half exceeds 0.4


def golden_logits(cells, box, source, model, mode):
    clip = lambda v, lo, hi: min(max(v, lo), hi)
    near = lambda v: math.floor(v + 0.5)
    rows, cols = cells.shape
    left, top, right, bottom = 0, 0, cols, rows
    if mode != "stretch":
        scale = min(model[0] / source[0], model[1] / source[1])
        w, h = math.trunc(source[0] * scale), math.trunc(source[1] * scale)
        px, py = (model[0] - w) / 2, (model[1] - h) / 2
        left, top = clip(near(px * cols / model[0]), 0, cols - 1), clip(near(py * rows / model[1]), 0, rows - 1)
        right, bottom = clip(near((px + w) * cols / model[0]), left + 1, cols), clip(near((py + h) * rows / model[1]), top + 1, rows)
    w, h = right - left, bottom - top
    out = []
    for y in range(int(box[1]), int(box[3])):
        sy = (y + 0.5) * (h / source[1]) - 0.5
        y0 = clip(math.floor(sy), 0, h - 1)
        y1 = min(y0 + 1, h - 1)
        for x in range(int(box[0]), int(box[2])):
            sx = (x + 0.5) * (w / source[0]) - 0.5
            x0 = clip(math.floor(sx), 0, w - 1)
            x1 = min(x0 + 1, w - 1)
            at = lambda j, i: float(cells[top + j, left + i])
            a = at(y0, x0) + (at(y0, x1) - at(y0, x0)) * (sx - x0)
            b = at(y1, x0) + (at(y1, x1) - at(y1, x0)) * (sx - x0)
            out.append(a + (b - a) * (sy - y0) > 0)
    return out


@pytest.mark.parametrize("mode", ["stretch", "proportional"])
def test_logit_masks_equal_the_golden_model(mode):
    rng = np.random.default_rng(4)
    for _ in range(40):
        cells = rng.normal(0, 1, tuple(rng.integers(1, 8, 2))).astype(np.float32)
        source, model = tuple(int(x) for x in rng.integers(5, 30, 2)), (16, 12)
        x, y = int(rng.integers(0, source[0])), int(rng.integers(0, source[1]))
        box = (x, y, int(rng.integers(x, source[0] + 1)), int(rng.integers(y, source[1] + 1)))
        want = golden_logits(cells, box, source, model, mode)
        assert masks.from_logits(cells, box, source, model, mode) == np.packbits(np.array(want, bool), bitorder="little").tobytes()


def test_segment_queries(spark):
    """Masks have the size of their boxes; contours are all edge pixels, once each."""
    rows = detect._segments(spark, SF).limit(60).collect()
    assert rows
    for r in rows:
        w, h = int(r.box.right - r.box.left), int(r.box.bottom - r.box.top)
        assert len(r.mask) == (-(-w * h // 8) if w > 0 and h > 0 else 0)
    for name in ("v26_segment", "rfdetr_segment", "image_tensor"):
        assert detect.QUERIES[name](spark, SF).count() > 0
    by = {}
    for r in detect.contour_trace(spark, SF).filter("image_id < 40").collect():
        by.setdefault((r.image_id, r.rank), []).append((r.step, r.x, r.y))
    seg = {(r.image_id, r["rank"]): r for r in detect._segments(spark, SF).filter("image_id < 40").collect()}
    for key, steps in by.items():
        b, m = seg[key].box, seg[key].mask
        w, h = int(b.right - b.left), int(b.bottom - b.top)
        bits = masks.unpacked(bytes(m), w, h)
        edges = {(b.left + x, b.top + y) for y in range(h) for x in range(w) if bits[y, x] and (x in (0, w - 1) or y in (0, h - 1) or not (bits[y, x - 1] and bits[y, x + 1] and bits[y - 1, x] and bits[y + 1, x]))}
        assert sorted(s for s, _, _ in steps) == list(range(len(edges))) and {(x, y) for _, x, y in steps} == edges
    set_pixels = lambda r: int(masks.unpacked(bytes(r.mask), int(r.box.right - r.box.left), int(r.box.bottom - r.box.top)).sum()) if r.mask else 0
    drawn = detect.mask_pixels(spark, SF).filter("image_id < 40").groupBy("image_id", "rank").count().collect()
    assert {(r.image_id, r["rank"]): r["count"] for r in drawn} == {k: n for k, r in seg.items() if (n := set_pixels(r))}
    layers = render.segment_layers(segmentation.edge_points(detect._segments(spark, SF).filter("image_id < 10")))
    counts = {(r.image_id, r["rank"], r.kind): r["count"] for r in layers.groupBy("image_id", "rank", "kind").count().collect()}
    for key, r in seg.items():
        if key[0] < 10:
            assert counts.get((*key, "mask"), 0) == set_pixels(r) and counts.get((*key, "contour"), 0) == len(by.get(key, []))
            assert counts.get((*key, "box"), 0) == (r.box.right > r.box.left and r.box.bottom > r.box.top)


def test_segment_queries_use_many_tasks(spark):
    """A table of one small file gives many pixels, which are not left to one task."""
    for name in ("mask_pixels", "v8_segment", "v26_segment", "rfdetr_segment"):
        assert detect.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 8


def test_mask_pixels_by_hand(spark):
    """Masks of under one byte to several words, with set bits beyond the box, which are no pixels."""
    rng = np.random.default_rng(6)
    sizes = [(1, 1), (3, 2), (8, 8), (13, 5), (64, 1), (5, 26), (40, 33)]
    rows = [(i, 0, i, (float(i), 7.0, float(i + w), 7.0 + h), bytearray(rng.integers(0, 256, -(-w * h // 8)).astype(np.uint8).tobytes())) for i, (w, h) in enumerate(sizes)]
    rows += [(90, 0, 0, (0.0, 0.0, 9.0, 9.0), bytearray(11)), (91, 0, 0, (0.0, 0.0, 0.0, 9.0), bytearray(b"\xff")), (92, 0, 0, (0.0, 0.0, 9.0, 9.0), bytearray())]
    df = spark.createDataFrame(rows, "image_id long, rank long, label_index long, box struct<left: double, top: double, right: double, bottom: double>, mask binary")
    got = [tuple(r) for r in render.mask_pixels(df).select("image_id", "x", "y", "r", "a").collect()]
    want = [(i, float(i + x), 7.0 + y, int(render.COLOURS[i % 8][1:3], 16), 64) for i, (w, h) in enumerate(sizes) for y in range(h) for x in range(w) if rows[i][4][(y * w + x) // 8] >> (y * w + x) % 8 & 1]
    assert sorted(got) == sorted(want) and len(got) > 100


class Step:
    """In place of DataFrame.mapInArrow: keeps the step's function."""

    def __init__(self, spark, monkeypatch):
        monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, run, schema: setattr(self, "run", run) or df)

    def sizes(self, df):
        """Rows, and bytes of each batch that the step makes of all of df in one batch."""
        batches = list(self.run(iter(df.toArrow().combine_chunks().to_batches())))
        return pa.Table.from_batches(batches).to_pylist(), [b.get_total_buffer_size() for b in batches]


def test_masks_leave_in_small_batches(spark, monkeypatch):
    """400 images with a mask of 125 KB each in one batch: never all of them at once."""
    box = "named_struct('left', 0D, 'top', 0D, 'right', 1000D, 'bottom', 1000D)"
    df = spark.range(400).selectExpr("id AS image_id", "named_struct('source_w', 1000) AS lb", "array(float(id % 2 * 9 - 4)) AS proto", f"IF(id % 100 = 7, NULL, array(named_struct('index', id, 'box', {box}, 'model_box', {box}, 'weights', array(1D)))) AS objects")
    step = Step(spark, monkeypatch)
    made = segmentation.in_prototypes("proto", (1, 1, 1), (1000, 1000), 0.5)
    made(df)
    rows, sizes = step.sizes(df.withColumn("objects", F.transform("objects", lambda o: o.withField("__crop", o["box"]))))
    assert [r["image_id"] for r in rows] == list(range(400))
    assert all(r["objects"] == [] if r["image_id"] % 100 == 7 else [(o["index"], set(o["mask"]), len(o["mask"])) for o in r["objects"]] == [(r["image_id"], {255 * (r["image_id"] % 2)}, 125000)] for r in rows)
    assert max(sizes) < 2 * segmentation.BYTES < 400 * 125000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= segmentation.BYTES


def test_contours_leave_in_small_batches(spark, monkeypatch):
    """300 masks with 4,000 separate points each in one batch."""
    box = "named_struct('left', 5D, 'top', 6D, 'right', 165D, 'bottom', 106D)"
    df = spark.range(300).selectExpr("id AS image_id", f"{box} AS box", "IF(id % 100 = 7, NULL, unhex(repeat(repeat('55', 20) || repeat('00', 20), 50))) AS mask")
    step = Step(spark, monkeypatch)
    segmentation.edge_points(df)
    rows, sizes = step.sizes(df)
    points = [(5.0 + x, 6.0 + y) for y in range(0, 100, 2) for x in range(0, 160, 2)]
    assert [r["image_id"] for r in rows] == list(range(300))
    assert all([(p["x"], p["y"]) for p in r["edge_points"]] == ([] if r["image_id"] % 100 == 7 else points) for r in rows)
    assert len(points) == 4000 and max(sizes) < 2 * segmentation.BYTES < 300 * 4000 * 16


def test_contours_by_hand():
    full = np.ones((3, 3), bool)
    edges = masks.edge_pixels(full)
    assert len(edges) == 8 and 4 not in edges
    assert masks.contour(edges, 3) == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    assert masks.contour(np.array([8, 0]), 5, 10, 20) == [(10, 20), (13, 21)]
    nine = np.zeros(9, bool)
    nine[8] = True
    assert masks.packed(nine) == b"\x00\x01" and masks.unpacked(b"\x00\x01", 3, 3)[2, 2]


def test_fixed_values():
    """What the SQL of some queries takes from the library, written out."""
    assert render.COLOURS == ["#22c55e", "#3b82f6", "#f97316", "#e11d48", "#8b5cf6", "#14b8a6", "#f59e0b", "#06b6d4"]
    assert render.SKELETON == [(5, 7), (7, 9), (6, 8), (8, 10), (5, 6), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16), (0, 1), (0, 2), (1, 3), (2, 4)]
    assert [v for _, v in labels.PREFIXES] == ["V5U", "V8", "V8E", "V9", "V10", "V11", "V11E", "V12", "V26"]
    assert [p.removeprefix("ultralytics ") for p, _ in labels.PREFIXES] == ["yolov5", "yolov8", "yoloe-v8", "yolov9", "yolov10", "yolo11", "yoloe-11", "yolov12", "yolo26"]
    every = {"Classification", "ObjectDetection", "ObbDetection", "Segmentation", "PoseEstimation"}
    assert {v for v, t in labels.SUPPORT.items() if set(t) == every} == {"V8", "V11", "V12", "V26"}
    assert {v for v, t in labels.SUPPORT.items() if t == ["ObjectDetection"]} == {"V5U", "V9", "V10", "RTDETR", "WORLDV2"}
    assert {v for v, t in labels.SUPPORT.items() if t == ["Segmentation"]} == {"V8E", "V11E"} and labels.SUPPORT["RFDETR"] == ["ObjectDetection", "Segmentation"] and len(labels.SUPPORT) == 12
