"""Queries of the decoders. Tensors are made of the rows of embeddings, 64 values each, brought to pixels or scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.operators import decode, infer, render, segmentation

MODEL = 640
NAMES = ["person", "car", "dog", "boat", "tree", "sign"]
LOGIT_NAMES = ["background_class", *NAMES]
CLASS_NAMES = [f"class_{k}" for k in range(40)]
BOX = ("left", "top", "right", "bottom")
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def flat_box(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "box"]
    return df.select(*kept, *(F.col(f"box.{s}").alias(f"box_{s}") for s in BOX))


def tensors(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    """image_id, data and lb; value(v, i): the tensor's value i from embedding value v."""
    return as_tensors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), value)


def as_tensors(e: DataFrame, value) -> DataFrame:
    lb = g.letterbox(300 + F.col("vec_id") % 7 * 120, 200 + F.col("vec_id") % 5 * 160, MODEL, MODEL)
    return e.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v, i: value(v.cast("double"), i)).alias("data"), lb.alias("lb"))


def beside(t: DataFrame, other: DataFrame) -> DataFrame:
    """t joined with other on image_id, dealt by it: few bytes of tensors become many of masks and pixels, so tasks are not to be merged by size."""
    spark = t.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return t.repartition(n, "image_id").join(other.repartition(n, "image_id"), "image_id")


def v8_value(v, i):
    return F.when(i < 16, (v + 0.6) * 600).when(i < 32, (v + 0.6) * 150).otherwise(v)


def v10_value(v, i):
    return F.when(i % 6 < 4, (v + 0.6) * 500).when(i % 6 == 4, v).otherwise((v + 0.6) * 8)


def rtdetr_value(v, i):
    return F.when(i % 8 < 2, v + 0.6).when(i % 8 < 4, (v + 0.6) * 0.4).otherwise(v)


# ---------------------------------------------------------------- the same in SQL

LB = f"""t AS (SELECT vec_id AS image_id, embedding AS d, CAST(300 + vec_id % 7 * 120 AS DOUBLE) AS sw, CAST(200 + vec_id % 5 * 160 AS DOUBLE) AS sh FROM embeddings),
r AS (SELECT *, CASE WHEN sw < {MODEL} AND sh < {MODEL} THEN 1e0 ELSE least({MODEL}e0 / sw, {MODEL}e0 / sh) END AS ratio FROM t),
lb AS (SELECT image_id, d, sw, sh, ({MODEL}e0 - sw * ratio) * 0.5e0 AS xp, ({MODEL}e0 - sh * ratio) * 0.5e0 AS yp, CASE WHEN sw < {MODEL} AND sh < {MODEL} THEN 1e0 ELSE greatest(sw / {MODEL}e0, sh / {MODEL}e0) END AS gain FROM r)"""


def scaled(x1: str, y1: str, x2: str, y2: str) -> str:
    one = lambda v, pad, size, less: f"least(greatest(trunc(({v} - {pad}) * gain) + 0e0, 0e0), {size} - {less})"
    return f"{one(x1, 'xp', 'sw', 1)} AS box_left, {one(y1, 'yp', 'sh', 1)} AS box_top, {one(x2, 'xp', 'sw', 0)} AS box_right, {one(y2, 'yp', 'sh', 0)} AS box_bottom"


def name_of(index: str, names: list[str]) -> str:
    return f"list_extract({names!r}, CAST({index} AS BIGINT) + 1)"


def v8_candidates(classes: int, conf: float, more: str = "") -> str:
    at = lambda a: f"CAST(d[{a} * 8 + i + 1] AS DOUBLE)"
    best = f"greatest({', '.join(at(4 + k) for k in range(classes))})"
    label = " ".join(f"WHEN {at(4 + k)} = best THEN {k}" for k in range(classes))
    return f"""{LB},
p AS (SELECT lb.*, i, {best} AS best, ({at(0)} + 0.6e0) * 600 AS x, ({at(1)} + 0.6e0) * 600 AS y, ({at(2)} + 0.6e0) * 150 AS w, ({at(3)} + 0.6e0) * 150 AS h FROM lb, range(8) s(i)),
cand AS (SELECT image_id, i AS index, CAST(CASE {label} END AS BIGINT) AS label_index, best AS confidence, {scaled('x - w / 2', 'y - h / 2', 'x + w / 2', 'y + h / 2')}{more} FROM p WHERE best > 0 AND best >= {conf}e0)"""


def overlap(a: str, b: str) -> str:
    """SQL: intersection over union of box_* of a and b."""
    w = f"(least({a}.box_right, {b}.box_right) - greatest({a}.box_left, {b}.box_left))"
    h = f"(least({a}.box_bottom, {b}.box_bottom) - greatest({a}.box_top, {b}.box_top))"
    area = lambda r: f"({r}.box_right - {r}.box_left) * ({r}.box_bottom - {r}.box_top)"
    return f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / ({area(a)} + {area(b)} - {w} * {h}) ELSE 0e0 END"


def suppressed(candidates: str, threshold: float, group: str = "image_id") -> str:
    """SQL: CTEs that end in kept, the rows of cand that survive, with rank."""
    kind = "STRUCT(box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE)[]"
    return f"""WITH RECURSIVE {candidates},
o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY confidence DESC, index) AS k FROM cand),
walk AS (SELECT DISTINCT {group} AS grp, CAST(0 AS BIGINT) AS k, CAST([] AS {kind}) AS boxes, false AS stays FROM o
  UNION ALL
  SELECT grp, k, CASE WHEN hit THEN boxes ELSE list_append(boxes, own) END, NOT hit FROM (
    SELECT walk.grp, o.k, walk.boxes, {{'box_left': o.box_left, 'box_top': o.box_top, 'box_right': o.box_right, 'box_bottom': o.box_bottom}} AS own,
      len(list_filter(walk.boxes, lambda q: {overlap('q', 'o')} > {threshold}e0)) > 0 AS hit
    FROM walk JOIN o ON o.{group} = walk.grp AND o.k = walk.k + 1)),
kept AS (SELECT o.*, row_number() OVER (PARTITION BY o.{group} ORDER BY o.k) - 1 AS rank FROM o JOIN walk ON o.{group} = walk.grp AND o.k = walk.k WHERE stays)"""


DETECTION = "image_id, rank, index, label_index, {label} AS label, confidence, box_left, box_top, box_right, box_bottom"
V8_NAMED = DETECTION.format(label=name_of("label_index", NAMES[:4]))
V8_NMS = f"{suppressed(v8_candidates(4, 0.05), 0.45)} SELECT {V8_NAMED} FROM kept"


@query(V8_NMS)
def v8_detect_nms(spark, sf_dir):
    return flat_box(decode.v8(tensors(spark, sf_dir, v8_value), NAMES[:4], 8, 0.05, 0.45))


@query(f"WITH {v8_candidates(4, 0.05)} SELECT {V8_NAMED} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY index) - 1 AS rank FROM cand)")
def v8_detect(spark, sf_dir):
    return flat_box(decode.v8(tensors(spark, sf_dir, v8_value), NAMES[:4], 8, 0.05, 0.0))


@query(f"WITH {v8_candidates(4, 0.0)} SELECT image_id, index, label_index, confidence FROM cand")
def v8_argmax(spark, sf_dir):
    return decode.v8(tensors(spark, sf_dir, v8_value), NAMES[:4], 8, 0.0, 0.0).select("image_id", "index", "label_index", "confidence")


OBB_SQL = v8_candidates(3, 0.05, ", CAST(d[7 * 8 + i + 1] AS DOUBLE) * 3 AS angle")


def _obb(spark, sf_dir, iou):
    return decode.v8(tensors(spark, sf_dir, lambda v, i: F.when(i >= 56, v * 3).otherwise(v8_value(v, i))), NAMES[:3], 8, 0.05, iou, "obb")


@query(f"{suppressed(OBB_SQL, 0.45)} SELECT {DETECTION.format(label=name_of('label_index', NAMES[:3]))}, angle FROM kept")
def v8_obb(spark, sf_dir):
    return flat_box(_obb(spark, sf_dir, 0.45))


_CX, _CY = "(box_left + box_right) / 2", "(box_top + box_bottom) / 2"
_SIDES = [("box_left", "box_top"), ("box_right", "box_top"), ("box_right", "box_bottom"), ("box_left", "box_bottom")]


@query(f"WITH {OBB_SQL}, c AS (" + " UNION ALL ".join(f"SELECT image_id, index, CAST({k} AS BIGINT) AS corner, {_CX} + ({x} - {_CX}) * cos(angle) - ({y} - {_CY}) * sin(angle) AS x, {_CY} + ({x} - {_CX}) * sin(angle) + ({y} - {_CY}) * cos(angle) AS y FROM cand WHERE box_right > box_left AND box_bottom > box_top" for k, (x, y) in enumerate(_SIDES)) + ") SELECT image_id, index, corner, round(x, 6) AS x, round(y, 6) AS y FROM c")
def obb_corners(spark, sf_dir):
    found = _obb(spark, sf_dir, 0.0).filter(g.drawable(F.col("box"))).select("image_id", "index", F.posexplode(g.corners(F.col("box"), F.col("angle"))).alias("corner", "p"))
    return found.select("image_id", "index", F.col("corner").cast("long").alias("corner"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _point(x: str, pad: str, size: str) -> str:
    return f"least(greatest(trunc(({x} - {pad}) * gain) + 0e0, 0e0), {size} - 1)"


@query(f"""WITH {LB}, p AS (SELECT lb.*, i, j, CAST(d[4 * 2 + i + 1] AS DOUBLE) AS score, (CAST(d[(5 + j * 3) * 2 + i + 1] AS DOUBLE) + 0.6e0) * 600 AS kx, (CAST(d[(6 + j * 3) * 2 + i + 1] AS DOUBLE) + 0.6e0) * 600 AS ky, CAST(d[(7 + j * 3) * 2 + i + 1] AS DOUBLE) + 0.6e0 AS kc FROM lb, range(2) s(i), range(9) q(j))
SELECT image_id, i AS index, j AS point, {_point('kx', 'xp', 'sw')} AS x, {_point('ky', 'yp', 'sh')} AS y, kc AS confidence FROM p WHERE score > 0 AND score >= 0.05e0""")
def v8_pose(spark, sf_dir):
    def value(v, i):
        a = F.floor(i / 2)
        return F.when(a < 2, (v + 0.6) * 600).when(a < 4, (v + 0.6) * 150).when(a == 4, v).when((a - 5) % 3 == 2, v + 0.6).otherwise((v + 0.6) * 600)

    found = decode.v8(tensors(spark, sf_dir, value), NAMES[:1], 2, 0.05, 0.0, "pose", key_points=decode.v8_key_points(32, 3, 1))
    found = found.select("image_id", "index", F.posexplode("key_points").alias("point", "p"))
    return found.select("image_id", "index", F.col("point").cast("long").alias("point"), "p.x", "p.y", "p.confidence")


def _flat_sql(rows: int, stride: int, cells: str, box: str, classes: str, conf: str, more: str = "") -> str:
    at = lambda k: f"CAST(d[i * {stride} + {k} + 1] AS DOUBLE)"
    return f"""WITH {LB}, p AS (SELECT lb.*, i, {cells.format(*map(at, range(min(stride, 8))))} FROM lb, range({rows}) s(i)),
f AS (SELECT *, CAST(trunc({classes}) AS BIGINT) AS label_index FROM p WHERE NOT (score < {conf})),
g AS (SELECT image_id, i AS index, label_index, {name_of('label_index', NAMES)} AS label, score AS confidence, {scaled(*box.split('|'))}{more} FROM f WHERE label_index BETWEEN 0 AND 5)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY index) - 1 AS rank, index, label_index, label, confidence, box_left, box_top, box_right, box_bottom{', angle' if more else ''} FROM g"""


@query(_flat_sql(10, 6, "({0} + 0.6e0) * 500 AS a, ({1} + 0.6e0) * 500 AS b, ({2} + 0.6e0) * 500 AS c, ({3} + 0.6e0) * 500 AS e, {4} AS score, ({5} + 0.6e0) * 8 AS cls", "a|b|c|e", "cls", "0.05e0"))
def v10_flat(spark, sf_dir):
    return flat_box(decode.flat(tensors(spark, sf_dir, v10_value), NAMES, 0.05))


@query(_flat_sql(8, 8, "({0} + 0.6e0) * 500 AS a, ({1} + 0.6e0) * 500 AS b, ({2} + 0.6e0) * 150 AS c, ({3} + 0.6e0) * 150 AS e, {4} AS score, ({5} + 0.6e0) * 8 AS cls, {6} * 3 AS angle", "a - c / 2|b - e / 2|a + c / 2|b + e / 2", "cls", "0.05e0", ", angle"))
def v26_obb(spark, sf_dir):
    value = lambda v, i: F.when(i % 8 < 2, (v + 0.6) * 500).when(i % 8 < 4, (v + 0.6) * 150).when(i % 8 == 4, v).when(i % 8 == 5, (v + 0.6) * 8).otherwise(v * 3)
    return flat_box(decode.flat(tensors(spark, sf_dir, value), NAMES, 0.05, 8, "obb"))


@query(f"""WITH {LB}, p AS (SELECT lb.*, j, trunc((CAST(d[6] AS DOUBLE) + 0.6e0) * 3) AS cls, CAST(d[5] AS DOUBLE) AS score, (CAST(d[7 + j * 3] AS DOUBLE) + 0.6e0) * 600 AS kx, (CAST(d[8 + j * 3] AS DOUBLE) + 0.6e0) * 600 AS ky, CAST(d[9 + j * 3] AS DOUBLE) + 0.6e0 AS kc FROM lb, range(19) q(j))
SELECT image_id, j AS point, {_point('kx', 'xp', 'sw')} AS x, {_point('ky', 'yp', 'sh')} AS y, kc AS confidence FROM p WHERE score >= -0.2e0 AND cls BETWEEN 0 AND 2""")
def v26_pose(spark, sf_dir):
    def value(v, i):
        k = (i - 6) % 3
        return F.when(i < 4, (v + 0.6) * 500).when(i == 4, v).when(i == 5, (v + 0.6) * 3).when(k == 2, v + 0.6).otherwise((v + 0.6) * 600)

    found = decode.flat(tensors(spark, sf_dir, value), NAMES[:3], -0.2, 64, "pose")
    found = found.select("image_id", F.posexplode("key_points").alias("point", "p"))
    return found.select("image_id", F.col("point").cast("long").alias("point"), "p.x", "p.y", "p.confidence")


_RT = [f"CAST(d[i * 8 + {k} + 1] AS DOUBLE)" for k in range(8)]


def _rt_side(c: str, half: str, sign: str, pad: str, size: str) -> str:
    return f"least(greatest(trunc(({c} * {MODEL} - {pad}) * gain {sign} {half} * {MODEL} * 0.5e0 * gain) + 0e0, 0e0), {size} - 1)"


@query(f"""WITH {LB}, p AS (SELECT lb.*, i, greatest({', '.join(_RT[4:])}) AS best, {_RT[0]} + 0.6e0 AS x, {_RT[1]} + 0.6e0 AS y, ({_RT[2]} + 0.6e0) * 0.4e0 AS w, ({_RT[3]} + 0.6e0) * 0.4e0 AS h FROM lb, range(8) s(i)),
c AS (SELECT *, CAST(CASE {' '.join(f'WHEN {_RT[4 + k]} = best THEN {k}' for k in range(4))} END AS BIGINT) AS label_index FROM p WHERE best > 0 AND best >= 0.05e0)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS rank, i AS index, label_index, {name_of('label_index', NAMES[:4])} AS label, best AS confidence,
{_rt_side('x', 'w', '-', 'xp', 'sw')} AS box_left, {_rt_side('y', 'h', '-', 'yp', 'sh')} AS box_top, {_rt_side('x', 'w', '+', 'xp', 'sw')} AS box_right, {_rt_side('y', 'h', '+', 'yp', 'sh')} AS box_bottom FROM c""")
def rtdetr_detect(spark, sf_dir):
    return flat_box(decode.rtdetr(tensors(spark, sf_dir, rtdetr_value), NAMES[:4], 8, 0.05))


_TOP = f"""{LB}, s AS (SELECT image_id, pair, CAST(1e0 / (1e0 + exp(-(CAST(d[pair + 1] AS DOUBLE) * 4))) AS FLOAT) AS score FROM lb, range(64) q(pair)),
k AS (SELECT image_id, pair, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pair) - 1 AS rank FROM s)"""


@query(f"WITH {_TOP} SELECT image_id, rank, pair, round(score, 6) AS score FROM k WHERE rank < 8")
def rfdetr_topk(spark, sf_dir):
    t = tensors(spark, sf_dir, lambda v, i: v * 4)
    found = t.select("image_id", F.posexplode(decode.top_pairs(F.col("data"), 8, 8)).alias("rank", "s"))
    return found.select("image_id", F.col("rank").cast("long").alias("rank"), F.col("s.pair").cast("long").alias("pair"), F.round("s.score", 6).alias("score"))


_DET = [f"CAST(b.embedding[CAST(floor(pair / 8) AS BIGINT) * 4 + {k + 1}] AS DOUBLE)" for k in range(4)]


@query(f"""WITH {_TOP}, m AS (SELECT k.image_id, k.rank AS place, pair, score, lb.sw, lb.sh, lb.xp, lb.yp, lb.gain, {_DET[0]} + 0.6e0 AS x, {_DET[1]} + 0.6e0 AS y, ({_DET[2]} + 0.6e0) * 0.4e0 AS w, ({_DET[3]} + 0.6e0) * 0.4e0 AS h
  FROM k JOIN lb USING (image_id) JOIN embeddings b ON b.vec_id = k.image_id + 1 WHERE k.rank < 8 AND score >= 0.5e0 AND pair % 8 BETWEEN 1 AND 6),
n AS (SELECT image_id, place, CAST(floor(pair / 8) AS BIGINT) AS index, pair % 8 AS label_index, {name_of('pair % 8', LOGIT_NAMES)} AS label, round(score, 6) AS confidence, {scaled(f'(x - w / 2) * {MODEL}', f'(y - h / 2) * {MODEL}', f'(x + w / 2) * {MODEL}', f'(y + h / 2) * {MODEL}')} FROM m)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY place) - 1 AS rank, index, label_index, label, confidence, box_left, box_top, box_right, box_bottom FROM n""")
def rfdetr_detect(spark, sf_dir):
    return flat_box(_rfdetr(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def _rfdetr(spark, sf_dir):
    return decode.rfdetr(_rfdetr_tensors(spark, sf_dir), LOGIT_NAMES, 8, 8, 0.5)


def _rfdetr_tensors(spark, sf_dir):
    other = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") - 1).alias("image_id"), F.transform(F.slice("embedding", 1, 32), lambda v, i: F.when(i % 4 < 2, v.cast("double") + 0.6).otherwise((v.cast("double") + 0.6) * 0.4)).alias("boxes"))
    return tensors(spark, sf_dir, lambda v, i: v * 4).withColumnRenamed("data", "logits").join(other, "image_id")


@query(f"""SELECT vec_id AS image_id, rank, CASE WHEN i < 40 THEN 'class_' || CAST(i AS VARCHAR) ELSE CAST(i AS VARCHAR) END AS label, confidence FROM (
  SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) AS rank FROM embeddings, range(64) s(i)) WHERE rank <= 5""")
def classify_topk(spark, sf_dir):
    return decode.classify(tensors(spark, sf_dir, lambda v, i: v), CLASS_NAMES)


@query(f"SELECT image_id, rank, box_left, box_top, box_right, box_bottom, list_extract({render.COLOURS!r}, label_index % 8 + 1) AS colour, label || ' ' || printf('%.1f', confidence * 100) || '%' AS caption, box_left AS caption_x, greatest(0e0, box_top - 14e0) AS caption_y FROM ({V8_NMS}) WHERE box_right > box_left AND box_bottom > box_top")
def draw_boxes(spark, sf_dir):
    return flat_box(render.rectangles(decode.v8(tensors(spark, sf_dir, v8_value), NAMES[:4], 8, 0.05, 0.45)))


@query(f"""SELECT image_id, 'modelType: ObjectDetection' || chr(10) || 'count: ' || CAST(count(*) AS VARCHAR) || chr(10) || string_agg(CAST(rank + 1 AS VARCHAR) || '. ' || label || ' confidence=' || printf('%.6f', confidence) || ' box=[' || printf('%.0f', box_left) || ', ' || printf('%.0f', box_top) || ', ' || printf('%.0f', box_right) || ', ' || printf('%.0f', box_bottom) || ']', chr(10) ORDER BY rank) AS report FROM ({V8_NMS}) GROUP BY image_id""")
def detection_report(spark, sf_dir):
    return render.report(decode.v8(tensors(spark, sf_dir, v8_value), NAMES[:4], 8, 0.05, 0.45), "ObjectDetection")


def _poses(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda j, k: F.get(F.col("embedding"), j * 3 + k).cast("double") + 0.6
    p = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.struct((at(j, 0) * 600).alias("x"), (at(j, 1) * 600).alias("y"), at(j, 2).alias("confidence")))
    return e.select(F.col("vec_id").alias("image_id"), F.lit(0).cast("long").alias("rank"), p.alias("key_points"))


_PTS = "k AS (SELECT vec_id AS image_id, CAST(0 AS BIGINT) AS rank, j AS point, (CAST(embedding[j * 3 + 1] AS DOUBLE) + 0.6e0) * 600 AS x, (CAST(embedding[j * 3 + 2] AS DOUBLE) + 0.6e0) * 600 AS y, CAST(embedding[j * 3 + 3] AS DOUBLE) + 0.6e0 AS confidence FROM embeddings, range(17) s(j))"


@query(f"WITH {_PTS} SELECT * FROM k WHERE confidence >= 0.55e0")
def keypoints_visible(spark, sf_dir):
    return render.points(_poses(spark, sf_dir), 0.55)


@query(f"WITH {_PTS}, e(a, b) AS (VALUES {', '.join(f'({a}, {b})' for a, b in render.SKELETON)}) SELECT p.image_id, p.rank, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM e JOIN k p ON p.point = a JOIN k q ON q.point = b AND q.image_id = p.image_id WHERE p.confidence >= 0.55e0 AND q.confidence >= 0.55e0")
def skeleton_edges(spark, sf_dir):
    return render.skeleton(_poses(spark, sf_dir), 0.55)


# ---------------------------------------------------------------- drawing rows and reports of the other tasks, and mixed layouts


@query(f"SELECT image_id, rank, label || ' (' || printf('%.1f', confidence * 100) || '%)' AS caption, 10e0 AS caption_x, rank * 20e0 AS caption_y FROM ({ORACLE_SQL['classify_topk']})")
def draw_classes(spark, sf_dir):
    return render.text_lines(classify_topk(spark, sf_dir))


@query(f"SELECT image_id, 'modelType: Classification' || chr(10) || 'count: ' || CAST(count(*) AS VARCHAR) || chr(10) || string_agg(CAST(rank AS VARCHAR) || '. ' || label || ' confidence=' || printf('%.6f', confidence), chr(10) ORDER BY rank) AS report FROM ({ORACLE_SQL['classify_topk']}) GROUP BY image_id")
def class_report(spark, sf_dir):
    return render.class_report(classify_topk(spark, sf_dir))


_CORNERS = ", ".join(f"round({_CX} + ({x} - {_CX}) * cos(angle) - ({y} - {_CY}) * sin(angle), 6) AS x{k}, round({_CY} + ({x} - {_CX}) * sin(angle) + ({y} - {_CY}) * cos(angle), 6) AS y{k}" for k, (x, y) in enumerate(_SIDES))


@query(f"SELECT image_id, rank, {_CORNERS}, list_extract(['#22c55e', '#3b82f6', '#f97316', '#e11d48', '#8b5cf6', '#14b8a6', '#f59e0b', '#06b6d4'], label_index % 8 + 1) AS colour, label || ' ' || printf('%.1f', confidence * 100) || '%' AS caption FROM ({ORACLE_SQL['v8_obb']}) WHERE box_right > box_left AND box_bottom > box_top")
def draw_polygons(spark, sf_dir):
    found = render.polygons(_obb(spark, sf_dir, 0.45))
    return found.select("image_id", "rank", *(F.round(F.get("corners", F.lit(k))[s], 6).alias(f"{s}{k}") for k in range(4) for s in "xy"), "colour", "caption")


@query(f"""SELECT image_id, 'modelType: ObbDetection' || chr(10) || 'count: ' || CAST(count(*) AS VARCHAR) || chr(10) || string_agg(CAST(rank + 1 AS VARCHAR) || '. ' || label || ' confidence=' || printf('%.6f', confidence) || ' angle=' || printf('%.6f', angle) || ' box=[' || printf('%.0f', box_left) || ', ' || printf('%.0f', box_top) || ', ' || printf('%.0f', box_right) || ', ' || printf('%.0f', box_bottom) || ']', chr(10) ORDER BY rank) AS report FROM ({ORACLE_SQL['v8_obb']}) GROUP BY image_id""")
def oriented_report(spark, sf_dir):
    return render.report(_obb(spark, sf_dir, 0.45), "ObbDetection", F.concat(F.lit("angle="), render.fixed(F.col("angle"), 6)))


@query(f"""WITH {_PTS} SELECT image_id, rank, x - 1 AS "left", y - 1 AS top, x + 2 AS "right", y + 2 AS bottom, list_extract(['#22c55e', '#3b82f6', '#f97316', '#e11d48', '#8b5cf6', '#14b8a6', '#f59e0b', '#06b6d4'], image_id % 9 % 8 + 1) AS colour FROM k""")
def contour_squares(spark, sf_dir):
    points = F.transform("key_points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return render.mask_edges(_poses(spark, sf_dir).select("image_id", "rank", (F.col("image_id") % 9).alias("label_index"), points.alias("edge_points")), 3)


@query(" UNION ALL ".join(f"SELECT image_id, rank, index, label_index, label, confidence, box_left, box_top, box_right, box_bottom FROM ({ORACLE_SQL[n]}) WHERE image_id % 3 = {k}" for k, n in enumerate(("v8_detect_nms", "v10_flat", "rtdetr_detect"))))
def mixed_decoders(spark, sf_dir):
    """One table of tensors in three layouts; each row names its decoder."""
    decoders = {
        "v8": lambda e: decode.v8(as_tensors(e, v8_value), NAMES[:4], 8, 0.05, 0.45),
        "v10": lambda e: decode.flat(as_tensors(e, v10_value), NAMES, 0.05),
        "rtdetr": lambda e: decode.rtdetr(as_tensors(e, rtdetr_value), NAMES[:4], 8, 0.05),
    }
    named = F.get(F.array(*map(F.lit, decoders)), (F.col("vec_id") % 3).cast("int"))
    return flat_box(decode.mixed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("decoder", named), "decoder", decoders))


# ---------------------------------------------------------------- masks, contours and inputs: no SQL, held against brute force in tests


def _segments(spark, sf_dir):
    """V8 segments: 8 predictions of 4 + 2 classes + 2 weights, prototypes 2 x 4 x 8 of the next row."""
    t = tensors(spark, sf_dir, lambda v, i: F.when(i < 48, v8_value(v, i)).otherwise(v * 20))
    proto = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") - 1).alias("image_id"), F.transform("embedding", lambda v: v * 10).alias("proto"))
    return decode.v8(beside(t, proto), NAMES[:2], 8, 0.05, 0.45, "segment", channels=2, finish=segmentation.in_prototypes("proto", (2, 4, 8), (MODEL, MODEL), 0.5))


@query()
def v8_segment(spark, sf_dir):
    return flat_box(_segments(spark, sf_dir).withColumn("mask", F.hex("mask")))


@query()
def contour_trace(spark, sf_dir):
    found = segmentation.edge_points(_segments(spark, sf_dir)).select("image_id", "rank", F.posexplode("edge_points").alias("step", "p")).select("image_id", "rank", F.col("step").cast("long").alias("step"), "p.x", "p.y")
    return render.polylines(found, ["image_id", "rank"], "step")


@query()
def v26_segment(spark, sf_dir):
    value = lambda v, i: F.when(i % 8 < 2, (v + 0.6) * 300).when(i % 8 < 4, (v + 0.6) * 900).when(i % 8 == 4, v).when(i % 8 == 5, (v + 0.6) * 8).otherwise(v * 20)
    proto = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") - 1).alias("image_id"), F.transform("embedding", lambda v: v * 10).alias("proto"))
    found = decode.flat(beside(tensors(spark, sf_dir, value), proto), NAMES, 0.05, 8, "segment", channels=2, finish=segmentation.in_prototypes("proto", (2, 4, 8), (MODEL, MODEL), 0.5))
    return flat_box(found.withColumn("mask", F.hex("mask")))


@query()
def rfdetr_segment(spark, sf_dir):
    maps = tensors(spark, sf_dir, lambda v, i: v).select((F.col("image_id") - 2).alias("image_id"), F.flatten(F.array_repeat("data", 2)).alias("maps"))
    found = decode.rfdetr(beside(_rfdetr_tensors(spark, sf_dir), maps), LOGIT_NAMES, 8, 8, 0.5, segmentation.in_logits("maps", (8, 4, 4)))
    return flat_box(found.withColumn("mask", F.hex("mask")))


@query()
def mask_pixels(spark, sf_dir):
    return render.mask_pixels(_segments(spark, sf_dir))


@query()
def image_tensor(spark, sf_dir):
    """Grey 8 x 8 images through the letterbox of a 16 x 12 input; mean and range of each plane."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(((v + 0.6) * 200).cast("int")), 2, "0")), ""))
    images = e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("n_channels"), data.alias("data"))
    t = infer.preprocess(images, 16, 12, "stretch", infer.MEAN, infer.STD)
    part = lambda k: F.slice("tensor", k * 192 + 1, 192)
    return t.select("image_id", *(F.round(F.aggregate(part(k), F.lit(0.0), lambda a, x: a + x) / 192, 4).alias(f"mean_{c}") for k, c in enumerate("rgb")), F.size("tensor").alias("n"))
