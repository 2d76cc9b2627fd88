"""Queries of geometry, suppression over tables, masks as relations, labels, drawing and streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions import labels as lb
from boxwright.functions import masks
from boxwright.operators import catalog, nms, render
from boxwright.plans.detect import overlap, suppressed
from boxwright.streaming import frames

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TILE = 128


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unboxed(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "box"]
    return df.select(*kept, *(F.col(f"box.{s}").alias(f"box_{s}") for s in ("left", "top", "right", "bottom")))


# ---------------------------------------------------------------- suppression over a table of boxes

_CAND = """cand AS (SELECT user_id, event_id AS index, value / 500 AS confidence, CAST(event_id * 37 % 500 AS DOUBLE) AS box_left, CAST(event_id * 53 % 400 AS DOUBLE) AS box_top,
  CAST(event_id * 37 % 500 + 20 + event_id * 7 % 90 AS DOUBLE) AS box_right, CAST(event_id * 53 % 400 + 20 + event_id * 11 % 80 AS DOUBLE) AS box_bottom FROM events)"""
_BOXES = "user_id, index, confidence, box_left, box_top, box_right, box_bottom"


def _boxes(spark, sf_dir):
    e = F.col("event_id")
    left, top = e * 37 % 500, e * 53 % 400
    b = g.box(left, top, left + 20 + e * 7 % 90, top + 20 + e * 11 % 80)
    return table(spark, sf_dir, "events").select("user_id", e.alias("index"), (F.col("value") / 500).alias("confidence"), b.alias("box"))


@query(f"{suppressed(_CAND, 0.2, 'user_id')} SELECT {_BOXES} FROM kept")
def nms_greedy(spark, sf_dir):
    return _unboxed(nms.suppress(_boxes(spark, sf_dir), "user_id", 0.2))


@query(f"{suppressed(_CAND, 0.2, 'user_id')} SELECT {_BOXES} FROM kept")
def nms_wide(spark, sf_dir):
    return _unboxed(nms.suppress_wide(_boxes(spark, sf_dir), "user_id", 0.2))


@query(f"WITH {_CAND} SELECT {_BOXES} FROM cand")
def nms_off(spark, sf_dir):
    return _unboxed(nms.suppress(_boxes(spark, sf_dir), "user_id", 0.0))


@query(f"WITH {_CAND} SELECT a.user_id, a.index AS a, b.index AS b, round({overlap('a', 'b')}, 9) AS iou FROM cand a JOIN cand b ON a.user_id = b.user_id AND a.index < b.index WHERE {overlap('a', 'b')} > 0.3e0")
def iou_pairs(spark, sf_dir):
    """Overlapping boxes of a user meet in tiles; a pair counts in the tile of its overlap's upper left corner."""
    b, span = F.col("box"), lambda low, high: F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE)))
    tiled = _boxes(spark, sf_dir).withColumn("tx", span(b["left"], b["right"])).withColumn("ty", span(b["top"], b["bottom"]))
    one, two = (tiled.select("user_id", "tx", "ty", F.col("index").alias(n), F.col("box").alias(f"box_{n}")) for n in ("a", "b"))
    met = one.join(two, ["user_id", "tx", "ty"]).filter("a < b")
    home = (F.floor(F.greatest("box_a.left", "box_b.left") / TILE) == F.col("tx")) & (F.floor(F.greatest("box_a.top", "box_b.top") / TILE) == F.col("ty"))
    found = met.filter(home).withColumn("iou", g.iou(F.col("box_a"), F.col("box_b"))).filter("iou > 0.3")
    return found.select("user_id", "a", "b", F.round("iou", 9).alias("iou"))


# ---------------------------------------------------------------- letterboxes and boxes

_SIZED = "s AS (SELECT p_partkey, CAST(100 + p_size * 40 AS DOUBLE) AS w, CAST(80 + p_partkey % 40 * 30 AS DOUBLE) AS h FROM part), r AS (SELECT *, w < 640 AND h < 640 AS small, least(640e0 / w, 640e0 / h) AS ratio FROM s)"


def _sized(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size") * 40).alias("w"), (80 + F.col("p_partkey") % 40 * 30).alias("h"))


@query(f"WITH {_SIZED}, d AS (SELECT *, CASE WHEN small THEN w ELSE w * ratio END AS draw_w, CASE WHEN small THEN h ELSE h * ratio END AS draw_h FROM r) SELECT p_partkey, (640e0 - draw_w) * 0.5e0 AS x_pad, (640e0 - draw_h) * 0.5e0 AS y_pad, CASE WHEN small THEN 1e0 ELSE greatest(w / 640e0, h / 640e0) END AS gain, draw_w, draw_h FROM d")
def letterbox(spark, sf_dir):
    box = g.letterbox(F.col("w"), F.col("h"), 640, 640)
    return _sized(spark, sf_dir).select("p_partkey", box.alias("b")).select("p_partkey", "b.x_pad", "b.y_pad", "b.gain", "b.draw_w", "b.draw_h")


_ROI = {"l": "p_size * 3.7e0 - 20", "t": "p_size * 2.3e0 - 15", "r": "p_size * 3.7e0 - 30 + p_partkey % 90", "b": "p_size * 2.3e0 - 15 + p_partkey % 70"}


@query(f"""WITH s AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _ROI.items())} FROM part), a AS (SELECT *, least(greatest(trunc(l) + 0e0, 0e0), 99e0) AS x, least(greatest(trunc(t) + 0e0, 0e0), 79e0) AS y FROM s)
SELECT p_partkey, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(least(greatest(trunc(r), x + 1), 100e0) - x AS BIGINT) AS width, CAST(least(greatest(trunc(b), y + 1), 80e0) - y AS BIGINT) AS height FROM a""")
def roi_rect(spark, sf_dir):
    roi = F.struct(*(F.expr(e.replace("e0", "D")).alias(n) for n, e in zip(("left", "top", "right", "bottom"), _ROI.values(), strict=True)))
    return table(spark, sf_dir, "part").select("p_partkey", g.roi_rect(F.lit(100), F.lit(80), roi).alias("r")).select("p_partkey", "r.*")


_STRETCHED = {"x1": "o_orderkey % 101 / 90e0 - 0.05e0", "y1": "o_custkey % 97 / 90e0 - 0.05e0", "x2": "o_orderkey % 101 / 90e0 + 0.2e0", "y2": "o_custkey % 97 / 90e0 + 0.3e0"}


@query(f"""WITH s AS (SELECT o_orderkey, CAST(50 + o_custkey % 1500 AS DOUBLE) AS w, CAST(60 + o_orderkey % 900 AS DOUBLE) AS h, {', '.join(f'{e} AS {n}' for n, e in _STRETCHED.items())} FROM orders)
SELECT o_orderkey, 10.5e0 + least(greatest(trunc(x1 * w) + 0e0, 0e0), w - 1) AS box_left, 4e0 + least(greatest(trunc(y1 * h) + 0e0, 0e0), h - 1) AS box_top, 10.5e0 + least(greatest(trunc(x2 * w) + 0e0, 0e0), w) AS box_right, 4e0 + least(greatest(trunc(y2 * h) + 0e0, 0e0), h) AS box_bottom FROM s""")
def box_rescale_stretched(spark, sf_dir):
    roi = F.struct(F.lit(10.5).alias("left"), F.lit(4.0).alias("top"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", g.letterbox(50 + F.col("o_custkey") % 1500, 60 + F.col("o_orderkey") % 900, 640, 480, "stretch", roi).alias("lb"), *(F.expr(e.replace("e0", "D")).alias(n) for n, e in _STRETCHED.items()))
    return _unboxed(o.select("o_orderkey", g.scale_unit_box(*(F.col(n) for n in _STRETCHED), F.col("lb")).alias("box")))


@query("""WITH s AS (SELECT o_orderkey, CAST(50 + o_custkey % 1500 AS DOUBLE) AS w, CAST(60 + o_orderkey % 900 AS DOUBLE) AS h, o_orderkey % 640 + 0.75e0 AS x, o_custkey % 480 + 0.25e0 AS y FROM orders),
r AS (SELECT *, w < 640 AND h < 480 AS small, least(640e0 / w, 480e0 / h) AS ratio FROM s), l AS (SELECT *, CASE WHEN small THEN (640e0 - w) * 0.5e0 ELSE (640e0 - w * ratio) * 0.5e0 END AS xp, CASE WHEN small THEN (480e0 - h) * 0.5e0 ELSE (480e0 - h * ratio) * 0.5e0 END AS yp, CASE WHEN small THEN 1e0 ELSE greatest(w / 640e0, h / 480e0) END AS gain FROM r)
SELECT o_orderkey, least(greatest(trunc((x - xp) * gain) + 0e0, 0e0), w - 1) AS x, least(greatest(trunc((y - yp) * gain) + 0e0, 0e0), h - 1) AS y FROM l""")
def point_rescale(spark, sf_dir):
    box = g.letterbox(50 + F.col("o_custkey") % 1500, 60 + F.col("o_orderkey") % 900, 640, 480).alias("lb")
    o = table(spark, sf_dir, "orders").select("o_orderkey", box, (F.col("o_orderkey") % 640 + 0.75).alias("x"), (F.col("o_custkey") % 480 + 0.25).alias("y"))
    return o.select("o_orderkey", g.scale_x(F.col("x"), F.col("lb")).alias("x"), g.scale_y(F.col("y"), F.col("lb")).alias("y"))


_SIDES = ("left", "top", "right", "bottom")


@query(f"""WITH b AS (SELECT vec_id AS image_id, {', '.join(f'(CAST(embedding[{k + 1}] AS DOUBLE) + 0.6e0) * 600 AS {n}' for k, n in enumerate('ltrb'))} FROM embeddings)
SELECT image_id, least(greatest(floor(l * 0.25e0), 0e0), 159e0) AS box_left, least(greatest(floor(t * 0.125e0), 0e0), 79e0) AS box_top, least(greatest(ceil(r * 0.25e0), 0e0), 159e0) AS box_right, least(greatest(ceil(b * 0.125e0), 0e0), 79e0) AS box_bottom FROM b""")
def mask_crop(spark, sf_dir):
    b = F.struct(*(((F.get("embedding", F.lit(k)).cast("double") + 0.6) * 600).alias(n) for k, n in enumerate(_SIDES)))
    return _unboxed(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), g.mask_crop(b, 160, 80, 640, 640).alias("box")))


@query("SELECT vec_id AS image_id, i AS class, round(1e0 / (1e0 + exp(-CAST(embedding[i + 1] AS DOUBLE))), 6) AS share FROM embeddings, range(64) s(i)")
def sigmoid_scores(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("class", "v"))
    return found.select("image_id", F.col("class").cast("long").alias("class"), F.round(g.sigmoid(F.col("v")), 6).alias("share"))


# ---------------------------------------------------------------- masks as relations


def _packed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), masks.pack(F.transform("embedding", lambda v: v > 0)).alias("m"))


@query("SELECT vec_id AS image_id, CAST(i // 8 AS BIGINT) AS byte, CAST(sum(CASE WHEN embedding[i + 1] > 0 THEN 1 << CAST(i % 8 AS INT) ELSE 0 END) AS BIGINT) AS value FROM embeddings, range(64) s(i) GROUP BY ALL")
def mask_pack(spark, sf_dir):
    found = _packed(spark, sf_dir).select("image_id", F.posexplode("m").alias("byte", "value"))
    return found.select("image_id", F.col("byte").cast("long").alias("byte"), F.col("value").cast("long").alias("value"))


@query("SELECT vec_id AS image_id, i AS pixel, coalesce(i BETWEEN 0 AND 63 AND embedding[i + 1] > 0, false) AS is_set FROM embeddings, range(-2, 67) s(i)")
def mask_bits(spark, sf_dir):
    every = _packed(spark, sf_dir).select("image_id", "m", F.explode(F.sequence(F.lit(-2), F.lit(66))).alias("pixel"))
    return every.select("image_id", F.col("pixel").cast("long").alias("pixel"), masks.bit(F.col("m"), F.col("pixel")).alias("is_set"))


@query("""WITH p AS (SELECT vec_id AS image_id, i, i % 8 AS x, i // 8 AS y, embedding AS e FROM embeddings, range(64) s(i))
SELECT image_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM p WHERE e[i + 1] > 0 AND (x IN (0, 7) OR y IN (0, 7) OR e[i] <= 0 OR e[i + 2] <= 0 OR e[i - 7] <= 0 OR e[i + 9] <= 0)""")
def mask_edges(spark, sf_dir):
    every = _packed(spark, sf_dir).select("image_id", "m", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return every.filter(masks.edge(F.col("m"), F.col("i"), 8, 8)).select("image_id", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"))


@query("""WITH p AS (SELECT user_id, event_id, event_id % 7 AS x, event_id % 5 AS y FROM events), n AS (SELECT *, CASE WHEN abs(x - lag(x) OVER w) > 1 OR abs(y - lag(y) OVER w) > 1 THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, x, y, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS line FROM n""")
def polyline_runs(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("x"), (F.col("event_id") % 5).alias("y"))
    return render.polylines(p, ["user_id"], "event_id")


# ---------------------------------------------------------------- colours and texts


@query(f"""WITH c AS (SELECT event_id, list_extract({render.COLOURS!r}, event_id % 13 % 8 + 1) AS colour FROM events)
SELECT event_id, colour, {', '.join(f"CAST(CAST('0x' || substr(colour, {2 + 2 * k}, 2) AS BIGINT) AS INTEGER) AS {n}" for k, n in enumerate('rgb'))}, least(greatest(event_id % 300 - 20, 0), 255) / 255e0 AS a FROM c""")
def palette(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", render.colour(F.col("event_id") % 13).alias("colour"))
    return e.select("event_id", "colour", render.channels(F.col("colour"), F.col("event_id") % 300 - 20).alias("c")).select("event_id", "colour", "c.*")


@query("SELECT vec_id AS image_id, 'class_' || CAST(label AS VARCHAR) || ' ' || printf('%.1f', (CAST(embedding[1] AS DOUBLE) + 0.6e0) / 1.2e0 * 100) || '%' AS caption, 'class_' || CAST(label AS VARCHAR) || ' (' || printf('%.1f', (CAST(embedding[1] AS DOUBLE) + 0.6e0) / 1.2e0 * 100) || '%)' AS bracketed FROM embeddings")
def label_text(spark, sf_dir):
    name, share = F.concat(F.lit("class_"), F.col("label")), (F.get("embedding", F.lit(0)).cast("double") + 0.6) / 1.2
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), render.caption(name, share).alias("caption"), render.caption(name, share, True).alias("bracketed"))


_FONT = "CASE p_partkey % 4 WHEN 0 THEN 'bold ' || CAST(p_size AS STRING) || 'px serif' WHEN 1 THEN CAST(p_size AS STRING) || '.5px x 9px' WHEN 2 THEN 'large' ELSE '' END"


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5e0 ELSE 14e0 END AS size FROM part")
def font_size(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", render.font_size(F.expr(_FONT)).alias("size"))


# ---------------------------------------------------------------- labels and models

_CLEAN = "list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n|,'), lambda x: regexp_replace(x, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')), lambda x: x <> '')"


@query(f"WITH n AS (SELECT doc_id, {_CLEAN} AS names FROM documents) SELECT doc_id, len(names) AS n_names, names[1] AS first_name, md5(array_to_string(names, '|')) AS digest FROM n")
def label_parse_list(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", lb.parse_list(F.col("text")).alias("names"))
    return n.select("doc_id", F.size("names").cast("long").alias("n_names"), F.get("names", F.lit(0)).alias("first_name"), F.md5(F.array_join("names", "|")).alias("digest"))


@query("""WITH k AS (SELECT p_partkey // 10 AS model_id, p_partkey * 7 % 23 AS key, p_partkey, p_brand FROM part), u AS (SELECT model_id, key, arg_max(p_brand, p_partkey) AS name FROM k GROUP BY ALL)
SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY key) - 1 AS index, name FROM u""")
def label_parse_dict(spark, sf_dir):
    """Texts like {5: 'a', 12: 'b'}, written from part, and read again."""
    item = F.concat((F.col("p_partkey") * 7 % 23).cast("string"), F.lit(": '"), F.col("p_brand"), F.lit("'"))
    texts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("model_id")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("l"))
    names = lb.parse_dict(F.concat(F.lit(" {"), F.array_join(F.transform("l", lambda x: x["item"]), " , "), F.lit("} ")))
    found = texts.select("model_id", F.posexplode(names).alias("index", "name"))
    return found.select("model_id", F.col("index").cast("long").alias("index"), "name")


@query("SELECT p_partkey, i AS index, CASE WHEN i = 0 THEN 'background_class' ELSE 'class_' || CAST(i AS VARCHAR) END AS name FROM part, range(50) s(i) WHERE i < p_size")
def labels_infer(spark, sf_dir):
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(lb.inferred(F.col("p_size"))).alias("index", "name"))
    return found.select("p_partkey", F.col("index").cast("long").alias("index"), "name")


@query("SELECT p_partkey // 10 AS model_id, CAST(coalesce(min(CASE WHEN p_partkey % 17 = 3 THEN p_partkey % 10 END), -1) AS INTEGER) AS background FROM part GROUP BY 1")
def label_background(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 17 == 3, F.concat(F.lit("Background_Class "), F.col("p_partkey"))).otherwise(F.col("p_brand"))
    full = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("model_id")).agg(F.sort_array(F.collect_list(F.struct((F.col("p_partkey") % 10).alias("at"), name.alias("name")))).alias("l"))
    at = lb.background_index(F.transform("l", lambda x: x["name"]))
    return full.select("model_id", F.when(at < 0, -1).otherwise(F.get("l", at)["at"]).cast("int").alias("background"))


_NAMED = "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS label_index FROM events"


def _classes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit("m").alias("model_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("label_index"))
    n = table(spark, sf_dir, "nation").select(F.lit("m").alias("model_id"), F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))
    return e, n


@query(f"SELECT event_id, label_index, n_name AS label FROM ({_NAMED}) JOIN nation ON n_nationkey = label_index")
def label_lookup_inner(spark, sf_dir):
    return catalog.named(*_classes(spark, sf_dir)).select("event_id", "label_index", "label")


@query(f"SELECT event_id, label_index, coalesce(n_name, CAST(label_index AS VARCHAR)) AS label FROM ({_NAMED}) LEFT JOIN nation ON n_nationkey = label_index")
def label_lookup_left(spark, sf_dir):
    return catalog.named(*_classes(spark, sf_dir), how="left").select("event_id", "label_index", "label")


_TEXTS = ["Ultralytics YOLOv5u x", "ultralytics YOLOv8s-worldv2", "Ultralytics YOLOE-v8", "Ultralytics YOLOv9c", "Ultralytics YOLOv10n", "Ultralytics YOLO11n", "Ultralytics YOLOE-11", "Ultralytics YOLOv12", "Ultralytics YOLO26s", "my worldv2 model", "Ultralytics RT-DETR-l", "Ultralytics ResNet", "Ultralytics yolo-nas", "other"]
_RULES = [(f"starts_with(d, '{p}')", v) for p, v in lb.PREFIXES] + [("contains(d, 'worldv2')", "WORLDV2"), ("starts_with(d, 'ultralytics rt-detr')", "RTDETR"), ("starts_with(d, 'ultralytics') AND NOT contains(d, 'yolo')", "V8")]


@query(f"WITH t AS (SELECT p_partkey, list_extract({_TEXTS!r}, p_partkey % {len(_TEXTS)} + 1) || ' ' || p_brand AS description FROM part), l AS (SELECT *, lower(description) AS d FROM t) SELECT p_partkey, CASE {' '.join(f'WHEN {c} THEN {v!r}' for c, v in _RULES)} END AS version FROM l")
def version_from_description(spark, sf_dir):
    text = F.concat(F.get(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS)).cast("int")), F.lit(" "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", lb.version_of(text).alias("version"))


_PAIRS = ", ".join(f"('{v}', '{t}')" for v, tasks in lb.SUPPORT.items() for t in tasks)


@query(f"WITH m AS (SELECT p_partkey AS model_id, list_extract({[*lb.SUPPORT]!r}, p_partkey % 12 + 1) AS model_version, list_extract({[*lb.TASKS.values()]!r}, p_partkey % 5 + 1) AS model_type FROM part), s(v, t) AS (VALUES {_PAIRS}) SELECT m.*, v IS NOT NULL AS supported FROM m LEFT JOIN s ON v = model_version AND t = model_type")
def task_support(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), pick(lb.SUPPORT, 12).alias("model_version"), pick(lb.TASKS.values(), 5).alias("model_type"))
    return catalog.supported(m).drop("decoder")


def _models(spark, sf_dir):
    """Descriptors made of part: by metadata, by output shapes with and without masks, with options."""
    k, empty = F.col("p_partkey") % 4, F.create_map().cast("map<string,string>")
    ints = lambda *v: F.array(*(x if not isinstance(x, int) else F.lit(x) for x in v)).cast("array<int>")
    heads = [F.lit("dets"), ints(1, 300, 4), F.lit("labels"), F.array(F.lit(1), F.lit(300), F.col("p_size") % 5 + 1)]
    meta = F.create_map(F.lit("task"), F.lit("segment"), F.lit("description"), F.lit("Ultralytics YOLO11n-seg"), F.lit("names"), F.lit("{0: 'a', 4: 'b'}"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("model_id"), F.when(k == 0, meta).otherwise(empty).alias("metadata"),
        F.when(k == 1, F.create_map(*heads)).when(k == 2, F.create_map(*heads, F.lit("masks"), ints(1, 300, 8, 8))).otherwise(F.create_map(F.lit("output0"), ints(1, 84, 8400))).alias("output_shapes"),
        F.array(F.lit(1), F.lit(3), F.col("p_size") * 32, F.col("p_size") * 32).alias("input_shape"), F.when(F.col("p_partkey") % 3 == 0, "float16").otherwise("float32").alias("input_type"),
        F.when(k == 3, "PoseEstimation").alias("task"), F.when(k == 3, "V26").alias("version"), F.when(k == 3, "x, y\n\nz ").alias("names"),
    )


@query("""SELECT p_partkey AS model_id, CASE p_partkey % 4 WHEN 0 THEN 'Segmentation' WHEN 1 THEN 'ObjectDetection' WHEN 2 THEN 'Segmentation' ELSE 'PoseEstimation' END AS model_type, CASE p_partkey % 4 WHEN 0 THEN 'V11' WHEN 3 THEN 'V26' ELSE 'RFDETR' END AS model_version,
CASE WHEN p_partkey % 3 = 0 THEN 'Float16' ELSE 'Float' END AS data_type, CAST(3 * p_size * 32 * p_size * 32 AS BIGINT) AS input_size, CASE p_partkey % 4 WHEN 0 THEN 'a,b' WHEN 3 THEN 'x,y,z' ELSE 'background_class' || CASE WHEN p_size % 5 > 0 THEN ',' || array_to_string(list_transform(range(1, p_size % 5 + 1), lambda i: 'class_' || CAST(i AS VARCHAR)), ',') ELSE '' END END AS labels,
CASE p_partkey % 4 WHEN 0 THEN 'v8' WHEN 3 THEN 'v26' ELSE 'rfdetr' END AS decoder, true AS supported FROM part""")
def model_catalogue(spark, sf_dir):
    return catalog.describe(_models(spark, sf_dir)).withColumn("labels", F.array_join("labels", ","))


@query("""SELECT p_partkey AS model_id, 'modelType: ' || CASE p_partkey % 4 WHEN 1 THEN 'ObjectDetection' WHEN 3 THEN 'PoseEstimation' ELSE 'Segmentation' END || chr(10) || 'modelVersion: ' || CASE p_partkey % 4 WHEN 0 THEN 'V11' WHEN 3 THEN 'V26' ELSE 'RFDETR' END || chr(10) || 'modelDataType: ' || CASE WHEN p_partkey % 3 = 0 THEN 'Float16' ELSE 'Float' END
|| chr(10) || 'inputShapeSize: ' || CAST(3 * p_size * 32 * p_size * 32 AS VARCHAR) || chr(10) || 'labels: ' || CASE p_partkey % 4 WHEN 0 THEN '0:a, 1:b' WHEN 3 THEN '0:x, 1:y, 2:z' ELSE '0:background_class' || CASE WHEN p_size % 5 > 0 THEN ', ' || array_to_string(list_transform(range(1, p_size % 5 + 1), lambda i: CAST(i AS VARCHAR) || ':class_' || CAST(i AS VARCHAR)), ', ') ELSE '' END END AS report FROM part""")
def model_report(spark, sf_dir):
    return render.model_report(catalog.describe(_models(spark, sf_dir)))


_WRITTEN = ["#22C55E", "rgba(1, 2, 3, 0.5)", "rgb(4,5)", "fill: rgb(7,8,9)", "red", "#12", "rgb()", "(1,2)"]


@query(f"""SELECT event_id, CAST(list_extract([34, 1, 4, 7, 34, 34, 34, 34], k) AS DOUBLE) AS r, CAST(list_extract([197, 2, 5, 8, 197, 197, 197, 197], k) AS DOUBLE) AS g, CAST(list_extract([94, 3, 94, 9, 94, 94, 94, 94], k) AS DOUBLE) AS b, CAST(list_extract([255, 128, 255, 255, 128, 128, 128, 128], k) AS DOUBLE) AS a,
CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 256 WHEN event_id % 3 = 1 THEN least(floor(least(event_id % 200 / 100e0, 1e0) * 255 + 0.5e0), 255) ELSE 255 END AS BIGINT) AS opacity FROM (SELECT event_id, event_id % 8 + 1 AS k FROM events)""")
def colour_texts(spark, sf_dir):
    """Colours written in several ways, and the alpha that a result's share, or its boxes' own, gives."""
    text, k = F.get(F.array(*map(F.lit, _WRITTEN)), (F.col("event_id") % 8).cast("int")), F.col("event_id") % 3
    alpha = render.opacity(F.when(k == 1, F.col("event_id") % 200 / 100.0), F.when(k == 0, F.col("event_id") % 256))
    return table(spark, sf_dir, "events").select("event_id", render.parsed_colour(text).alias("c"), alpha.alias("opacity")).select("event_id", "c.*", "opacity")


# ---------------------------------------------------------------- streams in batch form

_MS = "epoch_us(ts) / 1000e0"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, {_MS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT user_id, k, t, 0e0 AS fps FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, o.t, CASE WHEN o.t - w.t <= 0 THEN w.fps WHEN w.fps = 0 THEN 1000e0 / (o.t - w.t) ELSE w.fps * 0.85e0 + 1000e0 / (o.t - w.t) * 0.15e0 END FROM walk w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, round(CASE WHEN arg_max(fps, k) > 0 THEN arg_max(fps, k) END, 6) AS fps FROM walk GROUP BY user_id""")
def fps_ema(spark, sf_dir):
    return frames.frame_rate(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").withColumn("fps", F.round("fps", 6))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, epoch_us(lead(ts) OVER w) / 1000e0 - epoch_us(ts) / 1000e0 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap IS NULL OR gap >= 600000")
def debounce_last(spark, sf_dir):
    return frames.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 600_000).select("user_id", "event_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_frame(spark, sf_dir):
    return frames.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1")
def newest_result(spark, sf_dir):
    return frames.newest_result(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id")


_INPUT = "CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN ' ' WHEN 2 THEN '-3' WHEN 3 THEN concat('0.', CAST(event_id % 97 AS {t})) WHEN 4 THEN '1e3' ELSE CAST(NULL AS {t}) END"


@query(f"WITH s AS (SELECT event_id, {_INPUT.format(t='VARCHAR')} AS x FROM events) SELECT event_id, CASE WHEN trim(x) = '' THEN 0e0 ELSE CASE WHEN TRY_CAST(trim(x) AS DOUBLE) IS NULL THEN 0.7e0 ELSE least(greatest(TRY_CAST(trim(x) AS DOUBLE), 0e0), 1e0) END END AS threshold FROM s")
def threshold_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", frames.threshold(F.expr(_INPUT.format(t="STRING")), 0.7).alias("threshold"))
