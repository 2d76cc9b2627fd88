"""What a drawing needs, as rows: rectangles, polygons, lines, points, colours and texts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions import geometry as g

# Default colours in order, the colour (r, g, b, a) of unreadable texts, and default skeleton lines between key points.
UNREADABLE = (34, 197, 94, 128)
COLOURS = ["#22c55e", "#3b82f6", "#f97316", "#e11d48", "#8b5cf6", "#14b8a6", "#f59e0b", "#06b6d4"]
SKELETON = [(5, 7), (7, 9), (6, 8), (8, 10), (5, 6), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16), (0, 1), (0, 2), (1, 3), (2, 4)]
LEAST_POINT = 0.25


def colour(label_index: Column, palette: list[str] | None = None) -> Column:
    palette = COLOURS if palette is None else palette
    found = F.get(F.array(*map(F.lit, palette)), (label_index % len(palette)).cast("int")) if palette else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(COLOURS[0]))


def channels(hex_colour: Column, alpha: Column) -> Column:
    """r, g, b (0..255) and a (0..1, from alpha in 0..255) of #rrggbb; null for another text."""
    part = lambda at: F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("int")
    whole = F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"), (g.clamp(alpha, 0, 255) / 255.0).alias("a"))
    return F.when(hex_colour.rlike("^#[0-9A-Fa-f]{6}$"), whole)


def parsed_colour(text: Column) -> Column:
    """r, g, b and a (0..255) of #rrggbb, rgb(...) or rgba(...); UNREADABLE for anything else."""
    # a word that ends in rgb or rgba, then numbers in brackets
    word, open_ = F.substring_index(text, "(", 1), F.instr(text, "(")
    rest = F.substring(text, open_ + 1, F.length(text))
    inner = F.substring_index(rest, ")", 1)
    listed = (open_ > 0) & (word.endswith("rgb") | word.endswith("rgba")) & rest.contains(")") & (inner != "")
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    at = lambda k, default: F.coalesce(F.get(parts, F.lit(k)), F.lit(float(default)))
    own = channels(text, F.lit(255))
    struct = lambda r, gr, b, a: F.struct(*(c.cast("double").alias(n) for c, n in ((r, "r"), (gr, "g"), (b, "b"), (a, "a"))))
    written = struct(*(at(k, UNREADABLE[k]) for k in range(3)), g.half_up(at(3, 1) * 255))
    return F.when(own.isNotNull(), struct(own["r"], own["g"], own["b"], F.lit(255))).when(listed, written).otherwise(struct(*map(F.lit, UNREADABLE)))


def opacity(result: Column, boxes: Column) -> Column:
    """Alpha in 0..255: a share of 1 for the whole result wins over the boxes' own alpha; else opaque."""
    return F.coalesce(g.half_up(g.clamp(result, 0.0, 1.0) * 255), boxes, F.lit(255)).cast("long")


def fixed(value: Column, digits: int) -> Column:
    """value as C's printf writes it with digits decimals: the nearest to the exact value, of two equally near the even one; 'null' for null.

    Java's formatter rounds the shortest decimal text of a double instead, and halves away from 0.
    """
    v = value.cast("double")
    size = F.abs(v)
    minus = F.when((v < 0) | (v == 0) & v.cast("string").startswith("-"), "-").otherwise("")
    if digits:
        floor = F.floor(size)
        part, scale = size - floor, 10.0**digits
        # the product, and what rounding left out of it: exact, as high has the upper 26 bits of part
        p = part * scale
        split = part * 134217729.0
        high = split - (split - part)
        off = (high * scale - p) + (part - high) * scale
        n = F.when((p - F.floor(p) != 0.5) | (off == 0), F.rint(p)).otherwise(F.floor(p) + (off > 0).cast("int"))
        text = (floor.cast("decimal(19,0)") + n.cast(f"decimal({digits + 1},0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string")
    else:
        text = F.rint(size).cast("long").cast("string")
    text = F.when(size == float("inf"), "inf").when(size < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", size))
    return F.when(v.isNull(), "null").when(F.isnan(v), "nan").otherwise(F.concat(minus, text))


def percent(confidence: Column) -> Column:
    return F.concat(fixed(confidence * 100, 1), F.lit("%"))


def caption(name: Column, confidence: Column, bracketed: bool = False) -> Column:
    return F.concat(name, F.lit(" ("), percent(confidence), F.lit(")")) if bracketed else F.concat(name, F.lit(" "), percent(confidence))


def font_size(font: Column) -> Column:
    """Pixels of a font text such as 'bold 18px serif': the first number that px follows; 14 without any."""
    pieces = F.split(font, "px")
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.regexp_extract(x, "[0-9]+([.][0-9]+)?$", 0).try_cast("double"))
    return F.coalesce(F.get(F.filter(sizes, lambda x: x.isNotNull()), F.lit(0)), F.lit(14.0))


def margin(size: Column) -> Column:
    return F.greatest(F.lit(4), g.half_up(size / 3))


def rectangles(detections: DataFrame, font: float = 14.0) -> DataFrame:
    """image_id, rank, box, colour, text and where the text stands; boxes without an area are not drawn."""
    b = F.col("box")
    shown = detections.filter(g.drawable(b))
    return shown.select("image_id", "rank", "box", colour(F.col("label_index")).alias("colour"), caption(F.col("label"), F.col("confidence")).alias("caption"), b["left"].alias("caption_x"), F.greatest(F.lit(0.0), b["top"] - font).alias("caption_y"))


def text_lines(classes: DataFrame, line_height: float = 20.0, x: float = 10.0) -> DataFrame:
    """Classifications as lines one below another."""
    return classes.select("image_id", "rank", caption(F.col("label"), F.col("confidence"), True).alias("caption"), F.lit(x).alias("caption_x"), (F.col("rank") * line_height).alias("caption_y"))


def polygons(detections: DataFrame) -> DataFrame:
    """Rotated boxes as four corners, the text at corner 2."""
    c = g.corners(F.col("box"), F.col("angle"))
    return detections.filter(g.drawable(F.col("box"))).select("image_id", "rank", c.alias("corners"), colour(F.col("label_index")).alias("colour"), caption(F.col("label"), F.col("confidence")).alias("caption"), F.get(c, F.lit(1)).alias("caption_at"))


def points(poses: DataFrame, least: float = LEAST_POINT) -> DataFrame:
    """image_id, rank, point, x, y, confidence of the key points that are sure enough."""
    return poses.select("image_id", "rank", F.posexplode("key_points").alias("point", "p")).filter(F.col("p.confidence") >= least).select("image_id", "rank", F.col("point").cast("long").alias("point"), "p.x", "p.y", "p.confidence")


def skeleton(poses: DataFrame, least: float = LEAST_POINT, lines: list[tuple[int, int]] | None = None) -> DataFrame:
    """Lines between key points that are both there and sure enough; within the row, without a join."""
    edges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (SKELETON if lines is None else lines)))
    ends = F.transform(edges, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.get(F.col("key_points"), e["a"]).alias("p"), F.get(F.col("key_points"), e["b"]).alias("q")))
    both = F.filter(ends, lambda e: (e["p"]["confidence"] >= least) & (e["q"]["confidence"] >= least))
    found = poses.select("image_id", "rank", F.explode(both).alias("e"))
    return found.select("image_id", "rank", F.col("e.a").cast("long").alias("a"), F.col("e.b").cast("long").alias("b"), F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def polylines(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """points (x, y) with line: a new one starts where x or y is more than 1 off the point before."""
    w = Window.partitionBy(*keys).orderBy(order)
    apart = (F.abs(F.col("x") - F.lag("x").over(w)) > 1) | (F.abs(F.col("y") - F.lag("y").over(w)) > 1)
    return points.withColumn("__new", F.coalesce(apart.cast("long"), F.lit(0))).withColumn("line", F.sum("__new").over(w)).drop("__new")


def mask_pixels(segments: DataFrame, alpha: int = 64) -> DataFrame:
    """image_id, rank, x, y, r, g, b, a of every set pixel of every mask (binary); empty bytes are passed over."""
    b, k = F.col("box"), F.col("__k")
    width, height = (b["right"] - b["left"]).cast("int"), (b["bottom"] - b["top"]).cast("int")
    sized = segments.filter((width > 0) & (height > 0) & (F.length("mask") > 0))
    c = channels(colour(F.col("label_index")), F.lit(alpha))
    sized = sized.select("image_id", "rank", b["left"].alias("__left"), b["top"].alias("__top"), width.alias("__width"), (width * height).alias("__size"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), "mask")
    # eight bytes at a time as a long, the first byte highest; pixel k of a word is bit 56 - k + 2 * (k % 8) of it
    each = sized.withColumn("__at", F.explode(F.sequence(F.lit(0), F.length("mask") - 1, F.lit(8))))
    word = F.conv(F.rpad(F.hex(F.substring("mask", F.col("__at") + 1, F.lit(8))), 16, "0"), 16, -10).cast("long")
    each = each.withColumn("__word", word).drop("mask").filter("__word <> 0")
    on = each.withColumn("__k", F.explode(F.array(*map(F.lit, range(64))))).filter(F.getbit("__word", 56 - k + k % 8 * 2) == 1)
    on = on.withColumn("__pixel", F.col("__at") * 8 + k).filter("__pixel < __size")
    row = F.expr("__pixel div __width")
    return on.select("image_id", "rank", (F.col("__left") + F.col("__pixel") % F.col("__width")).alias("x"), (F.col("__top") + row).alias("y"), "r", "g", "b", F.lit(alpha).alias("a"))


def mask_edges(segments: DataFrame, thickness: int = 2) -> DataFrame:
    """image_id, rank, left, top, right, bottom, colour: a square of thickness around every point of edge_points."""
    p, off = F.col("p"), (thickness - 1) // 2
    each = segments.select("image_id", "rank", colour(F.col("label_index")).alias("colour"), F.explode("edge_points").alias("p"))
    return each.select("image_id", "rank", (p["x"] - off).alias("left"), (p["y"] - off).alias("top"), (p["x"] - off + thickness).alias("right"), (p["y"] - off + thickness).alias("bottom"), "colour")


def segment_layers(segments: DataFrame, mask: bool = True, contour: bool = True, boxes: bool = True, label: bool = True, alpha: int = 64, thickness: int = 2) -> DataFrame:
    """The layers of a drawing of segments: image_id, layer (in drawing order), rank, kind, left, top, right, bottom, colour, alpha, caption.

    Masks are pixels, contours squares, boxes rectangles; boxes are drawn unless both boxes and label are off.
    """
    one = lambda k, kind, df, a, caption: df.select("image_id", F.lit(k).alias("layer"), "rank", F.lit(kind).alias("kind"), *(F.col(s).cast("double").alias(s) for s in ("left", "top", "right", "bottom")), "colour", F.lit(a).alias("alpha"), caption.cast("string").alias("caption"))
    none, out = F.lit(None), []
    if mask:
        pixels = mask_pixels(segments, alpha)
        out.append(one(0, "mask", pixels.select("image_id", "rank", F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + 1).alias("right"), (F.col("y") + 1).alias("bottom"), F.lower(F.format_string("#%02x%02x%02x", "r", "g", "b")).alias("colour")), alpha, none))
    if contour:
        out.append(one(1, "contour", mask_edges(segments, thickness), 255, none))
    if boxes or label:
        out.append(one(2, "box", rectangles(segments).select("*", "box.*"), 255, F.col("caption")))
    layers = out[0] if out else one(0, "mask", rectangles(segments).select("*", "box.*").limit(0), 0, none)
    for x in out[1:]:
        layers = layers.unionByName(x)
    return layers


def shows_boxes(draw_boxes: Column, draw_label: Column) -> Column:
    """Masks and poses get boxes unless both boxes and labels are off."""
    return draw_boxes | draw_label


def report(detections: DataFrame, task: str, detail: Column | None = None) -> DataFrame:
    """image_id, report: one text for each image; detail: what stands between confidence and box."""
    side = lambda s: fixed(F.col(f"box.{s}"), 0)
    parts = [F.concat((F.col("rank") + 1).cast("string"), F.lit(". "), F.col("label")), F.concat(F.lit("confidence="), fixed(F.col("confidence"), 6))]
    parts += [detail] if detail is not None else []
    parts.append(F.concat(F.lit("box=["), F.concat_ws(", ", *map(side, ("left", "top", "right", "bottom"))), F.lit("]")))
    line = detections.select("image_id", "rank", F.concat_ws(" ", *parts).alias("line"))
    lines = line.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lines.select("image_id", F.concat_ws("\n", F.lit(f"modelType: {task}"), F.concat(F.lit("count: "), F.size("l")), F.transform("l", lambda x: x["line"])).alias("report"))


def class_report(classes: DataFrame) -> DataFrame:
    line = classes.select("image_id", "rank", F.concat(F.format_string("%d. %s confidence=", F.col("rank"), F.col("label")), fixed(F.col("confidence"), 6)).alias("line"))
    lines = line.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lines.select("image_id", F.concat_ws("\n", F.lit("modelType: Classification"), F.concat(F.lit("count: "), F.size("l")), F.transform("l", lambda x: x["line"])).alias("report"))


def model_report(models: DataFrame) -> DataFrame:
    """model_id, report: task, version, type, input size and the first ten labels."""
    shown = F.array_join(F.transform(F.slice("labels", 1, 10), lambda x, i: F.concat(i.cast("string"), F.lit(":"), x)), ", ")
    more = F.when(F.size("labels") > 10, "...").otherwise("")
    parts = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (("modelType", "model_type"), ("modelVersion", "model_version"), ("modelDataType", "data_type"), ("inputShapeSize", "input_size"))]
    return models.select("model_id", F.concat_ws("\n", *parts, F.concat(F.lit("labels: "), shown, more)).alias("report"))
