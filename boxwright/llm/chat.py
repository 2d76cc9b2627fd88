"""Multi-party chat formatting: the dialogue once for every participant, who speaks as the assistant.

A participant is a role other than system. In a participant's rendering its own turns are the assistant's
and are trained on (text and end mark); all others are named users; system turns come first as they are. The
turns of a conversation are ordered by (system first, turn, role, text). Roles and texts cannot forge the
marks: a MARK within them is broken by a zero-width joiner, and control characters in a role become spaces.

A rendering is written in rows of PART turns, so that a conversation of any length is spread over tasks. The
rows of a rendering, joined in the order of part, are the rendering: start is where a row's text begins in it,
and mask lists the trained code-point spans of the row's turns as start:end in it, comma-joined.

No conversation is gathered: turns are ranked by a range sort over all keys, whose partitions split a large
conversation, and a conversation's participants and places meet its turns by common.lookup.

Cases: a null role is a participant without a name (speaker is null), a null text is empty, a null turn comes
first, turns of null conv_id are one conversation. A conversation of system turns only has no rendering, nor
has an empty table. Repeated rows are repeated turns; equal rows are interchangeable, so ties do not matter.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.common import lookup, staged

PART = 64
#: Rows of a rendering whose starts are added up in one group.
RUN = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(c):
    return F.replace(c, F.lit("<|"), F.lit("<\u200d|"))


def _ranked(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, who (a key of the conversation), seq (the turn's rank in it) and speakers."""
    t = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("who"), (~F.col("role").eqNullSafe("system")).alias("late"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    keys = ["who", "late", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text", "tie"]
    ordered = t.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(ordered.select("conv_id", "who", "role", "text", F.monotonically_increasing_id().alias("at")).withColumn("task", F.shiftright("at", 33)), "turns")
    runs = placed.groupBy("who", "task").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.collect_set(F.when(~F.col("role").eqNullSafe("system"), F.struct("role"))).alias("people"))
    each = runs.groupBy("who").agg(F.sum("n").alias("n"), F.collect_list(F.struct("task", "low", "n")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("people"))).alias("speakers"))
    met = lookup(placed, each, "who", "n", placed.count(), "inner")
    before = "aggregate(runs, 0L, (a, r) -> a + if(r.task < task, r.n, if(r.task = task, at - r.low, 0L)))"
    return met.select("conv_id", "who", "role", "text", F.expr(before).alias("seq"), "speakers")


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, who, seq, role, speaker, segment, trained_from: each turn once for each participant; trained_from is null for other turns than the speaker's."""
    t = _ranked(turns).withColumn("speaker", F.explode("speakers")).withColumn("speaker", F.col("speaker.role"))
    own = F.col("role").eqNullSafe(F.col("speaker"))
    name = F.concat(F.lit("user name="), _safe(F.regexp_replace("role", r"[\p{Cc}\x{2028}\x{2029}]", " ")))
    head = F.when(F.col("role") == "system", "system").when(own, "assistant").when(F.col("role").isNull(), "user").otherwise(name)
    opening = F.concat(F.lit(OPEN), head, F.lit("\n"))
    return t.select("conv_id", "who", "seq", "role", "speaker", F.concat(opening, _safe(F.col("text")), F.lit(CLOSE + "\n")).alias("segment"), F.when(own, F.length(opening)).alias("trained_from"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, part, start, n_turns, text, mask."""
    # the speaker as a key, which tells a null from any name
    rows = rotate(turns).withColumn("as", F.coalesce(F.concat(F.lit("="), "speaker"), F.lit(""))).withColumn("part", (F.col("seq") / PART).cast("long"))
    grouped = rows.groupBy("who", "as", "part").agg(F.first("conv_id").alias("conv_id"), F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(F.struct("seq", "segment", "trained_from"))).alias("rows"))
    # spans end before the line end that follows the closing mark
    spans = "aggregate(rows, struct(0L as at, cast(array() as array<struct<a: bigint, b: bigint>>) as spans), (x, r) -> struct(x.at + length(r.segment) as at, if(r.trained_from is null, x.spans, array_append(x.spans, struct(x.at + r.trained_from as a, x.at + length(r.segment) - 1 as b))) as spans), x -> x.spans)"
    parts = staged(grouped.select("who", "as", "part", "conv_id", "speaker", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("text"), F.expr(spans).alias("spans")), "parts")

    # where the parts after the first begin: sums within runs of parts, and of runs
    sizes = parts.select("who", "as", "part", (F.col("part") / RUN).cast("long").alias("run"), F.length("text").cast("long").alias("n"))
    long = sizes.join(sizes.filter("part = 1").select("who", "as"), ["who", "as"], "left_semi")
    inner = long.withColumn("before", F.sum("n").over(Window.partitionBy("who", "as", "run").orderBy("part")) - F.col("n"))
    runs = long.groupBy("who", "as", "run").agg(F.sum("n").alias("m"))
    base = runs.select("who", "as", "run", (F.sum("m").over(Window.partitionBy("who", "as").orderBy("run")) - F.col("m")).alias("base"))
    starts = inner.filter("part > 0").join(base, ["who", "as", "run"]).select("who", "as", "part", (F.col("before") + F.col("base")).alias("start"))
    later = parts.filter("part > 0").join(starts, ["who", "as", "part"])
    every = parts.filter("part = 0").withColumn("start", F.lit(0).cast("long")).unionByName(later)
    mask = F.expr("array_join(transform(spans, s -> concat(s.a + start, ':', s.b + start)), ',')")
    return every.select("conv_id", "speaker", "part", "start", "n_turns", "text", mask.alias("mask"))
